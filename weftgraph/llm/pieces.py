"""SentencePiece encoding and decoding that keeps offsets.

A text is normalised by the longest prefix that the model's compiled character map has at each place; every
normalised byte records the source byte it came from, so that each piece is projected to the bytes of the
original text. Pieces are then found between word boundaries: with white space as a prefix and no vocabulary
entry that has a space after another character, no merge crosses a boundary, so the ids of a text are those
of its words, which recur and are remembered. Models for which that doesn't hold are encoded text by text.

Cases: null and empty texts have no ids and decode to an empty text; very long texts are handled whole; an
empty table gives no rows; a null doc_id stays null; other columns than doc_id and text are ignored. Of a
character that falls to several byte pieces each piece has its own byte.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.cache import Memo
from weftgraph.llm.units import Flat, encode_units, rounds

SPACE = "▁"
_MARK = SPACE.encode()


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 bytes, then the replacements, each ending in a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]
        #: bytes that something in the map begins with
        self.heads = np.array([self._begins(c) for c in range(256)], dtype=bool)

    def _begins(self, c: int) -> bool:
        if not self.units:
            return False
        node = self._offset(self.units[0]) ^ c
        return node < len(self.units) and (self.units[node] & 0x800000FF) == c

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of data[at:] in the trie, and what it becomes."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            if node >= len(units) or (units[node] & 0x800000FF) != c:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.texts[value : self.texts.index(0, value)])
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Pieces:
    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        model = pb.ModelProto.FromString(proto)
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.plain = not self.map.units and self.prefix and not self.squeeze and self.escape
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces)
        user = any(p.type == 4 for p in model.pieces)
        self.by_word = self.plain and not inner and self.sp.piece_to_id(SPACE) != self.sp.unk_id() and not user and model.trainer_spec.model_type == 2 and model.trainer_spec.byte_fallback
        # bytes of each piece in the normalised text
        self.wide = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in model.pieces], dtype=np.int64)
        self.memo = Memo(self._word, 150_000)

    def _word(self, unit: bytes) -> bytes:
        # the library puts a mark before a text, but not before an empty one
        return np.array(self.sp.encode(unit.decode()) if unit else [self.sp.piece_to_id(SPACE)], dtype="<u4").tobytes()

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and their end, the place in the source it came from."""
        out, source = bytearray(), []
        mark = SPACE.encode() if self.escape else b" "
        raw = np.frombuffer(text, np.uint8)
        if len(raw) and not self.squeeze and not self.map.heads[raw].any():  # the map changes nothing: only spaces become marks
            wide = np.where(raw == 32, len(mark), 1)
            lead = len(mark) if self.prefix else 0
            return mark * self.prefix + text.replace(b" ", mark), np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(raw)), wide), [len(raw)]])

        def put(piece: bytes, at: int):
            out.extend(piece)
            source.extend([at] * len(piece))

        i, n = 0, len(text)
        parts = []
        while i < n:
            hit = self.map.longest(text, i)
            if hit:
                size, piece = hit
            else:
                size = 1
                while i + size < n and text[i + size] & 0xC0 == 0x80:
                    size += 1
                piece = text[i : i + size]
            parts.append((i, piece))
            i += size
        if self.squeeze:
            while parts and not parts[0][1].strip(b" "):
                parts.pop(0)
        if not parts:
            return b"", np.zeros(1, dtype=np.int64)
        if self.prefix:
            put(mark, parts[0][0])
        spaced = self.squeeze
        for at, piece in parts:
            if self.squeeze and spaced:
                piece = piece.lstrip(b" ")
            put(piece.replace(b" ", mark), at)
            spaced = piece.endswith(b" ") if piece else spaced
        if self.squeeze:
            while out.endswith(mark):
                del out[-len(mark) :]
                n = source[-1]
                del source[-len(mark) :]
        source.append(n)
        return bytes(out), np.array(source, dtype=np.int64)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text: ids, and n + 1 places; piece i has the source bytes place[i]:place[i + 1].

        Every text goes through the character map first; its alignment gives the places. Texts that the map leaves as they are, but for marks, are encoded word by word.
        """
        normal = [self.normalise(t) for t in texts]
        mark = _MARK if self.escape else b" "
        same = [self.by_word and b"\0" not in t and _MARK not in t and out == (mark + t.replace(b" ", mark) if t else b"") for t, (out, _) in zip(texts, normal, strict=True)]
        flat = self._by_word([t if ok else b"" for t, ok in zip(texts, same, strict=True)])
        out = []
        for i, (t, ok) in enumerate(zip(texts, same, strict=True)):
            ids = flat.of(i).view(np.int32) if ok else np.array(self.sp.encode(t.decode()), dtype=np.int32)
            out.append((ids, self._places(ids, normal[i][1])))
        return out

    def _by_word(self, texts: list[bytes]) -> Flat:
        """Units: a run of spaces and what follows, without its first space; a text's first unit is as it stands."""
        data = b"".join(texts)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin = np.cumsum(size) - size
        space = np.frombuffer(data, dtype=np.uint8) == 32
        edge = space & ~np.append(False, space[:-1])[: len(space)]
        heads = begin[size > 0]
        edge[heads] = True
        # a text that begins with spaces: its run belongs to its first unit, even after a text that ends in one
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        head = np.zeros(len(data) + 1, dtype=bool)
        head[heads] = True
        inner = ~head[starts]
        return encode_units(data, starts + inner, ends, np.searchsorted(starts, np.append(begin, len(data))), self.memo.__getitem__)

    def _places(self, ids: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Pieces stand one after another in the normalised text; source tells where each of its bytes came from."""
        place = np.zeros(len(ids) + 1, dtype=np.int64)
        if len(ids):
            place[0] = source[0]
            place[1:] = source[np.minimum(np.cumsum(self.wide[ids]), len(source) - 1)]
            place[-1] = source[-1]
        return place

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist()) if len(ids) else ""


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


FIELDS = [("doc_id", "long"), ("ids", "array<int>"), ("begin", "array<long>"), ("end", "array<long>"), ("decoded", "string")]


def _full(doc, ids, place, decoded):
    return doc, ids.tolist(), place[:-1].tolist(), place[1:].tolist(), decoded


def encode(docs: DataFrame, model: str | None = None, row=_full, fields=FIELDS) -> DataFrame:
    """Of each row: ids, the source bytes begin:end of each piece, and what decode(ids) gives. `row` picks what leaves the task."""
    path = model or default_model()
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}

    def run(batches):
        p = pieces(path)
        for docs_, texts in rounds(batches):
            out = [row(doc, ids, place, p.decode(ids)) for doc, (ids, place) in zip(docs_, p.encode(texts), strict=True)]
            cols = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields))


def decimals(ids: np.ndarray) -> bytes:
    """Ids in decimal, joined by commas."""
    if not len(ids):
        return b""
    width = len(str(int(ids.max())))
    digits = np.empty((len(ids), width + 1), dtype=np.uint8)
    rest, show = ids.astype(np.int32), np.zeros((len(ids), width + 1), dtype=bool)
    for k in range(width - 1, -1, -1):
        digits[:, k] = rest % 10 + 48
        show[:, k] = (rest > 0) | (k == width - 1)
        rest = rest // 10
    digits[:, width], show[:, width] = 44, True
    return digits[show].tobytes()[:-1]


DIGEST_FIELDS = [("doc_id", "long"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("spans_sha256", "string")]


def digest(doc, ids, place, decoded):
    from hashlib import sha256

    return doc, len(ids), sha256(decimals(ids)).hexdigest(), sha256(decoded.encode()).hexdigest(), sha256(place.astype("<i8").tobytes()).hexdigest()
