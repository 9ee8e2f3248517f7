"""Vector bin packing of tokenised examples under simultaneous limits.

An example demands a vector: tokens, one segment, loss-bearing tokens. A bin (training sequence) has a limit
for each. The dot-product heuristic fills one bin at a time: of the waiting examples that fit in every
dimension, the one with the largest dot product of its demand and the bin's rest, both as shares of the
limits, goes in. Whole multiples of the token limit are cut off an example first; where nothing that waits
fits as a whole, an example is cut to fill the bin, so at most one sequence of a task is padded.

Loss-bearing are the ids that begin at or after `loss_from` characters of the text (0: all; null: none), so prompts of
instruction data take tokens and a segment but no loss; the end token bears none. With max_loss under max_tokens the
third limit binds: a bin whose loss is full goes on with prompts and loss-free pieces alone.

Each task packs its own partition: no shuffle, a pool of at most POOL waiting examples, and the same output
if a lost executor's task is run again. sequence_id is partition << 33 | number.

Cases: null and empty texts are their end token alone; very long texts become many pieces; repeated rows are
packed as often as they occur; a null doc_id is kept as null; an empty table gives no rows; other columns than
doc_id, text (and the column named by loss_from, if one is) are ignored.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.cache import Memo, give_back
from weftgraph.llm.units import encode_units, rounds

POOL = 2048
END = "<|endoftext|>"


class ByteBpe:
    """Ids of a byte-level BPE file (tokenizers' JSON), by pieces of text between spaces.

    Such a tokenizer first splits a text; a split always falls before a space that a character other than
    white space follows. So a text's ids are those of its units, which recur; each is merged once a batch, by
    the same vocabulary as ranks. Texts with the special token's string go to the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word != END}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranks = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.wide = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for word, i in vocab.items():
            self.wide[i] = len(word)  # a letter of the file's alphabet is a byte
        self.memo = Memo(lambda unit: np.array(self.ranks.encode_ordinary(unit.decode()), dtype="<u4").tobytes(), 150_000)

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        data = b"".join(texts)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin = np.cumsum(size) - size
        raw = np.frombuffer(data + b" ", dtype=np.uint8)
        edge = np.zeros(len(raw), dtype=bool)
        edge[:-1] = (raw[:-1] == 32) & _OPENS[raw[1:]]
        edge[begin] = True  # where a text is empty, the next one begins there too
        edge[len(data)] = False
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        flat = encode_units(data, starts, ends, np.searchsorted(starts, np.append(begin, len(data))), self.memo.__getitem__)
        special = END.encode()
        return [
            np.array(self.whole.encode(t.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes() if special in t else flat.of(i).tobytes()
            for i, t in enumerate(texts)
        ]


    def ids_before(self, text: bytes, ids: bytes, chars: int) -> int:
        """How many of a text's ids begin before so many of its characters."""
        at = len(text.decode()[:chars].encode())
        own = np.frombuffer(ids, dtype="<u4")
        begin = np.cumsum(self.wide[own]) - self.wide[own]
        return int(np.searchsorted(begin, at))


#: Bytes that may follow a space where a unit begins: none that are, or may begin, white space.
_OPENS = np.array([not (b <= 32 or b in (0xC2, 0xE1, 0xE2, 0xE3)) for b in range(256)])


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def lossy(start: int, n: int, loss_from: int, loss_to: int) -> int:
    """How many of the ids start:start + n lie in loss_from:loss_to."""
    return max(0, min(start + n, loss_to) - max(start, loss_from))


class Packer:
    """Waiting examples as rows of a demand matrix; emits (example, start, length, sequence, offset, segment)."""

    def __init__(self, limits: tuple[int, int, int], first: int):
        self.limits = np.array(limits, dtype=np.float64)
        self.sequence = first
        self.waiting: list[tuple[object, int, int, int, int]] = []  # example, start, tokens, where its loss begins and ends
        self.open()

    def open(self):
        self.rest = self.limits.copy()
        self.placed: list[tuple] = []

    def close(self):
        out = [(e, start, n, self.sequence, at) for e, start, n, at in self.placed]
        self.sequence += bool(out)
        self.open()
        return out

    def add(self, example, tokens: int, loss_from: int, loss_to: int):
        """Pieces of the whole token limit go out at once, if the loss limit lets them; the rest waits. Ids loss_from:loss_to bear loss."""
        size, start = int(self.limits[0]), 0
        while tokens - start > 0:
            n = min(size, tokens - start)
            while (over := lossy(start, n, loss_from, loss_to) - int(self.limits[2])) > 0:
                n -= over
            if n == size:
                yield (example, start, n, self.sequence, 0)
                self.sequence += 1
            else:
                self.waiting.append((example, start, n, loss_from, loss_to))
            start += n

    def drain(self, keep: int):
        """Fill bins until at most `keep` examples wait."""
        if len(self.waiting) <= keep:
            return
        demand = np.array([(n, 1, lossy(start, n, a, b)) for _, start, n, a, b in self.waiting], dtype=np.float64)
        alive = np.ones(len(demand), dtype=bool)
        left = len(demand)
        while left > keep or (keep == 0 and left):
            live = np.flatnonzero(alive)
            d = demand[live]
            fits = (d <= self.rest).all(axis=1)
            if fits.any():
                own = live[fits]
                i = own[np.argmax((demand[own] / self.limits) @ (self.rest / self.limits))]
                self._place(self.waiting[i])
                alive[i] = False
                left -= 1
            elif self.rest[1] < 1 or self.rest[0] < 1 or self.rest[2] < 1 and (d[:, 2] > 0).all():
                yield from self.close()
            else:
                # cut the largest example where the bin is full of tokens or of loss
                i = live[np.argmax(d[:, 0])]
                example, start, n, a, b = self.waiting[i]
                take = int(min(self.rest[0], n - 1))
                if lossy(start, take, a, b) > self.rest[2]:
                    take = max(a - start, 0) + int(self.rest[2])
                if take < 1:
                    yield from self.close()
                    continue
                self._place((example, start, take, a, b))
                self.waiting[i] = (example, start + take, n - take, a, b)
                demand[i] = (n - take, 1, lossy(start + take, n - take, a, b))
            if self.rest[0] < 1:
                yield from self.close()
        self.waiting = [w for w, a in zip(self.waiting, alive.tolist(), strict=True) if a]

    def _place(self, w):
        example, start, n, a, b = w
        self.placed.append((example, start, n, int(self.limits[0] - self.rest[0])))
        self.rest -= (n, 1, lossy(start, n, a, b))


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str | None = None, max_tokens: int = 1024, max_segments: int = 256, max_loss: int | None = None, end_id: int = 0, sink=None, schema: str = SCHEMA, loss_from: str | None = None) -> DataFrame:
    """Pieces of all documents with their ids, sequences and offsets.

    max_loss defaults to max_tokens; loss_from names a column of character places, or none for 0 everywhere. sink turns
    the seven columns into others inside the task (for digests, so that ids need not leave it).
    """
    path = tokenizer or default_tokenizer()
    limits = (max_tokens, max_segments, max_tokens if max_loss is None else max_loss)
    if min(limits) < 1:
        raise ValueError("limits have to be one or more")
    end = np.array([end_id], dtype="<u4").tobytes()
    finish = sink or (lambda cols: cols)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def batch(rows):
        cols = [[] for _ in range(7)]
        for (doc, ids, total), start, n, seq, at in rows:
            for c, v in zip(cols, (doc, start, n, ids[4 * start : 4 * (start + n)], total, seq, at), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(finish(cols), types, strict=True)], names=names)

    def packed(batches):
        bpe = byte_bpe(path)
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        out = []
        for keys, texts in rounds(batches):
            for key, text, ids in zip(keys, texts, bpe.encode(texts), strict=True):
                doc, begin = (key["d"], key["b"]) if loss_from else (key, 0)
                scored = len(ids) // 4
                first = scored if begin is None else bpe.ids_before(text, ids, begin) if begin > 0 else 0
                ids += end
                n = scored + 1
                out += packer.add((doc, ids, n), n, first, scored)
                if len(packer.waiting) >= POOL:
                    out += packer.drain(POOL // 2)
                if len(out) >= 2000:
                    yield batch(out)
                    out = []
        out += packer.drain(0)
        out += packer.close()
        yield batch(out)

    def run(batches):
        yield from packed(batches)
        give_back()

    doc = F.col("doc_id").cast("long")
    key = F.struct(doc.alias("d"), F.col(loss_from).cast("long").alias("b")) if loss_from else doc
    return docs.select(key.alias("key"), F.col("text").cast("string")).mapInArrow(run, schema)


def with_checksums(cols: list[list]) -> list[list]:
    import zlib

    doc, start, n, ids, total, seq, at = cols
    return [doc, start, n, [zlib.crc32(i) for i in ids], total, seq, at]


CHECKSUMS = SCHEMA.replace("ids binary", "ids_crc32 long")
