"""Vectorised words over batches of texts: runs of bytes other than \\x20 and \\x09-\\x0D."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken together up to so many bytes; a longer text is a batch of its own.
CHUNK_BYTES = 1 << 20

_SPACES = bytes([32, 9, 10, 11, 12, 13])
_UPPER = bytes(range(65, 91))
TO_SPACE = bytes.maketrans(_SPACES, b" " * 6)
TO_LOWER_SPACE = bytes.maketrans(_SPACES + _UPPER, b" " * 6 + _UPPER.lower())


def text_chunks(batches: Iterable[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes | None]]]:
    """(doc_ids, texts as UTF-8 or None) for columns 0 and 1 of the batches, some rows at a time."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        at, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t or b"")
            if held >= size or i + 1 == len(texts):
                yield ids[at : i + 1], texts[at : i + 1]
                at, held = i + 1, 0


class Words:
    """All words of some texts, one after another.

    buf: bytes, each run of white space as one space; starts, ends: of each word in buf; first: the number of
    the first word of each text, with the total at the end.
    """

    def __init__(self, texts: list[bytes | None], table: bytes = TO_SPACE):
        data = b" " + b" ".join(t or b"" for t in texts).translate(table) + b" "
        raw = np.frombuffer(data, dtype=np.uint8)
        sizes = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        begin = np.concatenate([[1], 1 + np.cumsum(sizes)])
        space = raw == 32
        self.first = np.searchsorted(np.flatnonzero(space[:-1] & ~space[1:]) + 1, begin)
        twice = space[1:] & space[:-1]
        if twice.any():
            raw, space = raw[np.concatenate([[True], ~twice])], space[np.concatenate([[True], ~twice])]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.buf, self.starts, self.ends = raw, edge[0::2], edge[1::2]

    def __len__(self) -> int:
        return len(self.starts)


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, CHUNK_BYTES // 4)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, _u(b))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if size > 8 * CHUNK_BYTES:
            return tuple(both)
        _powers[base] = tuple(both)
    return _powers[base]


def mix(h: np.ndarray, add: int = 0) -> np.ndarray:
    h = h + _u(add)
    h = (h ^ (h >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _u(27))) * _u(0x94D049BB133111EB)
    return h ^ (h >> _u(31))


class RangeHash:
    """64-bit hash of any run of items in constant time, from prefix sums of a polynomial.

    Items have to be hashes themselves: over small values such as bytes, texts of some regular patterns collide for any base.
    """

    def __init__(self, items: np.ndarray, base: int):
        up, self.down = _power(base, len(items) + 1)
        self.sums = np.zeros(len(items) + 1, dtype=np.uint64)
        np.cumsum(items * up[: len(items)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


_P1, _P2, _P3, _P4, _P5 = (_u(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _u(r)) | (x >> _u(64 - r))


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of buf; slices of one length are hashed together, column by column."""
    out = np.empty(len(starts), dtype=np.uint64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    long = np.ndarray(len(padded) - 7, dtype="<u8", buffer=padded, strides=(1,))
    mid = np.ndarray(len(padded) - 7, dtype="<u4", buffer=padded, strides=(1,))
    sizes = ends - starts
    order = np.argsort(sizes.astype(np.uint16) if len(sizes) and sizes.max() < 65536 else sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    with np.errstate(over="ignore"):
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = order[a:b]
            size, at = int(sizes[rows[0]]), starts[rows]

            def lane(acc, k, at=at):
                return _rot(acc + long[at + k] * _P2, 31) * _P1

            done = 0
            if size >= 32:
                acc = [np.full(len(rows), _u(seed + s)) for s in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
                while done + 32 <= size:
                    acc = [lane(v, done + 8 * i) for i, v in enumerate(acc)]
                    done += 32
                h = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
                for v in acc:
                    h = (h ^ (_rot(v * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(rows), _u(seed + int(_P5)))
            h = h + _u(size)
            while done + 8 <= size:
                h = _rot(h ^ (_rot(long[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
                done += 8
            if done + 4 <= size:
                h = _rot(h ^ (mid[at + done].astype(np.uint64) * _P1), 23) * _P2 + _P3
                done += 4
            while done < size:
                h = _rot(h ^ (padded[at + done].astype(np.uint64) * _P5), 11) * _P1
                done += 1
            h = (h ^ (h >> _u(33))) * _P2
            h = (h ^ (h >> _u(29))) * _P3
            out[rows] = h ^ (h >> _u(32))
    return out


def word_hashes(words: Words, seed: int = 42) -> np.ndarray:
    return xxh64(words.buf, words.starts, words.ends, seed)
