"""Encoding texts by units (pieces of text that a tokenizer never merges across), each distinct unit once a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

from weftgraph.llm.words import xxh64

ROUND_BYTES = 6 << 20
_HASH_BYTES = 1 << 20


def rounds(batches: Iterable[pa.RecordBatch], size: int = ROUND_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(doc_ids, texts in UTF-8, null as empty) of columns 0 and 1, gathered over batches up to a size."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or b"")
            held += len(texts[-1]) + 8
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice, some slices at a time."""
    out, lo = np.empty(len(starts), np.uint64), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _HASH_BYTES)))
        at = int(starts[lo])
        out[lo:hi] = xxh64(raw[at : int(ends[hi - 1])], starts[lo:hi] - at, ends[lo:hi] - at)
        lo = hi
    return out


def _same(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, rep: np.ndarray) -> bool:
    """Has every slice the bytes of the one that stands for it?"""
    size = ends - starts
    if not (size == size[rep]).all():
        return False
    other = np.flatnonzero(rep != np.arange(len(rep)))
    for lo in range(0, len(other), 1 << 16):
        own = other[lo : lo + (1 << 16)]
        n = size[own]
        upto = np.cumsum(n)
        step = np.arange(upto[-1] if len(upto) else 0) - np.repeat(upto - n, n)
        if not np.array_equal(raw[np.repeat(starts[own], n) + step], raw[np.repeat(starts[rep[own]], n) + step]):
            return False
    return True


class Flat:
    """ids: of all texts, one after another; first: where each text's begin, and the end."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.ids, self.first = ids, first

    def of(self, i: int) -> np.ndarray:
        return self.ids[self.first[i] : self.first[i + 1]]


def encode_units(data: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, lookup: Callable[[bytes], bytes]) -> Flat:
    """lookup(unit) gives 32-bit ids; first: the number of each text's first unit, and of all.

    Equal units are found by a hash and confirmed byte by byte.
    """
    if not len(starts):
        return Flat(np.zeros(0, np.uint32), np.zeros(len(first), np.int64))
    raw = np.frombuffer(data, np.uint8)
    _, rep, inverse = np.unique(_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    if not _same(raw, starts, ends, rep[inverse]):
        rep, inverse = np.arange(len(starts)), np.arange(len(starts))
    found = [lookup(data[a:b]) for a, b in zip(starts[rep].tolist(), ends[rep].tolist(), strict=True)]
    count = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    flat = np.frombuffer(b"".join(found), dtype="<u4")
    begin = np.cumsum(count) - count
    size = count[inverse]
    upto = np.concatenate([[0], np.cumsum(size)])
    return Flat(flat[np.repeat(begin[inverse] - upto[:-1], size) + np.arange(upto[-1])], upto[first])
