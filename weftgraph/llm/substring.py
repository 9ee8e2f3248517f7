"""Substring dedup by seed and extend, exact for repeats of `threshold` words and more.

Seeds: of every window of `threshold` words, the k-word gram with the smallest hash is its anchor (winnowing),
so equal windows have equal anchors. Consecutive windows with one anchor form a block: the anchor extended both
ways as far as its windows go. Documents are joined on anchors by hash partitioning, never pair by pair:
  1. blocks that are equal as a whole go to the smallest doc_id; in every other document they are repeats;
  2. where an anchor has several different blocks, one of each is extended window by window.
Windows found either way are merged into maximal repeats (rows of maximal_repeats()), the spans of words that are removed.

Hot passages are combined before the shuffle: of equal blocks in a batch only the smallest doc_id goes on as
a seed, the others are known repeats at once. No group is collected; groups are read as a sorted stream.

Cases: null and empty texts have no words and lose none; texts shorter than `threshold` words lose none; a null
doc_id has no order and takes no part, its row is kept as it is; repeated rows of one doc_id are never repeats
of each other; an empty table gives no rows; extra columns are kept by removal(). Of clashing names, only
doc_id and text are read.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.words import RangeHash, Words, mix, text_chunks, word_hashes
from weftgraph.runtime import cut, unused

GRAM = 5
_A, _B, _G = 0xD6E8FEB86659FD93, 0xCA5A826395121157, 0xA0761D6478BD642F


class Anchored:
    """Windows of some texts with their anchors. window: the first word of each; anchor: the hash of its anchor; at: the anchor's place."""

    def __init__(self, texts: list[bytes | None], threshold: int, gram: int):
        self.words = w = Words(texts)
        self.doc_of = np.repeat(np.arange(len(texts)), np.diff(w.first))
        items = word_hashes(w)
        with np.errstate(over="ignore"):
            self.one, self.two = RangeHash(items, _A), RangeHash(mix(items, 1), _B)
            n = len(items)
            grams = RangeHash(items, _G).of(np.arange(max(0, n - gram + 1)), np.arange(gram, n + 1)) if n >= gram else np.zeros(0, np.uint64)
            end = w.first[1:][self.doc_of] if n else np.zeros(0, np.int64)
            self.window = np.flatnonzero(np.arange(n) + threshold <= end)
            low, self.at = (grams[self.window], self.window.copy()) if len(self.window) else (np.zeros(0, np.uint64), self.window)
            for j in range(1, threshold - gram + 1):
                g = grams[self.window + j]
                less = g < low
                low = np.where(less, g, low)
                self.at = np.where(less, self.window + j, self.at)
        self.anchor = low

    def blocks(self, threshold: int):
        """begin (a window), number of windows, anchor hash, hash of all words of the block; one row a block."""
        if not len(self.window):
            z = np.zeros(0, np.int64)
            return z, z, z.view(np.uint64), z.view(np.uint64)
        new = np.flatnonzero((np.diff(self.at, prepend=-1) != 0) | (np.diff(self.window, prepend=-2) != 1))
        count = np.diff(np.append(new, len(self.window)))
        begin = self.window[new]
        return begin, count, self.anchor[new], self.one.of(begin, begin + count + threshold - 1)


def _rows(ids, texts):
    """Only rows with a doc_id take part. Their ids, texts and 32-bit text sums."""
    keep = [i for i, d in enumerate(ids) if d is not None and texts[i]]
    texts = [texts[i] for i in keep]
    return np.array([ids[i] for i in keep], dtype=np.int64), texts, np.array([zlib.crc32(t) for t in texts], dtype=np.int64)


def _pack(crc, at, count):
    """One long for a run of windows in a text: 32 bits of the text's sum, 28 of the place, 4 of the length."""
    return (crc << 32) | (at << 4) | count


#: Blocks of so many are combined before they leave a task.
COMBINE = 300_000


def _seeds(threshold: int, gram: int):
    def combined(parts):
        anchor, body, owner, run_ = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((owner, body, anchor))
        an, bo, ow = anchor[order], body[order], owner[order]
        new = np.append(True, (an[1:] != an[:-1]) | (bo[1:] != bo[:-1]))[: len(an)]
        least = ow[new][np.cumsum(new) - 1] if len(an) else ow
        # of the least document's own copies of a block all are sent on: each may be a repeat of another batch's
        again = ow > least
        key = np.where(again, mix(an + np.arange(len(an), dtype=np.uint64)), an)
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(bo.view(np.int64)), pa.array(again), pa.array(ow), pa.array(run_[order])],
            names=["a", "b", "again", "doc_id", "run"],
        )

    def run(batches):
        held, size = [], 0
        for ids, texts in text_chunks(batches):
            ids, texts, crc = _rows(ids, texts)
            a = Anchored(texts, threshold, gram)
            begin, count, anchor, body = a.blocks(threshold)
            if not len(begin):
                continue
            doc = a.doc_of[begin]
            held.append((anchor, body, ids[doc], _pack(crc[doc], begin - a.words.first[:-1][doc], count)))
            size += len(begin)
            if size >= COMBINE:
                yield combined(held)
                held, size = [], 0
        if held:
            yield combined(held)

    return run


def _windows(threshold: int):
    """doc_id, text, runs (null: none) -> the windows of those runs: (two hashes, doc_id, run)."""

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            if not batch.num_rows:
                continue
            runs = batch.column(2).to_pylist()
            done = 0
            for ids, texts in text_chunks([batch]):
                own = runs[done : done + len(ids)]
                done += len(ids)
                w = Words(texts)
                items = word_hashes(w)
                with np.errstate(over="ignore"):
                    one, two = RangeHash(items, _A), RangeHash(mix(items, 1), _B)
                at, owner, packed = [], [], []
                for i, r in enumerate(own):
                    crc = zlib.crc32(texts[i] or b"")
                    r = np.array(r, dtype=np.int64)
                    r = r[(r >> 32) & 0xFFFFFFFF == crc]
                    place, count = (r >> 4) & 0xFFFFFFF, r & 15
                    p = np.repeat(place - np.cumsum(count) + count, count) + np.arange(count.sum())
                    at.append(p + w.first[i])
                    owner.append(np.full(len(p), ids[i], dtype=np.int64))
                    packed.append(_pack(np.full(len(p), crc, dtype=np.int64), p, 1))
                at, owner, packed = (np.concatenate(x) for x in (at, owner, packed))
                with np.errstate(over="ignore"):
                    h1, h2 = one.of(at, at + threshold), two.of(at, at + threshold)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(owner), pa.array(packed)], names=["a", "b", "doc_id", "run"])

    return run


def covered(text: bytes | None, runs, threshold: int) -> np.ndarray:
    """The words of a text under the runs of windows that are repeats."""
    n = len((text or b"").split())
    mark = np.zeros(n + 1, dtype=np.int32)
    if runs is not None and len(runs):
        r = np.array(runs, dtype=np.int64)
        r = r[(r >> 32) & 0xFFFFFFFF == zlib.crc32(text or b"")]
        at = (r >> 4) & 0xFFFFFFF
        np.add.at(mark, at, 1)
        np.add.at(mark, at + (r & 15) + threshold - 1, -1)
    return np.cumsum(mark)[:n] > 0


def _marks(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    """(doc_id, __runs, __open): runs known to be repeats, and runs that have to be extended window by window."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    seeds = base.mapInArrow(_seeds(threshold, gram), "a long, b long, again boolean, doc_id long, run long")
    by_anchor, by_block = Window.partitionBy("a", "again"), Window.partitionBy("a", "again", "b")
    judged = seeds.withColumns({
        "low": F.min("b").over(by_anchor), "high": F.max("b").over(by_anchor), "least": F.min("doc_id").over(by_block),
    })
    whole = F.col("again") | (F.col("doc_id") > F.col("least"))
    judged = judged.where(whole | (F.col("low") < F.col("high"))).select("doc_id", F.when(whole, F.col("run")).alias("whole"), F.when(~whole, F.col("run")).alias("open"))
    return cut(judged.groupBy("doc_id").agg(F.collect_list("whole").alias("__runs"), F.collect_list("open").alias("__open")))


def repeats(docs: DataFrame, threshold: int = 13, gram: int = GRAM) -> DataFrame:
    """docs with `__runs` array<long>: packed runs of windows whose words also start in a document with a smaller doc_id.

    Both joins deal out documents alike, so that their texts are shuffled once.
    """
    gram = min(max(gram, threshold - 14), threshold)  # a run of windows has to fit in four bits
    marks = _marks(docs, threshold, gram)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    asked = marks.where(F.size("__open") > 0).select("doc_id", "__open")
    singles = docs.join(asked, "doc_id", "left").select("doc_id", "text", "__open", *rest).mapInArrow(_windows(threshold), "a long, b long, doc_id long, run long")
    singles = singles.withColumn("least", F.min("doc_id").over(Window.partitionBy("a", "b")))
    part = singles.where(F.col("doc_id") > F.col("least")).select("doc_id", "run")
    known = marks.select("doc_id", F.explode("__runs").alias("run"))
    runs = known.unionByName(part).groupBy("doc_id").agg(F.collect_list("run").alias("__runs"))
    return docs.join(runs, "doc_id", "left")


def summary(docs: DataFrame, threshold: int = 13, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    found = repeats(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), threshold, gram)

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            out = []
            for text, runs in zip(texts, b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = covered(text, runs, threshold) if runs else np.zeros(len(words), dtype=bool)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if runs else words
                out.append((len(words), len(words) - len(kept), sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return found.select("doc_id", "text", "__runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, gone: np.ndarray) -> str:
    """The text without the marked words and the white space after each; the rest stays as it was."""
    import re

    out, at = [], 0
    for g, m in zip(gone.tolist(), re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text), strict=True):
        if g:
            out.append(text[at : m.start()])
            at = m.end()
    return "".join([*out, text[at:]])


def maximal_repeats(docs: DataFrame, threshold: int = 13, gram: int = GRAM) -> DataFrame:
    """(doc_id, begin, end): words begin:end of a document, each stretch of repeats that touch or overlap extended both ways as far as it goes."""
    found = repeats(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), threshold, gram)

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, runs in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered(text, runs, threshold), [False]]).astype(np.int8)))
                rows += [(doc, int(x), int(y)) for x, y in zip(edge[0::2], edge[1::2], strict=True)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "begin", "end"])

    return found.where("__runs is not null").select("doc_id", "text", "__runs").mapInArrow(run, "doc_id long, begin long, end long")


def removal(docs: DataFrame, threshold: int = 13, gram: int = GRAM) -> DataFrame:
    """The documents with all their columns, repeats cut out of `text`; `n_chars`, if there, follows."""
    # a caller's own columns stay apart from those that repeats() adds
    names = {c: n for c, n in zip(docs.columns, unused([*docs.columns, "__runs", "__open"], *[f"own_{i}" for i in range(len(docs.columns))]), strict=True) if c not in ("doc_id", "text")}
    found = repeats(docs.withColumnsRenamed(names), threshold, gram)

    @F.pandas_udf("string")
    def shorter(texts, runs):
        import pandas as pd

        return pd.Series([t if t is None or r is None else cut_text(t, covered(t.encode(), r, threshold)) for t, r in zip(texts, runs, strict=True)], dtype=object)

    out = found.withColumn("text", F.when(F.col("__runs").isNull(), F.col("text")).otherwise(shorter("text", "__runs")))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.when(F.col("__runs").isNull(), F.col(names["n_chars"])).otherwise(F.length("text").cast("long")))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
