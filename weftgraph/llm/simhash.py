"""SimHash near-duplicates: a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most four bits share at least
four of them: that is the guaranteed minimum. Lists of a single positional byte would each hold 1/256 of
all fingerprints, and their pairs would grow with the square of the corpus, so the index is keyed by three
positional bytes: 20 triples of positions suffice for every choice of four positions to hold one of them
(a Turan design on eight points). Pairs met under a key are tallied over all eight positions, kept from four
shared bytes on, and verified by the number of differing bits.

Cases: null and empty texts have no words and the fingerprint zero; texts of under four words hash the whole
sequence; copies share a fingerprint and never become pairs; an empty table gives no rows; extra columns are
ignored by fingerprints() and kept by keep_one(). Rows of one doc_id with different texts are labelled each by its own
text. A null doc_id is kept as a row of its own with a null component, and neither links nor labels anything.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.words import TO_LOWER_SPACE, Words, text_chunks, xxh64
from weftgraph.operators.components import label_components
from weftgraph.runtime import cut, unused

#: Groups of over so many fingerprints under one key are compared block by block in numpy.
BLOCK = 512


def _design() -> list[tuple[int, int, int]]:
    """20 triples such that any 4 of 8 positions hold one: complements of a bipartite-like split in three classes."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    where = {p: c for c, own in enumerate(classes) for p in own}
    out = []
    for t in combinations(range(8), 3):
        c = sorted(where[p] for p in t)
        if c[0] == c[2] or (c[0] == c[1] and c[2] == (c[0] + 1) % 3) or (c[1] == c[2] and c[0] == (c[1] + 1) % 3):
            out.append(t)
    return out


TRIPLES = _design()


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One fingerprint for each run hashes[first[i]:first[i+1]]: the bits set in over half of it.

    Bits are counted eight at a time: a 64-bit word holds eight counters of eight bits, summed over at most
    255 rows before they could overflow.
    """
    size = np.diff(first)
    counts = np.zeros((len(size), 64), dtype=np.int64)
    full = np.flatnonzero(size)
    if len(full):
        pieces = -(-size[full] // 255)
        owner = np.repeat(full, pieces)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = first[owner] + 255 * step
        for bit in range(8):
            part = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101), begin)
            wide = part.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            np.add.at(counts, (owner[:, None], np.arange(8)[None, :] * 8 + bit), wide)
    return np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view("<u8").ravel()


def text_fingerprints(texts: list[bytes | None], shingle: int = 4) -> np.ndarray:
    w = Words(texts, TO_LOWER_SPACE)
    n = np.diff(w.first)
    m = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(m)])
    begin = np.repeat(w.first[:-1] - first[:-1], m) + np.arange(first[-1])
    last = np.minimum(begin + shingle, np.repeat(w.first[1:], m)) - 1
    return simhash(xxh64(w.buf, w.starts[begin], w.ends[last]), first)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, h, fp): h tells rows of one doc_id apart, the hash of the text as it is."""

    def run(batches):
        for b in batches:
            done = 0
            for ids, texts in text_chunks([b]):
                h = b.column(2).slice(done, len(ids))
                done += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), h, pa.array(text_fingerprints(texts, shingle).view(np.int64))], names=["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


def _shared(a, b):
    x = a.bitwiseXOR(b)
    return reduce(lambda p, q: p + q, [F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(8)])


def _blocks(max_bits: int):
    """A spanning forest of the links among the rows of two blocks: rows already reached are never compared again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, node = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
        todo = np.ones(len(fp), dtype=bool)
        out = []
        for start in range(len(fp)):
            queue = [start] if todo[start] else []
            todo[start] = False
            while queue:
                i = queue.pop()
                rest = np.flatnonzero(todo)
                if not len(rest):
                    break
                x = fp[rest] ^ fp[i]
                shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
                near = rest[(shared >= 8 - max_bits) & (np.bitwise_count(x) <= max_bits)]
                todo[near] = False
                out += [(node[i], node[j]) for j in near]
                queue += near.tolist()
        return pd.DataFrame(out, columns=["src", "dst"]).astype("int64")

    return run


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct (fp, node) -> (src, dst) nodes whose fingerprints differ in at most max_bits <= 4 bits.

    Every pair under small keys; for a key of over BLOCK fingerprints a spanning forest of the same links,
    found in pairs of blocks so that no task ever holds more than two blocks of a key.
    """
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = F.array(*[F.lit(t << 24).bitwiseOR(F.shiftleft(byte(a), 16)).bitwiseOR(F.shiftleft(byte(b), 8)).bitwiseOR(byte(c)) for t, (a, b, c) in enumerate(TRIPLES)])
    posted = fps.select("fp", "node", F.explode(keys).alias("key"))
    size = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    posted = cut(posted.join(size, "key"))
    few = posted.where(F.col("n") <= BLOCK)
    a, b = few.select("key", F.col("fp").alias("f"), F.col("node").alias("src")), few.select("key", F.col("fp").alias("g"), F.col("node").alias("dst"))
    pairs = a.join(b, "key").where("src < dst").where(_shared(F.col("f"), F.col("g")) >= 8 - max_bits)
    pairs = pairs.where(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= max_bits).select("src", "dst")
    dense = posted.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("long"))
    dense = dense.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dense = dense.where("block <> other").select("key", "fp", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    forest = dense.groupBy("key", "i", "j").applyInPandas(_blocks(max_bits), "src long, dst long")
    return pairs.unionByName(forest)


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, h, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    prints = cut(fingerprints(docs, shingle))
    fps = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    # a smallest doc_id may stand for several fingerprints where rows repeat it, so nodes are fingerprints' places
    fps = cut(fps.withColumn("node", F.struct("doc_id", "fp")))
    if fps.groupBy("doc_id").count().where("count > 1").isEmpty():
        label = label_components(links(fps.select("fp", F.col("doc_id").alias("node")), max_bits))
        merged = fps.join(label, fps["doc_id"] == label["node"], "left").select("fp", F.coalesce("component", "doc_id").alias("component_id"))
    else:
        pairs = links(fps.select("fp", F.col("fp").alias("node")), max_bits)
        place = lambda c: fps.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
        edges = pairs.join(place("src"), "src").join(place("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
        label = label_components(edges)
        merged = fps.join(label, "node", "left").select("fp", F.coalesce("component.doc_id", "doc_id").alias("component_id"))
    return prints.join(merged, "fp", "left").select("doc_id", "h", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows whose doc_id labels their group, all columns kept; equal rows of one doc_id all stay, and so do null ids."""
    found = near_duplicates(docs, shingle, max_bits)
    i, g = unused(docs.columns, "id", "hash")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(i), F.col("h").alias(g)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(g)), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

