"""Near-duplicates at a Jaccard similarity of 4/5 over sets of five-word shingles, exactly.

SimHash bytes lose pairs at this similarity (about 10 of 64 bits differ), so the index is over shingles: in any
common order of all shingles, two sets of n and m with similarity >= 4/5 share one among the first n - ceil(4n/5) + 1
and the first m - ceil(4m/5) + 1. Those are posted under their hashes, candidates are verified on whole sets,
and groups are the components of the verified links.

The order is frequent last, by a sketch of fixed size, so a common passage is seldom posted; any sketch gives the same
links. Keys are met in two rounds: first each member meets two leaders of its key (rows grow with the postings), then
members that are not in one group yet: pairs of keys of up to FEW members, and for larger keys, joined to clusters where
they share members, whole sets block by block (a task holds two blocks, compares them by a product of matrices and
gives a spanning forest), so no large group ever becomes rows of pairs. In the second round a key is taken once for each
window of set sizes (two steps of a quarter), as sets of sizes further apart are no link.

Pairs are verified on an eighth of all hashes first: given u sampled members of a union, at least 4/5 of which are common
but for chance, a pair with fewer than 4u/5 - 6 sigma is let go (a link is lost so with a chance of 1e-9); the rest is
verified on whole sets, exactly.

Cases: null and empty texts have the empty set and are copies; texts of under five words have one shingle, the whole;
texts with one set are one node; rows of one doc_id with different texts are nodes of their own; a null doc_id
neither links nor labels anything; an empty table gives no rows; other columns are ignored by groups() and kept by keep_one().
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.words import TO_LOWER_SPACE, Words, text_chunks, xxh64
from weftgraph.operators.components import label_components
from weftgraph.runtime import cut, unused

BUCKETS = 1 << 24
#: Up to so many pairs of ids are broadcast to the texts; more are joined by shuffle.
BROADCAST = 250_000
#: Keys of more members than this are compared in blocks, of about so many members and so many bytes of sets.
FEW, BLOCK, BLOCK_BYTES = 128, 1024, 4 << 20
#: Hashes up to this one are in the sample.
SAMPLED = (1 << 64) // 8


def shingle_sets(texts: list[bytes | None], shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the set of each text, ascending, is hashes[first[i]:first[i+1]]."""
    w = Words(texts, TO_LOWER_SPACE)
    n = np.diff(w.first)
    m = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(m)])
    begin = np.repeat(w.first[:-1] - first[:-1], m) + np.arange(first[-1])
    last = np.minimum(begin + shingle, np.repeat(w.first[1:], m)) - 1
    h = xxh64(w.buf, w.starts[begin], w.ends[last])
    owner = np.repeat(np.arange(len(texts)), m)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(texts)))])


def _nodes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(first[:-1], first[1:], strict=True)], dtype=np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, own): node stands for the set of shingles; own: its size, then its sampled hashes."""

    def run(batches):
        for b in batches:
            done = 0
            for ids, texts in text_chunks([b]):
                h = b.column(2).slice(done, len(ids))
                done += len(ids)
                sets, first = shingle_sets(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), h, pa.array(_nodes(sets, first)), _own(sets, first, SAMPLED)], names=["doc_id", "h", "node", "own"])

    return _texts(docs).mapInArrow(run, "doc_id long, h long, node long, own binary")


def _own(h: np.ndarray, first: np.ndarray, top: int) -> pa.Array:
    each = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return pa.array([np.uint64(len(x)).tobytes() + x[: np.searchsorted(x, np.uint64(top), side="right")].tobytes() for x in each], pa.binary())


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of hashes that stand out in some task, and the logarithms of their counts: at most BUCKETS of them, whatever the corpus."""

    def run(batches):
        counts, seen = np.zeros(BUCKETS, dtype=np.int32), set()
        for _, texts in text_chunks(batches):
            h, first = shingle_sets(texts)
            fresh = [x not in seen and not seen.add(x) for x in _nodes(h, first).tolist()]
            bucket, n = np.unique((h[np.repeat(np.array(fresh, dtype=bool), np.diff(first))] % np.uint64(BUCKETS)).astype(np.int32), return_counts=True)
            counts[bucket] += n.astype(np.int32)
        out = np.flatnonzero(counts >= 3 + 4 * counts.mean())
        yield pa.RecordBatch.from_arrays([pa.array(out.astype(np.int32)), pa.array(counts[out].astype(np.int64))], names=["bucket", "n"])

    rows = _texts(docs).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    return rows["bucket"].to_numpy(np.int32), np.log2(rows["n"].to_numpy(np.float64)).astype(np.uint8) + np.uint8(1)


def _postings(docs: DataFrame) -> DataFrame:
    """(key, node, n, pos): pos is the place of the shingle in the set's order, which is (level, hash)."""
    buckets, levels = _frequent(docs)

    def run(batches):
        level = np.zeros(BUCKETS, dtype=np.uint8)
        level[buckets] = levels
        seen = set()  # of a task's copies one posts
        for _, texts in text_chunks(batches):
            h, first = shingle_sets(texts)
            node = _nodes(h, first)
            fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], dtype=bool)
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((level[(h % np.uint64(BUCKETS)).astype(np.int64)], owner))  # stable, so hashes stay ascending
            pos = np.arange(len(h)) - first[owner]
            keep = fresh[owner] & (pos <= (n - (4 * n + 4) // 5)[owner])
            own = owner[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h[order][keep].view(np.int64)), pa.array(node[own]), pa.array(n[own].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["key", "node", "n", "pos"])

    return _texts(docs).mapInArrow(run, "key long, node long, n int, pos int")


def _sets(docs: DataFrame) -> DataFrame:
    """(node, own): the size of the set, then all its hashes."""

    def run(batches):
        for _, texts in text_chunks(batches):
            h, first = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(h, first)), _own(h, first, (1 << 64) - 1)], names=["node", "own"])

    return _texts(docs).mapInArrow(run, "node long, own binary")


def _verified(pairs: DataFrame, prints: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (src, dst) with 5 * |both| >= 4 * |either|, first by sampled hashes, then by all."""
    likely = cut(_agree(pairs, prints.select("node", "own"), True))
    small = likely.count() <= BROADCAST
    asked = likely.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return _agree(likely, _of_nodes(docs, prints, asked, small), False)


def _agree(pairs: DataFrame, sets: DataFrame, sampled: bool) -> DataFrame:
    def run(batches):
        for b in batches:
            yes = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64)[1:] for v in (x, y))
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                both = int((both[1:] == both[:-1]).sum())
                either = len(p) + len(q) - both
                yes.append(5 * both >= 4 * either - (12 * either**0.5 if sampled else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["src", "dst"]).filter(pa.array(yes, pa.bool_()))

    side = lambda c, first: F.struct(F.col(c).alias("node"), F.lit(first).alias("first"))
    sides = pairs.select("src", "dst", F.explode(F.array(side("src", True), side("dst", False))).alias("s")).select("src", "dst", "s.*")
    asked = sides.select("node").distinct()
    if pairs.count() <= BROADCAST:
        sides, asked = F.broadcast(sides), F.broadcast(asked)
    # copies have equal sets, so one of each node is taken before pairs meet them
    one = sets.join(asked, "node", "left_semi").groupBy("node").agg(F.first("own").alias("own"))
    met = one.join(sides, "node")
    own = lambda first: F.first(F.when(F.col("first") == F.lit(first), F.col("own")), ignorenulls=True)
    return met.groupBy("src", "dst").agg(own(True).alias("a"), own(False).alias("b")).mapInArrow(run, "src long, dst long")


def _may(n: str, i: str, m: str, j: str):
    """Sizes within 4/5, and enough left behind the places of a common shingle: that many are common at most, with those before."""
    most = F.least(F.col(i), F.col(j)) + F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * most >= 4 * (F.col(n) + F.col(m)))


def _member(prefix: str) -> list:
    return [F.col(c).alias(f"{prefix}{c}") for c in ("node", "group", "n", "pos")]


def _pairs(met: DataFrame) -> DataFrame:
    met = met.where((F.col("a_group") != F.col("b_group")) & _may("a_n", "a_pos", "b_n", "b_pos"))
    return met.select(F.least("a_node", "b_node").alias("src"), F.greatest("a_node", "b_node").alias("dst")).distinct()


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(src, dst) nodes: verified links that have the same components as all links.

    Each round deals postings out by key once; leaders, open keys and members then meet without a further exchange.
    """
    posted = _postings(docs).repartition("key")
    shared = posted.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    posted = cut(posted.join(shared, "key", "left_semi").distinct())

    # leaders: the members with the fewest and with the most rarer shingles
    own = posted.withColumn("group", F.col("node")).repartition("key")
    x = F.struct(*[F.col(c).alias(f"a_{c}") for c in ("node", "group", "n", "pos")])
    leaders = own.groupBy("key").agg(F.array(F.min_by(x, F.struct("pos", "node")), F.max_by(x, F.struct("pos", "node"))).alias("l"))
    met = own.select("key", *_member("b_")).join(leaders, "key").select("*", F.explode("l").alias("x")).select("key", "x.*", *[f"b_{c}" for c in ("node", "group", "n", "pos")])
    first = cut(_pairs(met))
    found = cut(_verified(first, prints, docs))

    label = cut(label_components(found))
    own = posted.join(label.select("node", "component"), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)) + 1e-9).cast("int")
    own = own.withColumn("win", F.explode(F.array(step, step - 1))).withColumn("key", F.xxhash64("key", "win")).repartition("key")
    open_keys = own.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
    size = own.join(open_keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("head"))
    own = cut(own.join(size, "key"))
    dense = _blocks(own.where(F.col("members") > FEW), docs, prints)
    few = own.where(F.col("members") <= FEW).repartition("key")
    met = few.select("key", *_member("a_")).join(few.select("key", *_member("b_")), "key").where("a_node < b_node")
    rest = cut(_pairs(met).join(first, ["src", "dst"], "left_anti"))
    return found.unionByName(cut(_verified(rest, prints, docs))).unionByName(dense)


def _of_nodes(docs: DataFrame, prints: DataFrame, asked: DataFrame, small: bool) -> DataFrame:
    """(node, own): whole sets of the nodes asked for; one text of each node is read again."""
    texts = prints.join(F.broadcast(asked) if small else asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("r")).select(F.col("r.doc_id").alias("__id"), F.col("r.h").alias("__g"))
    own = docs.select("doc_id", "text").join(F.broadcast(texts) if small else texts, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__g")), "left_semi")
    return _sets(own).groupBy("node").agg(F.first("own").alias("own"))


def _blocks(open_: DataFrame, docs: DataFrame, prints: DataFrame) -> DataFrame:
    """(src, dst): a forest of all links between members of one cluster of large keys."""
    star = open_.where("node <> head").select(F.struct("win", F.col("head").alias("node")).alias("src"), F.struct("win", "node").alias("dst")).distinct()
    label = cut(label_components(star).select("node.node", F.col("component").alias("cluster")))
    asked = label.select("node").distinct()
    sets = cut(_of_nodes(docs, prints, asked, asked.count() <= BROADCAST))
    sets = sets.join(label, "node")
    need = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("own")) / BLOCK_BYTES)).cast("long")
    sized = sets.join(sets.groupBy("cluster").agg(need.alias("blocks")), "cluster").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = sized.withColumn("other", other).select("cluster", "node", "own", F.col("block").alias("side"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        node, side = table["node"].to_numpy(), table["side"].to_numpy()
        sets_ = [np.frombuffer(v.as_buffer(), dtype=np.uint64)[1:] for v in table["own"].combine_chunks()]
        src, dst = _forest(node, sets_, None if (side == side[0]).all() else side)
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return cut(dealt.groupBy("cluster", "i", "j").applyInArrow(run, "src long, dst long"))


def _forest(node: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None) -> tuple[list, list]:
    """Edges of a spanning forest of the links among some sets; between two sides only, if there are two."""
    n = np.array([len(x) for x in sets], dtype=np.float32)
    owner = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    _, column, often = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    keep = often[column] > 1
    owner, column = owner[keep], (np.cumsum(often > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        x = np.zeros((len(sets), 2048), dtype=np.float32)
        x[owner[a:b], column[a:b] - at] = 1
        both += x @ x.T
    linked = 5 * both >= 4 * (n[:, None] + n[None, :] - both)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    todo, src, dst = np.ones(len(sets), dtype=bool), [], []
    for start in range(len(sets)):
        queue = [start] if todo[start] else []
        todo[start] = False
        while queue:
            i = queue.pop()
            near = np.flatnonzero(linked[i] & todo)
            todo[near] = False
            src += [node[i]] * len(near)
            dst += node[near].tolist()
            queue += near.tolist()
    return src, dst


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, h, component_id): component_id is the smallest doc_id reachable over links, itself included; h is the text's hash."""
    prints = cut(_prints(docs))
    known = docs.where("doc_id is not null")
    label = label_components(links(known, prints.where("doc_id is not null")))
    own = prints.select("doc_id", "h", "node").join(label, "node", "left").select("doc_id", "h", F.coalesce("component", "node").alias("node"))
    least = own.groupBy("node").agg(F.min("doc_id").alias("least"))
    return own.join(least, "node").select("doc_id", "h", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows whose doc_id labels their group, all columns kept; equal rows of one doc_id all stay, and so do null ids."""
    i, g = unused(docs.columns, "id", "hash")
    gone = groups(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(i), F.col("h").alias(g)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(i)) & (F.xxhash64("text") == F.col(g)), "left_anti")
