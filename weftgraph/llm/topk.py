"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks of like length (classes of the squared length, then a hash), queries into groups; a task holds
one block and one group. A block keeps, for each dimension, its candidates sorted by that component. For a query, lists are read from
their high end where the query's component is positive and from the low end where it is negative, in steps of growing depth. What is
met is scored in full; the threshold of a depth is the score of an imagined vector made of the components at
that depth in all lists. Once the query's kth score in the block exceeds the threshold, nothing unread can
be among the k best (or tie with them) and the block is left.

Blocks share a bound. A query first meets its own block; the kth score found there is its floor, which the kth result of all
cannot be under. It then goes only to classes whose longest vector, times its own length, reaches the floor, and there a block is left as
soon as the threshold is under the floor, before its lists are read if even its extremes are. The k best of each block
meet in one window over the queries.

Vectors are taken as floor(scale * x); scores are exact integers; vectors so long that a sum might not fit in 64 bits raise an error.

Cases: a vector that is null or has a null or non-finite component takes no part, nor does one of another
length than the most frequent (the larger, of several) length; ties go to the smaller id; a query has no
row for itself, so with k or fewer other vectors all are returned; rows with a null id take no part;
repeated rows of an id are candidates each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.runtime import cut

#: Components that a task holds of a block, and of a group of queries, at most (but 256 vectors at least); vectors of a block in small tables.
COMPONENTS, BLOCK = 1 << 21, 4096


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>), only the vectors that take part."""
    fine = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    size = ok.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).first()
    return ok.where(F.size("v") == (size["size"] if size else 0))


class SortedLists:
    """A block's vectors and, for each dimension, their places in order of that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, reach: int = 0):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        most = int(np.abs(rows).max(initial=0))
        # sums of products that stay under 2**53 are exact in floating point, and much faster; reach is the largest component of a query
        small = most * max(most, reach) * max(rows.shape[1], 1) < 1 << 52
        self.exact = self.rows.astype(np.float64) if small else self.rows
        self.up = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T)

    def threshold(self, query: np.ndarray, lists: np.ndarray, depth: int) -> int:
        """Score of the imagined vector of the components at a depth (from 1) in all lists."""
        n = len(self.ids)
        return sum(int(self.rows[self.up[d, n - depth] if query[d] > 0 else self.up[d, depth - 1], d]) * int(query[d]) for d in lists)

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, by score downward, then id; those under the floor may be left out.

        Depth doubles from step to step. Once half of the block has been met without the bound being reached, the rest is
        scored in one go instead of being read through its lists.
        """
        n, q = len(self.ids), query.astype(self.exact.dtype)
        done = self.ids == own
        lists = np.flatnonzero(query)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, 2 * k
        if floor is not None and n and self.threshold(query, lists, 1) < floor:
            return ids, scores
        while depth < n:
            upto = min(n, depth + step)
            met = np.zeros(n, dtype=bool)
            for d in lists:
                met[self.up[d, n - upto : n - depth] if query[d] > 0 else self.up[d, depth:upto]] = True
            fresh = np.flatnonzero(met & ~done)
            done[fresh] = True
            rest = not len(lists) or 2 * np.count_nonzero(done) > n
            if rest:
                fresh = np.append(fresh, np.flatnonzero(~done))
            ids, scores = np.append(ids, self.ids[fresh]), np.append(scores, (self.exact[fresh] @ q).astype(np.int64))
            if len(ids) > k:
                near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[near], scores[near]
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if rest:
                break
            depth, step = upto, step * 2
            bars = [b for b in (int(scores[-1]) if len(ids) == k else None, floor) if b is not None]
            if bars and max(bars) > self.threshold(query, lists, depth):
                break
        if floor is not None:
            ids, scores = ids[scores >= floor], scores[scores >= floor]
        return ids, scores


def _search(table: pa.Table, k: int) -> pa.Table:
    """The k best of a block for each query of a group; rows of queries have role 1, of candidates 0, of both 2."""
    ids, role = table["vec_id"].to_numpy(), table["role"].to_numpy()
    flat = table["v"].combine_chunks().flatten().to_numpy()
    rows, floors = flat.reshape(len(ids), -1), table["floor"].to_pylist()
    out = [(np.zeros(0, np.int64),) * 3]
    asked = np.flatnonzero(role > 0)
    if len(asked) and (role != 1).any():
        lists = SortedLists(ids[role != 1], rows[role != 1], int(np.abs(rows[asked]).max(initial=0)))
        for q in asked:
            got, score = lists.top(rows[q], int(ids[q]), k, floors[q])
            out.append((np.full(len(got), ids[q]), got, score))
    q, v, s = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query_id": q, "vec_id": v, "score": s})


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _squared(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, block: int | None = None, group: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the vectors whose id is divisible by `every`, candidates all.

    A task holds at most about `block` candidates and `group` queries. If they are not given, they follow from COMPONENTS and the number of
    dimensions; tables that would fill too few tasks get smaller blocks, down to BLOCK.
    """
    spark, schema = vectors.sparkSession, "query_id long, vec_id long, score long"
    own = cut(integers(vectors, scale).withColumn("squared", _squared("v")).withColumn("length_class", F.floor(2 * F.log2(F.col("squared") + 1)).cast("int")))
    # squared lengths are under 2**62, so classes are at most 125
    classes = own.groupBy("length_class").agg(F.count("*").alias("n"), F.max("squared").alias("most"), F.max(F.size("v")).alias("size")).collect()
    if not classes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if max(c.most for c in classes) >= 2.0**62:  # no inner product exceeds the largest squared length
        raise ValueError("components are too large for sums in 64 bits")
    n, full = sum(c.n for c in classes), max(256, COMPONENTS // max(1, classes[0]["size"]))
    block = block or min(full, max(BLOCK, n // (2 * spark.sparkContext.defaultParallelism)))
    groups = max(1, -(-n // (every * (group or full))))
    blocks = {c.length_class: max(1, round(c.n / block)) for c in classes}
    dealt = F.element_at(F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]), F.col("length_class"))
    home = own.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), dealt).cast("int"))
    query, fields, none = F.col("vec_id") % every == 0, ["length_class", "block", "grp", "vec_id", "v"], F.lit(None).cast("long").alias("floor")

    role = F.when(query, 2).otherwise(0).alias("role")
    first = home.select("length_class", "block", "vec_id", "v", none, role).groupBy("length_class", "block").applyInArrow(lambda t: _search(t, k), schema)
    first = cut(_best(first, k))
    if sum(blocks.values()) == 1:
        return first.select("query_id", "rank", "vec_id", "score")

    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    there = F.explode(F.array(*[F.struct(F.lit(c.length_class).alias("c"), F.lit(c.most).alias("most"), F.lit(blocks[c.length_class]).alias("blocks")) for c in classes])).alias("there")
    asked = home.where(query).join(floors, "vec_id", "left").withColumn("grp", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")).select("*", there)
    hope = F.col("floor").isNull() | (F.sqrt("squared") * F.sqrt("there.most") * (1 + 1e-9) + 1 >= F.col("floor"))
    asked = asked.where(hope)
    # candidates go only to groups with a query that may find something in their class: at most 125 rows of sets of groups
    wanted = asked.groupBy(F.col("there.c").alias("length_class")).agg(F.collect_set("grp").alias("groups"))
    asked = asked.select("length_class", "block", "there.c", F.explode(F.sequence(F.lit(0), F.col("there.blocks") - 1)).alias("b"), "grp", "vec_id", "v", "floor")
    asked = asked.where((F.col("c") != F.col("length_class")) | (F.col("b") != F.col("block"))).select(F.col("c").alias("length_class"), F.col("b").alias("block"), *fields[2:], "floor", F.lit(1).alias("role"))
    packed = home.join(F.broadcast(wanted), "length_class").withColumn("grp", F.explode("groups")).select(*fields, none, F.lit(0).alias("role"))
    then = packed.unionByName(asked).groupBy("length_class", "block", "grp").applyInArrow(lambda t: _search(t, k), schema)
    return _best(then.unionByName(first.select("query_id", "vec_id", "score")), k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH ok AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM ok q, ok c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
