"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def label_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(src, dst) undirected edges -> (node, component), component being the smallest node id reachable.

    Each round is two grouped minima and two equi joins; a hub's edges are never gathered in a list. The
    number of rounds grows with the logarithm of the graph's diameter. Self loops give a node its own
    component; edges with a null end are ignored; no edges give no rows.
    """
    named = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
    loops = named.where("a = b").select(F.col("a").alias("node"))
    e = cut(named.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(e)
    if before[0]:
        for _ in range(max_rounds):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u")
            e = cut(
                small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .unionByName(low.select("u", F.col("m").alias("v")))
                .where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
            )
            after = _state(e)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = labelled.unionByName(roots)
    return out.unionByName(loops.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
