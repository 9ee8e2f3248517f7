"""Digests of trees of files as a Merkle tree in a table, and the drift between two of them.

A leaf is a path and the SHA-256 of its bytes. Leaves go to nodes by the hexadecimal digits of the SHA-256 of their path, so nodes are alike in size however
paths are distributed over folders; a node of level d stands for all paths whose hash begins with its d digits. On the lowest level a node's digest is
over the sorted lines `hash of path:digest` of its leaves, above it is over the sorted lines `digits:digest` of its up to 16 nodes. Nodes
without leaves are left out, so a small tree has a small table. Level 0 has one node: the digest of all.

`drift` goes down from level 0 and takes, on each level, only nodes below those that differ: while these are few, as a filter that reaches the Parquet scan
(levels are partitions, and sorted), otherwise by a join. Leaves are read last, and only below nodes that differ.

Cases: equal rows of a path count once, different digests of one path are leaves each; rows without a path or digest raise an error where they are read;
an empty tree has no nodes and the digest of the empty text; two trees must have one depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.runtime import stored
from weftgraph.sources.files import bundle_manifest

#: Levels below the root: 65,536 lowest nodes.
DEPTH = 4
#: Up to so many nodes that differ are put into the scan's filter.
FILTERED = 1024
_NODES, _LEAVES = "prefix string, digest string, leaves long, parent string", "path string, digest string, hash string, parent string"
_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


@dataclass
class Tree:
    """nodes (level, parent, prefix, digest, leaves), leaves (parent, path, digest); parent is the prefix of the node above."""

    nodes: DataFrame
    leaves: DataFrame
    depth: int


def file_leaves(spark: SparkSession, root: str) -> DataFrame:
    """(path from the root, digest) of every file below a folder that has bytes."""
    return bundle_manifest(spark, root).select(F.col("file").alias("path"), F.col("sha256").alias("digest"))


def _digest(lines) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(lines)), "\n"), 256)


def write_tree(leaves: DataFrame, path: str, depth: int = DEPTH) -> Tree:
    """A tree over (path, digest), written below a folder; each level is made of the one below."""
    spark = leaves.sparkSession
    own = leaves.select(F.coalesce("path", F.raise_error("a leaf without a path")).alias("path"), F.coalesce("digest", F.raise_error("a leaf without a digest")).alias("digest")).distinct()
    own = own.withColumn("hash", F.sha2("path", 256)).withColumn("parent", F.substring("hash", 1, depth))
    own.repartitionByRange("parent").sortWithinPartitions("parent").write.parquet(f"{path}/leaves")
    below, of = spark.read.schema(_LEAVES).parquet(f"{path}/leaves"), F.concat_ws(":", "hash", "digest")
    for level in range(depth, -1, -1):
        count = F.count("*") if level == depth else F.sum("leaves")
        nodes = below.groupBy(F.col("parent").alias("prefix")).agg(_digest(of).alias("digest"), count.alias("leaves"))
        # prefix and parent of an empty prefix are empty
        nodes = nodes.withColumn("parent", F.substring("prefix", 1, max(level - 1, 0)))
        nodes.repartitionByRange("prefix").sortWithinPartitions("prefix").write.parquet(f"{path}/nodes/level={level}")
        below, of = spark.read.schema(_NODES).parquet(f"{path}/nodes/level={level}"), F.concat_ws(":", "prefix", "digest")
    return read_tree(spark, path, depth)


def read_tree(spark: SparkSession, path: str, depth: int = DEPTH) -> Tree:
    nodes = spark.read.schema(f"{_NODES}, level int").parquet(f"{path}/nodes")
    return Tree(nodes, spark.read.schema(_LEAVES).parquet(f"{path}/leaves"), depth)


def root(tree: Tree) -> DataFrame:
    """(digest, leaves) of the whole tree, one row."""
    top = tree.nodes.where("level = 0").agg(F.max("digest").alias("digest"), F.sum("leaves").alias("leaves"))
    return top.select(F.coalesce("digest", F.lit(_EMPTY)).alias("digest"), F.coalesce("leaves", F.lit(0)).alias("leaves"))


def _below(rows: DataFrame, differ: DataFrame | None) -> DataFrame:
    """The rows whose parent differs."""
    if differ is None:
        return rows
    some = [r.prefix for r in differ.limit(FILTERED + 1).collect()]
    return rows.where(F.col("parent").isin(some)) if len(some) <= FILTERED else rows.join(differ.select(F.col("prefix").alias("parent")), "parent", "left_semi")


def _unlike(was: DataFrame, now: DataFrame, key: str) -> DataFrame:
    a, b = was.select(F.col(key).alias("k"), F.col("digest").alias("old")), now.select(F.col(key).alias("l"), F.col("digest").alias("new"))
    return a.join(b, F.col("k") == F.col("l"), "full").where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("key", F.coalesce("k", "l"))


def drift(was: Tree, now: Tree) -> DataFrame:
    """(path, change added | changed | removed)."""
    if was.depth != now.depth:
        raise ValueError("trees of different depths")
    differ = None
    for level in range(was.depth + 1):
        a, b = (_below(t.nodes.where(F.col("level") == level), differ) for t in (was, now))
        differ = stored(_unlike(a, b, "prefix").select(F.col("key").alias("prefix")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    one = lambda t: _below(t.leaves, differ).groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("digest")), ",").alias("digest"))
    return _unlike(one(was), one(now), "path").select(F.col("key").alias("path"), change.alias("change"))
