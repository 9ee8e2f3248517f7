"""Graph loops: each level is one join, its result a reliable checkpoint; a loop ends with an empty frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.policy import active, retired, visible
from weftgraph.operators import cycles
from weftgraph.operators.components import label_components
from weftgraph.operators.lookup import inverse_edges, prerequisite_relations
from weftgraph.runtime import cut, stored
from weftgraph.schema import KnowledgeSet


def resolve(kg: KnowledgeSet) -> DataFrame:
    """Every entity's final id along deprecated_by: (id, resolved, hops, verdict ok | cycle | dangling).

    Pointer doubling: after n rounds a pointer spans 2**n hops, so depth costs its logarithm in joins.
    """
    ids = kg.entities.select("id")
    step = kg.entities.select("id", F.when(F.col("deprecated_by") != F.col("id"), F.col("deprecated_by")).alias("next"))
    known = ids.select(F.col("id").alias("next"), F.lit(True).alias("known"))
    step = step.join(known, "next", "left")
    state = cut(step.select(
        "id", F.when(F.col("next").isNotNull() & F.col("known").isNotNull(), F.col("next")).otherwise(F.col("id")).alias("at"),
        F.when(F.col("next").isNotNull() & F.col("known").isNotNull(), 1).otherwise(0).cast("long").alias("hops"),
        (F.col("next").isNotNull() & F.col("known").isNull()).alias("dangling"),
    ))
    ends = state.where("hops = 0").select(F.col("id").alias("at"), F.col("dangling").alias("end_dangling"))
    moved = state.agg(F.sum("hops"), F.count("*")).first()
    for _ in range(int(moved[1] or 0).bit_length()):  # no chain is longer than the table
        far = state.select(F.col("id").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"))
        nxt = cut(state.join(far, "at").select("id", F.col("to").alias("at"), (F.col("hops") + F.col("more")).alias("hops"), "dangling"))
        state, before, moved = nxt, moved, nxt.agg(F.sum("hops"), F.count("*")).first()
        if moved == before:
            break
    out = state.select("id", "at", "hops").join(ends, "at", "left")
    verdict = F.when(F.col("end_dangling").isNull(), "cycle").when(F.col("end_dangling"), "dangling").otherwise("ok")
    return out.select("id", F.when(verdict != "cycle", F.col("at")).alias("resolved"), F.when(verdict != "cycle", F.col("hops")).alias("hops"), verdict.alias("verdict"))


def prerequisites(kg: KnowledgeSet, starts: DataFrame, policy: str | None = None, include_retired: bool = False, max_levels: int = 200) -> DataFrame:
    """starts(id) -> (id, prerequisite, level): all reachable over the four relations, not through retired entities."""
    shown = kg.entities if include_retired else kg.entities.where(~retired())
    edges = prerequisite_relations(kg.connections.where(visible(policy))).select("source", "target").distinct()
    edges = cut(edges.join(shown.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target"))
    front = cut(starts.join(shown.select("id"), "id", "left_semi").select("id", F.col("id").alias("node")).distinct())
    seen = front.withColumn("level", F.lit(0))
    for level in range(1, max_levels + 1):
        step = front.join(edges, front["node"] == edges["source"]).select("id", F.col("target").alias("node")).distinct()
        front = cut(step.join(seen, ["id", "node"], "left_anti"))
        if front.isEmpty():
            return seen.where("level > 0").select("id", F.col("node").alias("prerequisite"), "level")
        seen = cut(seen.unionByName(front.withColumn("level", F.lit(level))))
    raise RuntimeError(f"there are prerequisites beyond {max_levels} levels")


def transitive_closure(kg: KnowledgeSet, relations: list[str] | None = None, with_path: bool = True) -> DataFrame:
    """(relation, source, target, path): reachable pairs beyond the direct ones, with the first of the shortest paths.

    Paths double: those of exactly the longest length known are joined with all known ones, so a chain of n edges takes log n rounds. The
    first of the shortest paths is made of such, whichever place it is cut at.
    """
    names = F.broadcast(kg.relations.where("transitive").select(F.col("name").alias("relation")))
    edges = kg.connections.where("target is not null and source <> target").join(names, "relation", "left_semi")
    if relations is not None:
        edges = edges.where(F.col("relation").isin(relations))
    pair = ["relation", "source", "target"]
    known = stored(edges.select(*pair).distinct().withColumn("n", F.lit(1).cast("long")).withColumn("path", F.array("target") if with_path else F.lit(None).cast("array<string>")))
    longest = 1
    while True:
        left = known.where(F.col("n") == longest).select("relation", "source", F.col("target").alias("mid"), F.col("path").alias("head"))
        right = known.select("relation", F.col("source").alias("mid"), "target", "n", F.col("path").alias("tail"))
        step = left.join(right, ["relation", "mid"]).where("target <> source").select(*pair, (F.col("n") + longest).alias("n"), F.concat("head", "tail").alias("path"))
        fresh = stored(step.groupBy(*pair).agg(F.min(F.struct("n", "path")).alias("best")).select(*pair, "best.*").join(known.select(*pair), pair, "left_anti"))
        if fresh.isEmpty():
            out = known.where("n > 1")
            return out.select(*pair, F.concat(F.array("source"), "path").alias("path")) if with_path else out.select(*pair)
        known, longest = stored(known.unionByName(fresh)), 2 * longest


def prerequisite_chains(kg: KnowledgeSet, n_starts: int = 20, max_edges: int = 4) -> DataFrame:
    """Simple paths of at most max_edges active dependency edges from the first sources by id: (path, length)."""
    dependency = F.broadcast(kg.relations.where("family = 'dependency'").select(F.col("name").alias("relation")))
    edges = kg.connections.where(active() & F.col("target").isNotNull()).join(dependency, "relation", "left_semi").select("source", "target").distinct()
    starts = edges.select("source").distinct().orderBy("source").limit(n_starts)
    paths = edges.join(F.broadcast(starts), "source", "left_semi").where("source <> target").select(F.array("source", "target").alias("path"))
    out = paths
    for _ in range(max_edges - 1):
        paths = paths.withColumn("source", F.element_at("path", -1)).join(edges, "source").where(~F.array_contains("path", F.col("target"))).select(F.array_append("path", F.col("target")).alias("path"))
        out = out.unionByName(paths)
    return out.select(F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("length"))


def relationship_cycles(kg: KnowledgeSet) -> DataFrame:
    """(relation, component, size, position, node): each strongly connected component of an active transitive, asymmetric relation, with one of its cycles, a row a node."""
    names = F.broadcast(kg.relations.where("transitive and not symmetric").select(F.col("name").alias("relation")))
    edges = cut(kg.connections.where(active() & F.col("target").isNotNull()).join(names, "relation", "left_semi").select("relation", "source", "target").distinct())
    label = cut(cycles.components(edges))
    size = label.groupBy("relation", "component").agg(F.count("*").alias("size"))
    return cycles.witnesses(edges, label).join(size, ["relation", "component"]).select("relation", "component", "size", "position", "node")


def connected_components(kg: KnowledgeSet) -> DataFrame:
    """(id, component, size) of every entity, edges taken both ways; an isolated entity is its own component."""
    edges = kg.connections.where("target is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    label = label_components(edges)
    own = kg.entities.select("id").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    own = cut(own.select("id", F.coalesce("component", "id").alias("component")))
    return own.join(own.groupBy("component").agg(F.count("*").alias("size")), "component")


def centrality(kg: KnowledgeSet, rounds: int = 5, damping: float = 0.85) -> DataFrame:
    """In, out and total degree, and rank after a fixed number of rounds, without redistribution of dangling rank.

    Parallel edges count once in a sum but fully in the divisor.
    """
    edges = kg.connections.where("target is not null").select("source", "target")
    outs = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"))
    ins = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    nodes = kg.entities.select("id").join(outs, "id", "left").join(ins, "id", "left").fillna(0, ["out_degree", "in_degree"])
    nodes = cut(nodes)
    n = max(nodes.count(), 1)
    ways = edges.distinct().join(nodes.select(F.col("id").alias("source"), "out_degree"), "source").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    ways = cut(ways.select("source", "target", "out_degree"))
    rank = nodes.select("id", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        got = ways.join(rank.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("out_degree")).alias("got"))
        rank = nodes.select("id").join(got, "id", "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
    out = nodes.join(rank, "id")
    return out.select("id", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"), F.round("rank", 6).alias("rank"))


def centrality_top(kg: KnowledgeSet, k: int = 20) -> DataFrame:
    return centrality(kg).orderBy(F.desc("rank"), "id").limit(k)


def cross_domain_pathways(kg: KnowledgeSet) -> DataFrame:
    end = lambda p: kg.entities.select(F.col("id").alias(p), F.col("domain").alias(f"{p}_domain"))
    return kg.connections.where("relation = 'bridges' and target is not null").join(end("source"), "source", "left").join(end("target"), "target", "left").select("id", "source", "source_domain", "target", "target_domain")


def pairs_by_relation(kg: KnowledgeSet, relation: str) -> DataFrame:
    return kg.connections.where((F.col("relation") == relation) & F.col("target").isNotNull()).select("id", "source", "target", "review")


def edge_union(kg: KnowledgeSet, limit: int | None = None) -> DataFrame:
    """Explicit, inverse and closure edges with how they were derived."""
    explicit = kg.connections.where("target is not null").select("source", "relation", "target", F.lit(False).alias("derived"), F.lit("explicit").alias("method"))
    inverse = inverse_edges(kg).select("source", "relation", "target", F.lit(True).alias("derived"), F.lit("inverse").alias("method"))
    closure = transitive_closure(kg, with_path=False).select("source", "relation", "target", F.lit(True).alias("derived"), F.lit("closure").alias("method"))
    if limit is not None:
        inverse, closure = (x.orderBy("source", "relation", "target").limit(limit) for x in (inverse, closure))
    return explicit.unionByName(inverse).unionByName(closure)


def dangling_endpoints(kg: KnowledgeSet) -> DataFrame:
    """Pointers that resolve to nothing: (kind, record, pointer)."""
    c, e, ids = kg.connections, kg.entities, kg.entities.select(F.col("id").alias("pointer"))
    point = lambda df, kind, column, record="id": df.where(F.col(column).isNotNull()).select(F.lit(kind).alias("kind"), F.col(record).alias("record"), F.col(column).alias("pointer"))
    to_entities = point(c, "source", "source").unionByName(point(c, "target", "target")).unionByName(point(e, "deprecated_by", "deprecated_by"))
    out = to_entities.join(ids, "pointer", "left_anti")
    out = out.unionByName(point(c, "replaced_by", "replaced_by").join(c.select(F.col("id").alias("pointer")), "pointer", "left_anti"))
    ev = kg.evidence.where("source_ref is not null").select(F.lit("evidence").alias("kind"), F.col("connection_id").alias("record"), F.col("source_ref").alias("pointer"))
    return out.unionByName(ev.join(kg.sources.select(F.col("id").alias("pointer")), "pointer", "left_anti")).select("kind", "record", "pointer")


def structural_index(kg: KnowledgeSet) -> DataFrame:
    """Adjacency of each entity, out and in, as sorted text."""
    c = kg.connections.where("target is not null")
    out = c.groupBy(F.col("source").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "relation", "target"))), ",").alias("outgoing"))
    into = c.groupBy(F.col("target").alias("id")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "relation", "source"))), ",").alias("incoming"))
    return kg.entities.select("id").join(out, "id", "left").join(into, "id", "left").fillna("", ["outgoing", "incoming"])


def ordinal(df: DataFrame, order: list, name: str = "ordinal", parts: int = 64) -> DataFrame:
    """A global row number in two passes: range partitions in order, then the count of the partitions before."""
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").count()
    before = sizes.select("__p", (F.sum("count").over(Window.orderBy("__p")) - F.col("count")).alias("__b"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranged.withColumn("__o", own).join(F.broadcast(before), "__p").withColumn(name, (F.col("__o") + F.col("__b")).cast("long")).drop("__p", "__o", "__b")
