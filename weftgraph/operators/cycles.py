"""Strongly connected components of directed edges, one relation at a time, and a witness cycle of each.

1. Trimming: edges from a node that nothing leads to, or to one that leads nowhere, lie on no cycle.
2. Contraction: each node that is left points to its smallest target. Pointers double until they stand on the cycles of that map, in a number of
   rounds that is the logarithm of the number of nodes; nodes of one such cycle are one node from then on. Long cycles go at once.
3. Colouring, of what is left: a node's colour is the smallest node that leads to it; the component of a colour's own node
   is what leads back to it within the colour. Edges between colours are on no cycle. Repeated until no edges are left; rounds
   follow the diameter of the contracted graph.

No path is enumerated, so dense components cost no more than their edges, and no length is given up on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import stored

_KEY = ["relation", "node"]


def trim(edges: DataFrame) -> DataFrame:
    """edges(relation, source, target) without those that a dead end shows to be on no cycle."""
    edges = stored(edges)
    n = edges.count()
    while n:
        outs = edges.select("relation", F.col("source").alias("target")).distinct()
        ins = edges.select("relation", F.col("target").alias("source")).distinct()
        edges = stored(edges.join(outs, ["relation", "target"], "left_semi").join(ins, ["relation", "source"], "left_semi").select("relation", "source", "target"))
        m = edges.count()
        if m == n:
            break
        n = m
    return edges


def _doublings(nodes: DataFrame) -> int:
    most = nodes.groupBy("relation").count().agg(F.max("count")).first()[0] or 1
    return max(1, (most - 1).bit_length())


def _smallest_target(edges: DataFrame) -> DataFrame:
    return stored(edges.groupBy("relation", F.col("source").alias("node")).agg(F.min("target").alias("to")))


def map_cycles(to: DataFrame) -> DataFrame:
    """to(relation, node, to), one row a node, every `to` a node -> (relation, node, head) of the nodes on cycles of this map; head: the smallest."""
    state = to.withColumn("low", F.col("node"))
    for _ in range(_doublings(to)):
        ahead = state.select("relation", F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("low").alias("low_ahead"))
        state = stored(state.join(ahead, ["relation", "to"]).select("relation", "node", F.col("beyond").alias("to"), F.least("low", "low_ahead").alias("low")))
    reached = state.select("relation", F.col("to").alias("node")).distinct()
    return stored(state.join(reached, _KEY, "left_semi").select("relation", "node", F.col("low").alias("head")))


def _relabel(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Edges between heads, without those within one."""
    of = lambda c: heads.select("relation", F.col("node").alias(c), F.col("head").alias(f"{c}_head"))
    j = edges.join(of("source"), ["relation", "source"], "left").join(of("target"), ["relation", "target"], "left")
    j = j.select("relation", F.coalesce("source_head", "source").alias("source"), F.coalesce("target_head", "target").alias("target"))
    return j.where("source <> target").distinct()


def _spread(state: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """The least value that reaches each node along edges(relation, source, target); state(relation, node, value) holds all nodes."""
    front = state.where(F.col(value).isNotNull())
    while True:
        told = front.select("relation", F.col("node").alias("source"), F.col(value).alias("told")).join(edges, ["relation", "source"])
        best = told.groupBy("relation", F.col("target").alias("node")).agg(F.min("told").alias("told"))
        front = stored(state.join(best, _KEY).where(F.col(value).isNull() | (F.col("told") < F.col(value))).select("relation", "node", F.col("told").alias(value)))
        if front.isEmpty():
            return state
        new = front.select("relation", "node", F.col(value).alias("new"))
        state = stored(state.join(new, _KEY, "left").select("relation", "node", F.coalesce("new", value).alias(value)))


def components(edges: DataFrame) -> DataFrame:
    """edges(relation, source, target) -> (relation, node, component) of all nodes on a cycle; component: its smallest node. A self loop is a cycle."""
    edges = edges.where("source is not null and target is not null").select("relation", "source", "target").distinct()
    core = trim(edges)
    loops = core.where("source = target").select("relation", F.col("source").alias("node"), F.col("source").alias("component"))
    rest = trim(core.where("source <> target"))
    if rest.isEmpty():
        return loops
    heads = map_cycles(_smallest_target(rest))
    left, found = trim(_relabel(rest, heads)), []
    while not left.isEmpty():
        nodes = left.select("relation", F.explode(F.array("source", "target")).alias("node")).distinct()
        colour = _spread(nodes.withColumn("colour", F.col("node")), left, "colour")
        of = lambda c: colour.select("relation", F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))  # noqa: B023, E731
        within = left.join(of("source"), ["relation", "source"]).join(of("target"), ["relation", "target"]).where("source_colour = target_colour")
        within = stored(within.select("relation", "source", "target"))
        back = within.select("relation", F.col("target").alias("source"), F.col("source").alias("target"))
        own = colour.select("relation", "node", F.when(F.col("node") == F.col("colour"), F.col("colour")).alias("component"))
        done = _spread(own, back, "component").where("component is not null")
        found.append(done)
        gone = lambda c: done.select("relation", F.col("node").alias(c))  # noqa: B023, E731
        left = trim(within.join(gone("source"), ["relation", "source"], "left_anti").join(gone("target"), ["relation", "target"], "left_anti"))
    # a head's component is that of the node which stands for it; what contraction joined is one component
    label = heads
    if found:
        many = found[0]
        for d in found[1:]:
            many = many.unionByName(d)
        many = stored(many)
        inner = heads.join(many.select("relation", F.col("node").alias("head"), "component"), ["relation", "head"], "left").select("relation", "node", F.coalesce("component", "head").alias("component"))
        outer = many.join(heads.select("relation", F.col("node")), _KEY, "left_anti")
        size = outer.unionByName(inner)
        label = size.join(size.groupBy("relation", "component").agg(F.min("node").alias("least"), F.count("*").alias("n")), ["relation", "component"]).where("n > 1").select("relation", "node", F.col("least").alias("component"))
    else:
        label = heads.select("relation", "node", F.col("head").alias("component"))
    label = stored(label)
    return stored(label.unionByName(loops.join(label, _KEY, "left_anti")))


def witnesses(edges: DataFrame, label: DataFrame) -> DataFrame:
    """One cycle of each component, a row a node: (relation, component, position, node), position 0 the cycle's smallest node.

    From the component's smallest node on, each node's smallest target within the component is followed until nodes repeat.
    """
    of = lambda c: label.select("relation", F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    within = edges.select("relation", "source", "target").distinct().join(of("source"), ["relation", "source"]).join(of("target"), ["relation", "target"]).where("source_component = target_component")
    to = _smallest_target(within)
    # where each component's smallest node ends up: the head of its cycle
    state = to.select("relation", "node", "to")
    for _ in range(_doublings(to)):
        ahead = state.select("relation", F.col("node").alias("to"), F.col("to").alias("beyond"))
        state = stored(state.join(ahead, ["relation", "to"]).select("relation", "node", F.col("beyond").alias("to")))
    on = map_cycles(to)
    reached = state.join(label.where("node = component").select("relation", "node", "component"), _KEY).select("relation", F.col("to").alias("node"), "component")
    chosen = stored(reached).join(on, _KEY).select("relation", "head", "component")
    ring = stored(on.join(chosen, ["relation", "head"]).join(to, _KEY))
    # steps to the head, by doubling; the head itself stays
    own = F.col("node") == F.col("head")
    steps = ring.select("relation", "component", "node", "head", F.when(own, F.col("node")).otherwise(F.col("to")).alias("at"), F.when(own, 0).otherwise(1).cast("long").alias("steps"))
    for _ in range(_doublings(ring)):
        ahead = steps.select("relation", F.col("node").alias("at"), F.col("at").alias("beyond"), F.col("steps").alias("more"))
        steps = stored(steps.join(ahead, ["relation", "at"]).select("relation", "component", "node", "head", F.col("beyond").alias("at"), (F.col("steps") + F.col("more")).alias("steps")))
    size = steps.groupBy("relation", "component").agg(F.count("*").alias("n"))
    place = F.when(own, 0).otherwise(F.col("n") - F.col("steps")).cast("long")
    return steps.join(size, ["relation", "component"]).select("relation", "component", place.alias("position"), "node")
