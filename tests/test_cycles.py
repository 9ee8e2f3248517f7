"""Strong components and closures of graphs that enumeration would not finish on."""

import random
from collections import defaultdict

from weftgraph import schema
from weftgraph.operators import cycles, graph


def reach(edges):
    to = defaultdict(set)
    for a, b in edges:
        to[a].add(b)
    out = {}
    for a in list(to):
        seen, todo = set(), [a]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out[a] = seen
    return out


def strong(edges):
    r = reach(edges)
    return {a: min(b for b in r[a] if a in r.get(b, ())) for a in r if a in r[a]}


def check(spark, edges):
    df = spark.createDataFrame([(k, f"n{a:04}", f"n{b:04}") for k, a, b in edges], "relation string, source string, target string").repartition(3)
    label = cycles.components(df)
    got = {(r.relation, r.node): r.component for r in label.collect()}
    want = {}
    for k in {k for k, _, _ in edges}:
        want |= {(k, f"n{a:04}"): f"n{c:04}" for a, c in strong([(a, b) for x, a, b in edges if x == k]).items()}
    assert got == want
    rings = defaultdict(list)
    for r in cycles.witnesses(df, label).collect():
        rings[r.relation, r.component].append((r.position, r.node))
    assert set(rings) == {(k, c) for (k, _), c in want.items()}
    there = {(k, f"n{a:04}", f"n{b:04}") for k, a, b in edges}
    for (k, c), ring in rings.items():
        nodes = [n for _, n in sorted(ring)]
        assert [p for p, _ in sorted(ring)] == list(range(len(ring))) and nodes[0] == min(nodes) and len(set(nodes)) == len(nodes)
        assert all((k, a, b) in there for a, b in zip(nodes, nodes[1:] + nodes[:1], strict=True)) and {want[k, n] for n in nodes} == {c}
    return rings


def test_a_long_cycle_and_a_dense_core(spark):
    ring = [("r", i, (i + 1) % 100) for i in range(100)]
    dense = [("d", a, b) for a in range(30) for b in range(30) if a != b]
    tails = [("r", 200 + i, 201 + i) for i in range(5)] + [("r", 205, 7), ("r", 50, 300), ("d", 3, 99), ("d", 77, 77), ("r", 301, 301)]
    rings = check(spark, ring + dense + tails)
    assert len(rings["r", "n0000"]) == 100


def test_random_graphs(spark):
    rng = random.Random(4)
    check(spark, [(k, rng.randrange(60), rng.randrange(60)) for k, n in (("a", 60), ("b", 90), ("c", 200), ("e", 30)) for _ in range(n)])


def test_no_edges(spark):
    assert cycles.components(spark.createDataFrame([], "relation string, source string, target string")).count() == 0


def test_closure_of_a_long_chain(spark):
    row = {f.strip().split(" ")[0]: None for f in schema.CONNECTIONS.split(",")}
    n = 1000
    edges = [row | {"id": f"e{i}", "source": f"n{i:04}", "relation": "part_of", "target": f"n{i + 1:04}"} for i in range(n)] + [row | {"id": "x", "source": "n0000", "relation": "part_of", "target": "n0002"}]
    names = [f.strip().split(" ")[0] for f in schema.CONNECTIONS.split(",")]
    kg = schema.KnowledgeSet(None, spark.createDataFrame([tuple(e[c] for c in names) for e in edges], schema.CONNECTIONS), relations=spark.createDataFrame(schema.REGISTRY, schema.RELATIONS))
    out = graph.transitive_closure(kg)
    assert out.count() == n * (n + 1) // 2 - n - 1
    last = out.where(f"source = 'n0000' and target = 'n{n:04}'").first()
    assert list(last.path) == ["n0000"] + [f"n{i:04}" for i in range(2, n + 1)]
