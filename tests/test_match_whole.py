"""Names that are alike, against difflib over all pairs."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from weftgraph.catalog import QUERIES
from weftgraph.operators import match, names
from weftgraph.operators.names import RATIO
from weftgraph.plans import testgraph
from weftgraph.schema import KnowledgeSet

SF = "/root/testdata/sf0.001"


def alike(rows, threshold=RATIO):
    """{(a, b): ratio} of (id, name), every pair."""
    rows, out = sorted(rows), {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            m = SequenceMatcher(None, x, y)
            if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
                out[a, b] = m.ratio()
    return out


def check(df, rows, threshold=RATIO):
    """Rows of one link are pairs with their ratio; rows of several stand for the pairs between two patterns, all of them and no others."""
    want, told = alike(rows, threshold), df.collect()
    pairs = {(r.a, r.b): r.ratio for r in told if r.links == 1}
    assert len(pairs) == sum(r.links == 1 for r in told)
    members, head = {}, {}
    for i, x in sorted(rows):
        p = "".join("0" if "0" <= c <= "9" else c for c in x)
        members.setdefault(p, []).append(i)
        head[members[p][0]] = p
    for r in told:
        if r.links > 1:
            between = {(min(a, b), max(a, b)) for a in members[head[r.a]] for b in members[head[r.b]] if a != b}
            assert len(between) == r.links and not between & pairs.keys()
            assert all(want[p] >= r.ratio - 1e-12 for p in between)
            pairs |= {p: want[p] for p in between}
    assert pairs == want
    return told


def test_names_of_all_domains_are_matched(spark):
    first = {}
    for r in sorted(testgraph.knowledge(spark, SF).entities.select("id", "name", "domain").collect(), key=lambda r: r.id):
        if r.name is not None:
            first.setdefault(r.name.lower(), r.id)
    told = check(QUERIES["match_name"](spark, SF), [(i, x) for x, i in first.items()])
    every = {(r.a, r.b) for r in QUERIES["match_all"](spark, SF).collect()}
    assert {(r.a, r.b) for r in told} <= every


@pytest.mark.parametrize("signatures,block", [(600, 2048), (5, 3)])
def test_planted_names(spark, monkeypatch, signatures, block):
    monkeypatch.setattr(names, "SIGNATURES", signatures)
    monkeypatch.setattr(names, "BLOCK", block)
    rng = random.Random(8)
    some = ["part 1", "part 9876543", "part 12", "a 123456789", "b 123456789", "a 123456780", "", "x", "xy", "7", "77", "0123456789", "0123456798", "#0123456789", "!0123456789", "abc", "abcd", "bcd", "heat flow", "heat flux", "flow heat", "ab ab ab ab ab", "abababab ab ab"]
    some += [f"international customer {i}" for i in range(12)] + [f"customer#{i:09}" for i in rng.sample(range(10**4), 60)] + [f"{i:012}" for i in rng.sample(range(300), 20)]
    some += [f"lot {rng.randrange(10**9)} of {rng.randrange(100)}" for _ in range(20)] + [f"l{i}t {i} of 3 long boxes" for i in range(9)] + ["n" * 240 + str(i) for i in range(4)]
    some += ["".join(rng.choice("ab1") for _ in range(rng.randint(3, 14))) for _ in range(120)]
    for x in some[:]:
        if x and rng.random() < 0.4:
            i = rng.randrange(len(x))
            some.append(x[:i] + rng.choice(["", "q", "5", x[i] * 2]) + x[i + 1 :])
    rows = [(f"e{i:04}", x) for i, x in enumerate(dict.fromkeys(some))]
    told = check(names.alike(spark.createDataFrame(rows, "id string, name string")), rows)
    assert any(r.links > 1 for r in told) == (signatures == 600) or signatures == 5


def test_families_meet_in_few_candidates():
    """Of a family of 3,000 numbers, those that meet under a key are near the pairs that are alike, not all pairs."""
    rng = random.Random(3)
    family = [f"{i:09}" for i in rng.sample(range(10**9), 3000)]
    keys = Counter(k for d in family for k in names.digit_keys(d, 9, 4, 2))
    met = sum(n * (n - 1) // 2 for n in keys.values())
    assert met < 0.03 * 3000 * 2999 / 2


def test_thresholds_that_are_not_proven_raise(spark):
    with pytest.raises(ValueError, match="ratios"):
        names.alike(spark.createDataFrame([("a", "b")], "id string, name string"), 0.5)


def test_aliases_met_in_blocks(spark, monkeypatch):
    """One alias of many, entities of several aliases and names, and no shuffle of the pairs but for those."""
    rows = [(f"a{i}", f"n{i}", ["Many", "x"] if i % 3 else ["many"]) for i in range(30)] + [(f"b{i}", "MANY", None) for i in range(20)] + [("b1", "X", ["n3"]), ("b1", "many", []), ("a7", "many", ["n3", "N3"])]
    e = spark.createDataFrame(rows, "id string, name string, aliases array<string>")
    want = {(p, q) for p, _, al in rows for q, n, _ in rows for x in al or [] if x.lower() == n.lower() and p != q}
    monkeypatch.setattr(match, "BLOCK", 5)
    got = [tuple(r) for r in match.match_alias(KnowledgeSet(e, None)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = match.match_alias(KnowledgeSet(e, None))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Union") and plan[1].startswith(":- Project [a#")  # the most of the pairs is not aggregated
