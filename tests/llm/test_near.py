import random
from itertools import combinations

from weftgraph.llm import near
from weftgraph.runtime import read, ship

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows):
    own = {i: shingles(t) for i, t in rows}
    top = {i: i for i in own}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(own), 2):
        x, y = own[a], own[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((root(a), root(b)))
            top[b] = a
    return {i: root(i) for i in own}


def test_stage_finds_all_pairs_from_four_fifths_on(spark):
    import corpus_pipeline

    ship(spark)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    for base in range(40):
        w = [word() for _ in range(rng.choice([4, 9, 60, 200]))] + (passage if base % 2 else [])
        rows.append((10_000 + 100 * base, " ".join(w)))
        for copy in range(1, 6):
            v = list(w)
            for at in rng.sample(range(len(v)), min(len(v), copy * len(v) // 60)):
                v[at] = word()
            rows.append((10_000 + 100 * base + copy, " ".join(v)))
    hot = [word() for _ in range(120)]  # many copies, each near the middle and not near each other
    for i in range(300):
        v = list(hot)
        for at in rng.sample(range(0, 120, 5), 2):
            v[at] = word()
        rows.append((20_000 + i, " ".join(v)))
    rows += [(20_500, " ".join(hot)), (30_000, None), (30_001, ""), (30_002, " \n"), (30_003, "one two"), (30_004, "ONE  two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near.groups(df).collect()}
    assert got == want
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, SF).collect()}
    assert left == {i for i, c in want.items() if i == c}


def test_repeated_and_null_ids(spark):
    ship(spark)
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (1, "other words"), (2, text + " end"), (None, text), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near.keep_one(df).collect()), key=str) == sorted([r for r in rows if r[0] != 2], key=str)
    assert near.keep_one(df.limit(0)).count() == 0
