"""The operators of language, centroids and spelling against brute force, over real rows and hostile ones."""

import hashlib
import math
import random
import zlib
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import langid, pivots, spelling
from weftgraph.llm.queries import QUERIES
from weftgraph.runtime import read, ship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return langid.vocabulary(langid.default_model())


def cuts(word, pieces):
    """All segmentations of a word's symbols, as lists of pieces, by enumeration."""
    number = {p: i for i, p in enumerate(pieces.names)}
    one = [c if c in number else tuple(f"<0x{b:02X}>" for b in c.encode()) for c in langid.MARK + word]
    flat = [x for c in one for x in ((c,) if isinstance(c, str) else c)]

    @lru_cache(None)
    def ways(at):
        if at == len(flat):
            return [[]]
        out = []
        for end in range(at + 1, len(flat) + 1):
            run = flat[at:end]
            p = run[0] if len(run) == 1 else "".join(run) if all(len(x) == 1 for x in run) else None
            if p in number:
                out += [[number[p], *rest] for rest in ways(end)]
        return out

    return ways(0)


def test_the_forward_algorithm_sums_all_segmentations(vocabulary):
    words = ["a", "the", "nation", "straße", "日本", "xqzj", "éléphant", "ციფრი", "undersea", "q" * 9]
    rng = np.random.default_rng(5)
    logs = np.log(rng.dirichlet(np.ones(len(vocabulary)), 3).T)
    got = langid.word_scores(vocabulary, words, logs)
    for w, row in zip(words, got, strict=True):
        want = [math.log(sum(math.exp(sum(logs[p, lang] for p in way)) for way in cuts(w, vocabulary))) for lang in range(3)]
        assert np.allclose(row, want)
    langs, n = np.array([i % 3 for i in range(len(words))]), np.arange(1.0, len(words) + 1)
    counts = langid.expected_counts(vocabulary, words, langs, n, logs)
    want = np.zeros_like(counts)
    for w, lang, k in zip(words, langs, n, strict=True):
        ways = [(math.exp(sum(logs[p, lang] for p in way)), way) for way in cuts(w, vocabulary)]
        for p, way in ways:
            for piece in way:
                want[piece, lang] += k * p / sum(x for x, _ in ways)
    assert np.allclose(counts, want)


def test_a_word_of_any_length_has_a_score(vocabulary):
    logs = langid._logs(np.zeros((len(vocabulary), 2)), 1.0)
    short, long = langid.word_scores(vocabulary, ["ab" * 50, "ab" * 20_000], logs)[:, 0]
    assert np.isfinite(long) and long < 300 * short < 0


def test_letters_are_those_of_isalpha():
    every = "".join(map(chr, [*range(32, 0xD800), *range(0xE000, 0x30000)]))
    assert set("".join(langid.letter_runs(every))) == {c for c in every if c.isalpha()}


def test_languages_held_out(spark):
    rows = QUERIES["op11_langid"](spark, SF).collect()
    told = {r.doc_id: r for r in read(spark, SF, "documents").collect()}
    assert len(rows) == len(told) and {r.doc_id for r in rows} == set(told)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out and told[r.doc_id].lang and any(c.isalpha() for c in told[r.doc_id].text or "")]
    right = sum(r.lang_pred == told[r.doc_id].lang for r in out)
    assert len(out) > 25 and right >= 0.95 * len(out), (right, len(out))
    assert all(0 < r.score <= 1 for r in rows if r.lang_pred != "und")


def test_languages_of_hostile_rows(spark):
    ship(spark)
    learn = [(i, x, t) for i, (x, t) in enumerate([("en", "the nation of the king and the queen"), ("fr", "la nation de la reine et du roi"), ("de", "die straße und der könig")] * 10)]
    odd = [(100, None, None), (101, None, ""), (102, "en", "12 ² ½ !? 34"), (None, "xx", "only nulls learn nothing"), (103, "en", "the king " * 20_000), (104, None, "und die " + "straße" * 5000), (104, None, "roi"), (104, None, "roi"), (105, None, "日本語 ციფრი")]
    docs = spark.createDataFrame([(i, x, t, "s", "clash", 0.5) for i, x, t in learn + odd], "doc_id long, lang string, text string, source string, lang_pred string, score double").repartition(3)
    rows = langid.identify(docs).collect()
    by = Counter((r.doc_id, r.lang_pred) for r in rows)
    assert len(rows) == len(learn) + len(odd)
    assert [by[i, "und"] for i in (100, 101, 102)] == [1, 1, 1] and by[103, "en"] == 1 and by[104, "de"] == 1 and by[104, "fr"] == 2
    assert all(r.score == 0 for r in rows if r.lang_pred == "und") and not any(r.lang_pred == "xx" for r in rows)
    assert all(r.lang_pred == x for r in rows for i, x, _ in learn if i == r.doc_id)
    assert langid.identify(docs.limit(0)).collect() == []
    unlearned = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlearned} == {("und", 0.0)}
    # neither lang, source nor doc_id takes part in a prediction
    model = langid.learn(langid.learnable(docs))
    moved = docs.select((F.col("doc_id") * 7 + 1).alias("doc_id"), F.lit("fr").alias("lang"), "text", F.lit("x").alias("source"))
    same = lambda d: Counter((r.lang_pred, r.score) for r in langid.predict(d, model).collect())
    assert same(docs) == same(moved)
    with pytest.raises(ValueError, match="languages"):
        langid.learn(langid.learnable(docs), max_langs=2)


def plain_clusters(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else m for j, m in enumerate(c)]
    told = [(i, *reversed(near(v))) for i, v in kept]
    total = Counter()
    for _, j, d in told:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in told)


def test_clusters_of_hostile_rows(spark):
    ship(spark)
    rng = random.Random(2)
    near = lambda m: [m + rng.gauss(0, 0.3) for _ in range(64)]
    rows = [(i, near(i % 5)) for i in range(120)] + [(i % 7, near(9)) for i in range(10)] + [(5, [0.5] * 64)] * 6 + [(None, near(2)), (None, None), (200, None), (201, [0.1] * 63), (202, []), (203, [0.0] * 63 + [None]), (204, [math.nan] * 64), (205, [math.inf] + [0.0] * 63), (206, [-0.0] * 64), (207, [-1e4] * 64)]
    df = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, d int").repartition(4)
    rounded = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert Counter(map(tuple, pivots.cluster(df).collect())) == plain_clusters(rounded)
    assert pivots.cluster(df.limit(0)).collect() == []
    few = df.where("vec_id < 3 and vec_id is not null").limit(3)
    assert len(pivots.cluster(few).collect()) == 3
    with pytest.raises(Exception, match="component"):
        pivots.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


def test_bounds_spare_distances_and_never_a_nearest():
    rng = np.random.default_rng(4)
    rows = np.concatenate([rng.integers(-50, 50, (300, 64)) + m for m in (0, 400, 900, 2000)]).astype(np.int64)
    centroids = rows[[0, 1, 310, 620, 930]]
    fixed = pivots.choose(rows[::40], 6)
    table = np.stack([pivots.roots(pivots.squared(rows, p)) for p in fixed], axis=1)
    cluster, best, done = pivots.nearest(rows, table, centroids, np.stack([pivots.roots(pivots.squared(centroids, p)) for p in fixed], axis=1))
    exact = np.stack([pivots.squared(rows, c) for c in centroids], axis=1)
    assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert done < 0.6 * exact.size  # the pivot table did leave centroids out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rng, n, letters, longest):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)})


@pytest.mark.parametrize("letters,longest", [("ab", 7), ("abc", 5), ("aé", 9), ("abcdefgh", 3)])
def test_composition_accepts_the_pairs_one_edit_apart(letters, longest):
    words = words_of(random.Random(1), 400, letters, longest)
    got = [tuple(sorted(p)) for p in spelling.Composition(spelling.Acceptor(words)).pairs().tolist()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for (i, a), (j, b) in combinations(enumerate(words), 2) if near(a, b)}


def test_the_acceptor_is_minimal():
    endings = ["ing", "ed", "er", "ers"]
    a = spelling.Acceptor(sorted(s + e for s in ("talk", "walk", "bark") for e in endings))
    assert len(a.arcs) == 12 and a.count[a.start] == 12  # talk and walk share all behind their first letter, all three their endings


@pytest.mark.parametrize("limit", [3, 40, 4096])
def test_partitions_of_any_size_give_the_same_pairs(spark, limit):
    rng = random.Random(6)
    words = words_of(rng, 150, "abc", 6) + words_of(rng, 60, "xyé", 8) + ["prefix" * 3 + w for w in words_of(rng, 40, "ab", 4)] + ["q" * 3000, "q" * 3001, "q" * 2999 + "r"]
    words = sorted({w for w in words if w})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long").repartition(3)
    got = Counter((r.word, r.other, r.other_n) for r in spelling.near_pairs(table, limit).collect())
    want = Counter()
    for (i, a), (j, b) in combinations(enumerate(words), 2):
        if near(a, b):
            want[a, b, j] += 1
            want[b, a, i] += 1
    assert got == want
    for r in spelling.forms(table, 2, limit).collect():
        links = sorted((-k, o) for (w, o, k) in want if w == r.word)
        n = words.index(r.word)
        best = links[0] if links and -links[0][0] >= 2 * n else None
        assert (r.n, r.n_near, r.form, r.form_n) == (n, len(links), best and best[1], best and -best[0])


def test_variants_of_hostile_rows(spark):
    ship(spark)
    base = "Colours " * 130 + "colour " * 26 + "colourz " * 5 + "xcolourz " * 5 + "short über12größen " * 6
    rows = [(1, base), (2, base), (2, base), (None, "nullid " * 6), (None, None), (3, None), (4, ""), (5, "Straßen×größen÷ " * 9), (6, "A" * 30_000 + " " + ("B" * 30_000 + " ") * 5 + ("B" * 29_999 + " ") * 25)]
    rows += [(i, "garbled ") for i in range(1000, 1600)]
    docs = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    counts = Counter()
    for i, t in rows:
        for w in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in t or "").split():
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    links = {w: sorted((-n[o], o) for o in n if near(w, o)) for w in n}
    form = {w: x[0][1] if x and -x[0][0] >= 5 * n[w] else None for w, x in links.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    want = Counter((w, form[w], root(w), n[w], len(links[w]), n[form[w]] if form[w] else None) for w in n)
    assert Counter(map(tuple, spelling.variants(docs).collect())) == want
    assert root("xcolourz") == "colours" or root("colour") == "colours"
    assert spelling.variants(docs.limit(0)).collect() == []
