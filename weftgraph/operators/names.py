"""Names that are alike: every pair whose difflib ratio reaches a threshold, found without comparing families member by member.

A ratio r of two names of n and m characters needs M = r(n + m) / 2 matched ones at least, in order, so at most u = n + m - 2M are
unmatched. Digits match digits and other characters match others, so u is spent on two parts: on the skeleton (the name without its digits) and
on the string of its digits. Names of a numbered family have one skeleton and meet by digits alone.

1. Skeletons. Equal ones meet by key. Different ones meet in a prefix-filtered join of their 2-grams: grams are put in one order, rare ones
   first; two skeletons with c common grams at least share one among the first (size - c + 1) of each. What their longest common
   subsequence leaves unmatched is what the digits cannot use. Names so full of digits that no common gram is certain (`a 123456789`,
   `b 123456789`) meet by the lengths of both parts instead, and by digits.
2. Digits. With d and e digits, at least L have to be common. Both names list their digits without (d - L), and (e - L), of them: names that are
   alike have one such string in common. Where these would be over SIGNATURES, one name is cut in pieces more than the other can miss.
3. Candidates have their ratio computed. If no digit needs to be common, families are compared by pattern (each digit as 0): where the longest run
   of other characters that both patterns hold gives the ratio by itself, every pair of members is alike, and one row with the true number
   of links stands for all; difflib takes the longest run first, so it cannot find less. Others are compared in blocks.

Nothing is dropped: no pair of names with the ratio is without a row of its own or of its classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import cut

RATIO = 0.85
#: Digit strings that a name lists for one kind of partner at most; members of a block; rows that may be broadcast.
SIGNATURES, BLOCK, SMALL = 600, 2048, 100_000
#: From so many characters on, difflib leaves frequent ones out, and the longest common run is not certain to be found.
POPULAR = 200


@lru_cache(maxsize=1 << 16)
def unmatched(total: int, threshold: float) -> int:
    """Characters of two names of `total` together that may stay unmatched; -1 if none can be alike."""
    m = max(0, int(threshold * total / 2) - 1)
    while 2.0 * m / total < threshold if total else False:
        m += 1
    return total - 2 * m


@lru_cache(maxsize=1 << 16)
def common_grams(skeleton: int, digits: int, threshold: float) -> int:
    """2-grams that a skeleton of that length shares with that of any name alike; under 1 if that is not certain."""
    n, least = skeleton + digits, skeleton - 1
    for m in range(1, 2 * n + 2):
        u = unmatched(n + m, threshold)
        matched = (n + m - u) // 2
        if matched <= min(n, m):
            least = min(least, skeleton - (n - matched) - u - 1)
    return least


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & place.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def longest_run(a: str, b: str) -> int:
    """The longest string without a digit that is in both."""
    best, row = 0, [0] * (len(b) + 1)
    for c in a:
        new = [0] * (len(b) + 1)
        if not "0" <= c <= "9":
            for j, d in enumerate(b, 1):
                if c == d:
                    new[j] = row[j - 1] + 1
                    best = max(best, new[j])
        row = new
    return best


def digit_keys(digits: str, other: int, spare: int, role: int) -> Iterator[tuple[int, str]]:
    """(role, key) by which digits meet `other` digits with at most `spare` unmatched in both; role 0 or 1, or 2 for both."""
    d = len(digits)
    least = -(-(d + other - spare) // 2)
    if least > min(d, other):
        return
    if max(comb(d, least), comb(other, least)) <= SIGNATURES:
        for kept in {"".join(x) for x in combinations(digits, least)}:
            yield role, kept
        return
    cuts = lambda size: [size * i // (spare + 1) for i in range(spare + 2)]
    if role in (0, 2):
        at = cuts(d)
        for i in range(spare + 1):
            yield 0, f"{i}:{digits[at[i] : at[i + 1]]}"
    if role in (1, 2):
        at = cuts(other)
        for i in range(spare + 1):
            size = at[i + 1] - at[i]
            for part in {digits[s : s + size] for s in range(max(0, at[i] - spare), min(d - size, at[i] + spare) + 1)}:
                yield 1, f"{i}:{part}"


def parts(df: DataFrame) -> DataFrame:
    """Adds a name's skeleton, digits, their lengths and its pattern."""
    out = df.withColumn("skeleton", F.regexp_replace("name", "[0-9]", "")).withColumn("digits", F.regexp_replace("name", "[^0-9]", ""))
    return out.withColumn("ns", F.length("skeleton")).withColumn("nd", F.length("digits")).withColumn("pattern", pattern(F.col("name")))


def pattern(name: Column) -> Column:
    return F.regexp_replace(name, "[0-9]", "0")


def _spare(threshold: float):
    """Digits of both that may stay unmatched, once the skeletons' `gap` is."""

    @F.pandas_udf("int")
    def f(ns_a: pd.Series, nd_a: pd.Series, ns_b: pd.Series, nd_b: pd.Series, gap: pd.Series) -> pd.Series:
        return pd.Series([unmatched(p + q + r + s, threshold) - g for p, q, r, s, g in zip(ns_a, nd_a, ns_b, nd_b, gap, strict=True)], dtype="int32")

    return f("ns_a", "nd_a", "ns_b", "nd_b", "gap")


def _grams_in_common(threshold: float):
    @F.pandas_udf("int")
    def f(ns: pd.Series, nd: pd.Series) -> pd.Series:
        return pd.Series([common_grams(p, q, threshold) for p, q in zip(ns, nd, strict=True)], dtype="int32")

    return f("ns", "nd")


def like_skeletons(skeletons: DataFrame, threshold: float = RATIO) -> DataFrame:
    """skeletons(skeleton, ns, nd most digits, grams fewest in common) -> (s, t, gap): s < t, gap characters unmatched, by the prefix-filtered join."""

    @F.pandas_udf("array<struct<gram: string, nth: int>>")
    def grams(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            seen, row = Counter(), []
            for i in range(len(x) - 1):
                seen[x[i : i + 2]] += 1
                row.append({"gram": x[i : i + 2], "nth": seen[x[i : i + 2]]})
            out.append(row)
        return pd.Series(out)

    @F.pandas_udf("int")
    def gap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(x) + len(y) - 2 * lcs(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")

    each = cut(skeletons.select("skeleton", "ns", "nd", "grams", F.explode(grams("skeleton")).alias("g")).select("skeleton", "ns", "nd", "grams", "g.*"))
    often = each.groupBy("gram", "nth").agg(F.count("*").alias("often"))
    sets = each.join(often, ["gram", "nth"]).groupBy("skeleton", "ns", "nd", "grams").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "nth"))).alias("all"))
    first = sets.select("skeleton", "ns", "nd", F.explode(F.slice("all", 1, F.col("ns") - F.col("grams"))).alias("g")).select("skeleton", "ns", "nd", "g.gram", "g.nth")
    side = lambda c: first.select("gram", "nth", *[F.col(x).alias(f"{x}_{c}") for x in ("skeleton", "ns", "nd")])
    most = F.floor((F.col("ns_a") + F.col("nd_a") + F.col("ns_b") + F.col("nd_b")) * (1 - threshold) + 1e-9)
    met = side("a").join(side("b"), ["gram", "nth"]).where((F.col("skeleton_a") < F.col("skeleton_b")) & (F.abs(F.col("ns_a") - F.col("ns_b")) <= most))
    met = met.select("skeleton_a", "skeleton_b", most.alias("most")).distinct().withColumn("gap", gap("skeleton_a", "skeleton_b"))
    return met.where("gap <= most").select(F.col("skeleton_a").alias("s"), F.col("skeleton_b").alias("t"), "gap")


def _partners(classes: DataFrame, threshold: float) -> DataFrame:
    """Classes (skeleton, nd) that can hold names alike, each unordered pair once: (skeleton_a, ns_a, nd_a, skeleton_b, ns_b, nd_b, spare)."""
    side = lambda c: classes.select(*[F.col(x).alias(f"{x}_{c}") for x in ("skeleton", "ns", "nd", "grams")])
    a, b, spent = side("a"), side("b"), _spare(threshold)
    own = a.join(b, F.col("skeleton_a") == F.col("skeleton_b")).where("nd_a <= nd_b").withColumn("gap", F.lit(0))
    sure = classes.where("grams > 0").groupBy("skeleton", "ns").agg(F.max("nd").alias("nd"), F.min("grams").alias("grams"))
    met = like_skeletons(sure, threshold)
    other = met.join(a, F.col("s") == F.col("skeleton_a")).join(b, F.col("t") == F.col("skeleton_b")).where("grams_a > 0 and grams_b > 0")
    cols = ["skeleton_a", "ns_a", "nd_a", "skeleton_b", "ns_b", "nd_b", "gap"]
    both = own.select(*cols).unionByName(other.select(*cols)).withColumn("spare", spent)
    return both.where(F.col("spare") >= F.abs(F.col("nd_a") - F.col("nd_b")))


def _met(keyed: DataFrame) -> DataFrame:
    """Rows (key columns, role, id, name) -> (a, b, x, y): different ids that meet under a key, the smaller first."""
    keys = [c for c in keyed.columns if c not in ("role", "id", "name")]
    p = keyed.where("role <> 1").select(*keys, "role", F.col("id").alias("p"), F.col("name").alias("p_name"))
    q = keyed.where("role <> 0").select(*keys, F.col("id").alias("q"), F.col("name").alias("q_name"))
    j = p.join(q, keys).where("p <> q and (role < 2 or p < q)")
    low = F.col("p") < F.col("q")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return j.select(pick("p", "q").alias("a"), pick("q", "p").alias("b"), pick("p_name", "q_name").alias("x"), pick("q_name", "p_name").alias("y"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it is small by count; joined by shuffle otherwise."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _keyed(names: DataFrame, routes: DataFrame, on: list[str]) -> DataFrame:
    """Names with the digit keys of each of their routes: (route, key, role, id, name)."""

    @F.pandas_udf("array<struct<role: int, key: string>>")
    def keys(digits: pd.Series, other: pd.Series, spare: pd.Series, role: pd.Series) -> pd.Series:
        return pd.Series([[{"role": r, "key": k} for r, k in digit_keys(*x)] for x in zip(digits, other, spare, role, strict=True)])

    j = names.join(_small(routes), on).select("route", F.explode(keys("digits", "other", "spare", "role")).alias("k"), "id", "name")
    return j.select("route", "k.role", "k.key", "id", "name")


def _routes_of_classes(partners: DataFrame) -> DataFrame:
    """Each class's side of its pairs of classes whose names have digits in common."""
    route = F.concat_ws("\x1f", "skeleton_a", "nd_a", "skeleton_b", "nd_b")
    self = (F.col("skeleton_a") == F.col("skeleton_b")) & (F.col("nd_a") == F.col("nd_b"))
    side = lambda c, d, role: F.struct(F.col(f"skeleton_{c}").alias("skeleton"), F.col(f"nd_{c}").alias("nd"), F.col(f"nd_{d}").alias("other"), F.lit(role).alias("role"))
    return partners.select(route.alias("route"), "spare", F.explode(F.when(self, F.array(side("a", "b", 2))).otherwise(F.array(side("a", "b", 0), side("b", "a", 1)))).alias("x")).select("route", "spare", "x.*")


def _routes_of_lengths(classes: DataFrame, threshold: float) -> DataFrame:
    """Sides of pairs of lengths, for different skeletons one of which has no certain gram."""
    shapes = classes.groupBy("ns", "nd").agg(F.min("grams").alias("grams")).withColumn("n", F.col("ns") + F.col("nd"))
    far = F.floor(F.col("n") * (2 * (1 - threshold) / threshold)).cast("int") + 1
    a = shapes.select(F.col("ns").alias("ns_a"), F.col("nd").alias("nd_a"), F.col("grams").alias("grams_a"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("n") - far), F.col("n") + far)).alias("n"))
    b = shapes.select("n", F.col("ns").alias("ns_b"), F.col("nd").alias("nd_b"), F.col("grams").alias("grams_b"))
    gap = F.when(F.col("ns_a") == F.col("ns_b"), 2).otherwise(F.abs(F.col("ns_a") - F.col("ns_b")))  # of different skeletons
    met = a.join(b, "n").where("(grams_a <= 0 or grams_b <= 0) and ns_a + ns_b > 0").withColumn("gap", gap).withColumn("spare", _spare(threshold)).where("spare >= abs(nd_a - nd_b)")
    low, high = F.struct("ns_a", "nd_a"), F.struct(F.col("ns_b").alias("ns_a"), F.col("nd_b").alias("nd_a"))
    route = F.concat_ws("/", F.least(low, high)["ns_a"], F.least(low, high)["nd_a"], F.greatest(low, high)["ns_a"], F.greatest(low, high)["nd_a"])
    return met.select(F.col("ns_a").alias("ns"), F.col("nd_a").alias("nd"), F.col("nd_b").alias("other"), "spare", F.when(low == high, 2).when(low < high, 0).otherwise(1).alias("role"), route.alias("route"))


def alike(names: DataFrame, threshold: float = RATIO) -> DataFrame:
    """names(id, name), distinct and lower-cased -> (a, b, ratio, links).

    A row with links = 1 is a pair, a < b, with difflib's ratio of the name of a to that of b. Other rows are pairs of patterns (classes), by their smallest
    ids (a = b for a class with itself): all `links` pairs of their members have at least the ratio that is told.
    """
    if not 0.8 <= threshold <= 1:
        raise ValueError("ratios from 0.8 to 1 can be asked for")
    t = cut(parts(names))
    classes = cut(t.groupBy("skeleton", "ns", "nd").agg(F.count("*").alias("n")).withColumn("grams", _grams_in_common(threshold)))
    partners = cut(_partners(classes, threshold).withColumn("least", F.ceil((F.col("nd_a") + F.col("nd_b") - F.col("spare")) / 2)))

    by_class = _met(_keyed(t, _routes_of_classes(partners.where("least > 0")), ["skeleton", "nd"]))
    by_length = _met(_keyed(t, _routes_of_lengths(classes, threshold), ["ns", "nd"]))
    by_length = by_length.where(F.regexp_replace("x", "[0-9]", "") != F.regexp_replace("y", "[0-9]", ""))

    # classes whose names need no digit in common, by pattern
    shapes = cut(t.groupBy("skeleton", "nd", "pattern").agg(F.min("id").alias("head"), F.count("*").alias("n")))
    side = lambda c: shapes.select(*[F.col(x).alias(f"{x}_{c}") for x in shapes.columns])
    loose = partners.where("least <= 0").select("skeleton_a", "nd_a", "skeleton_b", "nd_b")
    loose = loose.join(side("a"), ["skeleton_a", "nd_a"]).join(side("b"), ["skeleton_b", "nd_b"]).where((F.col("skeleton_a") != F.col("skeleton_b")) | (F.col("nd_a") != F.col("nd_b")) | (F.col("pattern_a") <= F.col("pattern_b")))

    @F.pandas_udf("double")
    def proven(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([2.0 * longest_run(p, q) / (len(p) + len(q)) if 0 < len(p) + len(q) and len(q) < POPULAR and len(p) < POPULAR else 0.0 for p, q in zip(x, y, strict=True)], dtype="float64")

    own = F.col("pattern_a") == F.col("pattern_b")
    links = F.when(own, F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
    loose = cut(loose.withColumn("links", links).where("links > 0").withColumn("ratio", F.when(F.col("links") > 1, proven("pattern_a", "pattern_b")).otherwise(0.0)))
    classes_alike = loose.where(F.col("ratio") >= threshold).select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"), "ratio", "links")
    open_ = loose.where(F.col("ratio") < threshold)
    side_of = lambda c, role: F.struct(F.col(f"pattern_{c}").alias("pattern"), F.lit(role).alias("role"))
    grid = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("n_a") * F.col("n_b")) / BLOCK)).cast("int")
    routes = open_.select(F.concat_ws("\x1f", "pattern_a", "pattern_b").alias("route"), grid.alias("grid"), F.explode(F.array(side_of("a", 0), side_of("b", 1))).alias("x")).select("route", "grid", "x.*")
    every, dealt = F.sequence(F.lit(0), F.col("grid") - 1), F.pmod(F.xxhash64("id"), F.col("grid")).cast("int")
    blocks = t.join(_small(routes), "pattern").select("route", "role", "id", "name", F.explode(every).alias("k"), dealt.alias("own"))
    cell = lambda role, x: F.when(F.col("role") == role, F.col("own")).otherwise(F.col("k")).alias(x)
    by_pattern = _met(blocks.select("route", cell(0, "row"), cell(1, "column"), "role", "id", "name"))

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        # what difflib knows of the second name is kept while that stays the same
        out, m, last = [0.0] * len(x), SequenceMatcher(None), None
        names, others = x.tolist(), y.tolist()
        for i in sorted(range(len(others)), key=others.__getitem__):
            if others[i] != last:
                last = others[i]
                m.set_seq2(last)
            m.set_seq1(names[i])
            out[i] = m.ratio()
        return pd.Series(out, dtype="float64")

    candidates = by_class.unionByName(by_length).unionByName(by_pattern).distinct()
    pairs = candidates.select("a", "b", ratio("x", "y").alias("ratio")).where(F.col("ratio") >= threshold).withColumn("links", F.lit(1).cast("long"))
    return pairs.unionByName(classes_alike)
