"""Quality rules as a learned decision list, in DataFrame operations only.

Statistics of each text are columns. Sequential covering learns from the labelled rows: a rule is a conjunction of
thresholds, grown one condition at a time by information gain on two thirds of the labelled rows, pruned from
its end on the other third, and kept if it is precise enough on all of them; rows that it covers are
taken out and the next rule is learned from the rest. Each step is one grouped aggregation over the labelled
rows, whose result has at most one row for each feature and cut point. The list becomes an ordered
conditional expression: the first rule that holds rejects; where none does, the text is kept.

Cases: null and empty texts have no words and fail the base rule; very long texts are counted whole; labels of
unknown documents, null labels, or no labels at all, leave the base rule only; repeated rows each get a row and
count as often in learning; a null doc_id is never labelled; an empty table gives no rows; other columns
than doc_id and text are ignored by judge() and kept by clean().
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.runtime import cut, unused

_SPACE = " \t\n\x0b\x0c\r"
_SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEATURES = ["symbol_ratio", "mean_word", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio", "log_words"]
CUTS = 32
MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION = 10, 3, 5, 0.97


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more, by 64-bit hashes of the windows."""
    n = F.size(words)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<long>"))
    return windows


def _covered(windows: Column) -> Column:
    keyed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s):
        again = F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull())
        return F.array_sort(again)

    # the last step of an aggregate binds the sorted array, so that it is sorted once
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    gaps = once(once(keyed, places), lambda p: F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(gaps).cast("long")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns, the counts of each row's text, and FEATURES."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", *keep, text.alias("__text"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    df = df.withColumns({"__words": F.filter(F.split("__text", _SPACES), lambda w: w != ""), "__lines": lines})
    df = df.withColumn("__windows", repeated_words(F.col("__words")))
    size = F.length("__text").cast("long")
    without = lambda chars: F.length(F.translate("__text", chars, "")).cast("long")
    df = df.select(
        "doc_id", *keep,
        F.size("__words").cast("long").alias("n_words"),
        without(_SPACE).alias("word_chars"),
        (size - without(SYMBOLS)).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("__n_lines"),
        _covered(F.col("__windows")).alias("n_repeat_words"),
        (size - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("__upper"),
        (size - without("!?")).alias("__marks"),
    )
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return df.withColumns({
        "symbol_ratio": per("n_symbols", "n_words"), "mean_word": per("word_chars", "n_words"), "dup_line_ratio": per("n_dup_lines", "__n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"), "upper_ratio": per("__upper", "word_chars"), "mark_ratio": per("__marks", "n_words"),
        "log_words": F.log1p(F.col("n_words").cast("double")),
    }).drop("__upper", "__marks", "__n_lines")


Condition = tuple[str, str, float]


def _holds(c: Condition) -> Column:
    return F.col(c[0]) > c[2] if c[1] == ">" else F.col(c[0]) <= c[2]


def rule_column(rule: list[Condition]) -> Column:
    return reduce(lambda a, c: a & _holds(c), rule[1:], _holds(rule[0]))


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule rejects; an ordered conditional expression."""
    out = F
    for rule in rules:
        out = out.when(rule_column(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def _cuts(labelled: DataFrame) -> dict[str, list[float]]:
    shares = [i / CUTS for i in range(1, CUTS)]
    row = labelled.agg(*[F.percentile_approx(f, shares, 2000).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(row[f] or [])) for f in FEATURES}


def _counts(rows: DataFrame, conditions: dict[str, list[float]]) -> tuple[tuple[int, int], dict[Condition, tuple[int, int]]]:
    """(rejects, others) in all, and of each condition, from one aggregation by feature and bin."""
    bins = [F.struct(F.lit(i).alias("f"), sum(((F.col(f) > c).cast("int") for c in cs), F.lit(0)).alias("bin")) for i, (f, cs) in enumerate(conditions.items())]
    tally = rows.select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    names, out, total = list(conditions), {}, (0, 0)
    for i, f in enumerate(names):
        own = {r["bin"]: (r["p"], r["n"]) for r in tally if r["f"] == i}
        total = tuple(sum(v[k] for v in own.values()) for k in (0, 1))
        for b, c in enumerate(conditions[f]):
            low = tuple(sum(v[k] for x, v in own.items() if x <= b) for k in (0, 1))
            out[f, "<=", c], out[f, ">", c] = low, (total[0] - low[0], total[1] - low[1])
    return total, out


def learn(labelled: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION) -> list[list[Condition]]:
    """Rules from rows with FEATURES, bad (1: reject, 0: keep) and fold (0 and 1: grow, 2: prune)."""
    conditions = _cuts(labelled)
    conditions = {f: cs for f, cs in conditions.items() if cs}
    rules: list[list[Condition]] = []
    if not conditions:
        return rules
    left = labelled
    for _ in range(max_rules):
        rule: list[Condition] = []
        rows = left.where("fold < 2")
        while len(rule) < max_conditions:
            (p, n), found = _counts(rows, conditions)
            if not p or not n:
                break
            gain = lambda v, p=p, n=n: v[0] * (math.log2(v[0] / (v[0] + v[1])) - math.log2(p / (p + n))) if v[0] >= MIN_COVER else -1.0
            best = max(found, key=lambda c: (gain(found[c]), c))
            if gain(found[best]) <= 0 or best in rule:
                break
            rule.append(best)
            rows = rows.where(_holds(best))
        if not rule:
            break
        # every prefix of the rule on the pruning rows and on all, in one aggregation
        heads = [rule_column(rule[: i + 1]) for i in range(len(rule))]
        sums = [F.sum(F.when(h & c, 1).otherwise(0)) for h in heads for c in (
            (F.col("fold") == 2) & (F.col("bad") == 1), (F.col("fold") == 2) & (F.col("bad") == 0), F.col("bad") == 1, F.col("bad") == 0)]
        got = [x or 0 for x in left.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        worth = []
        for i in range(len(rule)):
            p, n, allp, alln = got[4 * i : 4 * i + 4]
            worth.append(((p - n) / (p + n) if p + n else -1.0, allp / (allp + alln) >= min_precision if allp >= MIN_COVER else False))
        good = [i for i, (w, ok) in enumerate(worth) if ok]
        if not good:
            break
        end = max(good, key=lambda i: (worth[i][0], -i))
        rules.append(rule[: end + 1])
        left = left.where(~rule_column(rules[-1]))
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def train(stats: DataFrame, labels: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION) -> list[list[Condition]]:
    """The list for the rows that the base rule lets through, from their labels (quality 0: reject)."""
    known = labels.where("quality is not null").select("doc_id", (1 - F.col("quality").cast("int")).alias("bad"))
    rows = stats.where(~base_failed()).join(known, "doc_id").select(*FEATURES, "bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"))
    return learn(cut(rows), max_rules, max_conditions, min_precision)


def judge(docs: DataFrame, labels: DataFrame, *keep: str, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION) -> DataFrame:
    """Each row's counts, base_failed and kept, with the features they rest on.

    Covering stops at max_rules rules of at most max_conditions conditions, or earlier, where no rule is precise enough.
    """
    stats = cut(statistics(docs, *keep))
    rules = train(stats, labels, max_rules, max_conditions, min_precision)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, all columns. Rows are told apart by doc_id and their text's hash."""
    h, i, g = unused(docs.columns, "hash", "id", "found")
    own = docs.withColumn(h, F.xxhash64("text"))
    gone = judge(own, labels, h).where(~F.col("kept")).select(F.col("doc_id").alias(i), F.col(h).alias(g)).distinct()
    return own.join(gone, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(g)), "left_anti").drop(h)
