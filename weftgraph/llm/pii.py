"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans (email, ip, card, phone) come from fixed patterns. The method then goes on from them:
  1. occurrences: phone and card numbers, and tokens with a digit or an @, each with its lexical patterns (the one
     and the two words before it); an occurrence that is personal data by its own text is a seed of that kind;
  2. the graph has patterns on one side and instances (the lower-cased texts of occurrences) on the other, one edge for
     each two that meet, however often they do. In rounds, a pattern's confidence in a kind is the share of its
     instances that are believed to be of that kind, smoothed by half an instance that is not; with MIN_CONFIDENCE and
     MIN_SEEDS different believed instances it is accepted, and instances that it precedes are believed from then on,
     so they lend confidence to further patterns. Rounds end when nothing new is believed;
  3. every occurrence of a believed instance is a span of kind `context`, wherever it stands.
Instances of under MIN_DIGITS digits and without an @ (years, counts, rooms) are counted but never believed.

Confidence only grows from round to round, so there is one fixpoint. Edges are grouped with partial aggregation, so a
frequent pattern, or a text copied many times, is no hot group.

Cases: null and empty texts have no spans; very long texts are handled whole: places of matches come from running sums
of the lengths between them, in blocks of the square root of their number, so nothing is scanned from the front again;
repeated rows each get a row and count as one instance; a null doc_id stays null; an empty table gives no rows; columns
other than doc_id and text are ignored by find() and kept by redaction(), whatever their names. Starts and ends are
code points, ends exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.arrays import once, running
from weftgraph.runtime import cut, unused

KINDS = ["email", "ip", "card", "phone", "context"]

#: The fixed patterns, with possessive runs where nothing can be given back, and started only where the run
#: before ends, or the last match did: the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every match's text passes.
SIGNS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){11}[0-9]", "phone": r"\+[0-9][\x20().0-9-]"}

#: What may identify someone: a phone number, a card number in groups, or a token with a digit or an @.
OCCURRENCE = (
    r"\+[0-9][\x20().0-9-]+[0-9]|(?<![A-Za-z0-9@+#._%-])[0-9]{4}(?:[\x20-][0-9]{3,6}){2,4}(?![A-Za-z0-9@])"
    r"|(?<![A-Za-z0-9@+#._%-])(?=[A-Za-z+#._%-]*+[0-9@])[A-Za-z0-9@+#._%-]*+[A-Za-z0-9]"
    r"|(?<![A-Za-z0-9@+#._%-])(?=[A-Za-z+#._%-]*+[0-9@])[A-Za-z0-9@+#._%-]++"
)

MIN_DIGITS, MIN_SEEDS, MIN_CONFIDENCE = 5, 3, 0.8

SPAN = "struct<start: long, end: long, kind: string>"


MATCH = "array<struct<gap: string, m: string, start: long, end: long>>"


def matches(text: Column, pattern: str, sign: str | None = None) -> Column:
    """array<struct<gap, m, start, end>>: matches, the text between each and the one before, and their places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(x):
        pairs = F.arrays_zip(x["gap"], x["m"])
        sizes = F.flatten(F.transform(pairs, lambda p: F.array(F.length(p["gap"]).cast("long"), F.length(p["m"]).cast("long"))))
        # places 2k + 1 and 2k + 2 of the running sums are the start and the end of match k
        return once(running(sizes), lambda at: F.transform(pairs, lambda p, k: F.struct(p["gap"].alias("gap"), p["m"].alias("m"), F.get(at, 2 * k + 1).alias("start"), F.get(at, 2 * k + 2).alias("end"))))

    cut_up = lambda m: F.struct(F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("gap"), m.alias("m"))
    return F.when(text.rlike(sign or pattern), once(once(found, cut_up), placed)).otherwise(F.array().cast(MATCH))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _ok(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(12, 19) & F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda x: _ok(kind, x["m"])


def _labeller(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column) -> Column:
    empty = F.array().cast(f"array<{SPAN}>")
    each = [F.transform(F.filter(matches(text, PATTERNS[kind], SIGNS[kind]), _checker(kind)), _labeller(kind)) for kind in KINDS[:4]]
    return F.coalesce(F.concat(*each), empty)


def _rank(kind: Column) -> Column:
    return reduce(lambda a, k: F.when(kind == k[1], k[0]).otherwise(a), enumerate(KINDS), F.lit(len(KINDS)))


def in_order(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def kind_of(m: Column) -> Column:
    """The kind that a text is by itself: it holds a match of a fixed pattern that passes its check."""
    holds = lambda kind: m.rlike(SIGNS[kind]) & F.exists(F.regexp_extract_all(m, F.lit(PATTERNS[kind]), F.lit(0)), lambda x: _ok(kind, x))
    out = F.when(m.contains("@"), F.when(m.rlike(PATTERNS["email"]), "email"))
    others = F.when(F.length(m) > 6, F.when(holds("phone"), "phone").when(holds("ip"), "ip").when(holds("card"), "card"))
    return F.coalesce(out, others)


def occurrences(text: Column) -> Column:
    """array<struct<start, end, inst, kind, open, patterns>> of a text; open: the instance may become believed."""

    def one(x):
        words = F.filter(F.split(F.lower(x["gap"]), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        # another occurrence right before counts as the word #
        last, first = F.get(words, F.size(words) - 1), F.coalesce(F.get(words, F.size(words) - 2), F.lit("#"))
        patterns = F.when(last.isNotNull(), F.array(F.concat(F.lit("1 "), last), F.concat(F.lit("2 "), first, F.lit(" "), last)))
        handle = x["m"].rlike(r"[A-Za-z0-9]@[A-Za-z0-9]")
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lower(x["m"]).alias("inst"), kind_of(x["m"]).alias("kind"),
            ((F.length(_digits(x["m"])) >= F.lit(MIN_DIGITS)) | handle).alias("open"), F.coalesce(patterns, F.array().cast("array<string>")).alias("patterns"),
        )

    return F.transform(matches(text, OCCURRENCE, "[0-9@]"), one)


def believe(edges: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(pattern, inst, kind or null for no seed, open) -> (inst, kind): the instances that are no seeds and are believed in the end.

    An instance that is a seed of some kind is never believed to be of another.
    """
    edges = cut(edges.groupBy("pattern", "inst").agg(F.min("kind").alias("seed"), F.max("open").alias("open")))
    width = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    known = edges.where("seed is not null").select("inst", F.col("seed").alias("kind")).distinct()
    waiting = cut(edges.where("seed is null and open").select("pattern", "inst"))
    found, size = None, 0
    while True:
        share = edges.select("pattern", "inst").join(known, "inst").groupBy("pattern", "kind").agg(F.count("*").alias("good")).where(F.col("good") >= min_seeds)
        accepted = share.join(width, "pattern").where(F.col("good") / (F.col("n") + 0.5) >= min_confidence).select("pattern", "kind", (F.col("good") / (F.col("n") + 0.5)).alias("confidence"))
        # of several kinds, that of the surest pattern
        each = waiting.join(accepted, "pattern").groupBy("inst").agg(F.max(F.struct("confidence", "kind")).alias("best"))
        found = cut(each.select("inst", F.col("best.kind").alias("kind")))
        now = found.count()
        if now == size:
            return found
        size, known = now, known.where("kind is not null").select("inst", "kind").unionByName(found).groupBy("inst").agg(F.min("kind").alias("kind"))


def find(docs: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, keys: tuple = ("doc_id",)) -> DataFrame:
    """(keys, spans array<struct<start, end, kind>>) of each row, in order of start, then of kind as listed."""
    whole, row, base, occ = unused(keys, "whole", "row", "base", "occ")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    scanned = docs.select(*keys, text.alias(whole)).select(*keys, base_spans(F.col(whole)).alias(base), occurrences(F.col(whole)).alias(occ))
    scanned = cut(scanned.withColumn(row, F.monotonically_increasing_id()))
    each = scanned.select(F.col(row).alias("row"), F.explode(occ).alias("o")).select("row", "o.*")
    found = believe(each.select(F.explode("patterns").alias("pattern"), "inst", "kind", "open"), min_seeds, min_confidence)
    hits = each.where("kind is null and open").join(found.select("inst"), "inst")
    more = hits.groupBy("row").agg(F.collect_set(F.struct("start", "end", F.lit("context").alias("kind"))).alias("more")).withColumnRenamed("row", f"{row}_")
    out = scanned.select(row, *keys, base).join(more, F.col(row) == F.col(f"{row}_"), "left")
    return out.select(*keys, in_order(F.concat(F.col(base), F.coalesce("more", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def join_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "context")
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS], F.sha2(join_spans(base), 256).alias("base_sha256"), join_spans(F.col("spans")).alias("spans"))


#: Texts are cut into pieces of so many characters to take parts out of them without counting from the front.
PIECE = 512


def _redacted(text: Column, spans: Column) -> Column:
    """The text, spans (in order of start) replaced by [kind]; a span that begins inside an earlier one goes with it."""

    def part(pieces, a, b):
        lo, hi = F.floor(a / PIECE), F.floor((b - 1) / PIECE)
        return F.when(b > a, F.substring(F.array_join(F.slice(pieces, (lo + 1).cast("int"), (hi - lo + 1).cast("int")), ""), (a - lo * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def build(pieces, upto):
        # upto: the furthest end before each span; a span that begins from there on is preceded by the text between
        each = F.transform(F.arrays_zip(spans.alias("s"), F.slice(upto, 1, F.size(spans)).alias("u")), lambda x: F.when(x["s"]["start"] >= x["u"], F.concat(part(pieces, x["u"], x["s"]["start"]), F.lit("["), x["s"]["kind"], F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(each, ""), part(pieces, F.element_at(upto, -1), F.length(text).cast("long")))

    return once(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: once(running(spans["end"], lambda p, q: F.greatest(p, q)), lambda upto: build(pieces, upto)))


def redaction(docs: DataFrame) -> DataFrame:
    """The documents, spans replaced by [kind], all columns kept; `n_chars`, if there, follows.

    Spans go back to documents by doc_id (null equal to null) and the text's hash, so repeated ids do no harm.
    """
    i, h, i2, h2, s = unused(docs.columns, "id", "hash", "found_id", "found_hash", "spans")
    own = docs.withColumns({i: F.col("doc_id"), h: F.xxhash64("text")})
    found = find(own.select(i, h, "text"), keys=(i, h)).where("size(spans) > 0").groupBy(i, h).agg(F.first("spans").alias(s)).withColumnsRenamed({i: i2, h: h2})
    joined = own.join(found, F.col(i).eqNullSafe(F.col(i2)) & (F.col(h) == F.col(h2)), "left")
    out = joined.withColumn("text", F.when(F.col(s).isNotNull(), _redacted(F.col("text"), F.col(s))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(s).isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
