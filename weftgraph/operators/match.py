"""Matching of entities, and claims mined from text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.arrays import once, running
from weftgraph.operators import names
from weftgraph.operators.names import RATIO
from weftgraph.runtime import stored, unused
from weftgraph.schema import KnowledgeSet


def _first_of(df: DataFrame, key: str) -> DataFrame:
    """Rows that share a key with an earlier one: (first, id), first by id."""
    g = df.groupBy(key).agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return df.join(g, key).where(F.col("id") != F.col("first")).select(F.col("first").alias("a"), F.col("id").alias("b"))


def match_symbol(kg: KnowledgeSet) -> DataFrame:
    e = kg.entities.select("id", F.lower(F.trim("symbol")).alias("key")).where("key <> ''")
    return _first_of(e, "key")


def match_equation(kg: KnowledgeSet) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.lower("equation"), r"\s+", ""), "[·×]", "*")
    return _first_of(kg.entities.select("id", key.alias("key")).where("key <> ''"), "key")


#: Pairs of a block of one alias: the square of this number.
BLOCK = 2048


def match_alias(kg: KnowledgeSet) -> DataFrame:
    """An alias that is another entity's name; here a subdomain serves where there are no aliases.

    An alias that many have and many are named by is met block by block. Pairs are told once without being compared with each other, but for those of an entity
    of several aliases with one of several names.
    """
    alias = F.explode("aliases") if "aliases" in kg.entities.columns else F.col("subdomain")
    a = kg.entities.select(F.col("id").alias("a"), alias.alias("name")).select("a", F.lower("name").alias("name")).where("name is not null").distinct()
    b = kg.entities.select(F.col("id").alias("b"), F.lower("name").alias("name")).where("name is not null").distinct()
    b = b.join(a.select("name").distinct(), "name", "left_semi")
    many = lambda df, c: df.groupBy(c).agg((F.count("*") > 1).alias(f"{c}_many"))
    a, b = stored(a.join(many(a, "a"), "a")), stored(b.join(many(b, "b"), "b"))
    size = lambda df, c: df.groupBy("name").agg(F.count("*").alias(f"n_{c}"))
    grid = size(a, "a").join(size(b, "b"), "name").select("name", F.ceil(F.sqrt(F.col("n_a") * F.col("n_b")) / BLOCK).cast("int").alias("grid"))
    every, own = F.explode(F.sequence(F.lit(0), F.col("grid") - 1)), lambda c: F.pmod(F.xxhash64(c), F.col("grid")).cast("int")
    left = a.join(grid, "name").select("a", "a_many", "name", own("a").alias("row"), every.alias("column"))
    right = b.join(grid, "name").select("b", "b_many", "name", every.alias("row"), own("b").alias("column"))
    met = left.join(right, ["name", "row", "column"]).where("a <> b")
    again = F.col("a_many") & F.col("b_many")
    return met.where(~again).select("a", "b").unionByName(met.where(again).select("a", "b").distinct())


def match_cross_domain(kg: KnowledgeSet) -> DataFrame:
    g = kg.entities.groupBy(F.lower("name").alias("name")).agg(F.count_distinct("domain").alias("n_domains"), F.count("*").alias("n"), F.min("id").alias("first_id"))
    return g.where("n_domains > 1")


def _grams(name: Column, n: int) -> Column:
    return F.when(F.length(name) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float = RATIO, salt: int = 8, ordered: bool = False) -> DataFrame:
    """left(a, name), right(b, name), distinct names -> (a, b, ratio) with difflib's ratio at least the threshold (0.85 or more).

    Lossless blocking: at 0.85 two names share a 3-gram, or a 2-gram if their lengths sum to at most 16, or are
    equal; and the shorter has at least 0.739 of the longer's length. A frequent gram's block is split by a salt on either
    side. Only survivors reach difflib, in Arrow batches, and its ratio is taken where its own upper bounds allow.
    With `ordered`, only pairs with a < b.
    """
    if threshold < RATIO:
        raise ValueError(f"blocking is proven from {RATIO} on")
    keys = lambda df: df.select("*", F.explode(F.concat(F.transform(_grams(F.col("name"), 3), lambda g: F.concat(F.lit("3"), g)), F.when(F.length("name") <= 15, F.transform(_grams(F.col("name"), 2), lambda g: F.concat(F.lit("2"), g))).otherwise(F.array().cast("array<string>")))).alias("gram"))
    every, own = F.explode(F.sequence(F.lit(0), F.lit(salt - 1))), lambda c: F.pmod(F.xxhash64(c), F.lit(salt)).cast("int")
    a = keys(left.select("a", F.lower("name").alias("name"))).withColumn("row", own("a")).withColumn("column", every)
    b = keys(right.select("b", F.lower("name").alias("name"))).withColumn("column", own("b")).withColumn("row", every)
    b = b.select("b", F.col("name").alias("other"), "gram", "row", "column")
    j = a.join(b, ["gram", "row", "column"])
    if ordered:
        j = j.where("a < b")
    n, m = F.length("name"), F.length("other")
    j = j.where((F.least(n, m) >= 0.739 * F.greatest(n, m)) & (F.col("gram").startswith("3") | (n + m <= 16))).select("a", "b", "name", "other").distinct()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        out = []
        for p, q in zip(x, y, strict=True):
            m = SequenceMatcher(None, p, q)
            out.append(m.ratio() if m.quick_ratio() >= threshold else 0.0)
        return pd.Series(out, dtype="float64")

    near = j.select("a", "b", ratio("name", "other").alias("ratio"))
    same = left.select("a", F.lower("name").alias("name")).join(right.select("b", F.lower("name").alias("name")), "name").select("a", "b", F.lit(1.0).alias("ratio"))
    return near.unionByName(same).where(F.col("ratio") >= threshold).groupBy("a", "b").agg(F.max("ratio").alias("ratio"))


def match_name(kg: KnowledgeSet, threshold: float = RATIO) -> DataFrame:
    """(a, b, ratio, links): pairs of different names that are alike; entities of one name meet under its smallest id.

    A row of several links stands for all pairs between two classes of names (see names.alike and name_classes).
    """
    return names.alike(kg.entities.where("name is not null").groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id")).select("id", "name"), threshold)


def name_classes(kg: KnowledgeSet) -> DataFrame:
    """(id, class_id): the smallest id of the entities whose names differ in digits alone, digit by digit."""
    e = kg.entities.where("name is not null").select("id", names.pattern(F.lower("name")).alias("pattern"))
    return e.join(e.groupBy("pattern").agg(F.min("id").alias("class_id")), "pattern").select("id", "class_id")


def match_all(kg: KnowledgeSet) -> DataFrame:
    """(a, b, kind): the first kind of match for each unordered pair; one name in several domains by its first id.

    A row of kind name_class stands for the links between two classes of names, which match_name counts; a = b for a class with itself.
    """
    low = kg.entities.select("id", F.lower("name").alias("name"))
    across = match_cross_domain(kg).select("name", F.col("first_id").alias("a")).join(low.select("name", F.col("id").alias("b")), "name").where("a <> b").select("a", "b")
    alike = match_name(kg)
    kinds = [
        ("symbol", match_symbol(kg)), ("name", alike.where("links = 1").select("a", "b")), ("name_class", alike.where("links > 1").select("a", "b")), ("alias", match_alias(kg)),
        ("equation", match_equation(kg)), ("cross_domain", across),
    ]
    out = None
    for i, (name, df) in enumerate(kinds):
        df = df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct(F.lit(i).alias("order"), F.lit(name).alias("kind")).alias("m"))
        out = df if out is None else out.unionByName(df)
    return out.groupBy("a", "b").agg(F.min("m").alias("m")).select("a", "b", "m.kind")


def resolve_claim_entities(claims: DataFrame, kg: KnowledgeSet, threshold: float = RATIO) -> DataFrame:
    """claims(claim_id, subject) -> (claim_id, subject, entity_id, method exact | slug | similar | candidate)."""
    said = claims.select("claim_id", "subject", F.lower(F.translate("subject", "_", " ")).alias("text"))
    names = kg.entities.groupBy(F.lower("name").alias("text")).agg(F.min("id").alias("by_name"))
    slugs = kg.entities.select(F.lower("id").alias("subject_id"), F.col("id").alias("by_slug"))
    j = said.join(names, "text", "left").join(slugs, F.lower("subject") == F.col("subject_id"), "left")
    open_ = j.where("by_name is null and by_slug is null").select(F.col("text").alias("name")).distinct().select(F.col("name").alias("a"), "name")
    near = similar_pairs(open_, names.select(F.col("by_name").alias("b"), F.col("text").alias("name")), threshold)
    best = near.groupBy(F.col("a").alias("text")).agg(F.max_by("b", F.struct("ratio", "b")).alias("by_ratio"))
    out = j.join(best, "text", "left")
    method = F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_slug").isNotNull(), "slug").when(F.col("by_ratio").isNotNull(), "similar").otherwise("candidate")
    return out.select("claim_id", "subject", F.coalesce("by_name", "by_slug", "by_ratio", F.concat(F.lit("candidate:"), "subject")).alias("entity_id"), method.alias("method"))


def evidence_windows(docs: DataFrame, size: int | None = 3) -> DataFrame:
    """Sentences with places and context, `size` sentences either way: (doc_id, sentence_id, text_span, start, end, section, context); no context if size is None.

    A text's sentences, places and contexts are made before they become rows, so nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    gap = r"(?U)(?<=[.!?])\s+"

    def told(x):
        parts = x["parts"]
        sizes = F.transform(F.arrays_zip(parts.alias("p"), x["gaps"].alias("g")), lambda y: (F.length(y["p"]) + F.coalesce(F.length(y["g"]), F.lit(0))).cast("long"))
        around = lambda i: F.array_join(F.slice(parts, F.greatest(i - size, F.lit(0)) + 1, F.least(i, F.lit(size)) + 1 + size), " ")
        one = lambda at: F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("own"), F.get(at, i).alias("start"), (F.lit(None).cast("string") if size is None else around(i)).alias("context")))
        return once(running(sizes), one)

    cut_up = F.struct(F.split(text, gap).alias("parts"), F.regexp_extract_all(text, F.lit(gap), F.lit(0)).alias("gaps"))
    s = docs.select("doc_id", F.explode(once(cut_up, told)).alias("s")).select("doc_id", "s.*")
    out = s.select("doc_id", F.col("i").alias("sentence_id"), F.trim("own").alias("text_span"), "start", (F.col("start") + F.length("own")).alias("end"), F.concat(F.lit("section-"), F.floor(F.col("i") / 5).cast("string")).alias("section"), F.trim("context").alias("context"))
    return out.where(F.col("text_span") != "")


#: The relation phrases that are looked for.
PHRASES = [
    (r"is\s+directly\s+proportional\s+to", "proportional_to"),
    (r"is\s+inversely\s+proportional\s+to", "inversely_proportional_to"),
    (r"increases\s+with", "increases_with"),
    (r"decreases\s+with", "decreases_with"),
    (r"depends\s+on", "depends_on"),
    (r"causes", "causes"),
]


def extract_claims(windows: DataFrame, known_relations: list[str], phrases=PHRASES) -> DataFrame:
    """(doc_id, sentence_id, subject, relation, object, quantity, unit, conditions, generic) of each phrase found in a window.

    A relation that is not known becomes related_to; a document without any claim gets generic ones from its first three windows of 20
    characters and more.
    """
    # words in a row, which names and phrases are part of; each is looked at as a whole, so nothing is tried from every place
    rows = F.split("text_span", r"(?U)[^\w\s]+")
    name = lambda c: F.substring(F.translate(F.lower(F.trim(c)), " ", "_"), 1, 50)
    like = lambda p: lambda x: x.rlike(p)
    hits = []
    for phrase, relation in phrases:
        p = rf"(?isU)^\s*(\w(?:.*\w)?)\s+{phrase}\s+(\w(?:.*\w)?)\s*$"
        kept = relation if relation in known_relations else "related_to"
        first = F.get(F.filter("rows", like(p)), F.lit(0))
        hits.append(F.when(F.col("text_span").rlike(rf"(?i)\b{phrase}\b") & first.isNotNull(), F.struct(name(F.regexp_extract(first, p, 1)).alias("subject"), F.lit(kept).alias("relation"), name(F.regexp_extract(first, p, 2)).alias("object"))))
    said = F.col("text_span").rlike("(?i)" + "|".join(p for p, _ in phrases))
    windows = windows.withColumn("rows", F.when(said, rows))
    w = windows.withColumn("hit", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    amount = r"([0-9]+\.?[0-9]*)\s*([a-zA-Z/%°]+)"
    q, u = F.regexp_extract("text_span", amount, 1), F.regexp_extract("text_span", amount, 2)
    steady = F.when(F.col("text_span").rlike("(?i)constant temperature|temperature.*constant"), "temperature=constant")
    found = w.select("doc_id", "sentence_id", "hit.*", F.when(q != "", q).alias("quantity"), F.when(u != "", u).alias("unit"), steady.alias("conditions"), F.lit(False).alias("generic"))
    rest = windows.join(found.select("doc_id"), "doc_id", "left_anti")
    rest = rest.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence_id"))).where((F.col("rn") <= 3) & (F.length("text_span") >= 20))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("sentence_id"))
    none = F.lit(None).cast("string")
    generic = rest.select("doc_id", "sentence_id", F.concat(F.lit("concept_"), (n - 1).cast("string")).alias("subject"), F.lit("related_to").alias("relation"), F.concat(F.lit("concept_"), n.cast("string")).alias("object"), none.alias("quantity"), none.alias("unit"), none.alias("conditions"), F.lit(True).alias("generic"))
    return found.unionByName(generic)


def claim_provenance(claims: DataFrame) -> DataFrame:
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("")) for c in ("subject", "relation", "object", "value", "unit")])
    return claims.select("claim_id", F.sha2("document_id", 256).alias("document_hash"), F.sha2(text, 256).alias("content_hash"))


#: Relations that a claim may state besides those of the registry and the phrases.
CLAIM_RELATIONS = ["composed_of", "measured_by", "has_unit", "requires", "produces", "transforms_into"]


def verify_claims(claims: DataFrame, kg: KnowledgeSet, units: dict[str, list[str]] | None = None) -> DataFrame:
    """(claim_id, failed, support, status): checks of text, unit, number, entity, relation, equation (a column that claims may have) and dimension, and what the text says for itself.

    `units` names the units of a relation's dimension; a unit of a relation that it does not name fits.
    """
    known = F.broadcast(kg.relations.select(F.col("name").alias("relation"), F.lit(True).alias("known")))
    there = kg.entities.select(F.col("id").alias("subject"), F.lit(True).alias("there"))
    c = claims.join(known, "relation", "left").join(there, "subject", "left")
    low = F.lower("text_span")
    says = lambda x: F.coalesce(F.contains(low, F.lower(F.translate(F.col(x), "_", " "))), F.lit(False))
    named = says("subject") | says("object")
    tests = [
        ("cited_text", named | (F.length("text_span") > 20)),
        ("unit", F.col("unit").isNull() | ((F.length("unit") < 20) & F.col("unit").rlike(r"^[A-Za-zΩ]+$|[/^°]"))),
        ("number", F.col("value").isNull() | F.col("value").try_cast("double").isNotNull()),
        ("entity", ~F.col("subject").rlike(r"^(geo|org|prod)\.") | F.col("there").isNotNull()),
        ("relation", F.col("known").isNotNull() | F.col("relation").isin([r for _, r in PHRASES] + CLAIM_RELATIONS)),
        ("dimension", F.col("unit").isNull() | F.coalesce(*[F.when(F.col("relation") == r, F.col("unit").isin(u)) for r, u in (units or {}).items()], F.lit(True))),
    ]
    if "equation" in claims.columns:
        tests.append(("equation", F.col("equation").isNull() | (F.contains("equation", F.lit("=")) & (F.length("equation") < 500))))
    failed = F.array_join(F.filter(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]), lambda x: x.isNotNull()), ",")
    support = F.when(named, "supported").when(F.length("text_span") > 30, "uncertain").otherwise("unsupported")
    return c.select("claim_id", failed.alias("failed"), support.alias("support")).withColumn("status", F.when(F.col("failed") != "", "failed").when(F.col("support") == "supported", "verified").otherwise("needs_review"))


def proposals(kg: KnowledgeSet) -> DataFrame:
    """Claims as proposals: with the conflict they are part of, and what the gate misses."""
    c = kg.claims
    triple = ["subject", "relation", "object"]
    clash = c.where("value is not null").groupBy(*triple).agg((F.count_distinct("value") > 1).alias("conflict"))
    gaps = F.array_join(F.filter(F.array(*[F.when(F.col(f).isNull() | (F.trim(f) == ""), F.lit(f)) for f in ("source_id", "document_id", "text_span", "value")]), lambda x: x.isNotNull()), ",")
    return c.join(clash, triple, "left").select("claim_id", *triple, F.coalesce("conflict", F.lit(False)).alias("conflict"), F.lit("proposed").alias("review"), gaps.alias("gaps"))


#: What a proposal has to have before it is reviewed.
GATE = ("source_id", "document_hash", "text_span", "model_id", "pipeline_version", "verification_status")


def evidence_gate(claims: DataFrame, fields: tuple[str, ...] = GATE) -> DataFrame:
    """(claim_id, field): a row for each field that a proposal lacks (null, blank, or no such column); a document's hash is made of its id where there is no column of it."""
    if "document_hash" not in claims.columns and "document_id" in claims.columns:
        claims = claims.withColumn("document_hash", F.sha2("document_id", 256))
    lacks = [F.when(F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "" if f in claims.columns else F.lit(True), F.lit(f)) for f in fields]
    return claims.select("claim_id", F.explode(F.array_compact(F.array(*lacks))).alias("field"))


def required_literal(pattern: str) -> str:
    """The longest run of ASCII characters that every match of a pattern holds, in lower case; empty where none is certain.

    Groups, classes and escapes of letters end a run and give nothing; so does, for the whole pattern, a choice outside groups, quoting, or a mode in which letters
    match others than their two cases or white space means nothing.
    """
    modes = set("".join(re.findall(r"\(\?([a-zA-Z]+)", pattern)))
    if modes & {"x", "u", "U"} or r"\Q" in pattern:
        return ""
    runs, run, i, n = [], "", 0, len(pattern)

    def after_class(j: int) -> int:
        depth, j = 1, j + 1 + (pattern[j + 1 : j + 2] == "^")
        j += pattern[j : j + 1] == "]"
        while j < n and depth:
            depth += {"[": 1, "]": -1}.get(pattern[j], 0)
            j += 1 + (pattern[j] == "\\")
        return j

    while i < n:
        c = pattern[i]
        if c == "|":
            return ""
        literal, end = "", i + 1
        if c == "\\":
            end = i + 2
            literal = "" if pattern[i + 1 : i + 2].isalnum() else pattern[i + 1 : i + 2]
        elif c == "[":
            end = after_class(i)
        elif c == "(":
            depth, end = 1, i + 1
            while end < n and depth:
                if pattern[end] == "[":
                    end = after_class(end)
                    continue
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end += 1 + (pattern[end] == "\\")
        elif c not in ".^$" and c.isascii():
            literal = c
        times = re.match(r"(?:\*|\?|\+|\{[0-9]+(?:,[0-9]*)?\})[?+]?", pattern[end:])
        if literal and times and times.group()[0] in "*?{" and not re.match(r"\{0*[1-9]", times.group()):
            literal = ""
        run += literal
        if not literal or times:
            runs.append(run)
            run = ""
        i = end + (times.end() if times else 0)
    return max([*runs, run], key=len).lower()


def rule_entities(docs: DataFrame, rules: DataFrame, gram: int = 3, parts: int = 8) -> DataFrame:
    """rules(rule, pattern, domain) against every text: (doc_id, rule, domain, hits, first_hit), for any number of rules.

    Texts meet rules by the first characters of what each pattern needs (required_literal), in a join of the texts' grams; the pattern runs on texts that
    hold all of it. Patterns without such a literal run on every text. Null texts are empty.
    """

    @F.pandas_udf("string")
    def needed(p: pd.Series) -> pd.Series:
        return pd.Series([required_literal(x) for x in p])

    (row,) = unused(docs.columns, "row")
    d = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(row, F.monotonically_increasing_id()))
    r = stored(rules.select("rule", "pattern", "domain").withColumn("literal", needed("pattern")).withColumn("gram", F.substring("literal", 1, gram)))
    own = d.select(row, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"(?s)(?=(.{{{gram}}}))"), F.lit(1)))).alias("gram"))
    met = own.join(r.where(F.length("literal") >= gram), "gram").drop("gram")
    kept = met.join(d, row).where(F.contains(F.lower("text"), F.col("literal")))
    free = r.where(F.length("literal") < gram).withColumn("part", F.pmod(F.xxhash64("rule"), F.lit(parts)).cast("int"))
    every = d.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(free, "part")
    cols = ["doc_id", "rule", "domain", "pattern", "text"]
    hits = F.expr("regexp_extract_all(text, pattern, 0)")
    return kept.select(*cols).unionByName(every.select(*cols)).where("text rlike pattern").select("doc_id", "rule", "domain", F.size(hits).alias("hits"), F.get(hits, F.lit(0)).alias("first_hit"))


_WORD = "[a-z0-9]+"


def normal_text(c: str) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(_WORD), F.lit(0)), " ")


def search(kg: KnowledgeSet, query: str, domain=None, include_retired: bool = False, limit: int | None = None) -> DataFrame:
    """(id, name, rank): 0 the name starts with the query, 1 the name holds it or all its words, 2 the definition does."""
    from weftgraph.operators.lookup import entities_filter, limited

    words = re.findall(_WORD, query.casefold())
    if not words:
        raise ValueError("query must not be empty")
    q, want = " ".join(words), F.array(*[F.lit(w) for w in sorted(set(words))])
    e = entities_filter(kg, domain=domain, include_retired=include_retired).select("id", "name", normal_text("name").alias("n"), normal_text("definition").alias("d"))
    has = lambda c: F.col(c).contains(q) | (F.size(F.array_except(want, F.split(c, " "))) == 0)
    rank = F.when(F.col("n").startswith(q), 0).when(has("n"), 1).when(has("d"), 2)
    return limited(e.select("id", "name", rank.alias("rank")).where("rank is not null"), limit, "rank", "id")


#: Words of a question that say nothing about its subject.
STOP = [
    "a", "about", "an", "and", "any", "are", "at", "be", "between", "by", "can", "could", "describe", "did", "do", "does", "explain", "for", "from", "give", "has", "have", "how", "i", "if", "in", "is", "it",
    "its", "list", "me", "my", "of", "on", "or", "our", "please", "show", "so", "some", "tell", "that", "the", "their", "them", "there", "they", "this", "to", "us", "was", "we", "what", "when", "where",
    "which", "who", "why", "will", "with", "would", "you", "your",
]


def grounding_topk(kg: KnowledgeSet, question: str, k: int = 5, stop: list[str] = STOP) -> DataFrame:
    """The k records with the best additive score over entity fields and connection texts."""
    terms = [t for t in re.sub(r"[^a-z0-9\s._-]", " ", question.lower()).split() if len(t) > 1 and t not in stop]
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    when = lambda test, n: F.when(test, n).otherwise(0)
    e = c = F.lit(0)
    hay = F.lower(F.concat_ws(" ", "relation", "source_name", "target_name", "id"))
    for t in terms:
        e = e + F.when(low("name") == t, 10).when(low("name").contains(t), 6).otherwise(0) + when(low("id").contains(t), 5) + when(low("definition").contains(t), 2)
        e = e + when(low("symbol") == t, 6) + when(low("unit") == t, 4) + when(low("domain") == t, 3)
        c = c + when(hay.contains(t), 4)
    ents = kg.entities.select(F.lit("entity").alias("kind"), "id", e.alias("score"))
    end = lambda p: kg.entities.select(F.col("id").alias(p), F.col("name").alias(f"{p}_name"))
    cons = kg.connections.join(end("source"), "source", "left").join(end("target"), "target", "left").select(F.lit("connection").alias("kind"), "id", c.alias("score"))
    return ents.unionByName(cons).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def scoping_claims(docs: DataFrame, words: list[str]) -> DataFrame:
    """Documents whose text declares a scope: two of the words within a window of three tokens, which are runs of a-z in lower case.

    One pattern goes over a text once: a word, one other token at most, and a word that is not the same.
    """
    any_of = "|".join(sorted({w for w in words if re.fullmatch("[a-z]+", w)})) or "(?!)"
    near = rf"(?<![a-z])({any_of})[^a-z]++(?:[a-z]++[^a-z]++)?(?!\1(?![a-z]))(?:{any_of})(?![a-z])"
    return docs.where(F.lower("text").rlike(near)).select("doc_id")


def stale_counts(docs: DataFrame, live: int, noun: str) -> DataFrame:
    """Lines that restate a count of `noun` that is not the live one: (doc_id, line, said)."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    n = F.regexp_extract("said", rf"([0-9]+) {noun}", 1)
    return lines.select("doc_id", "line", n.alias("said")).where((F.col("said") != "") & (F.col("said").try_cast("long") != live))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Documents that match a key or password pattern and do not speak of an example."""
    hit = F.col("text").rlike(r"AKIA[A-Z0-9]{16}|(?i)(password|secret|token|api_?key)\s*[:=]\s*[\"'][^\"']{8,}")
    return docs.where(hit & ~F.lower("text").contains("example")).select("doc_id")


def embedding_leak_scan(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"\[\s*-?[0-9]+\.[0-9]+(\s*,\s*-?[0-9]+\.[0-9]+){7,}")).select("doc_id")
