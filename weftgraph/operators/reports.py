"""Counts and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.policy import active, policy, retired
from weftgraph.functions.signature import claim_signature
from weftgraph.schema import KnowledgeSet


def stats(kg: KnowledgeSet) -> DataFrame:
    c = kg.connections.agg(F.count("*").alias("connection_count"), F.count_if(policy("all")).alias("active_connection_count"), F.count_if(F.col("review") == "rejected").alias("rejected_connection_count"))
    e = kg.entities.agg(F.count("*").alias("entity_count"), F.count_if(retired()).alias("retired_entity_count"))
    return c.join(e, how="cross").join(kg.sources.agg(F.count("*").alias("source_count")), how="cross")


def status_counts(kg: KnowledgeSet) -> DataFrame:
    e = kg.entities.agg(F.count_if(F.col("status") == "human_reviewed").alias("entities_reviewed"), F.count_if(F.col("status") == "draft").alias("entities_draft"))
    c = kg.connections.agg(F.count_if(F.col("review") == "canonical").alias("connections_canonical"), F.count_if(F.col("review") == "unreviewed").alias("connections_unreviewed"), F.count("*").alias("n"))
    s = kg.sources.agg(F.count("*").alias("sources"))
    out = e.join(c, how="cross").join(s, how="cross")
    return out.withColumn("percent_canonical", F.round(F.coalesce(F.try_divide(100 * F.col("connections_canonical"), F.col("n")), F.lit(0.0)), 1)).drop("n")


def origin(asserted_by: str = "asserted_by", basis: str = "confidence_basis") -> Column:
    return F.when(F.col(basis) == "migrated", "migrated").when(F.col(asserted_by) == "llm", "llm").when(F.col(asserted_by) == "human", "human").otherwise("unknown")


def _long(df: DataFrame, dims: list[str], count: Column = None) -> DataFrame:
    """(dimension, value, n): one pass with a grouping set for each dimension."""
    df = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("none")).alias(d) for d in dims])
    sets = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        here = F.col("g").bitwiseAND(F.lit(1 << (len(dims) - 1 - i))) == 0
        which, value = F.when(here, F.lit(d)).otherwise(which), F.when(here, F.col(d)).otherwise(value)
    return sets.select(which.alias("dimension"), value.alias("value"), "n")


def curation_status(kg: KnowledgeSet) -> DataFrame:
    family = F.broadcast(kg.relations.select(F.col("name").alias("relation"), "family"))
    domain = kg.entities.select(F.col("id").alias("source"), "domain")
    c = kg.connections.join(family, "relation", "left").join(domain, "source", "left").withColumn("origin", origin())
    return _long(c, ["relation", "family", "review", "assertion_type", "assertion_status", "origin", "domain"])


def epistemic_summary(kg: KnowledgeSet) -> DataFrame:
    c = kg.connections.withColumns({"origin": origin(), "has_confidence": F.col("confidence").isNotNull()})
    return _long(c, ["assertion_type", "review", "assertion_status", "origin", "has_confidence"])


def trust_audit(kg: KnowledgeSet) -> DataFrame:
    """Canonical connections by relation: count, with evidence, with a basis of confidence."""
    ev = kg.evidence.select(F.col("connection_id").alias("id"), F.lit(1).alias("has")).distinct()
    c = kg.connections.where("review = 'canonical'").join(ev, "id", "left")
    return c.groupBy("relation").agg(F.count("*").alias("n"), F.count("has").alias("with_evidence"), F.count("confidence_basis").alias("with_basis"), F.round(F.count("has") / F.count("*"), 4).alias("evidence_share"))


def evidence_gaps(kg: KnowledgeSet) -> DataFrame:
    return kg.connections.where(active()).join(kg.evidence.select(F.col("connection_id").alias("id")), "id", "left_anti").select("id", "relation", "review")


def provenance_gaps(kg: KnowledgeSet) -> DataFrame:
    return kg.connections.where(F.col("review").isin("reviewed", "canonical") & F.col("asserted_by").eqNullSafe("llm") & F.col("confidence_basis").isNull()).select("id", "review")


def duplicate_claims(kg: KnowledgeSet) -> DataFrame:
    """Active connections (a missing status counts as active) that share a signature."""
    c = kg.connections.where(F.coalesce("assertion_status", F.lit("active")) == "active").select("id", claim_signature().alias("claim_signature"))
    return c.groupBy("claim_signature").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids")).where("n > 1")


def duplicate_triples(kg: KnowledgeSet) -> DataFrame:
    c = kg.connections.withColumn("object", F.coalesce("target", F.concat(F.lit("VALUE:"), F.col("amount"))))
    return c.groupBy("source", "relation", "object").agg(F.count("*").alias("n"), F.count_distinct("review").alias("n_reviews")).where("n > 1")


def conflicting_review(kg: KnowledgeSet) -> DataFrame:
    return duplicate_triples(kg).where("n_reviews > 1")


def conflicts(kg: KnowledgeSet) -> DataFrame:
    """(subject, relation, object) with more than one distinct value; units and sources are carried, not compared."""
    return kg.claims.where("value is not null").groupBy("subject", "relation", "object").agg(
        F.count("*").alias("n_claims"), F.count_distinct("value").alias("n_values"), F.array_join(F.sort_array(F.collect_set("value")), ",").alias("competing"), F.count_distinct("source_id").alias("n_sources"),
    ).where("n_values > 1")


def corroboration(kg: KnowledgeSet) -> DataFrame:
    """Each claim's agreement with the claims of its triple, from grouped counts joined back (a hot triple stays spread)."""
    triple = ["subject", "relation", "object"]
    g = kg.claims.groupBy(*triple).agg(F.count("*").alias("n"), F.count("value").alias("n_valued"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    verdict = F.when(F.col("n") == 1, "single_source").when(F.col("n_valued") < 2, "unrelated").when(F.col("lo") == F.col("hi"), "agree").otherwise("disagree")
    return kg.claims.join(g, triple).select("claim_id", "source_id", "value", verdict.alias("agreement"))


def lexical_index(kg: KnowledgeSet) -> DataFrame:
    """token -> number of entities and their smallest id, over name, definition, domain and type."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "name", "definition", "domain", "type")), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return kg.entities.select("id", F.explode(F.array_distinct(words)).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def lexical_postings(kg: KnowledgeSet) -> DataFrame:
    """(token, id): the index itself, a row a posting, so that no list grows with a token's frequency."""
    words = F.filter(F.split(F.lower(F.concat_ws(" ", "name", "definition", "domain", "type")), "[^a-z0-9]+"), lambda w: F.length(w) > 2)
    return kg.entities.select(F.explode(words).alias("token"), "id").distinct()


def citation_uses(kg: KnowledgeSet) -> DataFrame:
    """(source_ref, kind, id, stance): every use of a source, as evidence or as provenance."""
    ev = kg.evidence.select("source_ref", F.lit("evidence").alias("kind"), F.col("connection_id").alias("id"), "stance")
    return ev.unionByName(kg.entities.where("source_ref is not null").select("source_ref", F.lit("provenance").alias("kind"), "id", F.lit(None).cast("string").alias("stance")))


def citation_index(kg: KnowledgeSet) -> DataFrame:
    return kg.evidence.groupBy("source_ref").agg(F.count("*").alias("uses"), F.count_distinct("connection_id").alias("connections"), F.count_if(F.col("stance") == "refutes").alias("refuting"))


def unresolved_sources(kg: KnowledgeSet) -> DataFrame:
    """Cited sources without a record, by id or by citation text: (pointer, kind, uses)."""
    cited = kg.evidence.select(F.col("source_ref").alias("pointer"), F.lit("evidence").alias("kind")).unionByName(kg.entities.where("source_ref is not null").select(F.col("source_ref").alias("pointer"), F.lit("provenance").alias("kind")))
    uses = cited.groupBy("pointer", "kind").agg(F.count("*").alias("uses"))
    uses = uses.join(kg.sources.select(F.col("id").alias("pointer")), "pointer", "left_anti")
    return uses.join(kg.sources.select(F.col("title").alias("pointer")), "pointer", "left_anti")


def affected_by_source(kg: KnowledgeSet) -> DataFrame:
    c = kg.evidence.select("source_ref", F.lit("connection").alias("kind"), F.col("connection_id").alias("id")).distinct()
    e = kg.entities.where("source_ref is not null").select("source_ref", F.lit("entity").alias("kind"), "id")
    return c.unionByName(e).join(kg.sources.select(F.col("id").alias("source_ref")), "source_ref", "left_semi")


def review_progress(kg: KnowledgeSet) -> DataFrame:
    done = F.count_if(F.col("status").isin("canonical", "human_reviewed"))
    return kg.entities.groupBy("domain").agg(done.alias("reviewed"), F.count("*").alias("total"), F.round(100 * done / F.count("*"), 1).alias("percent"))


def isolated_entities(kg: KnowledgeSet) -> DataFrame:
    ends = kg.connections.select(F.explode(F.array("source", "target")).alias("id"))
    return kg.entities.select("id").join(ends, "id", "left_anti")


def relation_triage(kg: KnowledgeSet, priority: list[str]) -> DataFrame:
    """Active related_to edges: whether their pair already has a specific edge, else the first relation that fits their types."""
    pair = F.array_join(F.array_sort(F.array("source", "target")), "|")
    c = kg.connections.where("target is not null").withColumn("pair", pair)
    specific = c.where("relation <> 'related_to'").select("pair").distinct().withColumn("has", F.lit(1))
    typed = lambda p: kg.entities.select(F.col("id").alias(p), F.col("type").alias(f"{p}_type"))
    open_ = c.where("relation = 'related_to'").where(active()).join(specific, "pair", "left").join(typed("source"), "source", "left").join(typed("target"), "target", "left")
    fits = F.broadcast(kg.relations.where(F.col("name").isin(priority) & (F.col("family") != "associative")))
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("name"))
    fit = lambda types, t: (F.size(types) == 0) | F.array_contains(types, F.col(t))
    types = kg.entities.select("type").distinct()
    combos = types.select(F.col("type").alias("source_type")).crossJoin(types.select(F.col("type").alias("target_type"))).crossJoin(fits)
    best = combos.where(fit(F.col("domain"), "source_type") & fit(F.col("range"), "target_type")).groupBy("source_type", "target_type").agg(F.min_by("name", rank).alias("suggested"))
    out = open_.join(F.broadcast(best), ["source_type", "target_type"], "left")
    verdict = F.when(F.col("has") == 1, "already_specific").when(F.col("suggested").isNotNull(), "candidate").otherwise("none")
    return out.select("id", verdict.alias("verdict"), F.when(verdict == "candidate", F.col("suggested")).alias("suggested"))


#: Each dimension's weight, its level where no test holds, and its tests (column, pattern, level), the first that holds counting.
TRUST = {
    "institutional_authority": (0.20, 0.5, [("publisher", "nist|ieee|iso|iupac|who|unesco|nasa", 1.0), ("publisher", "university|press", 0.9), ("type", "^standard$", 1.0), ("type", "^textbook$", 0.8)]),
    "peer_review_status": (0.15, 0.5, [("type", "^(academic-paper|standard|textbook)$", 1.0), ("type", "^web$", 0.3)]),
    "methodological_strength": (0.15, 0.5, [("type", "^standard$", 1.0), ("type", "^(dataset|academic-paper)$", 0.9), ("type", "^textbook$", 0.7)]),
    "consensus_alignment": (0.15, 0.5, [("type", "^(textbook|standard)$", 1.0), ("type", "^academic-paper$", 0.7)]),
    "reproducibility": (0.10, 0.5, [("type", "^standard$", 1.0), ("type", "^dataset$", 0.9), ("type", "^academic-paper$", 0.6)]),
    "independence": (0.10, 0.7, [("publisher", "industry|corporate", 0.5), ("publisher", "government|nist", 0.9)]),
    "domain_relevance": (0.05, 0.8, []),
}
#: Weight of recency, level without a year, levels up to so many years of age, level beyond.
RECENCY = (0.10, 0.5, [(2, 1.0), (5, 0.8), (10, 0.6), (20, 0.4)], 0.2)


def source_trust(kg: KnowledgeSet, as_of: int) -> DataFrame:
    """Eight dimensions of trust from a source's metadata and their weighted sum, as of a given year."""
    dims, total = {}, F.lit(0.0)
    for name, (weight, default, tests) in TRUST.items():
        levels = [F.when(F.lower(F.coalesce(F.col(c), F.lit(""))).rlike(p), F.lit(v)) for c, p, v in tests]
        dims[name] = F.coalesce(*levels, F.lit(default))
        total = total + dims[name] * weight
    weight, unknown, steps, old = RECENCY
    age = F.lit(as_of) - F.col("year")
    dims["recency"] = F.coalesce(F.when(age.isNull(), unknown), *[F.when(age <= years, F.lit(v)) for years, v in steps], F.lit(old))
    total = total + dims["recency"] * weight
    return kg.sources.select("id", *[d.alias(n) for n, d in dims.items()], F.round(total, 3).alias("composite"))


def evidence_quality(kg: KnowledgeSet) -> DataFrame:
    strength = {"experiment": 1.0, "textbook": 0.9, "observation": 0.7, "review": 0.8, "definition": 1.0, "standard": 1.0, "simulation": 0.7, "derivation": 0.7, "dataset": 0.8, "expert_assessment": 0.6}
    kind = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in strength.items()], F.lit(0.5))
    return kg.evidence.select("connection_id", "source_ref", kind.alias("type_strength"), F.when(F.coalesce("stance", F.lit("supports")) != "supports", 1.0).otherwise(0.8).alias("stance_clarity"), F.when(F.col("locator").isNull(), 0.0).otherwise(F.round(F.lit(1 / 3), 4)).alias("locator_completeness"))


def source_slug(kg: KnowledgeSet) -> DataFrame:
    slug = F.concat_ws("-", F.substring(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 40), F.col("year").cast("string"))
    s = kg.sources.select("id", slug.alias("slug"))
    n = s.groupBy("slug").agg(F.count("*").alias("n"))
    return s.join(n, "slug").select("id", "slug", (F.col("n") > 1).alias("duplicate"))
