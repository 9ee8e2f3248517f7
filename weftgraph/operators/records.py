"""Rules over the nested blocks of records, kept flat: blocks(id, block, key, value), one row a member.

Vocabularies and registries are parameters; each rule is joins and grouped checks over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.policy import active
from weftgraph.operators import views
from weftgraph.operators.quality import RULES, _blank, _rows, check, rule
from weftgraph.schema import KnowledgeSet

REVIEWED = ["canonical", "human_reviewed"]
#: Registered extension keys: key, the type of entity they apply to, the pattern of their values.
EXTENSIONS = [("segment", "quantity", "^[a-z]+$"), ("balance", "quantity", "^[0-9.]+$"), ("priority", "unit", "^(high|low)$")]
HISTORICAL = ["stated_by", "year", "where", "context", "note"]
ADOPTED = ["external_id", "relation", "authority", "note", "adopted_at"]
ADOPTED_RELATIONS = ["exact", "close", "broad"]
CONTEXT = {"domain": ["geo", "org", "prod"], "scale": ["micro", "macro"]}
LEGACY = "legacy:"
#: Pairs of adjacent words in a key that declare a scope of teaching.
SCOPES = ["grade level", "school year", "course unit", "exam board"]


def _of(kg: KnowledgeSet, block: str) -> DataFrame:
    return kg.blocks.where(F.col("block") == block)


def _members(kg: KnowledgeSet, block: str, *keys: str) -> DataFrame:
    """One row a record that has the block, its members as columns."""
    return _of(kg, block).groupBy("id").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def _gaps(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    gap = F.explode(F.filter(F.array(*[F.when(_blank(k), F.lit(k)) for k in keys]), lambda x: x.isNotNull()))
    return _rows(df.select("id", gap.alias("field")), name, F.concat(F.lit("missing "), F.col("field")))


@rule
def dq_extensions(kg: KnowledgeSet) -> DataFrame:
    """Keys are registered, apply to the record's type, and have values of their pattern."""
    known = F.broadcast(kg.blocks.sparkSession.createDataFrame(EXTENSIONS, "key string, applies string, pattern string"))
    x = _of(kg, "extension").join(kg.entities.select("id", "type"), "id").join(known, "key", "left")
    why = F.when(F.col("applies").isNull(), "unregistered key").when(F.col("applies") != F.col("type"), "does not apply").when(~F.regexp_like("value", F.col("pattern")), "bad value")
    return _rows(x.withColumn("why", why).where("why is not null"), "dq_extensions", F.concat_ws(": ", "key", "why"))


@rule
def dq_historical(kg: KnowledgeSet) -> DataFrame:
    """An attribution has a closed set of members, says who, and its year is a number."""
    return _gaps(_members(kg, "historical", "stated_by"), ["stated_by"], "dq_historical")


@rule
def dq_adopted_from(kg: KnowledgeSet) -> DataFrame:
    """An adoption has a closed set of members, names the record, its relation to it and the authority."""
    return _gaps(_members(kg, "adopted_from", "external_id", "relation", "authority"), ["external_id", "relation", "authority"], "dq_adopted_from")


_in = lambda block, *keys: (F.col("block") == block) & (F.col("key").isin(*keys) if keys else F.lit(True))
_unknown = lambda: F.concat(F.lit("unknown member "), F.col("key"))
check("dq_historical", "blocks", lambda: _in("historical") & ~F.col("key").isin(HISTORICAL), _unknown)
check("dq_historical", "blocks", lambda: _in("historical", "year") & ~F.col("value").rlike("^-?[0-9]{1,4}$"), "year is no number")
check("dq_adopted_from", "blocks", lambda: _in("adopted_from") & ~F.col("key").isin(ADOPTED), _unknown)
check("dq_adopted_from", "blocks", lambda: _in("adopted_from", "relation") & ~F.col("value").isin(ADOPTED_RELATIONS), lambda: F.concat(F.lit("relation "), F.col("value")))
_of_vocabulary = lambda: F.coalesce(*[F.when(F.col("key") == k, F.col("value").isin(v)) for k, v in CONTEXT.items()], F.lit(False))
check("dq_context_vocab", "blocks", lambda: _in("context") & ~_of_vocabulary(), lambda: F.concat_ws(" ", "key", "value"))
# a retired id prefix, in any id, pointer or member
for _table, _columns in (("entities", ("id", "deprecated_by", "source_ref")), ("connections", ("id", "source", "target", "replaced_by")), ("blocks", ("value",))):
    for _c in _columns:
        check("dq_legacy_prefix", _table, lambda c=_c: F.contains(F.col(c), F.lit(LEGACY)), lambda c=_c: F.col(c))


@rule
def dq_debt(kg: KnowledgeSet, forward_only: bool = False) -> DataFrame:
    """Outstanding debt blocks a reviewed status (only a canonical one, if forward_only); cleared and deferred debts say by whom and when."""
    d = _members(kg, "debt", "status", "cleared_by", "cleared_at", "deferred_by", "deferred_until").withColumnRenamed("status", "debt")
    d = d.join(kg.entities.select("id", "status"), "id", "left")
    blocked = F.col("status").isin(["canonical"] if forward_only else REVIEWED)
    why = (
        F.when((F.col("debt") == "outstanding") & blocked, "outstanding debt of a reviewed record")
        .when((F.col("debt") == "cleared") & (_blank("cleared_by") | _blank("cleared_at")), "cleared by nobody")
        .when((F.col("debt") == "deferred") & (_blank("deferred_by") | _blank("deferred_until")), "deferred without an end")
        .when(~F.col("debt").isin("outstanding", "cleared", "deferred") | F.col("debt").isNull(), "unknown status")
    )
    return _rows(d.withColumn("why", why).where("why is not null"), "dq_debt", F.col("why"))


@rule
def dq_human_review(kg: KnowledgeSet) -> DataFrame:
    """A reviewed record has a registered human writer, and an edit by a human or a declared human review."""
    human = kg.agents.where("class = 'human'").select(F.col("id").alias("value"))
    said = kg.blocks.where("block in ('provenance', 'edit')").join(human, "value", "left_semi")
    of = said.groupBy("id").agg(F.max(F.col("key") == "writer").alias("writer"), F.max((F.col("block") == "edit") | (F.col("key") == "reviewer")).alias("reviewed"))
    r = kg.entities.where(F.col("status").isin(REVIEWED)).select("id").join(of, "id", "left")
    why = F.when(~F.coalesce("writer", F.lit(False)), "no registered human writer").when(~F.coalesce("reviewed", F.lit(False)), "no edit and no declared review")
    return _rows(r.withColumn("why", why).where("why is not null"), "dq_human_review", F.col("why"))


@rule
def dq_governing(kg: KnowledgeSet, core: tuple = ()) -> DataFrame:
    """Governing laws exist, are laws and not the record itself; the core laws are there."""
    law = kg.entities.select(F.col("id").alias("value"), F.col("type").alias("kind"))
    g = _of(kg, "governed_by").select("id", "value").join(law, "value", "left")
    why = F.when(F.col("id") == F.col("value"), "governs itself").when(F.col("kind").isNull(), "unknown law").when(F.col("kind") != "law", "no law")
    out = _rows(g.withColumn("why", why).where("why is not null"), "dq_governing", F.concat_ws(": ", "value", "why"))
    wanted = kg.entities.sparkSession.createDataFrame([(x,) for x in core], "id string").join(kg.entities.where("type = 'law'"), "id", "left_anti")
    return out.unionByName(_rows(wanted, "dq_governing", "core law is not there"))


@rule
def dq_node_projection(kg: KnowledgeSet) -> DataFrame:
    """Every node has a type and a label, an assertion both ends, and only canonical records are nodes."""
    n = views.jsonld_nodes(kg)
    source = kg.entities.where("status = 'canonical'").select(F.col("id").alias("node_id")).unionByName(kg.connections.where(active() & (F.col("review") == "canonical")).select(F.col("id").alias("node_id")))
    why = F.when(_blank("node_type") | _blank("label"), "no type or label").when((F.col("node_type") == "Assertion") & (_blank("source") | _blank("target")), "assertion without both ends")
    out = _rows(n.withColumn("why", why).where("why is not null"), "dq_node_projection", F.col("why"), focus="node_id")
    return out.unionByName(_rows(n.join(source, "node_id", "left_anti"), "dq_node_projection", "not canonical", focus="node_id"))


CANDIDATE_RULES = ["dq_enum", "dq_quantity_fields", "dq_target_xor_value", "dq_relation_known"]


def dq_candidate(kg: KnowledgeSet, entities: DataFrame, connections: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Drafted rows under the rules that published ones obey, before they are staged."""
    drafted, out = kg.with_(entities=entities, connections=connections), None
    if kg.blocks is not None:
        drafted = drafted.with_(blocks=kg.blocks.join(entities.select("id").unionByName(connections.select("id")), "id", "left_semi"))
    for name in rules or CANDIDATE_RULES:
        found = RULES[name](drafted)
        out = found if out is None else out.unionByName(found)
    return out.withColumn("message", F.concat_ws(": ", "rule", "message")).withColumn("rule", F.lit("dq_candidate"))


@rule
def dq_inline_relationships(kg: KnowledgeSet) -> DataFrame:
    return _rows(_of(kg, "relationships").select("id").distinct(), "dq_inline_relationships", "relationships stand on the entity")


def dq_live_counts(kg: KnowledgeSet, recorded: DataFrame) -> DataFrame:
    """recorded(name, n) against live counts of entities by status."""
    live = kg.entities.groupBy(F.col("status").alias("live_name")).agg(F.count("*").alias("live"))
    both = recorded.join(live, F.col("name") == F.col("live_name"), "full").where(~F.col("n").eqNullSafe(F.col("live")))
    said = F.concat_ws(" ", F.lit("recorded"), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit("live"), F.coalesce(F.col("live"), F.lit(0)).cast("string"))
    return _rows(both.withColumn("id", F.coalesce("name", "live_name")), "dq_live_counts", said)


def scoping_keys(blocks: DataFrame, scopes: list[str] | None = None) -> DataFrame:
    """Members whose keys, split at capitals, dashes and underscores, declare a scope: (id, key)."""
    words = F.trim(F.regexp_replace(F.lower(F.regexp_replace("key", "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+", " "))
    said = F.concat(F.lit(" "), words, F.lit(" "))
    hit = [F.contains(said, F.lit(f" {s} ")) for s in scopes or SCOPES]
    out = hit[0]
    for h in hit[1:]:
        out = out | h
    return blocks.where(out).select("id", "key").distinct()


#: The rules of this module.
RECORD_RULES = ["dq_extensions", "dq_historical", "dq_adopted_from", "dq_debt", "dq_human_review", "dq_governing", "dq_context_vocab", "dq_node_projection", "dq_legacy_prefix", "dq_inline_relationships"]
