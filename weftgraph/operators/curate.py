"""Batch state changes as snapshots: nothing is changed in place, verdicts are columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.history import CHAIN, as_recorded, stage_of
from weftgraph.schema import KnowledgeSet

#: The allowed changes of a review status.
TRANSITIONS = [
    ("proposed", "reviewed"), ("proposed", "rejected"), ("proposed", "proposed"), ("asserted", "reviewed"), ("asserted", "canonical"), ("asserted", "rejected"),
    ("reviewed", "canonical"), ("reviewed", "rejected"), ("reviewed", "reviewed"), ("canonical", "deprecated"), ("canonical", "rejected"),
    ("rejected", "proposed"), ("rejected", "unreviewed"), ("inferred", "reviewed"), ("inferred", "canonical"), ("inferred", "rejected"),
]


def validate_transitions(requests: DataFrame) -> DataFrame:
    """requests(id, from_review, to_review, reviewer, reason) -> the same with an error, null where the change may be made."""
    spark = requests.sparkSession
    allowed = F.broadcast(spark.createDataFrame(TRANSITIONS, "from_review string, to_review string").withColumn("ok", F.lit(True)))
    out = requests.join(allowed, ["from_review", "to_review"], "left")
    reopen = F.col("from_review").eqNullSafe("rejected") & F.col("to_review").isin("proposed", "unreviewed")
    who = F.col("to_review").isin("rejected", "reviewed", "canonical") | reopen
    why = (F.col("to_review") == "rejected") | reopen
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    error = F.when(F.col("ok").isNull(), "forbidden").when(who & blank("reviewer"), "reviewer needed").when(why & blank("reason"), "reason needed")
    return out.select("id", "from_review", "to_review", "reviewer", "reason", error.alias("error"))


def apply_review_decisions(kg: KnowledgeSet, sheet: DataFrame) -> DataFrame:
    """All or nothing: sheet(id, source, relation, target, decision, reviewer, reason) -> the new snapshot of connections.

    A row is stale where its triple is no longer that of the connection. With any error the snapshot is the old one;
    the column `applied` says so for every row.
    """
    c = kg.connections
    s = sheet.select(F.col("id").alias("sid"), F.col("source").alias("s_source"), F.col("relation").alias("s_relation"), F.col("target").alias("s_target"), "decision", "reviewer", F.col("reason").alias("why"))
    j = s.join(c, F.col("sid") == F.col("id"), "left")
    stale = F.col("id").isNull() | ~(F.col("s_source").eqNullSafe(F.col("source")) & F.col("s_relation").eqNullSafe(F.col("relation")) & F.col("s_target").eqNullSafe(F.col("target")))
    bad = stale | (F.col("decision").eqNullSafe("rejected") & F.coalesce(F.trim("why") == "", F.lit(True)))
    n = j.agg(F.count_if(bad).alias("errors"))
    decided = s.select(F.col("sid").alias("id"), "decision", "why")
    out = c.join(decided, "id", "left").join(F.broadcast(n))
    ok = (F.col("errors") == 0) & F.col("decision").isNotNull()
    return out.withColumns({"review": F.when(ok, F.col("decision")).otherwise(F.col("review")), "reason": F.when(ok & F.col("why").isNotNull(), F.col("why")).otherwise(F.col("reason")), "applied": ok}).select(*c.columns, "applied")


def promote_batch(kg: KnowledgeSet, requests: DataFrame, days: int = 1) -> DataFrame:
    """requests(id, actor, at) -> (id, stage, verdict): one stage on from the last, not sooner than `days` after it."""
    promotions, actor = as_recorded(kg.promotions)
    last = promotions.groupBy("id").agg(F.max("at").alias("last_at"), actor.alias("last_actor"))
    r = requests.join(stage_of(kg), "id", "left").join(last, "id", "left")
    stage = F.coalesce("next_stage", F.when(F.col("last_stage").isNull(), F.lit(CHAIN[0])))
    verdict = F.when(stage.isNull(), "complete").when(F.datediff("at", "last_at") < days, "too soon").when(F.col("actor") == F.col("last_actor"), "same actor").otherwise("ok")
    return r.select("id", stage.alias("stage"), verdict.alias("verdict"))


def set_debt(debts: DataFrame, changes: DataFrame) -> DataFrame:
    """debts(id, status, by, at), changes(id, to cleared | deferred, by, at, evidence) -> new debts; a change has to be attributable."""
    c = changes.select("id", F.col("to").alias("c_to"), F.col("by").alias("c_by"), F.col("at").alias("c_at"), "evidence")
    j = debts.join(c, "id", "left")
    ok = F.col("c_to").isin("cleared", "deferred") & F.col("c_by").isNotNull() & F.col("c_at").isNotNull() & ((F.col("c_to") == "deferred") | F.col("evidence").isNotNull()) & (F.col("status") == "outstanding")
    pick = lambda new, old: F.when(F.coalesce(ok, F.lit(False)), F.col(new)).otherwise(F.col(old)).alias(old)
    return j.select("id", pick("c_to", "status"), pick("c_by", "by"), pick("c_at", "at"))


def propagate(kg: KnowledgeSet, changed: DataFrame) -> DataFrame:
    """changed(source_ref, change retracted | corrected | superseded) -> (source_ref, kind, id, action).

    A connection whose only evidence is a retracted source is deprecated, with other evidence it is qualified;
    corrections ask for review, supersessions for their evidence to be moved.
    """
    ev = kg.evidence.join(changed, "source_ref", "left")
    per = kg.evidence.groupBy("connection_id").agg(F.count_distinct("source_ref").alias("n_sources"))
    hit = ev.where("change is not null").select("source_ref", "change", "connection_id").distinct().join(per, "connection_id")
    action = F.when(F.col("change") == "retracted", F.when(F.col("n_sources") > 1, "qualify").otherwise("deprecate")).when(F.col("change") == "corrected", "review").otherwise("migrate_evidence")
    c = hit.select("source_ref", F.lit("connection").alias("kind"), F.col("connection_id").alias("id"), action.alias("action"))
    e = kg.entities.join(changed.where("change = 'retracted'"), "source_ref").select("source_ref", F.lit("entity").alias("kind"), "id", F.lit("review").alias("action"))
    return c.unionByName(e)


def curation_decisions(candidates: DataFrame, gates: dict, repair=None, max_rounds: int = 2) -> DataFrame:
    """candidates with gates {name: Column, true where passed} -> decision by what failed; repair(frame) may mend rows between rounds.

    none failed: request_review; only `evidence`: hold; only one other: propose; more: reject.
    """
    failed = F.filter(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]), lambda x: x.isNotNull())
    df = candidates.withColumn("failed", failed)
    for _ in range(max_rounds if repair else 0):
        fine, poor = df.where(F.size("failed") == 0), df.where(F.size("failed") > 0).drop("failed")
        df = fine.unionByName(poor.mapInPandas(lambda it: (repair(p) for p in it), poor.schema).withColumn("failed", failed))
    n = F.size("failed")
    decision = F.when(n == 0, "request_review").when((n == 1) & F.array_contains("failed", "evidence"), "hold").when(n == 1, "propose").otherwise("reject")
    return df.withColumn("decision", decision)
