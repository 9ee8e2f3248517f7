"""Histories: promotion chains, identity over versions, ledgers, drift between snapshots."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.policy import active
from weftgraph.operators.graph import ordinal
from weftgraph.runtime import stored, unused
from weftgraph.schema import KnowledgeSet

CHAIN = ["editor", "domain_expert", "board"]
_place = lambda c="stage": F.array_position(F.array(*[F.lit(s) for s in CHAIN]), F.col(c))


def stage_gap_violations(kg: KnowledgeSet, days: int = 1) -> DataFrame:
    w = Window.partitionBy("id").orderBy("at", _place())
    p = kg.promotions.select("id", "stage", "at", F.lag("stage").over(w).alias("before"), F.datediff("at", F.lag("at").over(w)).alias("days"))
    return p.where(F.col("before").isNotNull() & (F.col("days") < days)).select("id", "before", "stage", "days")


def as_recorded(promotions: DataFrame) -> tuple[DataFrame, Column]:
    """Promotions, and the actor of the latest of a group; of several at that time the one that was recorded first, in the order of the table, counts."""
    (row,) = unused(promotions.columns, "row")
    return promotions.withColumn(row, F.monotonically_increasing_id()), F.max_by("actor", F.struct("at", -F.col(row)))


def stage_independence(kg: KnowledgeSet) -> DataFrame:
    """Consecutive required stages by one actor, where no waiver is recorded; an absent stage is not bridged."""
    promotions, actor = as_recorded(kg.promotions)
    last = promotions.groupBy("id", "stage").agg(actor.alias("actor"), F.max("waiver").alias("waiver"))
    w = Window.partitionBy("id").orderBy("place")
    p = last.withColumn("place", _place()).withColumn("waived", F.max("waiver").over(Window.partitionBy("id")))
    p = p.withColumns({"other": F.lag("actor").over(w), "gap": F.col("place") - F.lag("place").over(w)})
    return p.where((F.col("gap") == 1) & (F.col("other") == F.col("actor")) & ~F.coalesce("waived", F.lit(False))).select("id", "stage", "actor")


def stage_order(kg: KnowledgeSet) -> DataFrame:
    seen = kg.promotions.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", _place().alias("place"), "stage"))), lambda x: x["stage"]).alias("stages"))
    return seen.select("id", F.array_join("stages", ",").alias("stages"), (F.col("stages") == F.array(*[F.lit(s) for s in CHAIN])).alias("in_order"))


def stage_of(kg: KnowledgeSet) -> DataFrame:
    """The most advanced stage and the one that is due next."""
    top = kg.promotions.groupBy("id").agg(F.max(_place()).alias("place"))
    chain = F.array(*[F.lit(s) for s in CHAIN])
    return top.select("id", F.get(chain, (F.col("place") - 1).cast("int")).alias("last_stage"), F.get(chain, F.col("place").cast("int")).alias("next_stage"))


def id_reassigned(kg: KnowledgeSet) -> DataFrame:
    """Ids with a second distinct (name, domain): the first two stamps."""
    stamps = kg.entity_versions.groupBy("id", "name", "domain").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy("id").orderBy("seq")
    s = stamps.withColumns({"rn": F.row_number().over(w), "stamp": F.concat_ws("/", "name", "domain")})
    two = s.where("rn <= 2").groupBy("id").agg(F.max(F.when(F.col("rn") == 1, F.col("stamp"))).alias("first_stamp"), F.max(F.when(F.col("rn") == 2, F.col("stamp"))).alias("second_stamp"))
    return two.where("second_stamp is not null")


def id_deleted(kg: KnowledgeSet, live: DataFrame) -> DataFrame:
    last = kg.entity_versions.groupBy("id").agg(F.max_by("status", "seq").alias("last_status"))
    return last.where(~F.coalesce(F.col("last_status") == "deprecated", F.lit(False))).join(live.select("id"), "id", "left_anti")


def triple_changed(kg: KnowledgeSet) -> DataFrame:
    """The first version whose triple differs from the last whole one; versions with a missing part are skipped."""
    v = kg.connection_versions.where("source is not null and relation is not null and target is not null")
    w = Window.partitionBy("id").orderBy("seq")
    v = v.withColumn("triple", F.concat_ws("|", "source", "relation", "target")).withColumn("before", F.lag("triple").over(w))
    return v.where("before <> triple").groupBy("id").agg(F.min("seq").alias("seq"), F.min_by("before", "seq").alias("before"), F.min_by("triple", "seq").alias("after"))


def triple_deleted(kg: KnowledgeSet, live: DataFrame) -> DataFrame:
    last = kg.connection_versions.groupBy("id").agg(F.max_by("status", "seq").alias("last_status"), F.max("replaced_by").alias("replaced_by"))
    return last.where("last_status not in ('superseded', 'deprecated') and replaced_by is null").join(live.select("id"), "id", "left_anti").select("id", "last_status")


def alias_invalid(kg: KnowledgeSet) -> DataFrame:
    """deprecated_by that is neither a live nor a historical id."""
    known = kg.entities.select(F.col("id").alias("pointer")).unionByName(kg.entity_versions.select(F.col("id").alias("pointer")))
    return kg.entities.where("deprecated_by is not null").select("id", F.col("deprecated_by").alias("pointer")).join(known, "pointer", "left_anti").select("id", "pointer")


def review_batches_entities(kg: KnowledgeSet, ranks: DataFrame, seed: int = 5, size: int = 40) -> DataFrame:
    """Pending entities by score: a seed batch of the first `seed` of each domain, the rest in batches of `size` over all."""
    score = F.round(F.col("rank") + 0.001 * F.col("degree"), 6)
    e = kg.entities.where("status = 'draft'").select("id", "domain").join(ranks, "id").select("id", "domain", score.alias("score"))
    e = e.withColumn("in_domain", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("score"), "id")))
    rest = ordinal(e.where(F.col("in_domain") > seed), [F.desc("score"), F.col("id")], "n")
    first = e.where(F.col("in_domain") <= seed).select("id", "domain", "score", F.lit(0).cast("long").alias("batch"))
    return first.unionByName(rest.select("id", "domain", "score", (F.floor((F.col("n") - 1) / size) + 1).cast("long").alias("batch")))


def review_batches_edges(kg: KnowledgeSet, ranks: DataFrame, size: int = 50) -> DataFrame:
    """Pending dependency edges by the rank of both ends and the target's in-degree, laws first, in batches."""
    dep = F.broadcast(kg.relations.where("family = 'dependency'").select(F.col("name").alias("relation")))
    c = kg.connections.where("review = 'unreviewed' and target is not null").join(dep, "relation", "left_semi").select("id", "source", "target")
    end = lambda p: ranks.select(F.col("id").alias(p), F.col("rank").alias(f"{p}_rank"), F.col("in_degree").alias(f"{p}_in"))
    kind = kg.entities.select(F.col("id").alias("source"), F.col("type").isin("law", "equation").alias("law"))
    score = F.round(F.col("source_rank") + F.col("target_rank") + 0.02 * F.col("target_in") + F.when(F.col("law"), 0.05).otherwise(0.0), 6)
    c = c.join(end("source"), "source").join(end("target"), "target").join(kind, "source").select("id", score.alias("score"))
    return ordinal(c, [F.desc("score"), F.col("id")], "n").select("id", "score", (F.floor((F.col("n") - 1) / size) + 1).cast("long").alias("batch"))


def edge_prechecks(kg: KnowledgeSet) -> DataFrame:
    """Dependency edges: are the types legal, and is the target's name in the source's definition."""
    dep = F.broadcast(kg.relations.where("family = 'dependency'").select(F.col("name").alias("relation"), "domain", "range"))
    end = lambda p: kg.entities.select(F.col("id").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in ("type", "name", "definition")])
    c = kg.connections.where("target is not null").join(dep, "relation").join(end("source"), "source").join(end("target"), "target")
    legal = F.array_contains("domain", F.col("source_type")) & F.array_contains("range", F.col("target_type"))
    return c.select("id", legal.alias("legal"), F.coalesce(F.contains(F.lower("source_definition"), F.lower("target_name")), F.lit(False)).alias("named"))


def manifest(kg: KnowledgeSet) -> DataFrame:
    """Reviewed entities and the hash of what was reviewed."""
    text = F.concat_ws("\x1f", "id", "name", "type", "domain", F.coalesce("definition", F.lit("")), "status")
    return kg.entities.where(F.col("status").isin("canonical", "human_reviewed")).select("id", F.sha2(text, 256).alias("digest"))


def drift(old: DataFrame, new: DataFrame, key: str = "id", digest: str = "digest") -> DataFrame:
    """(key, change added | removed | changed) between two tables of digests."""
    a, b = old.select(F.col(key).alias("k"), F.col(digest).alias("was")), new.select(F.col(key).alias("j"), F.col(digest).alias("now"))
    both = a.join(b, F.col("k") == F.col("j"), "full")
    change = F.when(F.col("k").isNull(), "added").when(F.col("j").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(F.coalesce("k", "j").alias(key), change.alias("change")).where("change is not null")


def source_digest(sources: DataFrame) -> DataFrame:
    return sources.select("id", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("type", "title", "publisher", "year", "url", "lifecycle")]), 256).alias("digest"))


def ledger_append(events: DataFrame, stream: str, order: list[str], body: list[str]) -> DataFrame:
    """Events chained by hash within each stream: hash = sha256(previous, body).

    A chain is sequential by nature, but needs its last hash only: streams lie in order in their partitions and are read batch by
    batch, so a long stream takes no more memory than a short one. Nulls come first; events without a stream are one stream.
    """
    names = list(dict.fromkeys([stream, *order, *body]))
    (text,) = unused(names, "text")
    rows = events.select(*names, F.concat_ws("|", *body).alias(text))
    fields = [f"`{n}` {t}" for n, t in rows.dtypes if n != text] + ["prev_hash string", "hash string"]

    def fold(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa

        at, last = (), ""
        for batch in batches:
            prev, own = [], []
            for key, said in zip(batch.column(stream).to_pylist(), batch.column(text).to_pylist(), strict=True):
                if at != (key,):
                    at, last = (key,), "0" * 64
                prev.append(last)
                last = sha256(f"{last}|{said}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(prev, pa.string()), pa.array(own, pa.string())], [*names, "prev_hash", "hash"])

    return rows.repartition(stream).sortWithinPartitions(stream, *order).mapInArrow(fold, ", ".join(fields))


def ledger_verify(ledger: DataFrame, stream: str, order: list[str], body: list[str], parts: int | None = None) -> DataFrame:
    """Each entry: does its hash recompute, and does it link to the last entry before it whose own hash is good.

    A prefix scan in two passes: entries are dealt by ranges of (stream, order), so a long stream lies in many partitions; each is scanned on its own, and the last
    good hash that a partition leaves of its last stream is carried on to those behind it, a row a partition.
    """
    parts = parts or int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = F.sha2(F.concat_ws("|", "prev_hash", *body), 256) == F.col("hash")
    own = ledger.select(stream, *order, "prev_hash", F.coalesce(good, F.lit(False)).alias("hash_ok"), F.col("hash").alias("__hash"))
    dealt = stored(own.repartitionByRange(parts, stream, *order).withColumn("__part", F.spark_partition_id()))
    told = F.when(F.col("hash_ok"), F.col("__hash"))
    ends = dealt.groupBy("__part", stream).agg(F.max_by("__hash", F.when(F.col("hash_ok"), F.struct(*order))).alias("__left"))
    # streams that go on behind a partition are at most one a partition
    many = ends.groupBy(stream).agg(F.count("*").alias("n")).where("n > 1").select(F.col(stream).alias("__of"))
    ends = ends.join(many, F.col(stream).eqNullSafe(F.col("__of")), "left_semi")
    before = Window.partitionBy(stream).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("__part").alias("__at"), F.col(stream).alias("__of"), F.last("__left", ignorenulls=True).over(before).alias("__carried"))
    w = Window.partitionBy("__part", stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("__here", F.last(told, ignorenulls=True).over(w)).join(F.broadcast(carried), (F.col("__part") == F.col("__at")) & F.col(stream).eqNullSafe(F.col("__of")), "left")
    last = F.coalesce("__here", "__carried", F.lit("0" * 64))
    return out.withColumn("link_ok", F.col("prev_hash").eqNullSafe(last)).select(stream, *order, "hash_ok", "link_ok")


def proposal_ids(claims: DataFrame) -> DataFrame:
    return ordinal(claims.select("claim_id"), [F.col("claim_id")], "n").select("claim_id", F.concat(F.lit("proposal-"), F.lpad(F.col("n").cast("string"), 6, "0")).alias("proposal_id"))


def stale(kg: KnowledgeSet) -> DataFrame:
    return kg.connections.where(~active()).select("id")


#: Members of a ledger entry that cite others, and the event by which the cited one was entered.
CITED = {"candidate_refs": "candidate_created", "evidence_refs": "evidence_extracted", "source_refs": "source_registered"}


def _citing(event: str):
    return lambda ref: F.struct(F.lit(event).alias("to_event"), ref.alias("to_ref"))


def ledger_lineage(entries: DataFrame, admitted: str = "canonical_admitted") -> DataFrame:
    """(asked, seq, event_type, ref): for each admitted record the entries that its admission rests on, however long the way, each once.

    entries: (seq, event_type, ref, candidate_refs, evidence_refs, source_refs), the last three lists. What cites what is joined once; then all records go
    back together, a join a hop, and only entries that are new for a record go on, so cycles end. Nulls in lists cite nothing.
    """
    none = F.array().cast("array<string>")
    cited = F.concat(*[F.transform(F.coalesce(c, none), _citing(e)) for c, e in CITED.items()])
    known = entries.select("seq", "event_type", "ref")
    to = known.select(F.col("seq").alias("to_seq"), F.col("event_type").alias("to_event"), F.col("ref").alias("to_ref"))
    cites = stored(entries.select("seq", F.explode(cited).alias("x")).select("seq", "x.*").join(to, ["to_event", "to_ref"]).select("seq", "to_seq").distinct())
    found = fresh = stored(known.where(F.col("event_type") == admitted).select(F.col("ref").alias("asked"), "seq").distinct())
    while not fresh.isEmpty():
        fresh = stored(fresh.join(cites, "seq").select("asked", F.col("to_seq").alias("seq")).distinct().join(found, ["asked", "seq"], "left_anti"))
        found = found.unionByName(fresh)
    return found.join(known, "seq").select("asked", "seq", "event_type", "ref")
