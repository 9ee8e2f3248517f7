"""Published views: subsets, policy views, consumer bundles, node tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.policy import VIEWS, active, retired
from weftgraph.functions.signature import claim_signature
from weftgraph.schema import KnowledgeSet


def review_views(kg: KnowledgeSet) -> DataFrame:
    """Every policy view from one pass over the connections: (view, id, claim_signature)."""
    names = F.filter(F.array(*[F.when(p(), F.lit(n)) for n, p in VIEWS.items()]), lambda x: x.isNotNull())
    return kg.connections.select(F.explode(names).alias("view"), "id", claim_signature().alias("claim_signature"))


def subset_by(kg: KnowledgeSet, column: str) -> DataFrame:
    """All values of an entity column at once: (value, kind, id); an edge is in where both ends are, a valued claim where its source is."""
    key = kg.entities.select(F.col("id"), F.col(column).alias("value")).where("value is not null")
    src, dst = key.select(F.col("id").alias("source"), F.col("value").alias("value")), key.select(F.col("id").alias("target"), F.col("value").alias("other"))
    edges = kg.connections.select("id", "source", "target", "amount").join(src, "source")
    edges = edges.join(dst, "target", "left").where((F.col("other") == F.col("value")) | (F.col("target").isNull() & F.col("amount").isNotNull()))
    return key.select("value", F.lit("entity").alias("kind"), "id").unionByName(edges.select("value", F.lit("connection").alias("kind"), "id"))


def subset_connections_only(kg: KnowledgeSet) -> DataFrame:
    """Entities that an edge touches."""
    ends = kg.connections.select(F.explode(F.array("source", "target")).alias("id")).where("id is not null").distinct()
    return kg.entities.join(ends, "id", "left_semi").select("id", "name")


def subset_ai_rag(kg: KnowledgeSet) -> DataFrame:
    """Entity rows with their outgoing edges as one sorted column."""
    out = kg.connections.where("target is not null").groupBy(F.col("source").alias("id")).agg(F.sort_array(F.collect_list(F.struct("relation", "target"))).alias("outgoing"))
    e = kg.entities.join(out, "id", "left")
    return e.select("id", "name", "definition", F.array_join(F.transform(F.coalesce("outgoing", F.array().cast("array<struct<relation: string, target: string>>")), lambda x: F.concat_ws(":", x["relation"], x["target"])), ",").alias("outgoing"))


def subset_educational(kg: KnowledgeSet) -> DataFrame:
    ok = kg.entities.where(F.col("status").isin("canonical", "human_reviewed")).select("id")
    edges = kg.connections.where(F.col("review").isin("reviewed", "canonical"))
    for end in ("source", "target"):
        edges = edges.join(ok.select(F.col("id").alias(end)), end, "left_semi")
    return ok.select(F.lit("entity").alias("kind"), "id").unionByName(edges.select(F.lit("connection").alias("kind"), "id"))


def consumer_bundle(kg: KnowledgeSet, profiles: list[dict]) -> DataFrame:
    """(consumer, kind, id) for every profile {id, domains, types, policy}: entities, edges among them and the sources they cite.

    Profiles are predicates of one pass; an entity or edge is tagged with the consumers it is for.
    """
    def inside(p):
        keep = ~retired()
        for column, key in (("domain", "domains"), ("type", "types"), ("subdomain", "subdomains")):
            if p.get(key):
                keep = keep & F.col(column).isin(p[key])
        return keep

    tag = lambda tests: F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda x: x.isNotNull())
    ent = kg.entities.select("id", F.explode(tag([(p["id"], inside(p)) for p in profiles])).alias("consumer"))
    con = kg.connections.select("id", "source", "target", F.explode(tag([(p["id"], VIEWS[p.get("policy", "all")]()) for p in profiles])).alias("consumer"))
    con = con.join(ent.select(F.col("id").alias("source"), "consumer"), ["source", "consumer"], "left_semi")
    both = con.where("target is not null").join(ent.select(F.col("id").alias("target"), "consumer"), ["target", "consumer"], "left_semi")
    con = both.select("consumer", "id").unionByName(con.where("target is null").select("consumer", "id"))
    cited = con.join(kg.evidence.select(F.col("connection_id").alias("id"), "source_ref"), "id").select("consumer", F.col("source_ref").alias("id")).distinct()
    cited = cited.join(kg.sources.select("id"), "id", "left_semi")
    kind = lambda df, k: df.select("consumer", F.lit(k).alias("kind"), "id")
    return kind(ent, "entity").unionByName(kind(con, "connection")).unionByName(kind(cited, "source"))


def consumer_preview(kg: KnowledgeSet, domain: str, statuses: list[str], cap: int = 100) -> DataFrame:
    return kg.entities.where((F.col("domain") == domain) & F.col("status").isin(statuses)).select("id", "name", "status").orderBy("id").limit(cap)


def jsonld_nodes(kg: KnowledgeSet) -> DataFrame:
    """Canonical records as typed nodes: (node_id, node_type, label, source, target)."""
    e = kg.entities.where("status = 'canonical'").select(F.col("id").alias("node_id"), F.initcap("type").alias("node_type"), F.col("name").alias("label"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target"))
    c = kg.connections.where(active() & (F.col("review") == "canonical")).select(F.col("id").alias("node_id"), F.lit("Assertion").alias("node_type"), F.col("relation").alias("label"), "source", "target")
    return e.unionByName(c)


def projection_mismatch(kg: KnowledgeSet, nodes: DataFrame | None = None) -> DataFrame:
    """Ids in a published node table (default: the one made now) or among the canonical records but not in both: (id, side)."""
    ids = kg.entities.where("status = 'canonical'").select("id").unionByName(kg.connections.where(active() & (F.col("review") == "canonical")).select("id"))
    nodes = (jsonld_nodes(kg) if nodes is None else nodes).select("node_id")
    out = ids.join(nodes, F.col("id") == F.col("node_id"), "full")
    return out.where("id is null or node_id is null").select(F.coalesce("id", "node_id").alias("id"), F.when(F.col("id").isNull(), "extra").otherwise("missing").alias("side"))
