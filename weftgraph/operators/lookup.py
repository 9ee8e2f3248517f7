"""Look-ups over entities and connections; single ids are tables of ids, so that each call is one bulk job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.policy import retired, visible
from weftgraph.functions.signature import claim_signature
from weftgraph.schema import PREREQUISITE_RELATIONS, KnowledgeSet


def limited(df: DataFrame, limit: int | None, *order) -> DataFrame:
    if limit is None:
        return df
    if not isinstance(limit, int) or isinstance(limit, bool) or limit <= 0:
        raise ValueError("limit must be a positive integer")
    return df.orderBy(*order).limit(limit)


def summary(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("domain", "id", "name", "status", "type")])


def entity_get(kg: KnowledgeSet, ids: DataFrame, include_retired: bool = False) -> DataFrame:
    """ids(id) -> the entities, with a verdict: found, retired or missing."""
    e = kg.entities
    out = ids.select(F.col("id").alias("asked")).join(e, F.col("asked") == e["id"], "left")
    verdict = F.when(F.col("id").isNull(), "missing").when(retired() & F.lit(not include_retired), "retired").otherwise("found")
    return out.withColumn("verdict", verdict)


def entities_filter(kg: KnowledgeSet, domain=None, type=None, status=None, include_retired: bool = False, limit: int | None = None) -> DataFrame:
    e = kg.entities
    for column, value in (("domain", domain), ("type", type), ("status", status)):
        if value is not None:
            e = e.where(F.col(column) == value)
    if not include_retired and status not in ("deprecated", "superseded"):
        e = e.where(~retired())
    return limited(e, limit, "id")


def connections_filter(kg: KnowledgeSet, source=None, target=None, relation=None, review=None, policy=None, limit: int | None = None) -> DataFrame:
    c = kg.connections.where(visible(policy, review))
    for column, value in (("source", source), ("target", target), ("relation", relation)):
        if value is not None:
            c = c.where(F.col(column) == value)
    return limited(c, limit, "id")


def by_external_id(kg: KnowledgeSet, asked: DataFrame, include_retired: bool = False) -> DataFrame:
    """asked(scheme, value) -> entity_id where exactly one visible entity has it, and the verdict where not."""
    hits = kg.external_ids.join(kg.entities.select(F.col("id").alias("entity_id"), "status"), "entity_id")
    hits = hits.groupBy("scheme", "value").agg(F.count("*").alias("n_all"), F.sum((~retired() | F.lit(include_retired)).cast("int")).alias("n"), F.min(F.when(~retired() | F.lit(include_retired), F.col("entity_id"))).alias("entity_id"))
    out = asked.join(hits, ["scheme", "value"], "left")
    verdict = F.when(F.col("n_all").isNull(), "missing").when(F.col("n") == 0, "retired").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return out.withColumn("verdict", verdict).select("scheme", "value", "verdict", F.when(F.col("verdict") == "found", F.col("entity_id")).alias("entity_id"))


def values(kg: KnowledgeSet, relation=None, review=None, policy=None, include_retired: bool = False) -> DataFrame:
    """Valued claims of visible entities."""
    c = kg.connections.where(F.col("target").isNull() & F.col("amount").isNotNull() & visible(policy, review))
    if relation is not None:
        c = c.where(F.col("relation") == relation)
    own = kg.entities if include_retired else kg.entities.where(~retired())
    c = c.join(own.select(F.col("id").alias("source")), "source", "left_semi")
    return c.select(F.col("id").alias("connection_id"), "source", "relation", "amount", "unit", "review", "assertion_status", claim_signature().alias("claim_signature"))


def neighbors(kg: KnowledgeSet, ids: DataFrame | None = None, direction: str = "both", relation=None, review=None, policy=None, include_retired: bool = False, limit: int | None = None) -> DataFrame:
    """Edges of the given entities (all, if none are given), with a summary of the other end; a loop is reported out and as both."""
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    c = kg.connections.where(visible(policy, review) & F.col("target").isNotNull())
    if relation is not None:
        c = c.where(F.col("relation") == relation)
    c = c.select(F.col("id").alias("connection_id"), "source", "target", "relation", "review", "assertion_status")
    # both sides of an edge from one pass over the connections
    sides = []
    if direction != "in":
        sides.append(F.struct(F.col("source").alias("id"), F.col("target").alias("other"), F.lit("out").alias("direction")))
    if direction != "out":
        loop = F.when(F.col("source") == F.col("target"), "both").otherwise("in")
        sides.append(F.struct(F.col("target").alias("id"), F.col("source").alias("other"), loop.alias("direction")))
    e = c.withColumn("side", F.explode(F.array(*sides))).select("*", "side.id", "side.other", "side.direction").drop("side")
    shown = kg.entities if include_retired else kg.entities.where(~retired())
    near = shown.select(F.col("id").alias("other"), *[F.col(x).alias(f"other_{x}") for x in ("name", "domain", "type", "status")])
    out = e.join(near, "other").join(shown.select("id"), "id", "left_semi")
    if ids is not None:
        out = out.join(ids.select("id").distinct(), "id", "left_semi")
    return limited(out, limit, "connection_id", "direction", "other")


def concept_details(kg: KnowledgeSet) -> DataFrame:
    """Prerequisites, dependents and related entities of each entity, by the viewer's two dependency relations."""
    need = F.col("relation").isin("mathematically_requires", "logically_requires")
    c = kg.connections.where(~F.coalesce(F.col("assertion_status").isin("deprecated", "superseded"), F.lit(False)) & F.col("target").isNotNull())
    side = F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("other"), F.when(need, "prerequisite").otherwise("related").alias("role")),
        F.struct(F.col("target").alias("id"), F.col("source").alias("other"), F.when(need, "dependent").otherwise("related").alias("role")),
    ))
    links = c.select(side.alias("s")).select("s.*").join(kg.entities.select(F.col("id").alias("other")), "other", "left_semi")
    of = lambda r: F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("other"))))
    return links.join(kg.entities.select("id"), "id", "left_semi").groupBy("id").agg(*[F.array_join(of(r), ",").alias(f"{r}s") for r in ("prerequisite", "dependent", "related")])


def review_list(kg: KnowledgeSet) -> DataFrame:
    return kg.connections.select("id", "source", "relation", F.coalesce("target", F.concat(F.lit("value:"), F.col("amount"))).alias("claim"), "review", "assertion_status")


def review_show(kg: KnowledgeSet) -> DataFrame:
    """Connections with both ends' names and cut definitions, and the relation's family."""
    end = lambda p: kg.entities.select(F.col("id").alias(p), F.col("name").alias(f"{p}_name"), F.substring("definition", 1, 200).alias(f"{p}_definition"))
    family = F.broadcast(kg.relations.select(F.col("name").alias("relation"), "family"))
    return kg.connections.join(end("source"), "source", "left").join(end("target"), "target", "left").join(family, "relation", "left").select(
        "id", "source", "source_name", "source_definition", "relation", "family", "target", "target_name", "target_definition", "review")


def concept_summary(kg: KnowledgeSet) -> DataFrame:
    return kg.entities.select("id", "name", "domain", "type", "status")


def edge_projection(kg: KnowledgeSet, domain=None, relation=None) -> DataFrame:
    """Drawable edges: rejected ones stay, retired assertions and edges without both ends go. Width is style times trust."""
    c = kg.connections.where(~F.coalesce(F.col("assertion_status").isin("deprecated", "superseded"), F.lit(False)))
    if relation is not None:
        c = c.where(F.col("relation") == relation)
    ends = kg.entities if domain is None else kg.entities.where(F.col("domain") == domain)
    for end in ("source", "target"):
        c = c.join(ends.select(F.col("id").alias(end)), end, "left_semi")
    family = F.broadcast(kg.relations.select(F.col("name").alias("relation"), "family"))
    style = F.when(F.col("family") == "dependency", 2.0).when(F.col("family") == "structural", 1.5).otherwise(1.0)
    trust = F.coalesce("review", F.lit("unreviewed"))
    scale = F.when(trust == "canonical", 1.0).when(trust == "reviewed", 0.8).when(trust == "rejected", 0.3).otherwise(0.5)
    return c.join(family, "relation", "left").select("id", "source", "target", "relation", trust.alias("trust"), F.round(style * scale, 3).alias("width"))


#: Keywords that name a cluster, the first that a node's text holds.
CLUSTERS = ["region", "nation", "customer", "supplier", "widget", "brass", "copper", "tin", "nickel"]


def node_projection(kg: KnowledgeSet, clusters: list[str] = CLUSTERS) -> DataFrame:
    """Nodes with cluster (first keyword in the slug), degree and a size clamped by type."""
    edges = edge_projection(kg)
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    words = F.array(*[F.lit(w) for w in clusters])
    hay = F.lower(F.concat_ws(" ", "name", "subdomain"))
    cluster = F.coalesce(F.get(F.filter(words, lambda w: F.contains(hay, w)), F.lit(0)), F.lit("other"))
    most = F.when(F.col("type") == "law", 30).otherwise(20)
    out = kg.entities.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return out.select("id", "type", cluster.alias("cluster"), "degree", F.least(F.lit(4) + F.col("degree"), most).cast("long").alias("size"))


def inverse_edges(kg: KnowledgeSet) -> DataFrame:
    inverse = F.broadcast(kg.relations.where("inverse is not null").select(F.col("name").alias("relation"), "inverse"))
    c = kg.connections.where("target is not null").join(inverse, "relation")
    return c.select(F.col("target").alias("source"), F.col("inverse").alias("relation"), F.col("source").alias("target"), F.col("id").alias("derived_from"))


def prerequisite_relations(c: DataFrame) -> DataFrame:
    return c.where(F.col("relation").isin(PREREQUISITE_RELATIONS) & F.col("target").isNotNull())


def relation(kg: KnowledgeSet, asked: DataFrame) -> DataFrame:
    """asked(relation) -> its row of the registry; a relation that the registry lacks has none."""
    return kg.relations.join(asked.select(F.col("relation").alias("name")).distinct(), "name", "left_semi").select("name", "family", "inverse", "transitive", "symmetric", "status")


def vocabularies(kg: KnowledgeSet) -> DataFrame:
    """(vocabulary, term, n): the terms in use, each table scanned once."""
    pair = lambda name, c: F.struct(F.lit(name).alias("vocabulary"), c.alias("term"))
    e = kg.entities.select(F.explode(F.array(pair("domain", F.col("domain")), pair("subdomain", F.concat("domain", F.lit("/"), "subdomain")), pair("type", F.col("type")), pair("status", F.col("status")))).alias("x"))
    c = kg.connections.select(F.explode(F.array(pair("relation", F.col("relation")), pair("review", F.col("review")))).alias("x"))
    both = e.unionByName(c).unionByName(kg.sources.select(pair("source type", F.col("type")).alias("x"))).select("x.*")
    return both.where("term is not null").groupBy("vocabulary", "term").agg(F.count("*").alias("n"))
