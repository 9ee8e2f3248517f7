"""All queries of the library over the graph in the driver's tables, with the same results in plain SQL.

Lists are joined to text, so that results compare across engines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.operators import curate, graph, history, lookup, match, quality, records, reports, validation, vector, views
from weftgraph.plans import testgraph
from weftgraph.plans.testgraph import ctes, knowledge
from weftgraph.runtime import read, ship
from weftgraph.sources import bundle, files, merkle
from weftgraph.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

ACTIVE = "coalesce(assertion_status = 'active', false)"
VISIBLE = f"({ACTIVE} AND NOT coalesce(review = 'rejected', false))"
TRUSTED = f"({ACTIVE} AND coalesce(review IN ('reviewed', 'canonical'), false) AND (NOT coalesce(asserted_by = 'llm', false) OR review = 'canonical'))"
LIVE = "NOT coalesce(status IN ('deprecated', 'superseded'), false)"
SIGNATURE = "'sha256:' || sha256(source || chr(31) || relation || chr(31) || coalesce(target, 'None') || chr(31) || coalesce(polarity, 'positive') || chr(31) || '[]')"


def add(name: str, f: Callable, sql: str | None = None, *tables: str) -> None:
    """f takes a KnowledgeSet; sql goes after the graph's own tables."""
    QUERIES[name] = lambda spark, sf_dir: (ship(spark), f(knowledge(spark, sf_dir)))[1]
    if sql is not None:
        head = ctes(*tables)
        ORACLE[name] = head + (", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else "\n" + sql)


def add_rough(name: str, f: Callable, sql: str | None = None, *tables: str) -> None:
    """The same over the records as a careless hand would leave them, so that there is something to find."""
    def query(spark, sf_dir):
        ship(spark)
        return f(knowledge(spark, sf_dir).with_(entities=testgraph.table(spark, sf_dir, "rough_entities"), connections=testgraph.table(spark, sf_dir, "rough_connections")))

    QUERIES[name] = query
    if sql is not None:
        rough = [f"rough_{t}" if t in ("entities", "connections") else t for t in tables]
        sql = re.sub(r"\b(entities|connections)\b", r"rough_\1", sql)
        ORACLE[name] = ctes(*rough) + (", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else "\n" + sql)


def add_raw(name: str, f: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: (ship(spark), f(spark, sf_dir))[1]
    if sql is not None:
        ORACLE[name] = sql


# look-ups

_E = "id, type, name, domain, status"
add("entity_get", lambda kg: lookup.entity_get(kg, kg.entities.select("id")).select("asked", "verdict", "name"),
    f"SELECT id AS asked, CASE WHEN {LIVE} THEN 'found' ELSE 'retired' END AS verdict, name FROM entities", "entities")
add("entities_filter", lambda kg: lookup.entities_filter(kg, domain="org", type="law").select("id", "type", "name", "domain", "status"),
    f"SELECT {_E} FROM entities WHERE domain = 'org' AND type = 'law' AND {LIVE}", "entities")
add("limit", lambda kg: lookup.entities_filter(kg, domain="prod", limit=25).select("id", "type", "name", "domain", "status"),
    f"SELECT {_E} FROM entities WHERE domain = 'prod' AND {LIVE} ORDER BY id LIMIT 25", "entities")
add("by_external_id", lambda kg: lookup.by_external_id(kg, kg.external_ids.select("scheme", "value").distinct()),
    f"""SELECT scheme, value, CASE WHEN n = 0 THEN 'retired' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS verdict, CASE WHEN n = 1 THEN entity_id END AS entity_id FROM (
  SELECT scheme, value, count(*) FILTER ({LIVE}) AS n, min(entity_id) FILTER ({LIVE}) AS entity_id FROM external_ids JOIN entities ON entity_id = id GROUP BY scheme, value)""", "external_ids", "entities")
_C = "id, source, relation, target, review"
add("connections_filter", lambda kg: lookup.connections_filter(kg, relation="applies_to", policy="reviewed").select("id", "source", "relation", "target", "review"),
    f"SELECT {_C} FROM connections WHERE relation = 'applies_to' AND {ACTIVE} AND review IN ('reviewed', 'canonical')", "connections")
add("connections_rejected", lambda kg: lookup.connections_filter(kg, review="rejected").select("id", "source", "relation", "target", "review"),
    f"SELECT {_C} FROM connections WHERE {ACTIVE} AND review = 'rejected'", "connections")
add("values", lookup.values,
    f"""SELECT id AS connection_id, source, relation, amount, unit, review, assertion_status, {SIGNATURE} AS claim_signature FROM connections
WHERE target IS NULL AND amount IS NOT NULL AND {VISIBLE} AND source IN (SELECT id FROM entities WHERE {LIVE})""", "entities", "connections")
add("neighbors", lambda kg: lookup.neighbors(kg, policy="trusted"),
    f"""WITH sides AS (
  SELECT id AS connection_id, source, target, relation, review, assertion_status, source AS id, target AS other, 'out' AS direction FROM connections WHERE target IS NOT NULL AND {TRUSTED}
  UNION ALL SELECT id, source, target, relation, review, assertion_status, target, source, CASE WHEN source = target THEN 'both' ELSE 'in' END FROM connections WHERE target IS NOT NULL AND {TRUSTED})
SELECT s.*, o.name AS other_name, o.domain AS other_domain, o.type AS other_type, o.status AS other_status FROM sides s JOIN entities o ON s.other = o.id JOIN entities e ON s.id = e.id
WHERE NOT coalesce(o.status IN ('deprecated', 'superseded'), false) AND NOT coalesce(e.status IN ('deprecated', 'superseded'), false)""", "entities", "connections")
add("concept_details", lookup.concept_details,
    """WITH c AS (SELECT * FROM connections WHERE target IS NOT NULL AND NOT coalesce(assertion_status IN ('deprecated', 'superseded'), false)),
links AS (SELECT source AS id, target AS other, CASE WHEN relation IN ('mathematically_requires', 'logically_requires') THEN 'prerequisite' ELSE 'related' END AS role FROM c
  UNION SELECT target, source, CASE WHEN relation IN ('mathematically_requires', 'logically_requires') THEN 'dependent' ELSE 'related' END FROM c)
SELECT id, coalesce(string_agg(other, ',' ORDER BY other) FILTER (role = 'prerequisite'), '') AS prerequisites, coalesce(string_agg(other, ',' ORDER BY other) FILTER (role = 'dependent'), '') AS dependents,
  coalesce(string_agg(other, ',' ORDER BY other) FILTER (role = 'related'), '') AS relateds FROM links WHERE id IN (SELECT id FROM entities) AND other IN (SELECT id FROM entities) GROUP BY id""", "entities", "connections")
add("review_list", lookup.review_list, "SELECT id, source, relation, coalesce(target, 'value:' || amount) AS claim, review, assertion_status FROM connections", "connections")
add("review_show", lookup.review_show,
    """SELECT c.id, source, s.name AS source_name, substr(s.definition, 1, 200) AS source_definition, relation, family, target, t.name AS target_name, substr(t.definition, 1, 200) AS target_definition, review
FROM connections c LEFT JOIN entities s ON s.id = c.source LEFT JOIN entities t ON t.id = c.target LEFT JOIN relations r ON r.name = c.relation""", "entities", "connections", "relations")
add("concept_summary", lookup.concept_summary, "SELECT id, name, domain, type, status FROM entities", "entities")
add("edge_projection", lookup.edge_projection,
    """SELECT c.id, source, target, relation, coalesce(review, 'unreviewed') AS trust,
  round((CASE family WHEN 'dependency' THEN 2.0 WHEN 'structural' THEN 1.5 ELSE 1.0 END)::DOUBLE * (CASE coalesce(review, 'unreviewed') WHEN 'canonical' THEN 1.0 WHEN 'reviewed' THEN 0.8 WHEN 'rejected' THEN 0.3 ELSE 0.5 END)::DOUBLE, 3) AS width
FROM connections c LEFT JOIN relations r ON r.name = c.relation WHERE NOT coalesce(assertion_status IN ('deprecated', 'superseded'), false) AND source IN (SELECT id FROM entities) AND target IN (SELECT id FROM entities)""", "entities", "connections", "relations")
add("node_projection", lookup.node_projection,
    """WITH e AS (SELECT source, target FROM connections WHERE NOT coalesce(assertion_status IN ('deprecated', 'superseded'), false) AND source IN (SELECT id FROM entities) AND target IN (SELECT id FROM entities)),
d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id)
SELECT n.id, type, CASE WHEN h LIKE '%region%' THEN 'region' WHEN h LIKE '%nation%' THEN 'nation' WHEN h LIKE '%customer%' THEN 'customer' WHEN h LIKE '%supplier%' THEN 'supplier' WHEN h LIKE '%widget%' THEN 'widget'
  WHEN h LIKE '%brass%' THEN 'brass' WHEN h LIKE '%copper%' THEN 'copper' WHEN h LIKE '%tin%' THEN 'tin' WHEN h LIKE '%nickel%' THEN 'nickel' ELSE 'other' END AS cluster,
  coalesce(degree, 0) AS degree, CAST(least(4 + coalesce(degree, 0), CASE WHEN type = 'law' THEN 30 ELSE 20 END) AS BIGINT) AS size
FROM (SELECT *, lower(concat_ws(' ', name, subdomain)) AS h FROM entities) n LEFT JOIN d ON d.id = n.id""", "entities", "connections")
add("inverse_edges", lookup.inverse_edges,
    "SELECT target AS source, inverse AS relation, source AS target, id AS derived_from FROM connections JOIN relations ON name = relation WHERE inverse IS NOT NULL AND target IS NOT NULL", "connections", "relations")

# policies and views

_POLICY_SQL = {
    "all": VISIBLE, "reviewed": f"({ACTIVE} AND review IN ('reviewed', 'canonical'))", "canonical": f"({ACTIVE} AND review = 'canonical')", "trusted": TRUSTED,
    "proposed": "(assertion_type = 'proposed' AND review = 'unreviewed')", "rejected": "review = 'rejected'",
}


def _policy_query(name: str) -> Callable:
    from weftgraph.functions.policy import policy

    return lambda kg: kg.connections.where(policy(name)).select("id", "source", "relation", "target", "review")


for _name, _where in _POLICY_SQL.items():
    add(f"policy_{_name}", _policy_query(_name), f"SELECT {_C} FROM connections WHERE {_where}", "connections")
add("review_views", views.review_views, "\nUNION ALL ".join(f"SELECT '{n}' AS view, id, {SIGNATURE} AS claim_signature FROM connections WHERE {w}" for n, w in _POLICY_SQL.items()), "connections")
for _col in ("domain", "type", "status"):
    add(f"subset_{_col}", (lambda c: lambda kg: views.subset_by(kg, c))(_col),
        f"""SELECT {_col} AS value, 'entity' AS kind, id FROM entities UNION ALL
SELECT s.{_col}, 'connection', c.id FROM connections c JOIN entities s ON s.id = c.source LEFT JOIN entities t ON t.id = c.target WHERE s.{_col} = t.{_col} OR (c.target IS NULL AND c.amount IS NOT NULL)""", "entities", "connections")
add("subset_entities_only", lookup.concept_summary, "SELECT id, name, domain, type, status FROM entities", "entities")
add("subset_connections_only", views.subset_connections_only, "SELECT id, name FROM entities WHERE id IN (SELECT source FROM connections) OR id IN (SELECT target FROM connections)", "entities", "connections")
add("subset_ai_rag", views.subset_ai_rag,
    """SELECT id, name, definition, coalesce(outgoing, '') AS outgoing FROM entities LEFT JOIN (
  SELECT source, string_agg(relation || ':' || target, ',' ORDER BY relation, target) AS outgoing FROM connections WHERE target IS NOT NULL GROUP BY source) ON source = id""", "entities", "connections")
add("subset_educational", views.subset_educational,
    """WITH ok AS (SELECT id FROM entities WHERE status IN ('canonical', 'human_reviewed'))
SELECT 'entity' AS kind, id FROM ok UNION ALL SELECT 'connection', id FROM connections WHERE review IN ('reviewed', 'canonical') AND source IN (SELECT id FROM ok) AND target IN (SELECT id FROM ok)""", "entities", "connections")
PROFILES = [{"id": "atlas", "domains": ["geo"], "policy": "all"}, {"id": "shop", "domains": ["prod", "org"], "types": ["unit", "law"], "policy": "reviewed"}, {"id": "archive", "policy": "canonical"}]


def _bundle_sql() -> str:
    def where(p):
        parts = [LIVE]
        for col, key in (("domain", "domains"), ("type", "types")):
            if p.get(key):
                parts.append(f"{col} IN ({', '.join(repr(x) for x in p[key])})")
        return " AND ".join(parts)

    ent = " UNION ALL ".join(f"SELECT '{p['id']}' AS consumer, id FROM entities WHERE {where(p)}" for p in PROFILES)
    con = " UNION ALL ".join(f"SELECT '{p['id']}' AS consumer, id, source, target FROM connections WHERE {_POLICY_SQL[p['policy']]}" for p in PROFILES)
    return f"""WITH ent AS ({ent}), con AS (SELECT consumer, id FROM ({con}) c WHERE EXISTS (SELECT 1 FROM ent e WHERE e.consumer = c.consumer AND e.id = c.source)
  AND (target IS NULL OR EXISTS (SELECT 1 FROM ent e WHERE e.consumer = c.consumer AND e.id = c.target)))
SELECT consumer, 'entity' AS kind, id FROM ent UNION ALL SELECT consumer, 'connection', id FROM con UNION ALL
SELECT DISTINCT consumer, 'source', source_ref FROM con JOIN evidence ON connection_id = id WHERE source_ref IN (SELECT id FROM sources)"""


add("consumer_bundle", lambda kg: views.consumer_bundle(kg, PROFILES), _bundle_sql(), "entities", "connections", "evidence", "sources")
add("consumer_preview", lambda kg: views.consumer_preview(kg, "org", ["canonical", "human_reviewed"]),
    "SELECT id, name, status FROM entities WHERE domain = 'org' AND status IN ('canonical', 'human_reviewed') ORDER BY id LIMIT 100", "entities")
add("jsonld_nodes", views.jsonld_nodes,
    f"""SELECT id AS node_id, upper(substr(type, 1, 1)) || substr(type, 2) AS node_type, name AS label, CAST(NULL AS STRING) AS source, CAST(NULL AS STRING) AS target FROM entities WHERE status = 'canonical'
UNION ALL SELECT id, 'Assertion', relation, source, target FROM connections WHERE {ACTIVE} AND review = 'canonical'""", "entities", "connections")
_NODES = lambda kg: views.jsonld_nodes(kg.with_(entities=kg.entities.where("id not like '%70'").withColumn("status", F.when(F.col("id").like("%23"), "canonical").otherwise(F.col("status")))))
add("projection_mismatch", lambda kg: views.projection_mismatch(kg, _NODES(kg)),
    "SELECT id, 'missing' AS side FROM entities WHERE status = 'canonical' AND id LIKE '%70' UNION ALL SELECT id, 'extra' FROM entities WHERE status <> 'canonical' AND id LIKE '%23'", "entities")

# graph

add("resolve", graph.resolve,
    """WITH RECURSIVE walk AS (SELECT id, id AS pos, 0 AS hops FROM entities UNION ALL
  SELECT w.id, n.id, w.hops + 1 FROM walk w JOIN entities e ON e.id = w.pos JOIN entities n ON n.id = e.deprecated_by WHERE e.deprecated_by <> e.id AND w.hops < 100),
last AS (SELECT id, max(hops) AS hops, max_by(pos, hops) AS pos FROM walk GROUP BY id)
SELECT l.id, pos AS resolved, CAST(hops AS BIGINT) AS hops, CASE WHEN e.deprecated_by IS NOT NULL THEN 'dangling' ELSE 'ok' END AS verdict FROM last l JOIN entities e ON e.id = l.pos""".replace("WITH RECURSIVE", "WITH"), "entities")
ORACLE["resolve"] = ORACLE["resolve"].replace("WITH entities", "WITH RECURSIVE entities", 1)
_NEED = "relation IN ('mathematically_requires', 'requires', 'logically_requires', 'depends_on')"
add("prerequisites", lambda kg: graph.prerequisites(kg, kg.entities.select("id"), policy="reviewed").select("id", "prerequisite"),
    f"""WITH shown AS (SELECT * FROM entities WHERE {LIVE}), edges AS (SELECT DISTINCT source, target FROM connections WHERE {_NEED} AND target IN (SELECT id FROM shown) AND {_POLICY_SQL['reviewed']}),
reach AS (SELECT id, id AS node FROM shown UNION SELECT r.id, e.target FROM reach r JOIN edges e ON e.source = r.node)
SELECT id, node AS prerequisite FROM reach WHERE id <> node""", "entities", "connections")
ORACLE["prerequisites"] = ORACLE["prerequisites"].replace("WITH entities", "WITH RECURSIVE entities", 1)
add("transitive_closure", lambda kg: graph.transitive_closure(kg).select("relation", "source", "target", F.array_join("path", " > ").alias("path")),
    """WITH edges AS (SELECT DISTINCT relation, source, target FROM connections WHERE relation IN (SELECT name FROM relations WHERE transitive) AND target IS NOT NULL AND source <> target),
walk AS (SELECT relation, source, target, source || ' > ' || target AS path, 1 AS n FROM edges UNION ALL
  SELECT w.relation, w.source, e.target, path || ' > ' || e.target, n + 1 FROM walk w JOIN edges e ON e.relation = w.relation AND e.source = w.target WHERE n < 40)
SELECT relation, source, target, min(path) AS path FROM walk w WHERE n = (SELECT min(n) FROM walk v WHERE v.relation = w.relation AND v.source = w.source AND v.target = w.target) AND n > 1 GROUP BY relation, source, target""", "connections", "relations")
ORACLE["transitive_closure"] = ORACLE["transitive_closure"].replace("WITH pairs", "WITH RECURSIVE pairs", 1)
add("prerequisite_chains", graph.prerequisite_chains,
    f"""WITH edges AS (SELECT DISTINCT source, target FROM connections WHERE {ACTIVE} AND target IS NOT NULL AND relation IN ('mathematically_requires', 'logically_requires')),
starts AS (SELECT DISTINCT source FROM edges ORDER BY source LIMIT 20),
walk AS (SELECT [source, target] AS p FROM edges WHERE source IN (SELECT source FROM starts) AND source <> target UNION ALL SELECT list_append(p, target) FROM walk JOIN edges ON source = p[-1] WHERE len(p) < 5 AND NOT list_contains(p, target))
SELECT array_to_string(p, ' > ') AS path, CAST(len(p) - 1 AS INTEGER) AS length FROM walk""", "connections")
ORACLE["prerequisite_chains"] = ORACLE["prerequisite_chains"].replace("WITH pairs", "WITH RECURSIVE pairs", 1)
add_rough("relationship_cycles", graph.relationship_cycles,
    f"""WITH e AS (SELECT DISTINCT relation, source, target FROM connections WHERE {ACTIVE} AND target IS NOT NULL AND relation IN (SELECT name FROM relations WHERE transitive AND NOT "symmetric")),
reach AS (SELECT relation, source AS a, target AS b FROM e UNION SELECT r.relation, r.a, e.target FROM reach r JOIN e ON e.relation = r.relation AND e.source = r.b),
scc AS (SELECT x.relation, x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.relation = y.relation AND x.a = y.b AND x.b = y.a GROUP BY x.relation, x.a),
f AS (SELECT e.relation, e.source AS node, min(e.target) AS onward FROM e JOIN scc s ON s.relation = e.relation AND s.node = e.source JOIN scc t ON t.relation = e.relation AND t.node = e.target AND t.component = s.component GROUP BY e.relation, e.source),
walk AS (SELECT DISTINCT relation, component, [component] AS p FROM scc UNION ALL SELECT w.relation, w.component, list_append(p, onward) FROM walk w JOIN f ON f.relation = w.relation AND f.node = p[-1] WHERE NOT list_contains(p, onward)),
ring AS (SELECT w.relation, component, p[list_position(p, onward) :] AS c FROM walk w JOIN f ON f.relation = w.relation AND f.node = p[-1] WHERE list_contains(p, onward)),
turned AS (SELECT relation, component, list_concat(c[list_position(c, list_min(c)) :], c[: list_position(c, list_min(c)) - 1]) AS c FROM ring)
SELECT relation, component, (SELECT count(*) FROM scc s WHERE s.relation = t.relation AND s.component = t.component) AS size, CAST(i - 1 AS BIGINT) AS position, c[i] AS node FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM turned) t""", "connections", "relations")
ORACLE["relationship_cycles"] = "WITH RECURSIVE" + ORACLE["relationship_cycles"].removeprefix("WITH")
add("connected_components", graph.connected_components,
    """WITH edges AS (SELECT source AS a, target AS b FROM connections WHERE target IS NOT NULL UNION SELECT target, source FROM connections WHERE target IS NOT NULL),
near AS (SELECT id, least(id, coalesce(min(b), id)) AS low FROM entities LEFT JOIN edges ON a = id GROUP BY id),
near2 AS (SELECT n.id, least(n.low, coalesce(min(m.low), n.low)) AS low FROM near n LEFT JOIN edges ON a = n.id LEFT JOIN near m ON m.id = b GROUP BY n.id, n.low),
near3 AS (SELECT n.id, least(n.low, coalesce(min(m.low), n.low)) AS low FROM near2 n LEFT JOIN edges ON a = n.id LEFT JOIN near2 m ON m.id = b GROUP BY n.id, n.low),
near4 AS (SELECT n.id, least(n.low, coalesce(min(m.low), n.low)) AS low FROM near3 n LEFT JOIN edges ON a = n.id LEFT JOIN near3 m ON m.id = b GROUP BY n.id, n.low),
near5 AS (SELECT n.id, least(n.low, coalesce(min(m.low), n.low)) AS low FROM near4 n LEFT JOIN edges ON a = n.id LEFT JOIN near4 m ON m.id = b GROUP BY n.id, n.low),
near6 AS (SELECT n.id, least(n.low, coalesce(min(m.low), n.low)) AS low FROM near5 n LEFT JOIN edges ON a = n.id LEFT JOIN near5 m ON m.id = b GROUP BY n.id, n.low)
SELECT low AS component, id, count(*) OVER (PARTITION BY low) AS size FROM near6""", "entities", "connections")


def _rank_sql() -> str:
    out = """WITH edges AS (SELECT source, target FROM connections WHERE target IS NOT NULL),
nodes AS (SELECT id, (SELECT count(*) FROM edges WHERE target = id) AS in_degree, (SELECT count(*) FROM edges WHERE source = id) AS out_degree FROM entities),
total AS (SELECT count(*)::DOUBLE AS n FROM nodes), ways AS (SELECT DISTINCT source, target, out_degree FROM edges JOIN nodes ON id = source),
r0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM nodes, total)"""
    for i in range(1, 6):
        out += f""",
r{i} AS (SELECT id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(got, 0) AS rank FROM nodes CROSS JOIN total LEFT JOIN (SELECT target, sum(rank / out_degree) AS got FROM ways JOIN r{i - 1} ON id = source GROUP BY target) ON target = id)"""
    return out + "\n"


add("centrality", graph.centrality,
    _rank_sql() + "SELECT id, in_degree, out_degree, in_degree + out_degree AS degree, round(rank, 6) AS rank FROM nodes JOIN r5 USING (id)", "entities", "connections")
add("centrality_top", lambda kg: graph.centrality_top(kg).select("id", "degree"), _rank_sql() + "SELECT id, in_degree + out_degree AS degree FROM nodes JOIN r5 USING (id) ORDER BY round(rank, 6) DESC, id LIMIT 20", "entities", "connections")
add("cross_domain_pathways", graph.cross_domain_pathways,
    "SELECT c.id, source, s.domain AS source_domain, target, t.domain AS target_domain FROM connections c LEFT JOIN entities s ON s.id = source LEFT JOIN entities t ON t.id = target WHERE relation = 'bridges' AND target IS NOT NULL", "entities", "connections")
for _key, _rel in (("analogy_pairs", "analogous_to"), ("approximation_chains", "approximates")):
    add(_key, (lambda r: lambda kg: graph.pairs_by_relation(kg, r))(_rel), f"SELECT id, source, target, review FROM connections WHERE relation = '{_rel}'", "connections")
add("edge_union", graph.edge_union,
    """WITH c AS (SELECT * FROM connections WHERE target IS NOT NULL), d AS (SELECT DISTINCT relation, source, target FROM c WHERE relation IN (SELECT name FROM relations WHERE transitive) AND source <> target),
walk AS (SELECT * FROM d UNION SELECT w.relation, w.source, d.target FROM walk w JOIN d ON d.relation = w.relation AND d.source = w.target WHERE w.source <> d.target)
SELECT source, relation, target, false AS derived, 'explicit' AS method FROM c UNION ALL SELECT target, inverse, source, true, 'inverse' FROM c JOIN relations ON name = relation WHERE inverse IS NOT NULL UNION ALL
SELECT source, relation, target, true, 'closure' FROM (SELECT relation, source, target FROM walk EXCEPT SELECT * FROM d)""", "connections", "relations")
ORACLE["edge_union"] = ORACLE["edge_union"].replace("WITH pairs", "WITH RECURSIVE pairs", 1)
add("dangling_endpoints", graph.dangling_endpoints,
    """SELECT 'source' AS kind, id AS record, source AS pointer FROM connections WHERE source NOT IN (SELECT id FROM entities) UNION ALL
SELECT 'target', id, target FROM connections WHERE target IS NOT NULL AND target NOT IN (SELECT id FROM entities) UNION ALL
SELECT 'deprecated_by', id, deprecated_by FROM entities WHERE deprecated_by IS NOT NULL AND deprecated_by NOT IN (SELECT id FROM entities) UNION ALL
SELECT 'replaced_by', id, replaced_by FROM connections WHERE replaced_by IS NOT NULL AND replaced_by NOT IN (SELECT id FROM connections) UNION ALL
SELECT 'evidence', connection_id, source_ref FROM evidence WHERE source_ref NOT IN (SELECT id FROM sources)""", "entities", "connections", "evidence", "sources")
add("structural_index", graph.structural_index,
    """SELECT id, coalesce(o, '') AS outgoing, coalesce(i, '') AS incoming FROM entities
LEFT JOIN (SELECT source, string_agg(relation || ':' || target, ',' ORDER BY relation || ':' || target) AS o FROM connections WHERE target IS NOT NULL GROUP BY source) a ON a.source = id
LEFT JOIN (SELECT target, string_agg(relation || ':' || source, ',' ORDER BY relation || ':' || source) AS i FROM connections WHERE target IS NOT NULL GROUP BY target) b ON b.target = id""", "entities", "connections")

# reports

add("stats", reports.stats,
    f"""SELECT (SELECT count(*) FROM connections) AS connection_count, (SELECT count(*) FROM connections WHERE {VISIBLE}) AS active_connection_count, (SELECT count(*) FROM connections WHERE review = 'rejected') AS rejected_connection_count,
  (SELECT count(*) FROM entities) AS entity_count, (SELECT count(*) FROM entities WHERE NOT ({LIVE})) AS retired_entity_count, (SELECT count(*) FROM sources) AS source_count""", "entities", "connections", "sources")
add("status_counts", reports.status_counts,
    """SELECT (SELECT count(*) FROM entities WHERE status = 'human_reviewed') AS entities_reviewed, (SELECT count(*) FROM entities WHERE status = 'draft') AS entities_draft,
  count(*) FILTER (review = 'canonical') AS connections_canonical, count(*) FILTER (review = 'unreviewed') AS connections_unreviewed, (SELECT count(*) FROM sources) AS sources,
  round(100.0::DOUBLE * count(*) FILTER (review = 'canonical') / count(*), 1) AS percent_canonical FROM connections""", "entities", "connections", "sources")
_ORIGIN = "CASE WHEN confidence_basis = 'migrated' THEN 'migrated' WHEN asserted_by = 'llm' THEN 'llm' WHEN asserted_by = 'human' THEN 'human' ELSE 'unknown' END"


def _counts_sql(dims: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{d}' AS dimension, coalesce(CAST({e} AS STRING), 'none') AS value, count(*) AS n FROM {source} GROUP BY coalesce(CAST({e} AS STRING), 'none')" for d, e in dims.items())


add("curation_status", reports.curation_status,
    _counts_sql({"relation": "relation", "family": "family", "review": "review", "assertion_type": "assertion_type", "assertion_status": "assertion_status", "origin": _ORIGIN, "domain": "e.domain"},
                "connections c LEFT JOIN relations r ON r.name = c.relation LEFT JOIN entities e ON e.id = c.source"), "entities", "connections", "relations")
add("epistemic_summary", reports.epistemic_summary,
    _counts_sql({"assertion_type": "assertion_type", "review": "review", "assertion_status": "assertion_status", "origin": _ORIGIN, "has_confidence": "(confidence IS NOT NULL)"}, "connections"), "connections")
add("origin_classify", lambda kg: kg.connections.select("id", reports.origin().alias("origin")), f"SELECT id, {_ORIGIN} AS origin FROM connections", "connections")
add("trust_audit", reports.trust_audit,
    """SELECT relation, count(*) AS n, count(*) FILTER (id IN (SELECT connection_id FROM evidence)) AS with_evidence, count(confidence_basis) AS with_basis,
  round(count(*) FILTER (id IN (SELECT connection_id FROM evidence))::DOUBLE / count(*), 4) AS evidence_share FROM connections WHERE review = 'canonical' GROUP BY relation""", "connections", "evidence")
add("evidence_gaps", reports.evidence_gaps, f"SELECT id, relation, review FROM connections WHERE {ACTIVE} AND id NOT IN (SELECT connection_id FROM evidence)", "connections", "evidence")
add("provenance_gaps", reports.provenance_gaps, "SELECT id, review FROM connections WHERE review IN ('reviewed', 'canonical') AND asserted_by = 'llm' AND confidence_basis IS NULL", "connections")
add("duplicate_claims", reports.duplicate_claims,
    f"SELECT claim_signature, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT id, {SIGNATURE} AS claim_signature FROM connections WHERE coalesce(assertion_status, 'active') = 'active') GROUP BY claim_signature HAVING count(*) > 1", "connections")
_TRIPLES = "SELECT source, relation, coalesce(target, 'VALUE:' || amount) AS object, count(*) AS n, count(DISTINCT review) AS n_reviews FROM connections GROUP BY source, relation, coalesce(target, 'VALUE:' || amount) HAVING count(*) > 1"
add_rough("duplicate_triples", reports.duplicate_triples, _TRIPLES, "connections")
add_rough("conflicting_review", reports.conflicting_review, _TRIPLES + " AND count(DISTINCT review) > 1", "connections")
add("conflicts", reports.conflicts,
    """SELECT subject, relation, object, count(*) AS n_claims, count(DISTINCT value) AS n_values, string_agg(DISTINCT value, ',' ORDER BY value) AS competing, count(DISTINCT source_id) AS n_sources
FROM claims WHERE value IS NOT NULL GROUP BY subject, relation, object HAVING count(DISTINCT value) > 1""", "claims")
add("corroboration", reports.corroboration,
    """SELECT claim_id, source_id, value, CASE WHEN n = 1 THEN 'single_source' WHEN nv < 2 THEN 'unrelated' WHEN lo = hi THEN 'agree' ELSE 'disagree' END AS agreement FROM (
  SELECT *, count(*) OVER w AS n, count(value) OVER w AS nv, min(value) OVER w AS lo, max(value) OVER w AS hi FROM claims WINDOW w AS (PARTITION BY subject, relation, object))""", "claims")
add("lexical_index", reports.lexical_index,
    """SELECT token, count(*) AS n, min(id) AS first_id FROM (SELECT id, unnest(list_distinct([w FOR w IN regexp_split_to_array(lower(concat_ws(' ', name, definition, domain, type)), '[^a-z0-9]+') IF length(w) > 2])) AS token FROM entities) GROUP BY token""", "entities")
add("citation_index", reports.citation_index, "SELECT source_ref, count(*) AS uses, count(DISTINCT connection_id) AS connections, count(*) FILTER (stance = 'refutes') AS refuting FROM evidence GROUP BY source_ref", "evidence")
add("citation_uses", reports.citation_uses,
    "SELECT source_ref, 'evidence' AS kind, connection_id AS id, stance FROM evidence UNION ALL SELECT source_ref, 'provenance', id, NULL FROM entities WHERE source_ref IS NOT NULL", "evidence", "entities")
add("lexical_postings", reports.lexical_postings,
    """SELECT DISTINCT token, id FROM (SELECT id, unnest([w FOR w IN regexp_split_to_array(lower(concat_ws(' ', name, definition, domain, type)), '[^a-z0-9]+') IF length(w) > 2]) AS token FROM entities)""", "entities")
add("unresolved_sources", reports.unresolved_sources,
    """SELECT pointer, kind, count(*) AS uses FROM (SELECT source_ref AS pointer, 'evidence' AS kind FROM evidence UNION ALL SELECT source_ref, 'provenance' FROM entities WHERE source_ref IS NOT NULL)
WHERE pointer NOT IN (SELECT id FROM sources) AND pointer NOT IN (SELECT title FROM sources) GROUP BY pointer, kind""", "entities", "evidence", "sources")
add("affected_by_source", reports.affected_by_source,
    """SELECT DISTINCT source_ref, 'connection' AS kind, connection_id AS id FROM evidence WHERE source_ref IN (SELECT id FROM sources) UNION ALL SELECT source_ref, 'entity', id FROM entities WHERE source_ref IN (SELECT id FROM sources)""", "entities", "evidence", "sources")
add("review_progress", reports.review_progress,
    "SELECT domain, count(*) FILTER (status IN ('canonical', 'human_reviewed')) AS reviewed, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (status IN ('canonical', 'human_reviewed')) / count(*), 1) AS percent FROM entities GROUP BY domain", "entities")
add_rough("isolated_entities", reports.isolated_entities, "SELECT id FROM entities WHERE id NOT IN (SELECT source FROM connections) AND id NOT IN (SELECT target FROM connections WHERE target IS NOT NULL)", "entities", "connections")
PRIORITY = ["requires", "depends_on", "causes", "applies_to", "derived_from"]
add("relation_triage", lambda kg: reports.relation_triage(kg, PRIORITY),
    f"""WITH c AS (SELECT *, least(source, target) || '|' || greatest(source, target) AS pair FROM connections WHERE target IS NOT NULL),
fits AS (SELECT name, list_position(['requires', 'depends_on', 'causes', 'applies_to', 'derived_from'], name) AS p, string_split(domain, ',') AS d, string_split(range_, ',') AS r FROM relations WHERE name IN ('requires', 'depends_on', 'causes', 'applies_to', 'derived_from') AND family <> 'associative'),
j AS (SELECT c.id, c.pair IN (SELECT pair FROM c WHERE relation <> 'related_to') AS has, (SELECT min_by(name, p) FROM fits WHERE list_contains(d, s.type) AND list_contains(r, t.type)) AS best
  FROM c LEFT JOIN entities s ON s.id = source LEFT JOIN entities t ON t.id = target WHERE relation = 'related_to' AND {ACTIVE})
SELECT id, CASE WHEN has THEN 'already_specific' WHEN best IS NOT NULL THEN 'candidate' ELSE 'none' END AS verdict, CASE WHEN NOT has THEN best END AS suggested FROM j""", "entities", "connections", "relations")
add("source_trust", lambda kg: reports.source_trust(kg, 2026),
    """WITH d AS (SELECT id, CASE WHEN regexp_matches(lower(publisher), 'nist|ieee|iso|iupac|who|unesco|nasa') THEN 1.0 WHEN regexp_matches(lower(publisher), 'university|press') THEN 0.9 WHEN type = 'standard' THEN 1.0 WHEN type = 'textbook' THEN 0.8 ELSE 0.5 END::DOUBLE AS institutional_authority,
  CASE type WHEN 'academic-paper' THEN 1.0 WHEN 'standard' THEN 1.0 WHEN 'textbook' THEN 1.0 WHEN 'web' THEN 0.3 ELSE 0.5 END::DOUBLE AS peer_review_status, CASE type WHEN 'dataset' THEN 0.9 WHEN 'academic-paper' THEN 0.9 WHEN 'standard' THEN 1.0 WHEN 'textbook' THEN 0.7 ELSE 0.5 END::DOUBLE AS methodological_strength,
  CASE WHEN 2026 - year <= 2 THEN 1.0 WHEN 2026 - year <= 5 THEN 0.8 WHEN 2026 - year <= 10 THEN 0.6 WHEN 2026 - year <= 20 THEN 0.4 ELSE 0.2 END::DOUBLE AS recency, CASE type WHEN 'textbook' THEN 1.0 WHEN 'standard' THEN 1.0 WHEN 'academic-paper' THEN 0.7 ELSE 0.5 END::DOUBLE AS consensus_alignment,
  CASE type WHEN 'dataset' THEN 0.9 WHEN 'standard' THEN 1.0 WHEN 'academic-paper' THEN 0.6 ELSE 0.5 END::DOUBLE AS reproducibility, CASE WHEN regexp_matches(lower(publisher), 'industry|corporate') THEN 0.5 WHEN regexp_matches(lower(publisher), 'government|nist') THEN 0.9 ELSE 0.7 END::DOUBLE AS independence, 0.8::DOUBLE AS domain_relevance FROM sources)
SELECT *, round(0.0::DOUBLE + institutional_authority * 0.2::DOUBLE + peer_review_status * 0.15::DOUBLE + methodological_strength * 0.15::DOUBLE + recency * 0.1::DOUBLE + consensus_alignment * 0.15::DOUBLE + reproducibility * 0.1::DOUBLE + independence * 0.1::DOUBLE + domain_relevance * 0.05::DOUBLE, 3) AS composite FROM d""", "sources")
add("evidence_quality", reports.evidence_quality,
    """SELECT connection_id, source_ref, CASE type WHEN 'experiment' THEN 1.0 WHEN 'textbook' THEN 0.9 WHEN 'observation' THEN 0.7 ELSE 0.5 END::DOUBLE AS type_strength, CASE WHEN stance <> 'supports' THEN 1.0 ELSE 0.8 END::DOUBLE AS stance_clarity,
  CASE WHEN locator IS NULL THEN 0.0 ELSE 0.3333 END::DOUBLE AS locator_completeness FROM evidence""", "evidence")
add("source_slug", reports.source_slug,
    r"""WITH s AS (SELECT id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 40) || '-' || CAST(year AS STRING) AS slug FROM sources)
SELECT id, slug, count(*) OVER (PARTITION BY slug) > 1 AS duplicate FROM s""", "sources")
add("relations", lambda kg: kg.relations.select("name", "family", "inverse", "transitive", "symmetric", "status"), "SELECT name, family, inverse, transitive, \"symmetric\", status FROM relations", "relations")
add("vocabularies", lookup.vocabularies,
    """SELECT vocabulary, term, count(*) AS n FROM (SELECT 'domain' AS vocabulary, domain AS term FROM entities UNION ALL SELECT 'subdomain', domain || '/' || subdomain FROM entities UNION ALL SELECT 'type', type FROM entities UNION ALL SELECT 'status', status FROM entities
UNION ALL SELECT 'relation', relation FROM connections UNION ALL SELECT 'review', review FROM connections UNION ALL SELECT 'source type', type FROM sources) WHERE term IS NOT NULL GROUP BY vocabulary, term""", "entities", "connections", "sources")

# histories

_LAGGED = "SELECT id, stage, lag(stage) OVER w AS before, date_diff('day', lag(\"at\") OVER w, \"at\") AS days FROM promotions WINDOW w AS (PARTITION BY id ORDER BY \"at\", CASE stage WHEN 'editor' THEN 1 WHEN 'domain_expert' THEN 2 ELSE 3 END)"
add("stage_gap_violations", lambda kg: history.stage_gap_violations(kg, 3), f"SELECT id, before, stage, CAST(days AS INTEGER) AS days FROM ({_LAGGED}) WHERE before IS NOT NULL AND days < 3", "promotions")
_PLACE = "CASE stage WHEN 'editor' THEN 1 WHEN 'domain_expert' THEN 2 ELSE 3 END"
add("stage_independence", history.stage_independence,
    f"""WITH p AS (SELECT id, stage, max_by(actor, "at") AS actor, bool_or(waiver) AS waiver, max({_PLACE}) AS place FROM promotions GROUP BY id, stage),
q AS (SELECT *, lag(actor) OVER w AS other, place - lag(place) OVER w AS gap, bool_or(waiver) OVER (PARTITION BY id) AS waived FROM p WINDOW w AS (PARTITION BY id ORDER BY place))
SELECT id, stage, actor FROM q WHERE gap = 1 AND other = actor AND NOT waived""", "promotions")
add("stage_order", history.stage_order,
    f"""SELECT id, string_agg(stage, ',' ORDER BY "at", {_PLACE}) AS stages, string_agg(stage, ',' ORDER BY "at", {_PLACE}) = 'editor,domain_expert,board' AS in_order FROM promotions GROUP BY id""", "promotions")
for _key in ("last_stage", "next_stage"):
    add(_key, (lambda c: lambda kg: history.stage_of(kg).select("id", c))(_key),
        f"SELECT id, ['editor', 'domain_expert', 'board'][max({_PLACE}) + {int(_key == 'next_stage')}] AS {_key} FROM promotions GROUP BY id", "promotions")
add("id_reassigned", history.id_reassigned,
    """WITH s AS (SELECT id, name || '/' || domain AS stamp, min(seq) AS seq FROM entity_versions GROUP BY id, name, domain), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM s)
SELECT a.id, a.stamp AS first_stamp, b.stamp AS second_stamp FROM r a JOIN r b ON a.id = b.id AND a.rn = 1 AND b.rn = 2""", "entity_versions")
_GONE = "CAST(split_part(id, '.', 2) AS BIGINT) % 7 = 0"
_LIVE_USERS = lambda kg, p: kg.entity_versions.where(f"NOT {_GONE}").select(F.regexp_replace("id", "^user", p).alias("id")).distinct()
add("id_deleted", lambda kg: history.id_deleted(kg, _LIVE_USERS(kg, "user")),
    f"SELECT id, max_by(status, seq) AS last_status FROM entity_versions WHERE {_GONE} GROUP BY id HAVING max_by(status, seq) <> 'deprecated'", "entity_versions")
add("triple_changed", history.triple_changed,
    """WITH v AS (SELECT id, seq, source || '|' || relation || '|' || target AS triple FROM connection_versions WHERE target IS NOT NULL), l AS (SELECT *, lag(triple) OVER (PARTITION BY id ORDER BY seq) AS before FROM v),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM l WHERE before <> triple)
SELECT id, seq, before, triple AS after FROM c WHERE rn = 1""", "connection_versions")
add("triple_deleted", lambda kg: history.triple_deleted(kg, _LIVE_USERS(kg, "use")),
    f"""SELECT id, max_by(status, seq) AS last_status FROM connection_versions WHERE {_GONE}
GROUP BY id HAVING max_by(status, seq) NOT IN ('superseded', 'deprecated') AND max(replaced_by) IS NULL""", "connection_versions")
add_rough("alias_invalid", history.alias_invalid, "SELECT id, deprecated_by AS pointer FROM entities WHERE deprecated_by IS NOT NULL AND deprecated_by NOT IN (SELECT id FROM entities) AND deprecated_by NOT IN (SELECT id FROM entity_versions)", "entities", "entity_versions")


def _degrees(kg):
    """Degree as the rank, exact in any engine."""
    c = graph.centrality(kg, rounds=0)
    return c.withColumn("rank", F.col("in_degree") * 0.01)


_DEG = "d AS (SELECT id, (SELECT count(*) FROM connections c WHERE c.target = entities.id) AS in_degree, (SELECT count(*) FROM connections c WHERE c.source = entities.id AND c.target IS NOT NULL) AS out_degree FROM entities)"
add("review_batches_entities", lambda kg: history.review_batches_entities(kg, _degrees(kg)),
    f"""WITH {_DEG}, s AS (SELECT e.id, domain, round(in_degree * 0.01::DOUBLE + 0.001::DOUBLE * (in_degree + out_degree), 6) AS score FROM entities e JOIN d ON d.id = e.id WHERE status = 'draft'),
n AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY score DESC, id) AS k FROM s)
SELECT id, domain, score, CAST(0 AS BIGINT) AS batch FROM n WHERE k <= 5 UNION ALL SELECT id, domain, score, CAST(floor((row_number() OVER (ORDER BY score DESC, id) - 1) / 40.0) + 1 AS BIGINT) FROM n WHERE k > 5""", "entities", "connections")
add("review_batches_edges", lambda kg: history.review_batches_edges(kg, _degrees(kg)),
    f"""WITH {_DEG}, s AS (SELECT c.id, round(a.in_degree * 0.01::DOUBLE + b.in_degree * 0.01::DOUBLE + 0.02::DOUBLE * b.in_degree + CASE WHEN e.type IN ('law', 'equation') THEN 0.05 ELSE 0.0 END::DOUBLE, 6) AS score
  FROM connections c JOIN d a ON a.id = source JOIN d b ON b.id = target JOIN entities e ON e.id = source WHERE review = 'unreviewed' AND relation IN (SELECT name FROM relations WHERE family = 'dependency'))
SELECT id, score, CAST(floor((row_number() OVER (ORDER BY score DESC, id) - 1) / 50.0) + 1 AS BIGINT) AS batch FROM s""", "entities", "connections", "relations")
add("edge_prechecks", history.edge_prechecks,
    """SELECT c.id, list_contains(string_split(r.domain, ','), s.type) AND list_contains(string_split(range_, ','), t.type) AS legal, coalesce(contains(lower(s.definition), lower(t.name)), false) AS named
FROM connections c JOIN relations r ON r.name = relation AND family = 'dependency' JOIN entities s ON s.id = source JOIN entities t ON t.id = target""", "entities", "connections", "relations")
add("proposal_ids", lambda kg: history.proposal_ids(kg.claims), "SELECT claim_id, 'proposal-' || lpad(CAST(row_number() OVER (ORDER BY claim_id) AS STRING), 6, '0') AS proposal_id FROM claims", "claims")
add("manifest_drift", lambda kg: history.drift(history.manifest(kg), history.manifest(kg.with_(entities=kg.entities.where("id not like '%7'").withColumn("name", F.when(F.col("id").endswith("11"), F.upper("name")).otherwise(F.col("name")))))),
    """SELECT id, CASE WHEN id LIKE '%7' THEN 'removed' ELSE 'changed' END AS change FROM entities WHERE status IN ('canonical', 'human_reviewed') AND (id LIKE '%7' OR (id LIKE '%11' AND name <> upper(name)))""", "entities")
add("source_drift", lambda kg: history.drift(history.source_digest(kg.sources.where("year <> 2000")), history.source_digest(kg.sources.withColumn("lifecycle", F.when(F.col("year") == 2001, "retracted").otherwise(F.col("lifecycle"))))),
    "SELECT id, CASE WHEN year = 2000 THEN 'added' ELSE 'changed' END AS change FROM sources WHERE year = 2000 OR (year = 2001 AND lifecycle <> 'retracted')", "sources")


def _ledger(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.coalesce("props", F.lit("")).alias("props"))
    return history.ledger_append(e, "user_id", ["event_id"], ["event_id", "event_type", "props"])


_BODY = "concat_ws('|', {}, event_id, event_type, {})"
_CHAIN = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, coalesce(props, '') AS props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT *, repeat('0', 64) AS prev_hash, sha256({_BODY.format("repeat('0', 64)", "props")}) AS hash FROM e WHERE n = 1
  UNION ALL SELECT e.*, c.hash, sha256(concat_ws('|', c.hash, e.event_id, e.event_type, e.props)) FROM c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)"""
add_raw("ledger_append", _ledger, f"{_CHAIN} SELECT user_id, event_id, event_type, props, prev_hash, hash FROM c")
add_raw("ledger_verify", lambda spark, d: history.ledger_verify(_ledger(spark, d).withColumn("props", F.when(F.col("event_id") % 97 == 0, "forged").otherwise(F.col("props"))), "user_id", ["event_id"], ["event_id", "event_type", "props"]),
        f"""{_CHAIN}, g AS (SELECT *, {_BODY.format("prev_hash", "CASE WHEN event_id % 97 = 0 THEN 'forged' ELSE props END")} AS said FROM c), h AS (SELECT *, sha256(said) = hash AS hash_ok FROM g)
SELECT user_id, event_id, hash_ok, prev_hash = coalesce(last_value(CASE WHEN hash_ok THEN hash END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), repeat('0', 64)) AS link_ok FROM h""")
add_raw("ledger_query", lambda spark, d: read(spark, d, "events").where("event_type = 'click'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "user_id"),
        "SELECT event_id, user_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 50")
add("claim_lineage", lambda kg: kg.claims.select("claim_id", F.col("source_id")).join(kg.sources.select(F.col("id").alias("source_id"), "lifecycle"), "source_id").join(kg.evidence.select(F.col("source_ref").alias("source_id"), "connection_id").distinct().groupBy("source_id").agg(F.count("*").alias("n_connections")), "source_id").select("claim_id", "source_id", "lifecycle", "n_connections"),
    "SELECT claim_id, source_id, lifecycle, n AS n_connections FROM claims JOIN sources s ON s.id = source_id JOIN (SELECT source_ref, count(DISTINCT connection_id) AS n FROM evidence GROUP BY source_ref) e ON e.source_ref = source_id", "claims", "sources", "evidence")



def _entries(spark, sf_dir):
    """A ledger of admitted claims, the documents that they were candidates of, the parts that those rest on and the suppliers that those come from."""
    l = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("doc."), "l_orderkey").alias("d"), F.concat(F.lit("ev.p"), "l_partkey").alias("p"), F.concat(F.lit("src.s"), "l_suppkey").alias("s"), F.concat_ws(".", F.lit("claim"), "l_orderkey", "l_linenumber").alias("c"))
    none, one = F.lit(None).cast("array<string>"), lambda c: F.array(c)
    entry = lambda df, event, ref, cand, ev, src: df.select(F.lit(event).alias("event_type"), F.col(ref).alias("ref"), cand.alias("candidate_refs"), ev.alias("evidence_refs"), src.alias("source_refs"))
    out = entry(l.select("c", "d").distinct(), "canonical_admitted", "c", one("d"), none, none).unionByName(entry(l.groupBy("d").agg(F.collect_set("p").alias("ps")), "candidate_created", "d", none, F.col("ps"), none))
    out = out.unionByName(entry(l.groupBy("p").agg(F.collect_set("s").alias("ss")), "evidence_extracted", "p", none, none, F.col("ss"))).unionByName(entry(l.select("s").distinct(), "source_registered", "s", none, none, none))
    return out.withColumn("seq", F.xxhash64("event_type", "ref"))


def _traced(spark, sf_dir):
    n = lambda e, c: F.count_if(F.col("event_type") == e).alias(c)
    return history.ledger_lineage(_entries(spark, sf_dir)).groupBy(F.col("asked").alias("claim_id")).agg(n("candidate_created", "n_candidates"), n("evidence_extracted", "n_evidence"), n("source_registered", "n_sources"))


add_raw("ledger_lineage", _traced, """WITH parts AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), made AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
n AS (SELECT o, count(DISTINCT parts.p) AS n_evidence, count(DISTINCT s) AS n_sources FROM parts JOIN made ON made.p = parts.p GROUP BY o)
SELECT DISTINCT 'claim.' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) AS claim_id, CAST(1 AS BIGINT) AS n_candidates, n_evidence, n_sources FROM lineitem JOIN n ON o = l_orderkey""")

# quality

_DQ = {
    "dq_required": ("""SELECT 'dq_required' AS rule, 'error' AS severity, id AS focus, 'missing url' AS message FROM sources WHERE url IS NULL""", ["sources"]),
    "dq_quantity_fields": ("SELECT 'dq_quantity_fields' AS rule, 'error' AS severity, id AS focus, 'quantity without symbol' AS message FROM entities WHERE type = 'quantity' AND symbol IS NULL "
        "UNION ALL SELECT 'dq_quantity_fields', 'error', id, 'quantity_kind is neither base nor derived' FROM entities e WHERE type = 'quantity' AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.id = e.id AND block = 'quantity' AND key = 'quantity_kind' AND value IN ('base', 'derived')) "
        "UNION ALL SELECT 'dq_quantity_fields', 'error', id, 'tensor_character is not scalar, vector or tensor' FROM entities e WHERE type = 'quantity' AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.id = e.id AND block = 'quantity' AND key = 'tensor_character' AND value IN ('scalar', 'vector', 'tensor')) "
        "UNION ALL SELECT 'dq_quantity_fields', 'error', id, type || ' without others of its dimension' FROM entities e WHERE type IN ('quantity', 'unit') AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.id = e.id AND block = 'same_dimension')", ["entities", "blocks"]),
    "dq_provenance_shape": ("""SELECT 'dq_provenance_shape' AS rule, 'warning' AS severity, id AS focus, 'reviewed record without source' AS message FROM entities WHERE status IN ('canonical', 'human_reviewed') AND source_ref IS NULL
UNION ALL SELECT 'dq_provenance_shape', 'error', id, 'ai_drafted is not true or false' FROM blocks WHERE block = 'origin' AND key = 'ai_drafted' AND value NOT IN ('true', 'false')
UNION ALL SELECT 'dq_provenance_shape', 'error', id, 'source_kind ' || value FROM blocks WHERE block = 'origin' AND key = 'source_kind' AND value NOT IN ('paper', 'textbook', 'standard', 'dataset', 'expert')
UNION ALL SELECT 'dq_provenance_shape', 'error', id, 'neither source nor reviewer' FROM blocks WHERE block = 'origin' AND key = 'ai_drafted' AND value = 'false'
  AND id NOT IN (SELECT id FROM entities WHERE source_ref IS NOT NULL UNION SELECT id FROM blocks WHERE block = 'provenance' AND key = 'reviewer')""", ["entities", "blocks"]),
    "dq_target_xor_value": (r"""SELECT 'dq_target_xor_value' AS rule, 'error' AS severity, id AS focus, 'exactly one of target and value is needed' AS message FROM connections WHERE (target IS NULL) = (amount IS NULL)
UNION ALL SELECT 'dq_target_xor_value', 'error', id, 'amount is not a decimal' FROM connections WHERE NOT regexp_matches(amount, '^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$')""", ["connections"]),
    "dq_relation_known": ("SELECT 'dq_relation_known' AS rule, 'error' AS severity, id AS focus, 'unknown relation ' || relation AS message FROM connections WHERE relation NOT IN (SELECT name FROM relations)", ["connections", "relations"]),
    "dq_domain_range": ("""SELECT 'dq_domain_range' AS rule, 'error' AS severity, c.id AS focus, 'types do not fit ' || relation AS message FROM connections c JOIN relations r ON r.name = relation JOIN entities s ON s.id = source LEFT JOIN entities t ON t.id = target
WHERE (r.domain <> '' AND NOT list_contains(string_split(r.domain, ','), s.type)) OR (range_ <> '' AND t.type IS NOT NULL AND NOT list_contains(string_split(range_, ','), t.type))""", ["entities", "connections", "relations"]),
    "dq_reviewed_endpoints": ("""SELECT 'dq_reviewed_endpoints' AS rule, 'warning' AS severity, id AS focus, 'canonical connection cites an entity that is not reviewed' AS message FROM connections
WHERE review = 'canonical' AND (source IN (SELECT id FROM entities WHERE status NOT IN ('canonical', 'human_reviewed')) OR target IN (SELECT id FROM entities WHERE status NOT IN ('canonical', 'human_reviewed')))""", ["entities", "connections"]),
    "dq_epistemics": ("SELECT 'dq_epistemics' AS rule, 'warning' AS severity, id AS focus, 'confidence and its basis go together' AS message FROM connections WHERE (confidence IS NULL) <> (confidence_basis IS NULL) "
        "UNION ALL SELECT 'dq_epistemics', 'error', id, CASE WHEN inferred THEN 'inferred without rule and path' ELSE 'inference of what is not inferred' END FROM (SELECT c.id, coalesce(assertion_type, '') = 'inferred' AS inferred, r, p FROM connections c "
        "LEFT JOIN (SELECT id, count(*) FILTER (key = 'rule' AND trim(value) <> '') > 0 AS r, count(*) FILTER (key = 'path' AND trim(value) <> '') > 0 AS p FROM blocks WHERE block = 'inference' GROUP BY id) b ON b.id = c.id) x "
        "WHERE CASE WHEN inferred THEN NOT coalesce(r AND p, false) ELSE r IS NOT NULL END", ["connections", "blocks"]),
    "dq_rejected_reason": ("SELECT 'dq_rejected_reason' AS rule, 'error' AS severity, id AS focus, 'rejected without a written reason' AS message FROM connections WHERE review = 'rejected' AND reason IS NULL", ["connections"]),
    "dq_evidence": (f"SELECT 'dq_evidence' AS rule, CASE WHEN review = 'canonical' THEN 'error' ELSE 'warning' END AS severity, id AS focus, 'no evidence' AS message FROM connections WHERE {ACTIVE} AND id NOT IN (SELECT connection_id FROM evidence)", ["connections", "evidence"]),
    "dq_contradiction": ("""SELECT 'dq_contradiction' AS rule, 'warning' AS severity, pair AS focus, 'contradicted and asserted' AS message FROM (SELECT least(source, target) || '|' || greatest(source, target) AS pair, relation FROM connections WHERE target IS NOT NULL)
GROUP BY pair HAVING count(*) FILTER (relation = 'contradicts') > 0 AND count(*) FILTER (relation IN ('causes', 'requires', 'mathematically_requires', 'logically_requires')) > 0""", ["connections"]),
    "dq_agents": ("""SELECT 'dq_agents' AS rule, 'error' AS severity, p.id AS focus, why || ' ' || p.agent AS message FROM (SELECT p.id, p.agent, CASE WHEN class IS NULL THEN 'unknown agent' WHEN class <> 'human' AND role <> 'written' THEN role || ' by a machine'
  WHEN status <> 'active' AND role = 'promoted' THEN 'agent is retired' END AS why FROM (SELECT id, actor AS agent, 'promoted' AS role FROM promotions UNION SELECT id, value, CASE WHEN key = 'reviewer' THEN 'reviewed' ELSE 'written' END FROM blocks WHERE block = 'provenance') p
  LEFT JOIN agents a ON a.id = agent) p WHERE why IS NOT NULL""", ["promotions", "agents", "blocks"]),
    "dq_profile": ("""SELECT 'dq_profile' AS rule, 'error' AS severity, id AS focus, 'source cannot be verified' AS message FROM sources WHERE url IS NULL AND type NOT IN ('academic-paper', 'textbook', 'standard')
UNION ALL SELECT 'dq_profile', 'error', id, 'link has another form' FROM sources WHERE NOT regexp_matches(url, '^https://[a-z0-9.-]+/')
UNION ALL SELECT 'dq_profile', 'error', id, 'not in the profile: ' || relation FROM connections WHERE relation NOT IN ('part_of', 'mathematically_requires', 'logically_requires', 'has_price', 'applies_to', 'related_to', 'causes')
UNION ALL SELECT 'dq_profile', 'error', connection_id, 'evidence without a place' FROM evidence WHERE type IN ('experiment', 'textbook') AND locator IS NULL""", ["sources", "connections", "evidence"]),
    "dq_shape": ("""SELECT 'dq_shape' AS rule, 'warning' AS severity, id AS focus, type || ' has ' || CAST(n AS STRING) || ' ' || property AS message FROM (
  SELECT e.id, type, 'edges' AS property, coalesce(k, 0) AS n FROM entities e LEFT JOIN (SELECT source, count(*) AS k FROM connections GROUP BY source) c ON source = e.id UNION ALL SELECT id, type, 'symbol', CAST(symbol IS NOT NULL AS BIGINT) FROM entities
  UNION ALL SELECT id, type, 'source_ref', CAST(source_ref IS NOT NULL AS BIGINT) FROM entities UNION ALL SELECT id, type, 'definition', CAST(definition IS NOT NULL AS BIGINT) FROM entities) v
JOIN (VALUES ('law', 'edges', 1, 1000000000), ('unit', 'symbol', 1, 1), ('quantity', 'symbol', 1, 1), ('concept', 'source_ref', 0, 1), ('unit', 'definition', 1, 1)) s(t, p, least, most) ON t = type AND p = property WHERE n < least OR n > most""", ["entities", "connections"]),
    "dq_external_ids": ("""SELECT 'dq_external_ids' AS rule, 'error' AS severity, entity_id AS focus, scheme || ' has a wrong format' AS message FROM external_ids
WHERE NOT CASE scheme WHEN 'sku' THEN regexp_matches(value, '^SKU[0-9]+$') WHEN 'ledger' THEN regexp_matches(value, '^[0-9]+$') ELSE regexp_matches(value, '^Brand#[0-9]+-[0-9]+$') END
UNION ALL SELECT 'dq_external_ids', 'warning', min(entity_id), 'shared: ' || scheme || ' ' || value FROM external_ids GROUP BY scheme, value HAVING count(*) > 1""", ["external_ids"]),
    "dq_retired_pointer": (f"""SELECT 'dq_retired_pointer' AS rule, 'error' AS severity, id AS focus, 'retired record does not say what replaces it' AS message FROM entities WHERE NOT {LIVE} AND (deprecated_by IS NULL OR deprecated_by = id)
UNION ALL SELECT 'dq_retired_pointer', 'error', id, 'live record says it is replaced' FROM entities WHERE {LIVE} AND deprecated_by IS NOT NULL
UNION ALL SELECT 'dq_retired_pointer', 'error', id, 'alias is no id: ' || value FROM blocks WHERE block = 'aliases' AND NOT regexp_matches(value, '^[a-z]+[.][a-z]*[0-9]+$')
UNION ALL SELECT 'dq_retired_pointer', 'error', id, 'alias is its own id' FROM blocks WHERE block = 'aliases' AND value = id""", ["entities", "blocks"]),
    "dq_unique_ids": ("SELECT 'dq_unique_ids' AS rule, 'error' AS severity, id AS focus, CAST(count(*) AS STRING) || ' records' AS message FROM (SELECT id FROM entities UNION ALL SELECT id FROM connections UNION ALL SELECT id FROM sources) GROUP BY id HAVING count(*) > 1", ["entities", "connections", "sources"]),
    "dq_domain_identity": ("SELECT 'dq_domain_identity' AS rule, 'error' AS severity, id AS focus, 'id prefix and domain differ' AS message FROM entities WHERE split_part(id, '.', 1) <> domain AND split_part(id, '.', 1) IN ('geo', 'org', 'prod') "
        "UNION ALL SELECT 'dq_domain_identity', 'error', id, 'unknown id prefix ' || split_part(id, '.', 1) FROM entities WHERE split_part(id, '.', 1) NOT IN ('geo', 'org', 'prod') "
        "UNION ALL SELECT 'dq_domain_identity', 'error', id, 'not in vocabulary: domain ' || domain FROM entities WHERE domain NOT IN ('geo', 'org', 'prod') "
        "UNION ALL SELECT 'dq_domain_identity', 'error', id, 'file is not in the directory of its domain' FROM blocks WHERE block = 'file' AND split_part(value, '/', 1) <> CASE split_part(id, '.', 1) WHEN 'geo' THEN 'geography' WHEN 'org' THEN 'organisations' ELSE 'products' END", ["entities", "blocks"]),
    "dq_id_format": (r"SELECT 'dq_id_format' AS rule, 'error' AS severity, id AS focus, 'id does not fit its pattern' AS message FROM (SELECT id FROM entities UNION ALL SELECT id FROM connections UNION ALL SELECT id FROM sources) WHERE NOT regexp_matches(id, '^[a-z]+\.[a-z]*[0-9]+$') "
        "UNION ALL SELECT 'dq_id_format', 'error', id, 'file name is not the slug' FROM blocks WHERE block = 'file' AND split_part(split_part(value, '/', 2), '.', 1) <> split_part(id, '.', 2)", ["entities", "connections", "sources", "blocks"]),
    "dq_enum": ("""SELECT 'dq_enum' AS rule, 'error' AS severity, id AS focus, 'not in vocabulary: type ' || type AS message FROM entities WHERE type NOT IN ('concept', 'quantity', 'law', 'equation', 'model', 'phenomenon', 'unit', 'experiment', 'method')
UNION ALL SELECT 'dq_enum', 'error', id, 'not in vocabulary: status ' || status FROM entities WHERE status NOT IN ('draft', 'proposed', 'ai_reviewed', 'human_reviewed', 'reviewed', 'canonical', 'deprecated', 'superseded', 'rejected')""", ["entities"]),
}
_ROUGH = {"dq_id_format", "dq_enum", "dq_quantity_fields", "dq_retired_pointer", "dq_unique_ids", "dq_domain_identity", "dq_target_xor_value", "dq_relation_known", "dq_domain_range", "dq_contradiction", "dq_shape", "dq_epistemics"}
for _key in [k for k in quality.RULES if k not in records.RECORD_RULES]:
    _rule = quality.RULES[_key]
    _sql, _tables = _DQ.get(_key, (None, []))
    (add_rough if _key in _ROUGH else add)(_key, _rule, _sql, *_tables)


def _ill_registry(spark, sf_dir):
    pairs = testgraph.table(spark, sf_dir, "rough_relations")
    return pairs.withColumns({c: F.split(c, ",") for c in ("domain", "range")})


add_raw("dq_registry_coherence", lambda spark, d: quality.dq_registry_coherence(knowledge(spark, d).with_(relations=_ill_registry(spark, d))),
    ctes("rough_relations") + """, r AS (SELECT name, inverse, "symmetric", list_sort(string_split(domain, ',')) AS d, list_sort(string_split("range", ',')) AS r FROM rough_relations),
j AS (SELECT a.*, b.name AS found, b.inverse AS back, b.d AS bd, b.r AS br FROM r a LEFT JOIN r b ON b.name = a.inverse),
w AS (SELECT name, 'symmetric relation with inverse' AS message FROM j WHERE "symmetric" AND inverse IS NOT NULL UNION ALL SELECT name, 'inverse is not defined' FROM j WHERE inverse IS NOT NULL AND found IS NULL
  UNION ALL SELECT name, 'inverse is not mutual' FROM j WHERE found IS NOT NULL AND back IS DISTINCT FROM name UNION ALL SELECT name, 'domain does not mirror the inverse' FROM j WHERE d <> br
  UNION ALL SELECT name, 'range does not mirror the inverse' FROM j WHERE r <> bd UNION ALL SELECT name, 'unknown type in domain' FROM j WHERE list_contains(d, 'gizmo') UNION ALL SELECT name, 'unknown type in range' FROM j WHERE list_contains(r, 'gadget'))
SELECT 'dq_registry_coherence' AS rule, 'error' AS severity, name AS focus, message FROM w""")
add_rough("anomalies", quality.anomalies)

_from = lambda key: f"FROM ({ORACLE[key]}) x"
_say = lambda rule, severity, focus, message, rest: f"SELECT '{rule}' AS rule, '{severity}' AS severity, {focus} AS focus, {message} AS message {rest}"
ORACLE["dq_promotion"] = " UNION ALL ".join([
    _say("dq_promotion", "error", "id", "'too soon: ' || before || ' ' || stage", _from("stage_gap_violations") + " WHERE days < 1"),
    _say("dq_promotion", "error", "id", "'same actor at ' || stage", _from("stage_independence")),
    _say("dq_promotion", "warning", "id", "'chain is ' || stages", _from("stage_order") + " WHERE NOT in_order"),
    _say("dq_promotion", "error", "id", "'humans on the board: ' || CAST(n AS STRING)", f"""FROM ({ctes("promotions", "agents")}
SELECT p.id, count(DISTINCT actor) FILTER (class = 'human') AS n FROM promotions p LEFT JOIN agents a ON a.id = actor WHERE stage = 'board' GROUP BY p.id HAVING n < 2 AND NOT bool_or(waiver)) x"""),
])
ORACLE["dq_pointers"] = _say("dq_pointers", "error", "record", "kind || ' points to ' || pointer", _from("dangling_endpoints"))
_LONG = "'mathematically_requires', 'requires', 'logically_requires', 'depends_on', 'causes', 'applies_to', 'derived_from'"
ORACLE["dq_triage_advisory"] = _say("dq_triage_advisory", "info", "id", "'may be ' || suggested", "FROM (" + ORACLE["relation_triage"].replace("'requires', 'depends_on', 'causes', 'applies_to', 'derived_from'", _LONG) + ") x WHERE verdict = 'candidate'")
_KEY = "concat_ws('|', source, relation, object)"
ORACLE["anomalies"] = " UNION ALL ".join([
    _say("duplicate_triple", "low", _KEY, "CAST(n AS STRING) || ' times'", _from("duplicate_triples")),
    _say("conflicting_review", "high", _KEY, "CAST(n_reviews AS STRING) || ' reviews'", _from("conflicting_review")),
    _say("isolated_entity", "low", "id", "'no connection'", _from("isolated_entities")),
    _say("confidence_pair", "medium", "id", "'confidence and its basis go together'", "FROM (" + ctes("rough_connections") + " SELECT * FROM rough_connections) x WHERE (confidence IS NULL) <> (confidence_basis IS NULL)"),
    "SELECT rule, 'high' AS severity, focus, message " + _from("dq_contradiction"),
])

# rules over the nested blocks of records

_V = lambda rule, message, rest, severity="error", focus="id": f"SELECT '{rule}' AS rule, '{severity}' AS severity, {focus} AS focus, {message} AS message {rest}"
_BLOCK = lambda b: f"FROM blocks WHERE block = '{b}'"
_PIVOT = lambda b, *keys: f"(SELECT id, {', '.join(f'max(value) FILTER (key = {chr(39)}{k}{chr(39)}) AS {k}' for k in keys)} {_BLOCK(b)} GROUP BY id)"
_HUMANS = "(SELECT id FROM agents WHERE class = 'human')"
_RECORD_SQL = {
    "dq_extensions": (f"""WITH known AS (SELECT * FROM (VALUES ('segment', 'quantity', '^[a-z]+$'), ('balance', 'quantity', '^[0-9.]+$'), ('priority', 'unit', '^(high|low)$')) k(key, applies, pattern)),
x AS (SELECT b.id, b.key, CASE WHEN applies IS NULL THEN 'unregistered key' WHEN applies <> type THEN 'does not apply' WHEN NOT regexp_matches(value, pattern) THEN 'bad value' END AS why
  FROM blocks b JOIN entities e ON e.id = b.id LEFT JOIN known k ON k.key = b.key WHERE block = 'extension')
{_V("dq_extensions", "key || ': ' || why", "FROM x WHERE why IS NOT NULL")}""", ["blocks", "entities"]),
    "dq_historical": (" UNION ALL ".join([
        _V("dq_historical", "'unknown member ' || key", _BLOCK("historical") + " AND key NOT IN ('stated_by', 'year', 'where', 'context', 'note')"),
        _V("dq_historical", "'year is no number'", _BLOCK("historical") + " AND key = 'year' AND NOT regexp_matches(value, '^-?[0-9]{1,4}$')"),
        _V("dq_historical", "'missing stated_by'", "FROM " + _PIVOT("historical", "stated_by") + " WHERE stated_by IS NULL")]), ["blocks"]),
    "dq_adopted_from": (" UNION ALL ".join([
        _V("dq_adopted_from", "'unknown member ' || key", _BLOCK("adopted_from") + " AND key NOT IN ('external_id', 'relation', 'authority', 'note', 'adopted_at')"),
        _V("dq_adopted_from", "'relation ' || value", _BLOCK("adopted_from") + " AND key = 'relation' AND value NOT IN ('exact', 'close', 'broad')"),
        *[_V("dq_adopted_from", f"'missing {k}'", "FROM " + _PIVOT("adopted_from", k) + f" WHERE {k} IS NULL") for k in ("external_id", "relation", "authority")]]), ["blocks"]),
    "dq_debt": (f"""WITH d AS (SELECT d.*, e.status AS own FROM {_PIVOT("debt", "status", "cleared_by", "cleared_at", "deferred_by", "deferred_until")} d LEFT JOIN entities e ON e.id = d.id),
x AS (SELECT id, CASE WHEN status = 'outstanding' AND own IN ('canonical', 'human_reviewed') THEN 'outstanding debt of a reviewed record' WHEN status = 'cleared' AND (cleared_by IS NULL OR cleared_at IS NULL) THEN 'cleared by nobody'
  WHEN status = 'deferred' AND (deferred_by IS NULL OR deferred_until IS NULL) THEN 'deferred without an end' END AS why FROM d)
{_V("dq_debt", "why", "FROM x WHERE why IS NOT NULL")}""", ["blocks", "entities"]),
    "dq_human_review": (f"""WITH said AS (SELECT * FROM blocks WHERE block IN ('provenance', 'edit') AND value IN {_HUMANS}),
x AS (SELECT id, CASE WHEN id NOT IN (SELECT id FROM said WHERE key = 'writer') THEN 'no registered human writer' WHEN id NOT IN (SELECT id FROM said WHERE block = 'edit' OR key = 'reviewer') THEN 'no edit and no declared review' END AS why
  FROM entities WHERE status IN ('canonical', 'human_reviewed'))
{_V("dq_human_review", "why", "FROM x WHERE why IS NOT NULL")}""", ["blocks", "entities", "agents"]),
    "dq_context_vocab": (_V("dq_context_vocab", "key || ' ' || value", _BLOCK("context") + " AND NOT CASE key WHEN 'domain' THEN value IN ('geo', 'org', 'prod') WHEN 'scale' THEN value IN ('micro', 'macro') ELSE false END"), ["blocks"]),
    "dq_node_projection": (_V("dq_node_projection", "'assertion without both ends'", f"FROM connections WHERE {ACTIVE} AND review = 'canonical' AND target IS NULL"), ["connections"]),
    "dq_legacy_prefix": (_V("dq_legacy_prefix", "value", "FROM blocks WHERE contains(value, 'legacy:')"), ["blocks"]),
    "dq_inline_relationships": (_V("dq_inline_relationships", "'relationships stand on the entity'", "FROM (SELECT DISTINCT id " + _BLOCK("relationships") + ")"), ["blocks"]),
}
_GOVERN = f"""WITH x AS (SELECT b.id, value, CASE WHEN b.id = value THEN 'governs itself' WHEN e.id IS NULL THEN 'unknown law' WHEN e.type <> 'law' THEN 'no law' END AS why FROM blocks b LEFT JOIN entities e ON e.id = value WHERE block = 'governed_by')
{_V("dq_governing", "value || ': ' || why", "FROM x WHERE why IS NOT NULL")} UNION ALL {_V("dq_governing", "'core law is not there'", "FROM (VALUES ('org.s1'), ('org.s777777')) c(id) WHERE id NOT IN (SELECT id FROM entities WHERE type = 'law')")}"""
for _key in records.RECORD_RULES:
    if _key != "dq_governing":
        add(_key, quality.RULES[_key], _RECORD_SQL[_key][0], *_RECORD_SQL[_key][1])
add("dq_governing", lambda kg: records.dq_governing(kg, ("org.s1", "org.s777777")), _GOVERN, "blocks", "entities")
_CANDIDATE = " UNION ALL ".join(f"SELECT 'dq_candidate' AS rule, severity, focus, rule || ': ' || message AS message FROM ({_DQ[k][0]})" for k in records.CANDIDATE_RULES)
_CANDIDATE = re.sub(r"FROM entities", "FROM (SELECT * FROM entities WHERE status = 'draft')", re.sub(r"FROM connections", "FROM (SELECT * FROM connections WHERE review = 'unreviewed')", _CANDIDATE))
_CANDIDATE = re.sub(r"FROM blocks", "FROM (SELECT * FROM blocks WHERE id IN (SELECT id FROM entities WHERE status = 'draft' UNION ALL SELECT id FROM connections WHERE review = 'unreviewed'))", _CANDIDATE)
add_rough("dq_candidate", lambda kg: records.dq_candidate(kg, kg.entities.where("status = 'draft'"), kg.connections.where("review = 'unreviewed'")),
          _CANDIDATE, "entities", "connections", "relations", "blocks")
add("dq_live_counts", lambda kg: records.dq_live_counts(kg, kg.entities.where("id not like '%12'").groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n"))),
    """WITH r AS (SELECT status AS name, count(*) AS n FROM entities WHERE id NOT LIKE '%12' GROUP BY status), l AS (SELECT status, count(*) AS live FROM entities GROUP BY status)
SELECT 'dq_live_counts' AS rule, 'error' AS severity, coalesce(name, status) AS focus, 'recorded ' || CAST(coalesce(n, 0) AS STRING) || ' live ' || CAST(coalesce(live, 0) AS STRING) AS message FROM r FULL JOIN l ON name = status WHERE n IS DISTINCT FROM live""", "entities")
add("scoping_keys", lambda kg: records.scoping_keys(kg.blocks), "SELECT DISTINCT id, key FROM blocks WHERE key = 'gradeLevel'", "blocks")
add("relation", lambda kg: lookup.relation(kg, kg.connections.select("relation").distinct()),
    'SELECT r.name, family, inverse, transitive, "symmetric", r.status FROM relations r WHERE r.name IN (SELECT relation FROM connections)', "relations", "connections")


def _recorded(kg):
    return kg.entities.where("id not like '%12'").groupBy(F.col("status").alias("name")).agg(F.count("*").alias("n"))


def _validated(result):
    """All rules at once; the ill-made registry and records that wait to be staged are validated too."""
    def query(spark, sf_dir):
        ship(spark)
        kg = knowledge(spark, sf_dir)
        return result(kg, drafted=(kg.entities.where("status = 'draft'"), kg.connections.where("review = 'unreviewed'")), recorded=_recorded(kg), registry=_ill_registry(spark, sf_dir))

    return query


def _whole(sql, tables):
    return ctes(*tables) + (", " + sql.strip()[5:] if sql.strip().startswith("WITH ") else "\n" + sql)


_EVERY = {k: _whole(*v) for k, v in (_RECORD_SQL | {"dq_governing": (_GOVERN.split(" UNION ALL ")[0], ["blocks", "entities"])} | _DQ).items()}
_EVERY["dq_candidate"] = _whole(_CANDIDATE, ["entities", "connections", "relations", "blocks"])
_ALL = " UNION ALL ".join(f"SELECT rule, severity, focus, message FROM ({_EVERY.get(k) or ORACLE[k]}) x" for k in [*quality.RULES, "dq_candidate", "dq_live_counts"])
add_raw("validate", _validated(validation.conforms), f"SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS conforms FROM ({_ALL}) y")
add_raw("severity_counts", _validated(validation.severity_counts), f"SELECT rule, severity, count(*) AS n FROM ({_ALL}) y GROUP BY rule, severity")


# state changes


def _requests(kg):
    c = kg.connections
    to = F.when(F.col("review") == "reviewed", "canonical").when(F.col("review") == "rejected", "canonical").when(F.col("review") == "canonical", "deprecated").otherwise("reviewed")
    return c.select("id", F.col("review").alias("from_review"), to.alias("to_review"), F.when(F.col("asserted_by") == "human", "org.s1").alias("reviewer"), "reason")


add("validate_transitions", lambda kg: curate.validate_transitions(_requests(kg)).select("id", "to_review", "error"),
    """SELECT id, CASE review WHEN 'reviewed' THEN 'canonical' WHEN 'rejected' THEN 'canonical' WHEN 'canonical' THEN 'deprecated' ELSE 'reviewed' END AS to_review,
  CASE WHEN review IN ('rejected', 'unreviewed') THEN 'forbidden' WHEN review = 'reviewed' AND asserted_by <> 'human' THEN 'reviewer needed' END AS error FROM connections""", "connections")
add("apply_review_decisions", lambda kg: curate.apply_review_decisions(kg, kg.connections.where("relation = 'causes'").select("id", "source", "relation", "target", F.lit("reviewed").alias("decision"), F.lit("org.s1").alias("reviewer"), F.lit("seen").alias("reason"))).where("applied").select("id", "review", "reason"),
    "SELECT id, 'reviewed' AS review, 'seen' AS reason FROM connections WHERE relation = 'causes'", "connections")
add("promote_batch", lambda kg: curate.promote_batch(kg, kg.promotions.groupBy("id").agg(F.max("at").alias("last")).select("id", F.lit("org.s1").alias("actor"), F.date_add("last", 1).alias("at"))),
    f"""SELECT id, ['editor', 'domain_expert', 'board'][max({_PLACE}) + 1] AS stage, CASE WHEN max({_PLACE}) = 3 THEN 'complete' WHEN max_by(actor, "at") = 'org.s1' THEN 'same actor' ELSE 'ok' END AS verdict FROM promotions GROUP BY id""", "promotions")
add("propagate", lambda kg: curate.propagate(kg, kg.sources.where("lifecycle <> 'active'").select(F.col("id").alias("source_ref"), F.col("lifecycle").alias("change"))),
    """WITH ch AS (SELECT id AS source_ref, lifecycle FROM sources WHERE lifecycle <> 'active'), per AS (SELECT connection_id, count(DISTINCT source_ref) AS n FROM evidence GROUP BY connection_id)
SELECT DISTINCT ev.source_ref, 'connection' AS kind, ev.connection_id AS id, CASE lifecycle WHEN 'retracted' THEN CASE WHEN n > 1 THEN 'qualify' ELSE 'deprecate' END WHEN 'corrected' THEN 'review' ELSE 'migrate_evidence' END AS action
FROM evidence ev JOIN ch USING (source_ref) JOIN per USING (connection_id) UNION ALL SELECT e.source_ref, 'entity', id, 'review' FROM entities e JOIN ch ON ch.source_ref = e.source_ref WHERE lifecycle = 'retracted'""", "entities", "evidence", "sources")


for _change, _key in (("retracted", "retraction"), ("corrected", "correction"), ("superseded", "supersession")):
    add(f"propagate_{_key}", (lambda c: lambda kg: curate.propagate(kg, kg.sources.where(F.col("lifecycle") == c).select(F.col("id").alias("source_ref"), F.col("lifecycle").alias("change"))))(_change))
    ORACLE[f"propagate_{_key}"] = ORACLE["propagate"].replace("FROM sources WHERE lifecycle <> 'active'", f"FROM sources WHERE lifecycle = '{_change}'")


def _gates():
    return {"relation": F.col("relation").isNotNull(), "evidence": F.col("confidence").isNotNull(), "active": F.col("assertion_status") == "active", "human": F.col("asserted_by") == "human"}


add("curation_decisions", lambda kg: curate.curation_decisions(kg.connections, _gates()).select("id", "decision"),
    """SELECT id, CASE WHEN n = 0 THEN 'request_review' WHEN n = 1 AND confidence IS NULL THEN 'hold' WHEN n = 1 THEN 'propose' ELSE 'reject' END AS decision FROM (
  SELECT *, CAST(confidence IS NULL AS INT) + CAST(assertion_status <> 'active' AS INT) + CAST(asserted_by <> 'human' AS INT) AS n FROM connections)""", "connections")
add("set_debt", lambda kg: curate.set_debt(kg.sources.select("id", F.lit("outstanding").alias("status"), F.lit(None).cast("string").alias("by"), F.lit(None).cast("string").alias("at")),
                                          kg.sources.select("id", F.when(F.col("year") % 2 == 0, "cleared").otherwise("deferred").alias("to"), F.lit("org.s1").alias("by"), F.lit("2026-01-01").alias("at"), "url").withColumnRenamed("url", "evidence")),
    """SELECT id, CASE WHEN ok THEN CASE WHEN year % 2 = 0 THEN 'cleared' ELSE 'deferred' END ELSE 'outstanding' END AS status, CASE WHEN ok THEN 'org.s1' END AS by, CASE WHEN ok THEN '2026-01-01' END AS "at" FROM (SELECT *, year % 2 = 1 OR url IS NOT NULL AS ok FROM sources)""", "sources")

_NONE = lambda: F.lit(None).cast("string")
for _key, _to, _rest in (("clear_debt", "cleared", 0), ("defer_debt", "deferred", 1)):
    add(_key, (lambda to, rest: lambda kg: curate.set_debt(
        kg.sources.where(F.col("year") % 2 == rest).select("id", F.lit("outstanding").alias("status"), _NONE().alias("by"), _NONE().alias("at")),
        kg.sources.where(F.col("year") % 2 == rest).select("id", F.lit(to).alias("to"), F.lit("org.s1").alias("by"), F.lit("2026-01-01").alias("at"), F.col("url").alias("evidence"))))(_to, _rest),
        f"""SELECT id, CASE WHEN ok THEN '{_to}' ELSE 'outstanding' END AS status, CASE WHEN ok THEN 'org.s1' END AS by, CASE WHEN ok THEN '2026-01-01' END AS "at" FROM (SELECT *, year % 2 = 1 OR url IS NOT NULL AS ok FROM sources) WHERE year % 2 = {_rest}""", "sources")

# matching and mining

add("match_symbol", match.match_symbol,
    "WITH s AS (SELECT id, lower(trim(symbol)) AS k FROM entities WHERE symbol IS NOT NULL), f AS (SELECT k, min(id) AS first FROM s GROUP BY k HAVING count(*) > 1) SELECT first AS a, id AS b FROM s JOIN f USING (k) WHERE id <> first", "entities")
add_rough("match_alias", match.match_alias, "SELECT DISTINCT a.id AS a, b.id AS b FROM entities a JOIN entities b ON lower(a.subdomain) = lower(b.name) WHERE a.id <> b.id", "entities")
add_rough("match_cross_domain", match.match_cross_domain, "SELECT lower(name) AS name, count(DISTINCT domain) AS n_domains, count(*) AS n, min(id) AS first_id FROM entities GROUP BY lower(name) HAVING count(DISTINCT domain) > 1", "entities")
add("match_equation", lambda kg: match.match_equation(kg.with_(entities=kg.entities.withColumn("equation", F.concat(F.lit("Y = "), "definition", F.lit(" × t"))))),
    "WITH s AS (SELECT id, replace(replace(lower('Y = ' || definition || ' × t'), ' ', ''), '×', '*') AS k FROM entities WHERE definition IS NOT NULL), f AS (SELECT k, min(id) AS first FROM s GROUP BY k HAVING count(*) > 1) SELECT first AS a, id AS b FROM s JOIN f USING (k) WHERE id <> first", "entities")
add("match_name", match.match_name)
add("name_classes", match.name_classes, "SELECT id, min(id) OVER (PARTITION BY regexp_replace(lower(name), '[0-9]', '0', 'g')) AS class_id FROM entities WHERE name IS NOT NULL", "entities")
add("match_all", match.match_all)
add("resolve_claim_entities", lambda kg: match.resolve_claim_entities(kg.claims, kg).select("claim_id", "subject", "method"))
add("claim_provenance", lambda kg: match.claim_provenance(kg.claims),
    "SELECT claim_id, sha256(document_id) AS document_hash, sha256(concat_ws(chr(31), subject, relation, object, coalesce(value, ''), coalesce(unit, ''))) AS content_hash FROM claims", "claims")
_UNITS = {"has_unit": ["usd", "cent"]}
add_raw("verify_claims", lambda spark, d: match.verify_claims(testgraph.table(spark, d, "rough_claims"), knowledge(spark, d), _UNITS),
    ctes("rough_claims", "entities", "relations") + """, t AS (SELECT *, contains(lower(text_span), lower(replace(subject, '_', ' '))) OR contains(lower(text_span), lower(replace(object, '_', ' '))) AS named FROM rough_claims),
f AS (SELECT claim_id, CASE WHEN named THEN 'supported' WHEN length(text_span) > 30 THEN 'uncertain' ELSE 'unsupported' END AS support, concat_ws(',', CASE WHEN NOT named AND length(text_span) <= 20 THEN 'cited_text' END,
  CASE WHEN length(unit) >= 20 OR NOT regexp_matches(unit, '^[A-Za-zΩ]+$|[/^°]') THEN 'unit' END, CASE WHEN value IS NOT NULL AND TRY_CAST(value AS DOUBLE) IS NULL THEN 'number' END,
  CASE WHEN subject LIKE 'prod.%' AND subject NOT IN (SELECT id FROM entities) THEN 'entity' END, CASE WHEN relation NOT IN (SELECT name FROM relations) AND relation <> 'has_unit' THEN 'relation' END,
  CASE WHEN relation = 'has_unit' AND unit NOT IN ('usd', 'cent') THEN 'dimension' END, CASE WHEN NOT contains(equation, '=') THEN 'equation' END) AS failed FROM t)
SELECT claim_id, failed, support, CASE WHEN failed <> '' THEN 'failed' WHEN support = 'supported' THEN 'verified' ELSE 'needs_review' END AS status FROM f""")
add("proposals", match.proposals,
    """WITH k AS (SELECT subject, relation, object, count(DISTINCT value) > 1 AS conflict FROM claims WHERE value IS NOT NULL GROUP BY ALL)
SELECT claim_id, subject, relation, object, coalesce(conflict, false) AS conflict, 'proposed' AS review, CASE WHEN value IS NULL THEN 'value' ELSE '' END AS gaps FROM claims LEFT JOIN k USING (subject, relation, object)""", "claims")
add_raw("proposal_evidence_gate", lambda spark, d: match.evidence_gate(testgraph.table(spark, d, "rough_claims")), ctes("rough_claims") + """
SELECT claim_id, field FROM (SELECT claim_id, unnest(['source_id', 'document_hash', 'text_span', 'model_id', 'pipeline_version', 'verification_status']) AS field,
  unnest([source_id, document_id, text_span, model_id, pipeline_version, verification_status]) AS value FROM rough_claims) x WHERE trim(coalesce(value, '')) = ''""")
_DOCS = lambda spark, d: read(spark, d, "documents")
add_raw("evidence_windows", lambda spark, d: match.evidence_windows(_DOCS(spark, d)).select("doc_id", "sentence_id", "start", "end", F.length("text_span").cast("long").alias("n")))
RELATION_NAMES = ["depends_on", "causes", "related_to"]
add_raw("extract_claims", lambda spark, d: match.extract_claims(match.evidence_windows(_DOCS(spark, d), None), RELATION_NAMES))


def _rules(spark):
    return spark.createDataFrame([("email", "[a-z0-9]+@mail[0-9]", "contact"), ("licence", "Licensed under", "law"), ("token", "token = ", "secret"), ("phone", r"\+1 \([0-9]{3}\)", "contact"), ("shout", "[A-Z]{6}", "style"), ("both", "the (of|and) ?", "style")], "rule string, pattern string, domain string")


add_raw("rule_entities", lambda spark, d: match.rule_entities(_DOCS(spark, d), _rules(spark)).select("doc_id", "rule", "domain", F.col("hits").cast("long").alias("hits")),
        r"""SELECT doc_id, rule, domain, CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS hits FROM documents CROSS JOIN (VALUES ('email', '[a-z0-9]+@mail[0-9]', 'contact'), ('licence', 'Licensed under', 'law'), ('token', 'token = ', 'secret'), ('phone', '\+1 \([0-9]{3}\)', 'contact'), ('shout', '[A-Z]{6}', 'style'), ('both', 'the (of|and) ?', 'style')) r(rule, pattern, domain) WHERE regexp_matches(text, pattern)""")
add("search", lambda kg: match.search(kg, "widget"),
    rf"""SELECT id, name, CAST(CASE WHEN n LIKE 'widget%' THEN 0 WHEN n LIKE '%widget%' THEN 1 ELSE 2 END AS INTEGER) AS rank FROM (SELECT id, name, array_to_string(regexp_extract_all(lower(name), '[a-z0-9]+'), ' ') AS n, array_to_string(regexp_extract_all(lower(definition), '[a-z0-9]+'), ' ') AS d FROM entities WHERE {LIVE})
WHERE n LIKE '%widget%' OR d LIKE '%widget%'""", "entities")
add("grounding_topk", lambda kg: match.grounding_topk(kg, "tell me about the nation of France and Europe", 10),
    """WITH t AS (SELECT unnest(['nation', 'france', 'europe']) AS t), e AS (SELECT 'entity' AS kind, id, sum(CASE WHEN lower(name) = t THEN 10 WHEN contains(lower(name), t) THEN 6 ELSE 0 END + CASE WHEN contains(lower(id), t) THEN 5 ELSE 0 END + CASE WHEN contains(lower(definition), t) THEN 2 ELSE 0 END
  + CASE WHEN lower(coalesce(symbol, '')) = t THEN 6 ELSE 0 END + CASE WHEN domain = t THEN 3 ELSE 0 END) AS score FROM entities, t GROUP BY id),
c AS (SELECT 'connection' AS kind, c.id, sum(CASE WHEN contains(lower(concat_ws(' ', relation, s.name, g.name, c.id)), t) THEN 4 ELSE 0 END) AS score FROM connections c LEFT JOIN entities s ON s.id = source LEFT JOIN entities g ON g.id = target, t GROUP BY c.id)
SELECT kind, id, CAST(score AS INTEGER) AS score FROM (SELECT * FROM e UNION ALL SELECT * FROM c) WHERE score > 0 ORDER BY score DESC, id LIMIT 10""", "entities", "connections")
add_raw("scoping_claims", lambda spark, d: match.scoping_claims(_DOCS(spark, d), ["the", "and", "with"]),
        """WITH t AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+') IF w <> ''] AS t FROM documents)
SELECT doc_id FROM t WHERE len([i FOR i IN range(1, len(t) + 1) IF len(list_distinct(list_intersect(t[i : i + 2], ['the', 'and', 'with']))) >= 2]) > 0""")
add_raw("stale_counts", lambda spark, d: match.stale_counts(_DOCS(spark, d), 9, "the"),
        r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line, n AS said FROM (SELECT doc_id, i, regexp_extract(l[i], '([0-9]+) the', 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)) WHERE n <> '' AND TRY_CAST(n AS BIGINT) <> 9""")
add_raw("secret_scan", lambda spark, d: match.secret_scan(_DOCS(spark, d)),
        r"""SELECT doc_id FROM documents WHERE regexp_matches(text, 'AKIA[A-Z0-9]{16}|(?i:(password|secret|token|api_?key)\s*[:=]\s*["''][^"'']{8,})') AND NOT contains(lower(text), 'example')""")


def _leaks(spark, sf_dir):
    """Every third vector as a text that shows it."""
    digits = F.transform("embedding", lambda x: F.concat(F.when(x < 0, "-0.").otherwise("0."), F.lpad((F.abs(x) * 1000).cast("int").cast("string"), 4, "0")))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("[ "), F.array_join(digits, ", "))).otherwise("[0.5, 1]").alias("text"))


add_raw("embedding_leak_scan", lambda spark, d: match.embedding_leak_scan(_leaks(spark, d)), "SELECT vec_id AS doc_id FROM embeddings WHERE vec_id % 3 = 0")

# vectors

_VEC = lambda spark, d: read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
add_raw("vector_topk", lambda spark, d: vector.vector_topk(_VEC(spark, d), _VEC(spark, d).where("id = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 10),
        """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, round(list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS score FROM embeddings, q)
SELECT CAST(0 AS BIGINT) AS query_id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM s ORDER BY score DESC, id LIMIT 10""")
add_raw("vector_topk_all", lambda spark, d: vector.vector_topk(_VEC(spark, d), _VEC(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 10),
        """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.e, v.e) / (q.norm * v.norm), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM s QUALIFY rank <= 10""")
add_raw("embeddings_preview", lambda spark, d: vector.embeddings_preview(_VEC(spark, d)), "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dimensions, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
_CHUNK = "concat_ws(chr(10), 'Name: ' || name, 'Type: ' || type, 'Domain: ' || domain, 'Definition: ' || definition, 'Symbol: ' || symbol)"
add("chunk_entities", vector.chunk_entities, f"SELECT id, {_CHUNK} AS content FROM entities", "entities")
add("embedding_hash", lambda kg: vector.embedding_hash(vector.chunk_entities(kg), "m1", "h"), f"SELECT id, substr(sha256({_CHUNK} || '|m1|h'), 1, 16) AS hash FROM entities", "entities")
add("placeholder_embed", lambda kg: vector.placeholder_embed(vector.chunk_entities(kg)).select("id", F.round(F.get("vector", F.lit(0)), 6).alias("first"), "placeholder"),
    f"SELECT id, round(CAST('0x' || substr(sha256({_CHUNK}), 1, 4) AS INT)::DOUBLE / 65535 * 2 - 1, 6) AS first, true AS placeholder FROM entities", "entities")


def _hits(kg):
    return match.search(kg, "widget", limit=5).select(F.lit(0).cast("long").alias("query_id"), F.row_number().over(Window.orderBy("rank", "id")).alias("rank"), "id")


def _stray(kg):
    """An answer for each supplier that cites what nothing retrieved, or is refused and cites nothing."""
    k = F.split_part("id", F.lit("org.s"), F.lit(2)).cast("long")
    return kg.entities.where("type = 'law'").select(k.alias("query_id"), (k % 2 == 0).alias("refused"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("id")).alias("cited"))


add("rag_context", lambda kg: vector.rag_context(_hits(kg), vector.chunk_entities(kg)).select("query_id", F.sha2("context", 256).alias("context_sha256"), F.array_join("citations", ",").alias("citations")),
    f"""WITH h AS (SELECT id, row_number() OVER (ORDER BY rank, id) AS rank FROM ({ORACLE["search"]}) x QUALIFY row_number() OVER (ORDER BY rank, id) <= 5)
SELECT CAST(0 AS BIGINT) AS query_id, sha256(string_agg('[' || rank || '] ' || id || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS context_sha256, string_agg(id, ',' ORDER BY rank) AS citations FROM h JOIN (SELECT id, {_CHUNK} AS content FROM entities) k USING (id)""", "entities")
add("citations_grounded", lambda kg: vector.citations_grounded(vector.rag_context(_hits(kg), vector.chunk_entities(kg)).select("query_id", F.lit(False).alias("refused"), F.col("citations").alias("cited")).unionByName(_stray(kg)), _hits(kg), kg),
    "SELECT CAST(0 AS BIGINT) AS query_id, true AS grounded UNION ALL SELECT CAST(substr(id, 6) AS BIGINT), CAST(substr(id, 6) AS BIGINT) % 3 = 0 FROM entities WHERE id LIKE 'org.s%'", "entities")

def _measures(texts):
    """An embedding hook for the tests of this catalog: length and number of spaces."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def _one_hot(texts):
    """Another: a one at the length modulo 64."""
    return [[float(i == len(t) % 64) for i in range(64)] for t in texts]


def _retrieved(kg, spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("prod.p"), F.col("vec_id").cast("string")).alias("id"), F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")).alias("model"), F.col("embedding").alias("vector"))
    return vector.retrieve(v, read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), kg, _one_hot, "m1", 5, "prod")


add("embed_with", lambda kg: vector.embed_with(kg.entities.select("id", F.col("name").alias("content")), _measures, "m1").select("id", "model", F.get("vector", F.lit(0)).alias("length"), F.get("vector", F.lit(1)).alias("spaces")),
    "SELECT id, 'm1' AS model, CAST(length(name) AS DOUBLE) AS length, CAST(length(name) - length(replace(name, ' ', '')) AS DOUBLE) AS spaces FROM entities", "entities")
_RETRIEVED = """v AS (SELECT 'prod.p' || CAST(vec_id AS STRING) AS id, embedding AS e, sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])) AS norm FROM embeddings WHERE vec_id % 3 = 1 AND 'prod.p' || CAST(vec_id AS STRING) IN (SELECT id FROM entities)),
s AS (SELECT CAST(item_id AS STRING) AS query_id, id, round(CAST(e[length(text) % 64 + 1] AS DOUBLE) / norm, 6) AS score FROM benchmark, v),
h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5)"""
add_raw("retrieve", lambda spark, d: _retrieved(knowledge(spark, d), spark, d), ctes("entities") + f", {_RETRIEVED} SELECT query_id, rank, id, score, name, 'm1' AS model FROM h JOIN entities USING (id)")
add_raw("rag_citations", lambda spark, d: vector.rag_citations(_retrieved(knowledge(spark, d), spark, d), knowledge(spark, d)),
        ctes("entities", "sources") + f", {_RETRIEVED} SELECT query_id, rank, h.id AS entity_id, coalesce(e.source_ref, '') AS source_ref, coalesce(url, '') AS link FROM h JOIN entities e ON e.id = h.id LEFT JOIN sources s ON s.id = e.source_ref")

# sources and streams

def _digest_sql(table: str, columns: list[str]) -> str:
    sums = ", ':', ".join(f"sum(CAST('0x' || substr(h, {a}, 15) AS BIGINT)::HUGEINT)" for a in (4, 19, 34, 49))
    return f"""WITH h AS (SELECT sha256(CAST(to_json(struct_pack({", ".join(f'"{c}" := "{c}"' for c in sorted(columns))})) AS STRING)) AS h FROM {table}),
p AS (SELECT count(*) AS n, concat(substr(h, 1, 3), ':', count(*), ':', {sums}) AS line FROM h GROUP BY substr(h, 1, 3))
SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, CAST(sum(n) AS BIGINT) AS rows FROM p"""


add("payload_sha256", lambda kg: files.tree_hash(kg.entities.select("id", "name", "status")), _digest_sql("entities", ["id", "name", "status"]), "entities")
add("content_hash", lambda kg: files.tree_hash(kg.connections), _digest_sql("connections", [c.split()[0] for c in schema.CONNECTIONS.split(", ")]), "connections")


def _shared(spark, name):
    """A new folder among those that all executors share."""
    import uuid

    from weftgraph.runtime import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _vectors(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return v.select(F.concat(F.lit("v."), F.col("vec_id").cast("string")).alias("entity_id"), F.lit("m1").alias("model"), F.lit(False).alias("placeholder"), F.size("embedding").alias("dimensions"), F.col("embedding").alias("vector"))


def _reread_vectors(spark, sf_dir):
    path = _shared(spark, "vectors")
    files.write_embeddings(_vectors(spark, sf_dir), path, "m1")
    return files.load_embeddings(spark, path).select("entity_id", "model", "dimensions", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


def _export(spark, sf_dir, entities="entities", connections="connections"):
    """The graph as one published document in a shared folder; some counts and members of the rough one are wrong."""
    rough = entities != "entities"
    e, c, s = testgraph.table(spark, sf_dir, entities), testgraph.table(spark, sf_dir, connections), testgraph.table(spark, sf_dir, "sources")
    raw = lambda df, *cols: df.select(F.to_json(F.struct(*cols)).alias("raw"))
    lit = lambda x, n: F.lit(x).alias(n)
    sections = {
        "entities": raw(e, "id", "type", "name", "domain", "subdomain", "status", F.when((F.length("name") % 3 > 0) | F.lit(not rough), F.col("definition")).alias("definition"), "symbol", F.struct(F.col("source_ref").alias("source"), lit('a "quoted" {brace', "note")).alias("provenance")),
        "connections": raw(c, "id", lit("connection", "type"), "source", "relation", "target", F.when(F.col("amount").isNotNull(), F.struct("amount", "unit")).alias("value"), F.struct(F.col("assertion_status").alias("status"), F.struct(F.col("review").alias("status")).alias("review")).alias("assertion"), F.struct(F.struct(F.col("asserted_by").alias("type")).alias("asserted_by")).alias("provenance")),
        "sources": raw(s, "id", "type", F.col("title").alias("citation"), "title", "publisher", F.col("year").cast("string").alias("year"), "lifecycle"),
    }
    n = [e.count() + rough, c.count(), s.count()]
    head = {"export_version": "2.2" if rough else "2.2.0", "schema_version": "1.3.0", "content_hash": "sha256:" + "0" * 64, "source": "driver's tables", "entity_count": n[0], "connection_count": n[1], "source_count": n[2]}
    head |= {"relation_registry": {r[0]: dict(zip(("family", "inverse", "transitive", "symmetric", "domain", "range", "status"), r[1:], strict=True)) for r in schema.REGISTRY}}
    path = _shared(spark, "export") + ".json"
    files.write_export(spark, head, sections, path)
    return path


def _load_export(spark, sf_dir):
    kg, _, _ = files.load_export(spark, _export(spark, sf_dir), 1 << 16)
    part = lambda df, kind, *cols: df.select(F.lit(kind).alias("kind"), *[F.col(c).cast("string").alias(n) for n, c in zip("abcd", cols, strict=True)])
    return part(kg.entities, "entity", "id", "name", "status", "source_ref").unionByName(part(kg.connections, "connection", "id", "relation", "target", "amount")).unionByName(part(kg.sources, "source", "id", "title", "publisher", "year")).unionByName(part(kg.relations, "relation", "name", "family", "inverse", "transitive"))


add_raw("load_export", _load_export, ctes("entities", "connections", "sources", "relations") + """
SELECT 'entity' AS kind, id AS a, name AS b, status AS c, source_ref AS d FROM entities UNION ALL SELECT 'connection', id, relation, target, amount FROM connections
UNION ALL SELECT 'source', id, title, publisher, CAST(year AS STRING) FROM sources UNION ALL SELECT 'relation', name, family, inverse, CAST(transitive AS STRING) FROM relations""")


def _export_contract(spark, sf_dir):
    _, head, records = files.load_export(spark, _export(spark, sf_dir, "rough_entities", "rough_connections"), 1 << 16)
    return files.export_contract(spark, head, records)


add_raw("dq_export_contract", _export_contract, ctes("rough_entities", "rough_connections", "sources") + """
SELECT 'entities' AS section, id AS focus, 'required:definition' AS rule FROM rough_entities WHERE length(name) % 3 = 0
UNION ALL SELECT 'entities', id, 'duplicate id' FROM rough_entities GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'connections', id, 'duplicate id' FROM rough_connections GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'connections', id, 'target xor value' FROM rough_connections WHERE (target IS NULL) = (amount IS NULL)
UNION ALL SELECT 'connections', id, 'decimal:amount' FROM rough_connections WHERE amount = '1.5e'
UNION ALL SELECT 'export', 'export_version', 'version' UNION ALL SELECT 'export', 'entity_count', 'count'""")


def _write_files(df, path):
    """Rows (file, content): a file each, written by the tasks that hold them."""
    def write(frames):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        for pdf in frames:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                store.create_dir(f"{at}/{name}".rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(f"{at}/{name}") as out:
                    out.write(content.encode())
            yield pdf[["file"]]

    df.mapInPandas(write, "file string").count()
    return path


def _corpus(spark, sf_dir):
    """A file for each supplier (Markdown with front matter, some with repeated keys, some without) and nation (YAML)."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    front = F.concat(F.lit("---\nid: org.s"), k.cast("string"), F.lit("\nname: "), F.col("s_name"), F.lit("\nprovenance:\n  writer: w"), (k % 5).cast("string"), F.when(k % 7 == 0, F.lit("\n  writer: again")).otherwise(""),
                     F.lit("\n  at: [1, {page: 2}]"), F.when(k % 11 == 0, F.lit("\nname: twice")).otherwise(""), F.lit("\n---\nText.\n"))
    md = s.select(F.concat(F.lit("org/s"), k.cast("string"), F.lit(".md")).alias("file"), F.when(k % 13 == 0, "no front matter").otherwise(front).alias("content"))
    yml = n.select(F.concat(F.lit("geo/n"), F.col("n_nationkey").cast("string"), F.lit(".yaml")).alias("file"), F.concat(F.lit("name: "), F.col("n_name"), F.lit("\nregion: "), F.col("n_regionkey").cast("string"), F.lit("\nnote: null\n")).alias("content"))
    return files.load_corpus(spark, _write_files(md.unionByName(yml), _shared(spark, "corpus")))


_FILE = "element_at(split(path, '/'), -1) AS file"
_NAMED = "'s' || CAST(s_suppkey AS STRING) || '.md'"
add_raw("load_corpus", lambda spark, d: (lambda c: files.blocks(c).unionByName(c.where("error is not null").select("path", F.lit("error").alias("block"), F.lit("").alias("key"), F.col("error").alias("value"))))(_corpus(spark, d)).selectExpr(_FILE, "block", "key", "value"), f"""
WITH s AS (SELECT s_suppkey AS k, s_name, {_NAMED} AS file FROM supplier WHERE s_suppkey % 13 > 0)
SELECT file, 'id' AS block, '' AS key, 'org.s' || CAST(k AS STRING) AS value FROM s
UNION ALL SELECT file, 'name', '', CASE WHEN k % 11 = 0 THEN 'twice' ELSE s_name END FROM s
UNION ALL SELECT file, 'provenance', 'writer', CASE WHEN k % 7 = 0 THEN 'again' ELSE 'w' || CAST(k % 5 AS STRING) END FROM s
UNION ALL SELECT file, 'provenance', 'at.0', '1' FROM s UNION ALL SELECT file, 'provenance', 'at.1.page', '2' FROM s
UNION ALL SELECT {_NAMED}, 'error', '', 'no front matter' FROM supplier WHERE s_suppkey % 13 = 0
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING) || '.yaml', b, '', CASE b WHEN 'name' THEN n_name WHEN 'region' THEN CAST(n_regionkey AS STRING) END FROM nation, (SELECT unnest(['name', 'region', 'note']) AS b) x""")
add_raw("duplicate_yaml_keys", lambda spark, d: files.duplicate_yaml_keys(_corpus(spark, d)).selectExpr(_FILE, "key"), f"""
SELECT {_NAMED} AS file, 'provenance.writer' AS key FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey % 13 > 0 UNION ALL SELECT {_NAMED}, 'name' FROM supplier WHERE s_suppkey % 11 = 0 AND s_suppkey % 13 > 0""")


def _texts(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    ending = F.element_at(F.array(*map(F.lit, ("txt", "md", "html", "bin"))), (F.col("item_id") % 4 + 1).cast("int"))
    rows = b.select(F.concat(F.lit("t"), F.col("item_id").cast("string"), F.lit("."), ending).alias("file"), F.coalesce("text", F.lit("")).alias("content"))
    return files.ingest_text_documents(spark, _write_files(rows, _shared(spark, "texts")))


add_raw("ingest_text_documents", lambda spark, d: _texts(spark, d).selectExpr(_FILE, "kind", "sha256", "length(preview) AS preview"), """
SELECT 't' || CAST(item_id AS STRING) || '.' || ['txt', 'md', 'html'][item_id % 4 + 1] AS file, ['text', 'markdown', 'html'][item_id % 4 + 1] AS kind, sha256(coalesce(text, '')) AS sha256, CAST(least(length(coalesce(text, '')), 2000) AS INTEGER) AS preview
FROM benchmark WHERE item_id % 4 < 3""")
add_raw("write_embeddings", lambda spark, d: files.write_embeddings(_vectors(spark, d), _shared(spark, "vectors"), "m1"),
        "SELECT 'm1' AS model, count(*) AS count, CAST(max(len(embedding)) AS INTEGER) AS dimensions, 'cosine' AS metric FROM embeddings")
add_raw("load_embeddings", _reread_vectors, "SELECT 'v.' || CAST(vec_id AS STRING) AS entity_id, 'm1' AS model, CAST(len(embedding) AS INTEGER) AS dimensions, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")


def _publish_views(spark, sf_dir):
    """Two views of the graph published together: what is live, and the canonical entities alone; both stamped with the content hash of all entities."""
    kg, path = knowledge(spark, sf_dir), _shared(spark, "views")
    live = kg.entities.where(~F.coalesce(F.col("status").isin("deprecated", "superseded"), F.lit(False)))
    views_ = {"live": {"entities": live, "connections": kg.connections, "sources": kg.sources}, "canonical": {"entities": kg.entities.where("status = 'canonical'")}, "rejected": {"connections": kg.connections.where("review = 'rejected'")}}
    stamp = files.tree_hash(kg.entities.select("id", "name", "status")).first().digest
    bundle.publish(spark, views_, path, {"content_hash": f"sha256:{stamp}"})
    return path


def _reread_views(spark, sf_dir):
    path = _publish_views(spark, sf_dir)
    each = [bundle.read_view(spark, path, v, "entities", "domain string").withColumn("view", F.lit(v)) for v in ("live", "canonical")]
    return each[0].unionByName(each[1]).groupBy("view", "domain").agg(F.count("*").alias("n"))


def _view_manifest(spark, sf_dir):
    m = bundle.current(_publish_views(spark, sf_dir))
    rows = [(v, x["kind"], s.removesuffix("_count"), n, m["content_hash"]) for v, x in m["views"].items() for s, n in x.items() if s != "kind"]
    return spark.createDataFrame(rows, "view string, kind string, section string, n long, content_hash string")


add_raw("write_views", _reread_views, ctes("entities") + f"""
SELECT 'live' AS view, domain, count(*) AS n FROM entities WHERE {LIVE} GROUP BY domain UNION ALL SELECT 'canonical', domain, count(*) FROM entities WHERE status = 'canonical' GROUP BY domain""")
add_raw("view_manifest", _view_manifest, ctes("entities", "connections", "sources") + f""", stamp AS ({_digest_sql("entities", ["id", "name", "status"])}),
n AS (SELECT 'live' AS view, 'export' AS kind, 'entities' AS section, count(*) AS n FROM entities WHERE {LIVE} UNION ALL SELECT 'live', 'export', 'connections', count(*) FROM connections
  UNION ALL SELECT 'live', 'export', 'sources', count(*) FROM sources UNION ALL SELECT 'canonical', 'other', 'entities', count(*) FROM entities WHERE status = 'canonical'
  UNION ALL SELECT 'rejected', 'connections-view', 'connections', count(*) FROM connections WHERE review = 'rejected')
SELECT n.*, 'sha256:' || digest AS content_hash FROM n, stamp""")


def _text_trees(spark, sf_dir):
    """Digests of two trees with a file for each passage of the benchmark: the later one lacks some files, has some changed and some new."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.coalesce("text", F.lit("")).alias("content"))
    named = lambda df: df.select(F.concat(F.lit("d"), (F.col("k") % 7).cast("string"), F.lit("/t"), F.col("k").cast("string"), F.lit(".txt")).alias("file"), "content")
    late = b.where("k % 9 > 0").withColumn("content", F.when(F.col("k") % 10 == 3, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    late = late.unionByName(b.where("k % 11 = 0").withColumn("k", -F.col("k") - 1))
    out = []
    for rows in (b, late):
        at = _shared(spark, "tree")
        _write_files(named(rows), f"{at}/files")
        out.append(merkle.write_tree(merkle.file_leaves(spark, f"{at}/files"), f"{at}/merkle"))
    return out


def _merkle_sql(depth=4):
    levels = [f"l{depth} AS (SELECT substr(h, 1, {depth}) AS p, sha256(string_agg(h || ':' || digest, chr(10) ORDER BY h || ':' || digest)) AS d, count(*) AS n FROM leaf GROUP BY 1)"]
    levels += [f"l{i} AS (SELECT substr(p, 1, {i}) AS p, sha256(string_agg(p || ':' || d, chr(10) ORDER BY p || ':' || d)) AS d, sum(n) AS n FROM l{i + 1} GROUP BY 1)" for i in range(depth - 1, -1, -1)]
    return f"""WITH leaf AS (SELECT sha256('d' || CAST(item_id % 7 AS STRING) || '/t' || CAST(item_id AS STRING) || '.txt') AS h, sha256(coalesce(text, '')) AS digest FROM benchmark),
{", ".join(levels)} SELECT d AS digest, CAST(n AS BIGINT) AS leaves FROM l0"""


_PATH = "'d' || CAST({0} % 7 AS STRING) || '/t' || CAST({0} AS STRING) || '.txt'"
add_raw("tree_content_hash", lambda spark, d: merkle.root(_text_trees(spark, d)[0]), _merkle_sql())
add_raw("tree_drift", lambda spark, d: merkle.drift(*_text_trees(spark, d)), f"""
SELECT {_PATH.format("item_id")} AS path, CASE WHEN item_id % 9 = 0 THEN 'removed' ELSE 'changed' END AS change FROM benchmark WHERE item_id % 9 = 0 OR item_id % 10 = 3
UNION ALL SELECT {_PATH.format("(-item_id - 1)")}, 'added' FROM benchmark WHERE item_id % 11 = 0""")


def _bundles(spark, sf_dir):
    """Two copies of a bundle of as many text files as there are domains and statuses; the second lacks one folder and has another one's content changed."""
    e, path = knowledge(spark, sf_dir).entities, _shared(spark, "bundle")
    rows = e.select("domain", "status", F.concat_ws("|", "id", "name").alias("line")).repartition("domain", "status").sortWithinPartitions("domain", "status", "line")
    rows.write.partitionBy("domain", "status").text(f"{path}/a")
    late = rows.where("not (domain = 'org' and status = 'draft')").withColumn("line", F.when(F.col("status") == "canonical", F.upper("line")).otherwise(F.col("line")))
    late.write.partitionBy("domain", "status").text(f"{path}/b")
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return [files.bundle_manifest(spark, f"{path}/{x}").where("file like '%.txt'").withColumn("file", folder) for x in "ab"]


add_raw("bundle_manifest", lambda spark, d: _bundles(spark, d)[0].select("file", F.col("bytes").cast("long").alias("bytes")),
        ctes("entities") + "\nSELECT 'domain=' || domain || '/status=' || status AS file, CAST(sum(strlen(id) + strlen(name) + 2) AS BIGINT) AS bytes FROM entities GROUP BY domain, status")
add_raw("bundle_verify", lambda spark, d: files.bundle_verify(*_bundles(spark, d)),
        ctes("entities") + """
SELECT 'domain=' || domain || '/status=' || status AS file, CASE WHEN domain = 'org' AND status = 'draft' THEN 'missing' ELSE 'mismatch' END AS problem FROM entities WHERE (domain = 'org' AND status = 'draft') OR status = 'canonical' GROUP BY domain, status""")


def _audit(spark, sf_dir):
    path = _shared(spark, "audit")
    rows = read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("event"), F.col("event_id").cast("string").alias("doc_id"), F.col("props").alias("detail"))
    rows.write.json(path)
    return files.audit_read(spark, path, 100).select("timestamp", "event", "doc_id")


add_raw("audit_read", _audit, "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, event_type AS event, CAST(event_id AS STRING) AS doc_id FROM events ORDER BY 1 DESC, 2, CAST(event_id AS STRING) LIMIT 100")

add_raw("stream_audit_counts", lambda spark, d: jobs.run(jobs.audit_counts(jobs.source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))), "complete"),
        "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
add_raw("stream_duplicate_claims", lambda spark, d: jobs.run(jobs.repeated_claims(jobs.source(spark, d, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("signature"), F.col("event_id").alias("claim_id")))).groupBy("signature").agg(F.count("*").alias("n")),
        "SELECT CAST(user_id AS STRING) || '|' || event_type AS signature, count(*) - 1 AS n FROM events GROUP BY ALL HAVING count(*) > 1")
add_raw("stream_conflicts", lambda spark, d: jobs.run(jobs.conflicts(jobs.source(spark, d, "events").select(F.col("user_id").cast("string").alias("triple"), F.col("event_type").alias("value")))).groupBy("triple").agg(F.max("n_values").alias("n_values")),
        "SELECT CAST(user_id AS STRING) AS triple, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
add_raw("stream_human_edits", lambda spark, d: jobs.run(jobs.human_edits(jobs.source(spark, d, "events").select("event_id", F.concat(F.lit("org.s"), F.col("user_id").cast("string")).alias("agent")), testgraph.table(spark, d, "agents"))),
        ctes("agents") + "\nSELECT event_id, 'org.s' || CAST(user_id AS STRING) AS agent FROM events WHERE 'org.s' || CAST(user_id AS STRING) IN (SELECT id FROM agents WHERE class = 'human' AND status = 'active')")
add_raw("stream_ledger_verify", lambda spark, d: jobs.run(jobs.ledger_verify(_ledger_stream(spark, d))).groupBy("hash_ok", "link_ok").agg(F.count("*").alias("n")),
        "SELECT true AS hash_ok, true AS link_ok, count(*) AS n FROM events")


def _ledger_stream(spark, sf_dir):
    """The ledger is written once to the checkpoint folder and read as a stream."""
    import uuid

    from weftgraph.runtime import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/ledger-{uuid.uuid4().hex}"
    rows = _ledger(spark, sf_dir).select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("seq"), "prev_hash", "hash", F.concat_ws("|", "event_id", "event_type", "props").alias("body"))
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)

