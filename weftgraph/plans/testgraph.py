"""A knowledge graph read out of star-schema tables, in SQL that Spark and other engines share.

The rules (key modulo a small number) are this library's own; they give every operator something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph import schema
from weftgraph.runtime import read
from weftgraph.schema import KnowledgeSet

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def _entity(prefix: str, key: str, kind: str, name: str, domain: str, definition: str, symbol: str, table: str, sub: str) -> str:
    return f"""SELECT '{prefix}' || CAST({key} AS STRING) AS id, '{kind}' AS type, {name} AS name, '{domain}' AS domain, {sub} AS subdomain,
  CASE WHEN {key} % 10 = 0 THEN 'canonical' WHEN {key} % 10 = 1 THEN 'human_reviewed' WHEN {key} % 10 = 2 THEN 'deprecated' WHEN {key} % 30 = 3 THEN 'superseded' ELSE 'draft' END AS status,
  {definition} AS definition, {symbol} AS symbol, CAST(NULL AS STRING) AS unit, CAST(NULL AS STRING) AS equation,
  CASE WHEN {key} % 10 = 2 OR {key} % 30 = 3 THEN '{prefix}' || CAST({key} + 1 AS STRING) END AS deprecated_by,
  CASE WHEN {key} % 9 = 0 THEN 'src.s' || CAST({key} % 100 AS STRING) END AS source_ref
  FROM {table}"""


def _edge(prefix: str, key: str, source: str, relation: str, target: str, table: str, amount: str = "CAST(NULL AS STRING)", unit: str = "CAST(NULL AS STRING)") -> str:
    return f"""SELECT '{prefix}' || CAST({key} AS STRING) AS id, {source} AS source, {relation} AS relation, {target} AS target, {amount} AS amount, {unit} AS unit,
  CASE WHEN {key} % 7 = 0 THEN 'superseded' ELSE 'active' END AS assertion_status, CASE WHEN {key} % 4 = 0 THEN 'proposed' ELSE 'asserted' END AS assertion_type,
  CASE WHEN {key} % 13 = 0 THEN 'negative' ELSE 'positive' END AS polarity,
  CASE {key} % 5 WHEN 0 THEN 'unreviewed' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'canonical' WHEN 3 THEN 'rejected' ELSE 'canonical' END AS review,
  CASE WHEN {key} % 3 = 0 THEN 'llm' ELSE 'human' END AS asserted_by, CASE WHEN {key} % 2 = 0 THEN CAST(({key} % 100) AS DOUBLE) / 100 END AS confidence,
  CASE WHEN {key} % 6 = 0 THEN 'sampled' END AS confidence_basis, CASE WHEN {key} % 10 = 3 THEN 'out of scope' END AS reason,
  CASE WHEN {key} % 14 = 0 THEN '{prefix}' || CAST({key} + 1 AS STRING) END AS replaced_by
  FROM {table}"""


GRAPH = {
    "entities": "\nUNION ALL ".join([
        _entity("geo.r", "r_regionkey", "concept", "r_name", "geo", "'a region of the world'", "CAST(NULL AS STRING)", "region", "'region'"),
        _entity("geo.n", "n_nationkey", "concept", "n_name", "geo", "'a nation'", "CAST(NULL AS STRING)", "nation", "'nation'"),
        _entity("org.c", "c_custkey", "quantity", "c_name", "org", "'a customer of the ' || lower(c_mktsegment) || ' segment'", "c_mktsegment", "customer", "lower(c_mktsegment)"),
        _entity("org.s", "s_suppkey", "law", "s_name", "org", "'a supplier'", "CAST(NULL AS STRING)", "supplier", "'supplier'"),
        _entity("prod.p", "p_partkey", "unit", "p_name", "prod", "lower(p_type) || ' of ' || p_brand", "p_brand", "part", "lower(p_brand)"),
    ]),
    "pairs": "SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem",
    "connections": "\nUNION ALL ".join([
        _edge("e.n", "n_nationkey", "'geo.n' || CAST(n_nationkey AS STRING)", "'part_of'", "'geo.r' || CAST(n_regionkey AS STRING)", "nation"),
        _edge("e.c", "c_custkey", "'org.c' || CAST(c_custkey AS STRING)", "'part_of'", "'geo.n' || CAST(c_nationkey AS STRING)", "customer"),
        _edge("e.s", "s_suppkey", "'org.s' || CAST(s_suppkey AS STRING)", "'part_of'", "'geo.n' || CAST(s_nationkey AS STRING)", "supplier"),
        _edge("e.m", "p_partkey", "'prod.p' || CAST(p_partkey AS STRING)", "'mathematically_requires'", "'prod.p' || CAST(CAST(floor(p_partkey / 2.0) AS BIGINT) AS STRING)", "part WHERE p_partkey >= 6"),
        _edge("e.l", "p_partkey", "'prod.p' || CAST(p_partkey AS STRING)", "'logically_requires'", "'prod.p' || CAST(CAST(floor(p_partkey / 3.0) AS BIGINT) AS STRING)", "part WHERE p_partkey >= 6"),
        _edge("e.a", "(s * 1000003 + p)", "'org.s' || CAST(s AS STRING)", "CASE WHEN (s + p) % 11 = 0 THEN 'contradicts' WHEN (s + p) % 2 = 0 THEN 'applies_to' ELSE 'related_to' END", "'prod.p' || CAST(p AS STRING)", "pairs"),
        _edge("e.x", "p_partkey", "'prod.p' || CAST(p_partkey AS STRING)", "CASE p_partkey % 4 WHEN 0 THEN 'bridges' WHEN 1 THEN 'analogous_to' WHEN 2 THEN 'approximates' ELSE 'causes' END", "'geo.n' || CAST(p_partkey % 25 AS STRING)", "part WHERE p_partkey % 3 = 0"),
        _edge("e.v", "p_partkey", "'prod.p' || CAST(p_partkey AS STRING)", "'has_price'", "CAST(NULL AS STRING)", "part", "CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS STRING)", "'cent'"),
        _edge("e.w", "(p_partkey + 3)", "'prod.p' || CAST(p_partkey AS STRING)", "'has_price'", "CAST(NULL AS STRING)", "part WHERE p_partkey % 20 = 0", "CAST(p_size AS STRING)", "'cent'"),
    ]),
    "sources": """SELECT 'src.s' || CAST(s_suppkey AS STRING) AS id,
  CASE s_suppkey % 5 WHEN 0 THEN 'academic-paper' WHEN 1 THEN 'textbook' WHEN 2 THEN 'standard' WHEN 3 THEN 'dataset' ELSE 'web' END AS type, s_name AS title,
  CASE s_suppkey % 4 WHEN 0 THEN 'NIST' WHEN 1 THEN 'Old University Press' WHEN 2 THEN 'Industry Letters' ELSE 'Open House' END AS publisher,
  CAST(1995 + s_suppkey % 30 AS INT) AS year, CASE WHEN s_suppkey % 3 = 0 THEN 'https://example.org/' || CAST(s_suppkey AS STRING) END AS url,
  CASE WHEN s_suppkey % 11 = 0 THEN 'retracted' WHEN s_suppkey % 11 = 1 THEN 'corrected' WHEN s_suppkey % 11 = 2 THEN 'superseded' ELSE 'active' END AS lifecycle FROM supplier""",
    "evidence": """SELECT CASE WHEN p % 2 = 0 THEN 'e.v' ELSE 'e.m' END || CAST(p AS STRING) AS connection_id, 'src.s' || CAST(CASE WHEN s % 17 = 0 THEN s + 1000000 ELSE s END AS STRING) AS source_ref,
  CASE s % 4 WHEN 0 THEN 'experiment' WHEN 1 THEN 'textbook' WHEN 2 THEN 'observation' ELSE 'note' END AS type,
  CASE WHEN s % 5 = 0 THEN 'refutes' ELSE 'supports' END AS stance, CASE WHEN s % 2 = 0 THEN 'p. ' || CAST(p AS STRING) END AS locator FROM pairs WHERE p % 10 <> 7""",
    "claims": """SELECT 'claim.' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) AS claim_id, 'doc.' || CAST(l_orderkey AS STRING) AS document_id, 'src.s' || CAST(l_suppkey AS STRING) AS source_id,
  'prod.p' || CAST(l_partkey AS STRING) AS subject, 'unit_price' AS relation, 'discount_' || CAST(CAST(round(l_discount * 100) AS INT) AS STRING) AS object,
  CASE WHEN l_linenumber < 6 THEN CAST(CAST(round(l_extendedprice / l_quantity / 100) AS BIGINT) AS STRING) END AS value, 'usd' AS unit,
  'prod.p' || CAST(l_partkey AS STRING) || ' has a unit price' AS text_span FROM lineitem""",
    "promotions": """SELECT 'ord.' || CAST(l_orderkey AS STRING) AS id, CASE l_linenumber WHEN 1 THEN 'editor' WHEN 2 THEN 'domain_expert' ELSE 'board' END AS stage,
  'org.s' || CAST(l_suppkey % 10 AS STRING) AS actor, l_shipdate AS at, (l_orderkey % 19 = 0) AS waiver FROM lineitem WHERE l_linenumber <= 3""",
    "entity_versions": """SELECT 'user.' || CAST(user_id AS STRING) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN user_id % 3 = 0 THEN event_type ELSE 'steady' END AS name,
  'd' || CAST(user_id % 4 AS STRING) AS domain, CASE WHEN event_id % 9 = 0 THEN 'deprecated' ELSE 'draft' END AS status FROM events""",
    "connection_versions": """SELECT 'use.' || CAST(user_id AS STRING) AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, 'user.' || CAST(user_id AS STRING) AS source,
  'does' AS relation, CASE WHEN event_id % 10 = 0 THEN CAST(NULL AS STRING) WHEN user_id % 2 = 0 THEN event_type ELSE 'same' END AS target, CASE WHEN event_id % 8 = 0 THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN event_id % 50 = 0 THEN 'use.0' END AS replaced_by FROM events""",
    "agents": """SELECT 'org.s' || CAST(s_suppkey AS STRING) AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'machine' ELSE 'human' END AS class, CASE WHEN s_suppkey % 8 = 1 THEN 'retired' ELSE 'active' END AS status FROM supplier""",
    "external_ids": """SELECT 'prod.p' || CAST(p_partkey AS STRING) AS entity_id, 'brand' AS scheme, p_brand || '-' || CAST(p_size AS STRING) AS value FROM part
UNION ALL SELECT 'prod.p' || CAST(p_partkey AS STRING), 'sku', CASE WHEN p_partkey % 50 = 0 THEN 'bad sku' ELSE 'SKU' || CAST(p_partkey AS STRING) END FROM part
UNION ALL SELECT 'org.c' || CAST(c_custkey AS STRING), 'ledger', CAST(c_custkey AS STRING) FROM customer""",
}


def _block(kind: str, key: str, value: str, record: str, table: str, where: str) -> str:
    return f"SELECT {record} AS id, '{kind}' AS block, {key} AS key, {value} AS value FROM {table} WHERE {where}"


_C, _P, _S = ("'org.c' || CAST(c_custkey AS STRING)", "'prod.p' || CAST(p_partkey AS STRING)", "'org.s' || CAST({} AS STRING)")
GRAPH["blocks"] = "\nUNION ALL ".join([
    _block("extension", "CASE c_custkey % 5 WHEN 0 THEN 'segment' WHEN 1 THEN 'gradeLevel' WHEN 2 THEN 'balance' ELSE 'priority' END", "CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'high' ELSE CAST(c_custkey AS STRING) END", _C, "customer", "c_custkey % 4 = 0"),
    _block("historical", "'stated_by'", "p_name", _P, "part", "p_partkey % 20 = 1"),
    _block("historical", "'year'", "CASE WHEN p_partkey % 30 = 1 THEN 'about 1900' ELSE '1900' END", _P, "part", "p_partkey % 10 = 1"),
    _block("historical", "'motto'", "p_name", _P, "part", "p_partkey % 50 = 1"),
    _block("adopted_from", "'external_id'", "'X' || CAST(p_partkey AS STRING)", _P, "part", "p_partkey % 10 = 5"),
    _block("adopted_from", "'relation'", "CASE p_partkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'close' ELSE 'same' END", _P, "part", "p_partkey % 10 = 5"),
    _block("adopted_from", "'authority'", "'board'", _P, "part", "p_partkey % 20 = 5"),
    _block("debt", "'status'", "CASE c_custkey % 3 WHEN 0 THEN 'outstanding' WHEN 1 THEN 'cleared' ELSE 'deferred' END", _C, "customer", "c_custkey % 10 < 3"),
    _block("debt", "'cleared_by'", "'org.s1'", _C, "customer", "c_custkey % 10 < 3 AND c_custkey % 3 = 1"),
    _block("debt", "'cleared_at'", "'2026-01-01'", _C, "customer", "c_custkey % 20 < 3 AND c_custkey % 3 = 1"),
    _block("debt", "'deferred_by'", "'org.s2'", _C, "customer", "c_custkey % 10 < 3 AND c_custkey % 3 = 2"),
    _block("debt", "'deferred_until'", "'2027-01-01'", _C, "customer", "c_custkey % 20 < 3 AND c_custkey % 3 = 2"),
    _block("provenance", "'writer'", "CASE WHEN c_custkey % 30 = 10 THEN 'legacy:' ELSE '' END || " + _S.format("c_custkey % 12"), _C, "customer", "c_custkey % 10 < 2"),
    _block("provenance", "'reviewer'", _S.format("c_custkey % 7"), _C, "customer", "c_custkey % 20 = 0"),
    _block("edit", "'by'", _S.format("c_custkey % 5"), _C, "customer", "c_custkey % 30 = 1"),
    _block("governed_by", "'law'", "CASE WHEN p_partkey % 36 = 0 THEN 'prod.p1' WHEN p_partkey % 18 = 0 THEN 'prod.p' || CAST(p_partkey AS STRING) WHEN p_partkey % 12 = 0 THEN 'org.s999999999' ELSE 'org.s' || CAST(p_partkey % 10 AS STRING) END", _P, "part", "p_partkey % 6 = 0"),
    _block("context", "'domain'", "CASE c_custkey % 3 WHEN 0 THEN 'org' WHEN 1 THEN 'geo' ELSE 'moon' END", "'e.c' || CAST(c_custkey AS STRING)", "customer", "c_custkey % 8 = 0"),
    _block("context", "'scale'", "CASE WHEN c_custkey % 5 = 0 THEN 'cosmic' ELSE 'macro' END", "'e.c' || CAST(c_custkey AS STRING)", "customer", "c_custkey % 8 = 0"),
    _block("origin", "'ai_drafted'", "CASE c_custkey % 5 WHEN 0 THEN 'false' WHEN 1 THEN 'maybe' ELSE 'true' END", _C, "customer", "c_custkey % 12 < 3"),
    _block("origin", "'source_kind'", "CASE c_custkey % 4 WHEN 0 THEN 'paper' WHEN 1 THEN 'rumour' ELSE 'expert' END", _C, "customer", "c_custkey % 12 < 2"),
    _block("relationships", "'requires'", "'prod.p1'", _C, "customer", "c_custkey % 101 = 0"),
    _block("quantity", "'quantity_kind'", "CASE c_custkey % 7 WHEN 0 THEN 'odd' WHEN 1 THEN 'base' ELSE 'derived' END", _C, "customer", "c_custkey % 20 > 0"),
    _block("quantity", "'tensor_character'", "CASE c_custkey % 5 WHEN 0 THEN 'matrix' WHEN 1 THEN 'vector' WHEN 2 THEN 'tensor' ELSE 'scalar' END", _C, "customer", "c_custkey % 25 > 0"),
    _block("same_dimension", "'0'", "'org.c1'", _C, "customer", "c_custkey % 15 > 0"),
    _block("same_dimension", "'0'", "'prod.p1'", _P, "part", "p_partkey % 40 > 0"),
    _block("aliases", "'0'", "CASE c_custkey % 3 WHEN 0 THEN 'not an id' WHEN 1 THEN 'org.c' || CAST(c_custkey AS STRING) ELSE 'org.old' || CAST(c_custkey AS STRING) END", _C, "customer", "c_custkey % 16 = 5"),
    _block("file", "'path'", "CASE WHEN c_custkey % 31 = 0 THEN 'products' ELSE 'organisations' END || '/' || CASE WHEN c_custkey % 29 = 0 THEN 'c0' ELSE 'c' END || CAST(c_custkey AS STRING) || '.md'", _C, "customer", "c_custkey % 2 = 0"),
    _block("inference", "'rule'", "'transitive'", "'e.m' || CAST(p_partkey AS STRING)", "part", "p_partkey % 17 = 0 AND p_partkey % 3 > 0 OR p_partkey % 97 = 7"),
    _block("inference", "'path'", "CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE 'e.m1, e.m2' END", "'e.m' || CAST(p_partkey AS STRING)", "part", "p_partkey % 17 = 0 AND p_partkey % 5 > 0"),
])

#: The graph's records as a careless hand would leave them, for the rules to find: k is the number in the id.
_K = "CAST(regexp_extract(id, '([0-9]+)', 1) AS BIGINT)"
GRAPH["rough_entities"] = f"""SELECT CASE WHEN k % 41 = 0 THEN upper(id) ELSE id END AS id, CASE WHEN k % 37 = 0 THEN 'thing' ELSE type END AS type, CASE WHEN k % 83 = 0 THEN lower(subdomain) ELSE name END AS name,
  CASE WHEN k % 43 = 0 THEN 'misc' ELSE domain END AS domain, subdomain, CASE WHEN k % 47 = 0 THEN 'unknown' ELSE status END AS status, definition, CASE WHEN k % 13 = 0 THEN CAST(NULL AS STRING) ELSE symbol END AS symbol, unit, equation,
  CASE WHEN k % 29 = 2 THEN CAST(NULL AS STRING) WHEN k % 31 = 0 THEN id WHEN k % 89 = 0 THEN 'prod.p999999999' ELSE deprecated_by END AS deprecated_by, source_ref FROM (SELECT *, {_K} AS k FROM entities) e
UNION ALL SELECT id, type, name, domain, subdomain, status, definition, symbol, unit, equation, deprecated_by, source_ref FROM entities WHERE {_K} % 53 = 0"""
_EDGE = "asserted_by, confidence, confidence_basis, reason, replaced_by"
GRAPH["rough_connections"] = f"""SELECT id, source, CASE WHEN k % 59 = 0 THEN 'unheard_of' WHEN k % 61 = 0 THEN 'requires' WHEN k % 7 = 3 AND relation IN ('applies_to', 'related_to') THEN 'contradicts' ELSE relation END AS relation, CASE WHEN k % 71 = 0 THEN CAST(NULL AS STRING) ELSE target END AS target,
  CASE WHEN k % 71 = 1 THEN '1.5e' ELSE amount END AS amount, unit, assertion_status, CASE WHEN k % 17 = 0 THEN 'inferred' ELSE assertion_type END AS assertion_type, review, {_EDGE} FROM (SELECT *, {_K} AS k FROM connections) c
UNION ALL SELECT id || '0000000000', source, relation, target, amount, unit, 'active', assertion_type, CASE WHEN {_K} % 2 = 0 THEN 'canonical' ELSE review END, {_EDGE} FROM connections WHERE {_K} % 73 = 0
UNION ALL SELECT id || '1000000000', target, relation, source, amount, unit, 'active', assertion_type, review, {_EDGE} FROM connections WHERE relation = 'logically_requires' AND {_K} % 5 = 0 AND {_K} % 7 > 0
UNION ALL SELECT id || '2000000000', source, 'causes', target, amount, unit, 'active', assertion_type, review, {_EDGE} FROM connections WHERE relation IN ('applies_to', 'related_to') AND {_K} % 14 = 3"""

#: A registry of one relation a part, in pairs of inverses, some of them ill made; domain and range are comma-separated.
_R = "'rel' || CAST({} AS STRING)"
GRAPH["rough_relations"] = f"""SELECT {_R.format("k")} AS name, CASE WHEN k % 28 = 2 THEN 'rel999999999' WHEN k % 20 = 1 THEN {_R.format("k + 4")} WHEN k % 4 = 0 THEN {_R.format("k + 1")} WHEN k % 4 = 1 THEN {_R.format("k - 1")} END AS inverse,
  k % 6 = 0 AS symmetric, CASE WHEN k % 35 = 0 THEN 'gizmo' WHEN k % 4 = 0 THEN 'law,unit' WHEN k % 4 = 1 THEN 'quantity' ELSE 'concept' END AS domain,
  CASE WHEN k % 4 = 0 THEN 'quantity' WHEN k % 12 = 1 THEN 'law' WHEN k % 4 = 1 THEN 'unit,law' WHEN k % 51 = 2 THEN 'gadget' ELSE 'concept' END AS range FROM (SELECT p_partkey AS k FROM part) p"""
#: Claims of several relations, with units, numbers, texts, subjects and equations some of which fail.
GRAPH["rough_claims"] = """SELECT claim_id, document_id, source_id, CASE WHEN k % 11 = 0 THEN 'prod.p999999999' ELSE subject END AS subject, CASE WHEN k % 4 = 0 THEN relation WHEN k % 4 = 1 THEN 'depends_on' WHEN k % 4 = 2 THEN 'has_unit' ELSE 'causes' END AS relation, object,
  CASE WHEN k % 7 = 0 THEN 'about ' || value ELSE value END AS value, CASE WHEN k % 6 = 1 THEN 'usd for 100' WHEN k % 6 = 2 THEN 'm/s' WHEN k % 6 = 3 THEN CAST(NULL AS STRING) ELSE unit END AS unit,
  CASE WHEN k % 9 = 0 THEN 'short' WHEN k % 9 = 1 THEN 'a longer text which names nobody at all' ELSE text_span END AS text_span, CASE WHEN k % 5 = 0 THEN 'p = c * d' WHEN k % 5 = 1 THEN 'p c d' END AS equation,
  CASE WHEN k % 8 > 0 THEN 'm' || CAST(k % 3 AS STRING) END AS model_id, CASE WHEN k % 10 = 0 THEN ' ' ELSE '1.0' END AS pipeline_version, CASE WHEN k % 12 > 0 THEN 'verified' END AS verification_status
  FROM (SELECT *, CAST(split_part(claim_id, '.', 2) AS BIGINT) AS k FROM claims) c"""

#: Tables that each graph table is made of, besides the driver's.
_USES = {"connections": ["pairs"], "evidence": ["pairs"], "rough_entities": ["entities"], "rough_connections": ["pairs", "connections"], "rough_claims": ["claims"]}


def _registry_rows() -> str:
    q = lambda x: "CAST(NULL AS STRING)" if x is None else f"'{x}'"
    return "\nUNION ALL ".join(
        f"SELECT {q(n)} AS name, {q(f)} AS family, {q(i)} AS inverse, {str(t).lower()} AS transitive, {str(s).lower()} AS symmetric, '{','.join(d)}' AS domain, '{','.join(r)}' AS range_, {q(st)} AS status"
        for n, f, i, t, s, d, r, st in schema.REGISTRY
    )


def ctes(*names: str) -> str:
    """WITH clause that defines the graph tables named, for an engine that has the driver's tables."""
    sql = GRAPH | {"relations": _registry_rows()}
    order = []
    for n in names:
        order += [x for x in (*_USES.get(n, []), n) if x not in order]
    return "WITH " + ",\n".join(f"{n} AS ({sql[n]})" for n in order)


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(schema.REGISTRY, schema.RELATIONS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    import re

    sql = GRAPH[name]
    frames = {}
    for used in [*BASE, *_USES.get(name, [])]:
        pattern = rf"(?<=FROM ){used}\b"
        if re.search(pattern, sql):
            sql = re.sub(pattern, "{" + used + "}", sql)
            frames[used] = table(spark, sf_dir, used) if used in GRAPH else read(spark, sf_dir, used)
    return spark.sql(sql, **frames)


def knowledge(spark: SparkSession, sf_dir: str) -> KnowledgeSet:
    """Lazy: a table that an operator does not use is never read."""
    own = {n: table(spark, sf_dir, n) for n in GRAPH if n != "pairs" and not n.startswith("rough")}
    return KnowledgeSet(**own, relations=relations(spark))
