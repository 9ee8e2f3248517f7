"""Quality rules: each gives violations (rule, severity, focus, message). Checks of single rows are data, compiled into one scan a table; see validation.py."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.policy import active, retired
from weftgraph.operators import history, reports
from weftgraph.operators.graph import dangling_endpoints
from weftgraph.schema import KnowledgeSet

ENTITY_TYPES = ["concept", "quantity", "law", "equation", "model", "phenomenon", "unit", "experiment", "method"]
ENTITY_STATUSES = ["draft", "proposed", "ai_reviewed", "human_reviewed", "reviewed", "canonical", "deprecated", "superseded", "rejected"]
#: Kinds of source that the origin of a record may have.
SOURCE_KINDS = ["paper", "textbook", "standard", "dataset", "expert"]
SOURCE_TYPES = ["academic-paper", "textbook", "standard", "dataset", "web"]
#: Formats of external ids by scheme.
SCHEMES = {"sku": "^SKU[0-9]+$", "ledger": "^[0-9]+$", "brand": "^Brand#[0-9]+-[0-9]+$"}
DECIMAL = r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
ID = r"^[a-z]+\.[a-z]*[0-9]+$"

#: Domain and directory of ids by their prefix.
DOMAINS = {"geo": ("geo", "geography"), "org": ("org", "organisations"), "prod": ("prod", "products")}
#: What a quantity says about itself.
QUANTITY_KINDS, TENSORS = ["base", "derived"], ["scalar", "vector", "tensor"]

#: Different humans that a board stage needs, unless it is waived.
BOARD = 2

Rule = Callable[[KnowledgeSet], DataFrame]
#: Rules by name; each gives its violations alone.
RULES: dict[str, Rule] = {}
#: What rules need besides the row itself: joins and groups, by rule.
JOINED: dict[str, Rule] = {}


@dataclass(frozen=True)
class Check:
    """A constraint on single rows of a table: rows for which `test` holds break `rule`. Columns are made when the table is scanned."""

    rule: str
    table: str
    test: Callable[[], Column]
    message: Callable[[], Column]
    severity: str = "error"
    focus: str = "id"


CHECKS: list[Check] = []


def check(rule: str, table: str, test: Callable[[], Column], message: str | Callable[[], Column], severity: str = "error", focus: str = "id") -> None:
    CHECKS.append(Check(rule, table, test, message if callable(message) else lambda: F.lit(message), severity, focus))
    RULES.setdefault(rule, lambda kg: _of_rule(kg, rule))


def rule(f: Rule) -> Rule:
    """Registers what a rule needs joins for; its checks of single rows are added."""
    JOINED[f.__name__] = f
    RULES[f.__name__] = lambda kg: _of_rule(kg, f.__name__)
    return f


def row_violations(kg: KnowledgeSet, checks: list[Check]) -> DataFrame | None:
    """All violations of checks of single rows: one scan a table, whatever the number of checks, its violations in one array that is exploded once."""
    out, tables = None, kg.tables()
    for table in dict.fromkeys(c.table for c in checks):
        if table in tables:
            # a when() in each place: a row has as many as it breaks
            each = [F.when(c.test(), F.struct(F.lit(c.rule).alias("rule"), F.lit(c.severity).alias("severity"), F.col(c.focus).alias("focus"), c.message().alias("message"))) for c in checks if c.table == table]
            found = tables[table].select(F.explode(F.array_compact(F.array(*each))).alias("v")).select("v.*")
            out = found if out is None else out.unionByName(found)
    return out


def _of_rule(kg: KnowledgeSet, name: str) -> DataFrame:
    own = row_violations(kg, [c for c in CHECKS if c.rule == name])
    joined = JOINED[name](kg) if name in JOINED else None
    return joined if own is None else own if joined is None else own.unionByName(joined)


def _rows(df: DataFrame, name: str, message: Column | str, severity: str = "error", focus: str = "id") -> DataFrame:
    return df.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(focus).alias("focus"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def _required(rule: str, table: str, columns: list[str]) -> None:
    for c in columns:
        check(rule, table, lambda c=c: _blank(c), f"missing {c}")


_required("dq_required", "entities", ["type", "name", "domain", "status", "definition"])
_required("dq_required", "connections", ["source", "relation", "assertion_status", "review"])
_required("dq_required", "sources", ["type", "title", "url"])

for _table in ("entities", "connections", "sources"):
    check("dq_id_format", _table, lambda: ~F.col("id").rlike(ID), "id does not fit its pattern")

check("dq_enum", "entities", lambda: ~F.col("type").isin(ENTITY_TYPES), lambda: F.concat(F.lit("not in vocabulary: type "), "type"))
check("dq_enum", "entities", lambda: ~F.col("status").isin(ENTITY_STATUSES), lambda: F.concat(F.lit("not in vocabulary: status "), "status"))

check("dq_quantity_fields", "entities", lambda: (F.col("type") == "quantity") & _blank("symbol"), "quantity without symbol")


@rule
def dq_quantity_fields(kg):
    """Quantities say their kind and tensor character; they and units name others of their dimension (members of the blocks `quantity` and `same_dimension`)."""
    if kg.blocks is None:
        return None
    of = lambda k: F.max(F.when((F.col("block") == "quantity") & (F.col("key") == k), F.col("value"))).alias(k)
    said = kg.blocks.where("block in ('quantity', 'same_dimension')").groupBy("id").agg(of("quantity_kind"), of("tensor_character"), F.count_if((F.col("block") == "same_dimension") & F.col("value").isNotNull()).alias("alike"))
    e = kg.entities.where("type in ('quantity', 'unit')").select("id", "type").join(said, "id", "left")
    quantity, among = F.col("type") == "quantity", lambda c, known: F.coalesce(F.col(c).isin(known), F.lit(False))
    tests = [
        (quantity & ~among("quantity_kind", QUANTITY_KINDS), F.lit("quantity_kind is neither base nor derived")),
        (quantity & ~among("tensor_character", TENSORS), F.lit("tensor_character is not scalar, vector or tensor")),
        (F.coalesce("alike", F.lit(0)) == 0, F.concat("type", F.lit(" without others of its dimension"))),
    ]
    return _rows(e.select("id", F.explode(F.array_compact(F.array(*[F.when(t, m) for t, m in tests]))).alias("why")), "dq_quantity_fields", F.col("why"))



_origin = lambda key: (F.col("block") == "origin") & (F.col("key") == key)
check("dq_provenance_shape", "entities", lambda: F.col("status").isin("canonical", "human_reviewed") & _blank("source_ref"), "reviewed record without source", "warning")
check("dq_provenance_shape", "blocks", lambda: _origin("ai_drafted") & ~F.coalesce(F.col("value").isin("true", "false"), F.lit(False)), "ai_drafted is not true or false")
check("dq_provenance_shape", "blocks", lambda: _origin("source_kind") & ~F.col("value").isin(SOURCE_KINDS), lambda: F.concat(F.lit("source_kind "), F.col("value")))


@rule
def dq_provenance_shape(kg):
    """Reviewed records have a source; the origin says by true or false whether a machine drafted the record, and its kind of source is known; what no machine drafted has a source or a reviewer."""
    if kg.blocks is None:
        return None
    named = kg.entities.where(~_blank("source_ref")).select("id").unionByName(kg.blocks.where("block = 'provenance' and key = 'reviewer'").select("id"))
    alone = kg.blocks.where("block = 'origin' and key = 'ai_drafted' and value = 'false'").select("id").distinct().join(named, "id", "left_anti")
    return _rows(alone, "dq_provenance_shape", "neither source nor reviewer")


check("dq_retired_pointer", "entities", lambda: retired() & (_blank("deprecated_by") | (F.col("deprecated_by") == F.col("id"))), "retired record does not say what replaces it")
check("dq_retired_pointer", "entities", lambda: ~retired() & ~_blank("deprecated_by"), "live record says it is replaced")
check("dq_retired_pointer", "blocks", lambda: (F.col("block") == "aliases") & ~F.coalesce(F.col("value").rlike(ID), F.lit(False)), lambda: F.concat(F.lit("alias is no id: "), F.coalesce("value", F.lit("null"))))
check("dq_retired_pointer", "blocks", lambda: (F.col("block") == "aliases") & (F.col("value") == F.col("id")), "alias is its own id")


@rule
def dq_unique_ids(kg):
    ids = kg.entities.select("id").unionByName(kg.connections.select("id")).unionByName(kg.sources.select("id"))
    return _rows(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "dq_unique_ids", F.concat(F.col("n").cast("string"), F.lit(" records")))


_prefix, _slug = lambda: F.split_part("id", F.lit("."), F.lit(1)), lambda: F.regexp_replace("id", r"^[^.]*\.", "")
_by_prefix = lambda i: F.coalesce(*[F.when(_prefix() == p, F.lit(x[i])) for p, x in DOMAINS.items()])
_path = lambda: (F.col("block") == "file") & (F.col("key") == "path")
check("dq_domain_identity", "entities", lambda: _by_prefix(0).isNull(), lambda: F.concat(F.lit("unknown id prefix "), _prefix()))
check("dq_domain_identity", "entities", lambda: _by_prefix(0) != F.col("domain"), "id prefix and domain differ")
check("dq_domain_identity", "entities", lambda: ~F.col("domain").isin([d for d, _ in DOMAINS.values()]), lambda: F.concat(F.lit("not in vocabulary: domain "), "domain"))
# the block `file` has the path of a record in its tree
check("dq_domain_identity", "blocks", lambda: _path() & (F.split_part("value", F.lit("/"), F.lit(1)) != _by_prefix(1)), "file is not in the directory of its domain")
check("dq_id_format", "blocks", lambda: _path() & (F.regexp_extract("value", r"([^/]*?)(\.[a-z]+)?$", 1) != _slug()), "file name is not the slug")

_form = lambda: F.coalesce(*[F.when(F.col("scheme") == s, F.col("value").rlike(p)) for s, p in SCHEMES.items()], F.lit(False))
check("dq_external_ids", "external_ids", lambda: ~_form(), lambda: F.concat(F.col("scheme"), F.lit(" has a wrong format")), focus="entity_id")


@rule
def dq_external_ids(kg):
    twice = kg.external_ids.groupBy("scheme", "value").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id")).where("n > 1")
    return _rows(twice, "dq_external_ids", F.concat_ws(" ", F.lit("shared:"), "scheme", "value"), "warning", "entity_id")


check("dq_target_xor_value", "connections", lambda: F.col("target").isNull() == F.col("amount").isNull(), "exactly one of target and value is needed")
check("dq_target_xor_value", "connections", lambda: F.col("amount").isNotNull() & ~F.col("amount").rlike(DECIMAL), "amount is not a decimal")


@rule
def dq_relation_known(kg):
    known = F.broadcast(kg.relations.select(F.col("name").alias("relation")))
    return _rows(kg.connections.join(known, "relation", "left_anti"), "dq_relation_known", F.concat(F.lit("unknown relation "), F.col("relation")))


def with_ends(kg: KnowledgeSet) -> DataFrame:
    """Connections with the types of both ends, and whether they are there; a row for each pair of records that the ends name."""
    end = lambda p: kg.entities.select(F.col("id").alias(p), F.col("type").alias(f"{p}_type"), F.lit(True).alias(f"{p}_there"))
    return kg.connections.select("id", "source", "relation", "target").join(end("source"), "source", "left").join(end("target"), "target", "left")


@rule
def dq_domain_range(kg):
    reg = F.broadcast(kg.relations.select(F.col("name").alias("relation"), "domain", "range"))
    c = with_ends(kg).where("source_there").join(reg, "relation")
    bad = ((F.size("domain") > 0) & ~F.array_contains("domain", F.col("source_type"))) | ((F.size("range") > 0) & F.col("target_type").isNotNull() & ~F.array_contains("range", F.col("target_type")))
    return _rows(c.where(bad), "dq_domain_range", F.concat_ws(" ", F.lit("types do not fit"), "relation"))


@rule
def dq_reviewed_endpoints(kg):
    """A row for each connection, however many records have its id or those of its ends."""
    open_ = kg.entities.where(~F.col("status").isin("canonical", "human_reviewed")).select("id").distinct()
    end = lambda p: open_.select(F.col("id").alias(p), F.lit(True).alias(f"{p}_open"))
    c = kg.connections.where("review = 'canonical'").select("id", "source", "target").join(end("source"), "source", "left").join(end("target"), "target", "left")
    return _rows(c.where("source_open or target_open"), "dq_reviewed_endpoints", "canonical connection cites an entity that is not reviewed", "warning")


@rule
def dq_registry_coherence(kg):
    """Inverses are defined, mutual and mirror domain and range; symmetric relations have none; types are known."""
    a = kg.relations.select("name", "inverse", "symmetric", *[F.array_sort(F.coalesce(s, F.array().cast("array<string>"))).alias(s) for s in ("domain", "range")])
    b = a.select(F.col("name").alias("inverse"), F.col("name").alias("found"), F.col("inverse").alias("back"), F.col("domain").alias("back_domain"), F.col("range").alias("back_range"))
    j, other = a.join(b, "inverse", "left"), F.col("inverse").isNotNull()
    known = F.array(*[F.lit(t) for t in ENTITY_TYPES])
    tests = [
        (F.col("symmetric") & other, "symmetric relation with inverse"),
        (other & F.col("found").isNull(), "inverse is not defined"),
        (F.col("found").isNotNull() & ~F.col("back").eqNullSafe(F.col("name")), "inverse is not mutual"),
        (F.col("found").isNotNull() & (F.col("domain") != F.col("back_range")), "domain does not mirror the inverse"),
        (F.col("found").isNotNull() & (F.col("range") != F.col("back_domain")), "range does not mirror the inverse"),
        (F.size(F.array_except("domain", known)) > 0, "unknown type in domain"),
        (F.size(F.array_except("range", known)) > 0, "unknown type in range"),
    ]
    why = F.filter(F.array(*[F.when(t, F.lit(m)) for t, m in tests]), lambda x: x.isNotNull())
    return _rows(j.select("name", F.explode(why).alias("why")), "dq_registry_coherence", F.col("why"), focus="name")


check("dq_epistemics", "connections", lambda: F.col("confidence").isNull() != F.col("confidence_basis").isNull(), "confidence and its basis go together", "warning")
check("dq_epistemics", "connections", lambda: (F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence outside 0..1")


@rule
def dq_epistemics(kg):
    """Inferred connections name a rule and a path (members of the block `inference`), others have no such block; beside the checks of confidence."""
    if kg.blocks is None:
        return None
    has = lambda k: (F.count_if((F.col("key") == k) & (F.trim("value") != "")) > 0).alias(k)
    block = kg.blocks.where("block = 'inference'").groupBy("id").agg(has("rule"), has("path"))
    c = kg.connections.select("id", (F.coalesce("assertion_type", F.lit("")) == "inferred").alias("inferred")).join(block, "id", "left")
    why = F.when(F.col("inferred") & ~F.coalesce(F.col("rule") & F.col("path"), F.lit(False)), "inferred without rule and path").when(~F.col("inferred") & F.col("rule").isNotNull(), "inference of what is not inferred")
    return _rows(c.select("id", why.alias("why")).where("why is not null"), "dq_epistemics", F.col("why"))



check("dq_rejected_reason", "connections", lambda: (F.col("review") == "rejected") & _blank("reason"), "rejected without a written reason")


@rule
def dq_evidence(kg):
    gaps = kg.connections.where(active()).join(kg.evidence.select(F.col("connection_id").alias("id")), "id", "left_anti")
    severity = F.when(F.col("review") == "canonical", "error").otherwise("warning")
    return gaps.select(F.lit("dq_evidence").alias("rule"), severity.alias("severity"), F.col("id").alias("focus"), F.lit("no evidence").alias("message"))


@rule
def dq_contradiction(kg):
    """Pairs that are both contradicted and caused or required, in either direction."""
    pair = F.array_join(F.array_sort(F.array("source", "target")), "|")
    c = kg.connections.where("target is not null").select(pair.alias("pair"), "relation")
    g = c.groupBy("pair").agg(F.count_if(F.col("relation") == "contradicts").alias("n"), F.count_if(F.col("relation").isin("causes", "requires", "mathematically_requires", "logically_requires")).alias("m"))
    return _rows(g.where("n > 0 and m > 0"), "dq_contradiction", "contradicted and asserted", "warning", "pair")


@rule
def dq_agents(kg):
    """Every agent resolves; promotions and reviews are by humans, whoever drafted; retired agents promote nothing."""
    p = kg.promotions.select("id", F.col("actor").alias("agent"), F.lit("promoted").alias("role"))
    if kg.blocks is not None:
        said = kg.blocks.where("block = 'provenance'")
        p = p.unionByName(said.select("id", F.col("value").alias("agent"), F.when(F.col("key") == "reviewer", "reviewed").otherwise("written").alias("role")))
    a = F.col("class")
    j = p.distinct().join(kg.agents.select(F.col("id").alias("agent"), "class", "status"), "agent", "left")
    why = F.when(a.isNull(), "unknown agent").when((a != "human") & (F.col("role") != "written"), F.concat("role", F.lit(" by a machine"))).when((F.col("status") != "active") & (F.col("role") == "promoted"), "agent is retired")
    return _rows(j.withColumn("why", why).where("why is not null"), "dq_agents", F.concat_ws(" ", "why", "agent"))


@rule
def dq_promotion(kg):
    out = _rows(history.stage_gap_violations(kg, 1), "dq_promotion", F.concat_ws(" ", F.lit("too soon:"), "before", "stage"))
    human = kg.agents.where("class = 'human'").select(F.col("id").alias("actor"), F.lit(True).alias("human"))
    board = kg.promotions.where("stage = 'board'").join(human, "actor", "left").groupBy("id").agg(F.count_distinct(F.when(F.col("human"), F.col("actor"))).alias("n"), F.max("waiver").alias("waiver"))
    out = out.unionByName(_rows(board.where((F.col("n") < BOARD) & ~F.coalesce("waiver", F.lit(False))), "dq_promotion", F.concat(F.lit("humans on the board: "), F.col("n").cast("string"))))
    out = out.unionByName(_rows(history.stage_independence(kg), "dq_promotion", F.concat_ws(" ", F.lit("same actor at"), "stage")))
    return out.unionByName(_rows(history.stage_order(kg).where(~F.col("in_order")), "dq_promotion", F.concat_ws(" ", F.lit("chain is"), "stages"), "warning"))


@rule
def dq_pointers(kg):
    return _rows(dangling_endpoints(kg), "dq_pointers", F.concat_ws(" ", "kind", F.lit("points to"), "pointer"), focus="record")


#: The profile: relations it has, types of sources that need no link, form of links, types of evidence that need a place in their source.
PROFILE = {
    "relations": ["part_of", "mathematically_requires", "logically_requires", "has_price", "applies_to", "related_to", "causes"],
    "libraries": ["academic-paper", "textbook", "standard"], "link": "^https://[a-z0-9.-]+/", "placed": ["experiment", "textbook"],
}


# sources have a link of a known form or are kept in libraries; evidence has its place; relations are those of the profile
check("dq_profile", "sources", lambda: _blank("url") & ~F.col("type").isin(PROFILE["libraries"]), "source cannot be verified")
check("dq_profile", "sources", lambda: ~_blank("url") & ~F.col("url").rlike(PROFILE["link"]), "link has another form")
check("dq_profile", "connections", lambda: ~F.col("relation").isin(PROFILE["relations"]), lambda: F.concat(F.lit("not in the profile: "), F.col("relation")))
check("dq_profile", "evidence", lambda: F.col("type").isin(PROFILE["placed"]) & _blank("locator"), "evidence without a place", focus="connection_id")


#: Limits on the number of values of a property, by type: (type, property, least, most).
SHAPES = [("law", "edges", 1, None), ("unit", "symbol", 1, 1), ("quantity", "symbol", 1, 1), ("concept", "source_ref", 0, 1), ("unit", "definition", 1, 1)]


def shape_violations(kg: KnowledgeSet, shapes: list[tuple]) -> DataFrame:
    """(id, type, property, n) of each entity with fewer or more values than a shape lets it have."""
    edges = kg.connections.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("edges"))
    count = lambda c: F.when(_blank(c), 0).otherwise(1).cast("long")
    each = F.array(F.struct(F.lit("edges").alias("property"), F.coalesce("edges", F.lit(0)).alias("n")), *[F.struct(F.lit(c).alias("property"), count(c).alias("n")) for c in ("symbol", "source_ref", "definition")])
    v = kg.entities.join(edges, "id", "left").select("id", "type", F.explode(each).alias("x")).select("id", "type", "x.*")
    limits = F.broadcast(kg.entities.sparkSession.createDataFrame(shapes, "type string, property string, least long, most long"))
    return v.join(limits, ["type", "property"]).where("n < least or n > most").select("id", "type", "property", "n")


@rule
def dq_shape(kg):
    return _rows(shape_violations(kg, SHAPES), "dq_shape", F.concat_ws(" ", "type", F.lit("has"), F.col("n").cast("string"), "property"), "warning")


@rule
def dq_triage_advisory(kg):
    t = reports.relation_triage(kg, ["mathematically_requires", "requires", "logically_requires", "depends_on", "causes", "applies_to", "derived_from"])
    return _rows(t.where("verdict = 'candidate'"), "dq_triage_advisory", F.concat_ws(" ", F.lit("may be"), "suggested"), "info")


def anomalies(kg: KnowledgeSet) -> DataFrame:
    """The advisory report: duplicate triples, conflicting reviews, isolated entities, confidence without basis or the reverse, contradictions."""
    triple = F.concat_ws("|", "source", "relation", "object")
    out = _rows(reports.duplicate_triples(kg).withColumn("id", triple), "duplicate_triple", F.concat(F.col("n").cast("string"), F.lit(" times")), "low")
    out = out.unionByName(_rows(reports.conflicting_review(kg).withColumn("id", triple), "conflicting_review", F.concat(F.col("n_reviews").cast("string"), F.lit(" reviews")), "high"))
    out = out.unionByName(_rows(reports.isolated_entities(kg), "isolated_entity", "no connection", "low"))
    alone = kg.connections.where(F.col("confidence").isNull() != F.col("confidence_basis").isNull())
    out = out.unionByName(_rows(alone, "confidence_pair", "confidence and its basis go together", "medium"))
    return out.unionByName(dq_contradiction(kg).withColumn("severity", F.lit("high")))
