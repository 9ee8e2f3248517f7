"""Record model. Nested records are kept as flat tables: one row per entity, connection, source, evidence item."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame

ENTITIES = "id string, type string, name string, domain string, subdomain string, status string, definition string, symbol string, unit string, equation string, deprecated_by string, aliases array<string>, source_ref string"
CONNECTIONS = (
    "id string, source string, relation string, target string, amount string, unit string, assertion_status string, assertion_type string, "
    "polarity string, review string, asserted_by string, confidence double, confidence_basis string, reason string, replaced_by string"
)
SOURCES = "id string, type string, title string, publisher string, year int, url string, lifecycle string"
EVIDENCE = "connection_id string, source_ref string, type string, stance string, locator string"
RELATIONS = "name string, family string, inverse string, transitive boolean, symmetric boolean, domain array<string>, range array<string>, status string"
CLAIMS = "claim_id string, document_id string, source_id string, subject string, relation string, object string, value string, unit string, text_span string"
PROMOTIONS = "id string, stage string, actor string, at timestamp, waiver boolean"
ENTITY_VERSIONS = "id string, seq long, name string, domain string, status string"
CONNECTION_VERSIONS = "id string, seq long, source string, relation string, target string, status string, replaced_by string"
AGENTS = "id string, class string, status string"
EXTERNAL_IDS = "entity_id string, scheme string, value string"

BLOCKS = "id string, block string, key string, value string"

#: Fixed values.
RETIRED = ["deprecated", "superseded"]

#: The four relations of a prerequisite.
PREREQUISITE_RELATIONS = ["mathematically_requires", "requires", "logically_requires", "depends_on"]

_ALL = ["concept", "quantity", "law", "equation", "model", "phenomenon", "unit", "experiment", "method"]

#: The relations that this library's own graphs use: name, family, inverse, transitive, symmetric, domain, range, status.
REGISTRY = [
    ("part_of", "structural", "has_part", True, False, _ALL, _ALL, "adopted"),
    ("has_part", "structural", "part_of", True, False, _ALL, _ALL, "reserved"),
    ("mathematically_requires", "dependency", "mathematically_required_by", True, False, _ALL, _ALL, "adopted"),
    ("mathematically_required_by", "dependency", "mathematically_requires", True, False, _ALL, _ALL, "reserved"),
    ("logically_requires", "dependency", None, True, False, _ALL, _ALL, "adopted"),
    ("requires", "dependency", None, True, False, ["concept", "quantity", "law", "equation", "model", "phenomenon"], ["concept", "quantity", "law", "equation", "model", "phenomenon"], "reserved"),
    ("depends_on", "dependency", None, True, False, ["quantity", "model"], ["quantity", "model"], "adopted"),
    ("applies_to", "applicability", None, False, False, ["law", "model"], ["unit", "concept"], "adopted"),
    ("derived_from", "derivation", None, True, False, _ALL, _ALL, "adopted"),
    ("has_price", "measurement", None, False, False, ["unit", "quantity"], [], "adopted"),
    ("related_to", "associative", None, False, True, _ALL, _ALL, "adopted"),
    ("analogous_to", "associative", None, False, True, _ALL, _ALL, "adopted"),
    ("approximates", "approximation", None, False, False, _ALL, _ALL, "adopted"),
    ("bridges", "cross_domain", None, False, True, _ALL, _ALL, "adopted"),
    ("contradicts", "conflict", None, False, True, _ALL, _ALL, "reserved"),
    ("causes", "causal", None, False, False, _ALL, _ALL, "adopted"),
]


@dataclass(frozen=True)
class KnowledgeSet:
    """A named bundle of DataFrames; those that a source lacks are None."""

    entities: DataFrame
    connections: DataFrame
    sources: DataFrame | None = None
    evidence: DataFrame | None = None
    relations: DataFrame | None = None
    claims: DataFrame | None = None
    promotions: DataFrame | None = None
    entity_versions: DataFrame | None = None
    connection_versions: DataFrame | None = None
    agents: DataFrame | None = None
    external_ids: DataFrame | None = None
    blocks: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> KnowledgeSet:
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}
