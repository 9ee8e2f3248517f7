"""Lineage through a ledger, the evidence gate, and rules on nested members."""

from collections import Counter

from weftgraph import schema
from weftgraph.operators import history, match, quality

from .test_library import frame


def test_lineage_is_followed_to_the_end(spark):
    rows = [(1, "canonical_admitted", "a", ["c1", "c2", None], None, None), (2, "candidate_created", "c1", None, ["e1"], None), (3, "candidate_created", "c2", None, [], ["s1"]), (4, "evidence_extracted", "e1", None, ["e2"], None),
            (5, "evidence_extracted", "e2", ["c1"], ["e1"], ["s1", "s1"]), (6, "source_registered", "s1", None, None, None), (7, "canonical_admitted", "b", None, None, ["s1", "nowhere"]), (8, "source_registered", "c1", None, None, None),
            (9, "canonical_admitted", "lone", None, None, None), (10, "source_registered", "s1", None, None, None)]
    e = spark.createDataFrame(rows, "seq long, event_type string, ref string, candidate_refs array<string>, evidence_refs array<string>, source_refs array<string>")
    got = Counter((r.asked, r.seq) for r in history.ledger_lineage(e).collect())
    assert got == Counter([("a", n) for n in (1, 2, 3, 4, 5, 6, 10)] + [("b", n) for n in (7, 6, 10)] + [("lone", 9)])
    assert history.ledger_lineage(e.limit(0)).count() == 0


def test_gate_names_each_missing_field(spark):
    c = spark.createDataFrame([("1", "s", "d", "t", "m", "1", "yes"), ("2", None, None, " ", "m", "", "yes")], "claim_id string, source_id string, document_id string, text_span string, model_id string, pipeline_version string, verification_status string")
    assert sorted(map(tuple, match.evidence_gate(c).collect())) == [("2", f) for f in ("document_hash", "pipeline_version", "source_id", "text_span")]
    assert Counter(r.field for r in match.evidence_gate(c.drop("model_id")).collect())["model_id"] == 2


def test_rules_on_members_of_blocks(spark):
    entities = frame(spark, [{"id": f"org.c{i}", "type": t, "domain": d} for i, t, d in ((1, "quantity", "org"), (2, "quantity", "org"), (3, "unit", "org"), (4, "law", "geo"), (5, "unit", "moon"))] + [{"id": "moon.c6", "type": "law", "domain": "moon"}], schema.ENTITIES)
    blocks = [("org.c1", "quantity", "quantity_kind", "base"), ("org.c1", "quantity", "tensor_character", "scalar"), ("org.c1", "same_dimension", "0", "org.c2"), ("org.c2", "quantity", "quantity_kind", "odd"), ("org.c3", "same_dimension", "0", None),
              ("org.c1", "aliases", "0", "org.c1"), ("org.c1", "aliases", "1", "org.d7"), ("org.c2", "aliases", "0", None), ("org.c1", "file", "path", "organisations/c1.md"), ("org.c2", "file", "path", "products/x/c3.md"),
              ("e.1", "inference", "rule", "r"), ("e.1", "inference", "path", "p"), ("e.2", "inference", "rule", "r"), ("e.3", "inference", "rule", "r")]
    edges = [{"id": f"e.{i}", "assertion_type": t} for i, t in ((1, "inferred"), (2, "inferred"), (3, "asserted"), (4, None), (5, "inferred"))]
    kg = schema.KnowledgeSet(entities, frame(spark, edges, schema.CONNECTIONS), sources=frame(spark, [], schema.SOURCES), blocks=spark.createDataFrame(blocks, schema.BLOCKS))
    of = lambda name: sorted((r.focus, r.message) for r in quality.RULES[name](kg).collect())
    assert [x for x in of("dq_quantity_fields") if "symbol" not in x[1]] == [("org.c2", "quantity without others of its dimension"), ("org.c2", "quantity_kind is neither base nor derived"), ("org.c2", "tensor_character is not scalar, vector or tensor"),
                                                                             ("org.c3", "unit without others of its dimension"), ("org.c5", "unit without others of its dimension")]
    assert of("dq_retired_pointer") == [("org.c1", "alias is its own id"), ("org.c2", "alias is no id: null")]
    assert of("dq_id_format") == [("org.c2", "file name is not the slug")]
    assert of("dq_domain_identity") == [("moon.c6", "not in vocabulary: domain moon"), ("moon.c6", "unknown id prefix moon"), ("org.c2", "file is not in the directory of its domain"), ("org.c4", "id prefix and domain differ"),
                                        ("org.c5", "id prefix and domain differ"), ("org.c5", "not in vocabulary: domain moon")]
    assert of("dq_epistemics") == [("e.2", "inferred without rule and path"), ("e.3", "inference of what is not inferred"), ("e.5", "inferred without rule and path")]
