"""All rules together: as each alone, and a scan a table for all checks of single rows."""

from collections import Counter

from pyspark.sql import functions as F

from weftgraph.operators import quality, records, validation
from weftgraph.plans.testgraph import knowledge, table

SF = "/root/testdata/sf0.001"


def test_row_checks_scan_each_table_once(spark, tmp_path):
    kg = knowledge(spark, SF)
    kept = {}
    for name in ("entities", "connections", "sources", "evidence", "external_ids", "blocks"):
        kg.tables()[name].write.parquet(str(tmp_path / name))
        kept[name] = spark.read.parquet(str(tmp_path / name))
    out = quality.row_violations(kg.with_(**kept), quality.CHECKS)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") == len(kept) and "Join" not in plan and len(quality.CHECKS) > 40
    assert out.count() > 0


def test_together_as_alone(spark):
    kg = knowledge(spark, SF).with_(entities=table(spark, SF, "rough_entities"), connections=table(spark, SF, "rough_connections"))
    names = ["dq_required", "dq_enum", "dq_legacy_prefix", "dq_domain_range", "dq_reviewed_endpoints", "dq_provenance_shape", "dq_debt"]
    want = Counter()
    for n in names:
        want.update(map(tuple, quality.RULES[n](kg).collect()))
    assert Counter(map(tuple, validation.validate(kg, names).collect())) == want and {r[0] for r in want} == set(names)


def test_every_rule_takes_part():
    rules = set(quality.RULES)
    assert set(records.RECORD_RULES) <= rules and len(rules) == 34
    assert rules == {c.rule for c in quality.CHECKS} | set(quality.JOINED)


def test_each_canonical_connection_is_told_once(spark):
    """Two connections of one id, as keys beyond a million give, and two records of one end."""
    one = knowledge(spark, SF)
    e = one.entities.where("id in ('geo.n5', 'geo.n0')")
    c = one.connections.limit(1).withColumns({"review": F.lit("canonical"), "id": F.lit("e.a1"), "source": F.lit("geo.n5"), "target": F.lit("geo.n0")})
    kg = one.with_(entities=e.unionByName(e), connections=c.unionByName(c))
    assert Counter(r.focus for r in quality.RULES["dq_reviewed_endpoints"](kg).collect()) == Counter({"e.a1": 2})
