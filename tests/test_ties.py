"""Promotions at one time: the one recorded first counts, as in the SQL of the queries."""

import datetime as dt

from weftgraph import schema
from weftgraph.operators import curate, history, quality, validation
from weftgraph.plans.testgraph import knowledge

DAY = dt.datetime(2026, 1, 1)
#: x has an actor at both stages by the first of two rows, y by the second alone
ROWS = [
    ("x", "editor", "p", DAY, False), ("x", "domain_expert", "p", DAY, False), ("x", "domain_expert", "q", DAY, False),
    ("y", "editor", "q", DAY, False), ("y", "domain_expert", "p", DAY, False), ("y", "domain_expert", "q", DAY, False),
]


def graph(spark):
    return knowledge(spark, "/root/testdata/sf0.001").with_(promotions=spark.createDataFrame(ROWS, schema.PROMOTIONS).coalesce(1))


def test_stage_independence(spark):
    assert [tuple(r) for r in history.stage_independence(graph(spark)).collect()] == [("x", "domain_expert", "p")]


def test_promote_batch(spark):
    kg = graph(spark).with_(promotions=spark.createDataFrame([r for r in ROWS if r[1] == "domain_expert"], schema.PROMOTIONS).coalesce(1))
    asked = spark.createDataFrame([("x", "q", DAY + dt.timedelta(2)), ("y", "p", DAY + dt.timedelta(2))], "id string, actor string, at timestamp")
    assert sorted((r.id, r.verdict) for r in curate.promote_batch(kg, asked).collect()) == [("x", "ok"), ("y", "same actor")]


def test_dq_promotion(spark):
    assert [r.focus for r in quality.RULES["dq_promotion"](graph(spark)).where("message like 'same actor%'").collect()] == ["x"]


#: an actor at both stages of z by the second of two rows alone, so nothing is wrong there but its chain and times
ONE = [("z", "editor", "q", DAY, False), ("z", "domain_expert", "p", DAY + dt.timedelta(9), False), ("z", "domain_expert", "q", DAY + dt.timedelta(9), False)]


def one(spark):
    return graph(spark).with_(promotions=spark.createDataFrame(ONE, schema.PROMOTIONS).coalesce(1))


def test_validate(spark):
    errors = validation.conforms(one(spark), only=["dq_promotion"]).first().errors
    assert errors == quality.RULES["dq_promotion"](one(spark)).where("severity = 'error' and message not like 'same actor%'").count()


def test_severity_counts(spark):
    n = {r.severity: r.n for r in validation.severity_counts(one(spark), only=["dq_promotion"]).collect()}
    assert n.get("error", 0) == quality.RULES["dq_promotion"](one(spark)).where("severity = 'error' and message not like 'same actor%'").count() and n["warning"] == 1
