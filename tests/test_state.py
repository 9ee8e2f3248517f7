"""State of streams over restarts and batches; ledgers split over partitions."""

import random
from hashlib import sha256

from pyspark.sql import functions as F

from weftgraph.operators import history
from weftgraph.runtime import ship
from weftgraph.streaming import jobs


def feed(spark, path, rows, fields):
    spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(fields).parquet(path)


def test_conflicts_go_on_after_a_restart(spark, tmp_path):
    ship(spark)
    fields, path, home = "triple string, value string", str(tmp_path / "in"), str(tmp_path / "home")
    jobs.run(jobs.conflicts(feed(spark, path, [("a", "1"), ("a", "1"), ("b", "1"), ("b", None), ("c", "1"), ("c", "2")], fields)), home=home)
    out = jobs.run(jobs.conflicts(feed(spark, path, [("a", "1"), ("b", "2"), ("b", "3"), ("c", "2"), ("d", None)], fields)), home=home)
    assert sorted(map(tuple, out.collect())) == [("b", 3), ("c", 2)]


def test_the_first_claim_is_the_smallest_of_its_trigger(spark, tmp_path):
    ship(spark)
    fields, path, home = "signature string, claim_id long", str(tmp_path / "in"), str(tmp_path / "home")
    ids = list(range(3000))
    random.Random(1).shuffle(ids)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        jobs.run(jobs.repeated_claims(feed(spark, path, [("s", i) for i in ids], fields)), home=home)
        out = jobs.run(jobs.repeated_claims(feed(spark, path, [("s", -5), ("t", 9), ("t", 7)], fields)), home=home)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [tuple(r) for r in out.collect()]
    assert sorted(rows) == sorted([("s", i, 0) for i in range(1, 3000)] + [("s", -5, 0), ("t", 9, 7)])


def test_values_may_have_a_time_to_live(spark, tmp_path):
    ship(spark)
    out = jobs.run(jobs.conflicts(feed(spark, str(tmp_path / "in"), [("a", "1"), ("a", "2")], "triple string, value string"), live_ms=3_600_000), idle=False)
    assert [tuple(r) for r in out.collect()] == [("a", 2)]


def test_a_long_stream_is_split_and_verified_as_one(spark):
    rng, rows = random.Random(2), []
    for stream, n in (("a", 20), (None, 30), ("long", 400), ("z", 1), ("y", 50)):
        last = "0" * 64
        for i in range(n):
            own = sha256(f"{last}|{i}|t{i}".encode()).hexdigest()
            rows.append([stream, i, f"t{i}", last, own])
            last = own
    for r in rng.sample(rows, 60):
        r[rng.choice([2, 3, 4])] = rng.choice(["forged", None])
    for r in rows[100:220]:  # a run without a good hash, longer than a partition
        r[2] = "forged"
    want, last = {}, {}
    for stream, i, text, prev, own in rows:
        ok = own is not None and sha256("|".join(x for x in (prev, str(i), text) if x is not None).encode()).hexdigest() == own
        want[stream, i] = (ok, prev == last.get(stream, "0" * 64))
        if ok:
            last[stream] = own
    df = spark.createDataFrame([tuple(r) for r in rows], "s string, i long, t string, prev_hash string, hash string").repartition(3)
    for parts in (1, 4, 16):
        out = history.ledger_verify(df, "s", ["i"], ["i", "t"], parts)
        assert {(r.s, r.i): (r.hash_ok, r.link_ok) for r in out.collect()} == want
    spread = df.where("s = 'long'").repartitionByRange(16, "s", "i").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 8
