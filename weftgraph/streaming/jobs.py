"""Checks of append-only logs as Structured Streaming jobs.

Each takes a streaming DataFrame and gives one; run() drives any of them to the end of what there is and leaves
the result as a table in the checkpoint folder, with state and offsets kept there too, so that a restart goes on.

Checks with state of their own are stateful processors over RocksDB: a value that was seen is one state entry, not part of a growing array, and
entries may be given a time to live.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from weftgraph.runtime import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, a file a trigger at most where there are several."""
    kinds = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(kinds).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def run(stream: DataFrame, mode: str = "append", home: str | None = None, idle: bool = True) -> DataFrame:
    """The result so far, as a table. home: a shared folder for state, offsets and result; with that of an earlier run the job goes on from where it ended.

    idle: triggers without data, which watermarks may need. Jobs whose entries live for a time ask for one after another, without end, so they need idle=False.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    home = home or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    out, settings = f"{home}/out", {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        writer = stream.writeStream.option("checkpointLocation", f"{home}/state").outputMode(mode).trigger(availableNow=True)
        if mode == "append":
            q = writer.format("parquet").option("path", out).start()
        else:
            q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(out)).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(out)


def audit_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and type."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_claims(claims: DataFrame, late: str = "1 day") -> DataFrame:
    """Claims without the repeats of a signature within the watermark."""
    return claims.withWatermark("ts", late).dropDuplicatesWithinWatermark(["signature"])


def _processed(rows: DataFrame, key: str, processor: StatefulProcessor, fields: str, live_ms: int | None) -> DataFrame:
    """Entries live by processing time, if they do not live for ever."""
    return rows.groupBy(key).transformWithStateInPandas(processor, fields, "append", "none" if live_ms is None else "processingTime")


class _Repeats(StatefulProcessor):
    def __init__(self, live_ms: int | None):
        self.live_ms = live_ms

    def init(self, handle):
        self.first = handle.getValueState("first", "id long", self.live_ms)

    def handleInputRows(self, key, rows, timerValues):
        if not self.first.exists():
            # which is the first is known when all rows of the trigger are; until then their ids are held
            ids = sorted(x for pdf in rows for x in pdf["claim_id"])
            self.first.update((ids[0],))
            frames = [ids[1:]]
        else:
            frames = (pdf["claim_id"] for pdf in rows)
        first = self.first.get()[0]
        for ids in frames:
            yield pd.DataFrame({"signature": [key[0]] * len(ids), "claim_id": list(ids), "first_id": [first] * len(ids)}).astype({"claim_id": "int64", "first_id": "int64"})


def repeated_claims(claims: DataFrame, live_ms: int | None = None) -> DataFrame:
    """claims(signature, claim_id) -> each claim whose signature was seen before, with the first that had it: the smallest id of the first trigger with any."""
    return _processed(claims, "signature", _Repeats(live_ms), "signature string, claim_id long, first_id long", live_ms)


class _Distinct(StatefulProcessor):
    def __init__(self, live_ms: int | None):
        self.live_ms = live_ms

    def init(self, handle):
        self.seen = handle.getMapState("seen", "value string", "times long", self.live_ms)
        self.number = handle.getValueState("number", "n long")

    def handleInputRows(self, key, rows, timerValues):
        before = now = self.number.get()[0] if self.number.exists() else 0
        for pdf in rows:
            for value, times in pdf["value"].value_counts().items():  # without nulls
                old = self.seen.getValue((value,)) if self.seen.containsKey((value,)) else None
                now += old is None
                self.seen.updateValue((value,), ((old[0] if old else 0) + int(times),))
        if self.live_ms is not None and now > before:  # values may have gone by themselves
            now = sum(1 for _ in self.seen.keys())
        self.number.update((now,))
        if now > max(before, 1):
            yield pd.DataFrame({"triple": [key[0]], "n_values": [now]})


def conflicts(claims: DataFrame, live_ms: int | None = None) -> DataFrame:
    """claims(triple, value) -> a row each time a triple has got a further distinct value: (triple, n_values)."""
    return _processed(claims, "triple", _Distinct(live_ms), "triple string, n_values long", live_ms)


class _Chain(StatefulProcessor):
    def init(self, handle):
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows, timerValues):
        from hashlib import sha256

        last = self.last.get()[0] if self.last.exists() else "0" * 64
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            good = sha256(f"{r.prev_hash}|{r.body}".encode()).hexdigest() == r.hash
            out.append((key[0], r.seq, good, r.prev_hash == last))
            last = r.hash if good else last
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["stream", "seq", "hash_ok", "link_ok"])


def ledger_verify(entries: DataFrame) -> DataFrame:
    """entries(stream, seq, prev_hash, hash, body) -> (stream, seq, hash_ok, link_ok); a bad entry does not move the link on.

    Entries of a stream have to arrive in order of seq from trigger to trigger; within one they are put in order.
    """
    return _processed(entries, "stream", _Chain(), "stream string, seq long, hash_ok boolean, link_ok boolean", None)


def human_edits(audit: DataFrame, agents: DataFrame) -> DataFrame:
    """Events of registered active humans: a stream joined with a table."""
    people = agents.where("class = 'human' and status = 'active'").select(F.col("id").alias("agent"))
    return audit.join(people, "agent", "left_semi")
