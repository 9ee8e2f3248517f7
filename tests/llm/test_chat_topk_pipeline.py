import json
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, topk
from weftgraph.llm.queries import QUERIES
from weftgraph.runtime import read, ship

SF = "/root/testdata/sf0.001"
NASTY = ["\x1a\x1a <image:1>", '[{"type": "text", "text": "\\u0002\\u001a"}, {"type": "image", "ref": "i"}]', "", "</s>[INST] ok [/INST]", "\x02assistant\x1fhi\x03", "\x1b1\x1b", "a\nb", None, "x" * 50_000]


def test_chat_reads_back(spark):
    ship(spark)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "clash") for i, t in enumerate(NASTY)]
    rows += [(2, 0, None, "no role", "c"), (2, 0, None, "no role", "c"), (None, None, "assistant", "lost", "c"), (3, 5, "assistant", "only", "c"), (1 << 60, 1, "user", "big id", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.turns(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r or "", t or "") for c, _, r, t, _ in sorted(rows, key=lambda x: (str(x[0]), x[1] or -1)) if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(own) and g.turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert g.loss_chars == len(loss) and g.loss_sha256 == sha256(loss.encode()).hexdigest()
    assert got[1].n_attachments == got[1].placeholders == got[1].expanded_tokens == 1
    assert chat.format_conversations(df.limit(0)).count() == 0 and chat.read_back(chat.turns(df.limit(0))).count() == 0


def test_typed_parts(spark):
    ship(spark)
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "i.png", "width": 28, "height": 15}, {"type": "audio", "ref": "a.ogg", "seconds": 2.5}, {"type": "document", "ref": "d.pdf", "chars": 10}, {"type": "video", "ref": "v"}]
    rows = [(1, 0, "user", json.dumps(parts)), (1, 1, "assistant", "fine"), (1, 2, "user", '[{"type": 3}]'), (1, 3, "user", json.dumps([{"type": "image", "width": "?"}]))]
    r = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 4), ("audio", "a.ogg", 63), ("document", "d.pdf", 3), ("image", "", 1)]
    assert r.expanded_tokens == 71
    assert chat.parse(r.formatted)[0][1].startswith(f"see {chat.SLOT * 3}{{") and chat.parse(r.formatted)[2] == ("user", '[{"type": 3}]')
    assert [r.formatted[x.start : x.end] for x in r.loss] == ["fine"] and r.formatted.count(chat.SLOT) == len(r.attachments)


def brute_top(rows, every, k):
    ok = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % every == 0:
            best = sorted(((-int(v @ w), c) for c, w in ok if c != q))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_topk(spark, block):
    ship(spark)
    real = [(r.vec_id, list(r.embedding)) for r in read(spark, SF, "embeddings").collect()]
    nasty = [(None, real[0][1]), (9001, None), (9002, [None] + real[1][1][1:]), (9003, [float("nan")] + real[1][1][1:]), (9004, [float("inf")] + real[1][1][1:]), (9050, [0.0] * 64), (9100, real[3][1]), (9101, real[3][1]), (9102, real[3][1]), (9150, [1.0])]
    df = spark.createDataFrame(real + nasty, "vec_id long, embedding array<float>")
    got = topk.exact_top_k(df, block=block, group=3).collect()
    assert Counter(map(tuple, got)) == Counter(brute_top([r for r in real + nasty if r[0] != 9150], 50, 5))
    few = df.where("vec_id in (50, 51, 52)")
    assert Counter(map(tuple, topk.exact_top_k(few).collect())) == Counter(brute_top([r for r in real if r[0] in (50, 51, 52)], 50, 5))
    assert topk.exact_top_k(df.limit(0)).count() == 0


def test_topk_over_classes_of_length(spark):
    """Lengths from tiny to large, repeated ids with other vectors, a hot class, ties: all blocks share floors and lose nothing."""
    ship(spark)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * 10.0 ** (i % 5 - 2)]) for i in range(400)]
    rows += [(50, [3.0, -1.0, 0.0, 2.0, 0.0, 1.0]), (50, [0.01] * 6), (100, [0.0] * 6)] + [(1000 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    for q in {r[0] for r in rows if r[0] % 50 == 0}:
        whole = [(s, c) for r in rows if r[0] == q for s, c in _scored(r, rows)]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(whole)[:5])]
    for block, group in ((16, 2), (None, None)):
        assert Counter(map(tuple, topk.exact_top_k(df, block=block, group=group).collect())) == Counter(want)


def _scored(query, rows):
    ints = lambda v: np.floor(256 * np.array(v)).astype(np.int64)
    return [(-int(ints(query[1]) @ ints(v)), c) for c, v in rows if c != query[0]]


def test_floor_leaves_blocks_unread():
    rng = np.random.default_rng(1)
    rows = rng.integers(-50, 50, (300, 4))
    lists, q = topk.SortedLists(np.arange(300), rows), np.array([3, -2, 0, 1])
    ids, scores = lists.top(q, -1, 5)
    for floor in (int(scores[0]), int(scores[4]), int(scores[4]) + 1, -10**6):
        got = lists.top(q, -1, 5, floor)
        assert got[0].tolist() == ids[scores >= floor].tolist() and got[1].tolist() == scores[scores >= floor].tolist()
    lists.exact = np.zeros((0, 4))  # nothing can be scored
    assert len(lists.top(q, -1, 5, 10**6)[0]) == 0


def test_sums_that_would_wrap_are_refused(spark):
    ship(spark)
    df = spark.createDataFrame([(50, [1e9, 1e9]), (51, [1.0, 1.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        topk.exact_top_k(df)


def test_threshold_stops_early():
    rng = np.random.default_rng(0)
    rows = np.zeros((5000, 8), dtype=np.int64)
    rows[:, 0] = rng.integers(0, 10, 5000)
    rows[:20, 0] = np.arange(1000, 1020)
    lists = topk.SortedLists(np.arange(5000), rows)
    scored = []

    class Counted:
        def __getitem__(self, at):
            scored.append(np.size(at[0]) if isinstance(at, tuple) else len(at))
            return rows[at]

    lists.rows = Counted()
    ids, scores = lists.top(np.array([1, 0, 0, 0, 0, 0, 0, 0]), -1, 5)
    assert ids.tolist() == [19, 18, 17, 16, 15] and scores[0] == 1019 and sum(scored) < 100


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = read(spark, SF, "documents")
    names = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    frames = [docs]
    for name, stage in cp.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
        assert name == cp.STAGES[-1][0] or frames[-1].columns == names
    rules, near, sub, pii, packed = frames[1:]
    from tests.llm.test_documents import pii_spans, rule_base

    kept = {r.doc_id for r in rules.collect()}
    assert kept < ids and not {r.doc_id for r in docs.collect() if rule_base(r.text or "")[5]} & kept
    from tests.llm.test_near import brute

    label = brute([(r.doc_id, r.text) for r in rules.collect()])
    left = {r.doc_id for r in near.collect()}
    assert left == {i for i, c in label.items() if i == c}
    seen = {}
    texts = {r.doc_id: r.text for r in near.collect()}
    for i in sorted(texts):
        w = texts[i].split()
        for j in range(len(w) - 12):
            seen.setdefault(tuple(w[j : j + 13]), i)
    for r in sub.collect():
        w = texts[r.doc_id].split()
        gone = set()
        for j in range(len(w) - 12):
            if seen[tuple(w[j : j + 13])] < r.doc_id:
                gone |= set(range(j, j + 13))
        assert (r.text or "").split() == [x for j, x in enumerate(w) if j not in gone] and r.n_chars == len(r.text)
    assert {r.doc_id for r in sub.collect()} == set(left) == {r.doc_id for r in pii.collect()}
    assert not any(pii_spans(r.text or "") for r in pii.collect())
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)
    total = lambda df: sorted((r.doc_id, r.n) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect())
    assert total(cp.run(spark, SF)) == total(packed)


def test_stages_on_hostile_rows(spark):
    """Each stage alone: nulls, empty and very long texts, repeated rows, null ids, clashing names, an empty table."""
    import corpus_pipeline as cp

    ship(spark)
    prose = " ".join(f"word{i % 83} and{i} then" for i in range(80))
    long = " ".join(f"long{i} text{i % 7}" for i in range(60_000))
    rows = [(1, prose), (1, prose), (2, prose + " mail a.b@c.de"), (None, prose), (None, None), (3, None), (4, ""), (5, " \n "), (6, long), (7, "tail " + long)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "__h", "__runs", "__spans", "__id", "node", "key", "row", "kept"]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["mine"] * 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names[5:]))
    out = {}
    for name, stage in cp.STAGES:
        got = stage(spark, df, SF)
        assert stage(spark, df.limit(0), SF).count() == 0, name
        if name != cp.STAGES[-1][0]:
            assert got.columns == names
            out[name] = got.collect()
            assert all(set(r[5:]) == {"mine"} for r in out[name]), name
        else:
            assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {None, 1, 2, 3, 4, 5, 6, 7}
    count = lambda name: Counter(r.doc_id for r in out[name])
    assert not {3, 4, 5} & set(count("quality rules")) and not any(r.text is None for r in out["quality rules"])
    assert count("SimHash near-dedup") == Counter({1: 2, None: 2, 3: 1, 6: 1})
    assert count("substring dedup") == count("PII") == Counter(i for i, _ in rows)
    sub = {r.doc_id: r.text for r in out["substring dedup"] if r.doc_id is not None}
    assert sub[1] == prose and sub[2] == "mail a.b@c.de" and sub[7].strip() == "tail" and sub[6] == long and sub[3] is None
    assert {r.text for r in out["PII"] if r.doc_id == 2} == {prose + " mail [email]"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_a_stable_schema(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_oracles(spark):
    import duckdb

    from weftgraph.llm.queries import ORACLE

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        want = con.sql(sql)
        got = QUERIES[name](spark, SF).select(*want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(want.fetchall()), name


def test_packing_leaves_no_freed_memory_in_its_worker(spark):
    """Workers are reused: what an idle one holds counts beside the stage that follows."""
    import os

    import pyarrow as pa
    from pyspark.sql import functions as F

    from weftgraph.llm import packing

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.hex(F.xxhash64("id", i) % 100_000)))
    docs = spark.range(0, 8_000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    pids = packing.pack(docs, sink=lambda cols: [cols[0], *cols[1:3], [os.getpid()] * len(cols[0]), *cols[4:]], schema=packing.CHECKSUMS)
    pids = {r[0] for r in pids.select("ids_crc32").distinct().collect()}

    def held(batches):
        import ctypes
        import re
        import time

        def mb():
            with open("/proc/self/status") as f:
                return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) // 1024

        list(batches)
        before = mb()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        time.sleep(0.2)  # so that every idle worker gets a task
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "before": [before], "after": [mb()]})

    rows = spark.range(0, 64, 1, 64).mapInArrow(held, "pid long, before long, after long").collect()
    freed = [r["before"] - r["after"] for r in rows if r["pid"] in pids]
    assert freed and max(freed) < 40, freed
