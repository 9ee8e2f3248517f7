import numpy as np

from weftgraph.catalog import QUERIES
from weftgraph.operators import vector
from weftgraph.runtime import read


def brute(rows, queries, k):
    out = set()
    for q, x in queries:
        scored = []
        for i, y in rows:
            s = 0.0
            if x and y and len(x) == len(y) and None not in x and None not in y:
                n = np.linalg.norm(x) * np.linalg.norm(y)
                s = float(np.dot(x, y) / n) if n else 0.0
            scored.append((-round(s, 6), i))
        out |= {(q, r + 1, i, -s + 0.0) for r, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def test_more_than_a_thousand_queries_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(1150)]
    rows += [(2000 + i, [1.0, 2.0, 3.0, 1.0]) for i in range(60)] + [(3000, None), (3001, []), (3002, [1.0, None, 1.0, 1.0]), (3003, [0.0] * 4), (3004, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    q = v.selectExpr("id as query_id", "vector as query")
    got = {(r.query_id, r["rank"], r.id, r.score + 0.0) for r in vector.vector_topk(v, q, 5, block=300, query_block=100).collect()}
    assert got == brute(rows, rows, 5)
    assert vector.vector_topk(v, q.limit(0)).count() == 0 == vector.vector_topk(v.limit(0), q.limit(3)).count()


def test_every_twentieth_row_is_a_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in read(spark, sf, "embeddings").collect()]
    got = {(r.query_id, r["rank"], r.id) for r in QUERIES["vector_topk_all"](spark, sf).collect()}
    want = {x[:3] for x in brute(rows, [r for r in rows if r[0] % 20 == 0], 10)}
    assert len(want) > 10 and got == want
