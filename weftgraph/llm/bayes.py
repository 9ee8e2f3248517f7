"""Quality classifier: hierarchical empirical Bayes over documents, sites and paths.

1. Evidence: for each target (bad quality; toxic), naive Bayes over hashed words, seen in a text or not, and the binned
   statistics of the text; the model is a table of a fixed number of buckets, counted by grouped aggregation over at
   most SAMPLE labelled documents (those whose id hashes lowest). So bounded, the labels go to the texts, not
   the texts to the labels. All else, sites included, covers all documents.
2. Sites: a document's evidence becomes a probability; hosts and paths sum it (partial aggregation). The global
   mean is the prior of hosts, a host's posterior mean is the prior of its paths; the strength of each prior (a Beta's
   size) is estimated by moments from the spread of children around their own parent's mean, so sparse sites shrink to what
   is above them, and paths of an unusual host are not taken for unusual paths.
3. A document's posterior odds are its own odds times those of the other documents of its path (shrunk to the host in the
   same way) against the global prior, tempered by SITE.

A document is kept if neither bad nor toxic is more likely than not, with MARGIN for doubt.

Cases: null and empty texts have no words and only the prior; very long texts count whole; a null host or path is a
site of its own; repeated rows each get a row and count as often; labels that are null or of unknown documents
are not used; without labels of both classes a target's evidence is nothing and all are kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.words import TO_LOWER_SPACE, Words, text_chunks, word_hashes
from weftgraph.runtime import cut

BITS = 16
SITE, MARGIN = 0.5, 0.6
#: Bound on the labelled rows that the model is fitted on.
SAMPLE = 50_000
TARGETS = ["bad", "toxic"]
_UPPER = bytes(range(65, 91))


def _features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each distinct word bucket; buckets beyond 2**BITS stand for binned statistics."""
    w = Words(texts, TO_LOWER_SPACE)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(texts)), n)
    pairs = [(doc << 20) | (word_hashes(w) >> np.uint64(64 - BITS)).astype(np.int64)]
    raw = np.array([sum(map((t or b"").count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!"))) for t in texts])
    upper = np.array([len(t or b"") - len((t or b"").translate(None, _UPPER)) for t in texts])
    size = np.array([len(t or b"") for t in texts])
    share = np.minimum(15, (20 * raw / np.maximum(n, 1)).astype(np.int64))
    long = np.minimum(15, (2 * size / np.maximum(n, 1)).astype(np.int64) // 2)
    capital = np.minimum(15, (20 * upper / np.maximum(size, 1)).astype(np.int64))
    at = np.arange(len(texts)) << 20
    pairs += [at | (1 << BITS | k << 4 | v) for k, v in enumerate((share, long, capital))]
    both = np.unique(np.concatenate(pairs))
    return both >> 20, both & 0xFFFFF


def _counted(labelled: DataFrame) -> DataFrame:
    """(bucket, documents, bad, toxic) over the labelled documents, combined in each task first."""

    def run(batches):
        total = np.zeros((3, (1 << BITS) + 64))
        for b in batches:
            bad, toxic = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            done = 0
            for ids, texts in text_chunks([b]):
                doc, bucket = _features(texts)
                np.add.at(total[0], bucket, 1)
                np.add.at(total[1], bucket, bad[done + doc])
                np.add.at(total[2], bucket, toxic[done + doc])
                done += len(ids)
                total[:, -1] += len(ids), bad[done - len(ids) : done].sum(), toxic[done - len(ids) : done].sum()
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(t[at]) for t in total]], names=["bucket", "n", "bad", "toxic"])

    counts = labelled.mapInArrow(run, "bucket long, n double, bad double, toxic double")
    return counts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])


class Model:
    """Log odds of each bucket; at most 2**BITS + 64 rows, whatever the corpus."""

    def __init__(self, rows):
        size = (1 << BITS) + 64
        n, pos = np.zeros(size), {t: np.zeros(size) for t in TARGETS}
        for r in rows:
            n[r["bucket"]] = r["n"]
            for t in TARGETS:
                pos[t][r["bucket"]] = r[t]
        self.weight, self.prior = {}, {}
        for t in TARGETS:
            p, q = pos[t], n - pos[t]
            ps, qs = p[-1], q[-1]
            ready = ps > 0 and qs > 0
            self.prior[t] = float(np.log((ps + 1) / (qs + 1))) if ready else -9.0
            w = np.log((p + 0.5) / (ps + 1)) - np.log((q + 0.5) / (qs + 1))
            # only buckets whose share differs beyond chance speak
            mean = (ps + 1) / (ps + qs + 2)
            z = (p - n * mean) / np.sqrt(np.maximum(n * mean * (1 - mean), 1e-9))
            self.weight[t] = np.where((np.abs(z) >= 4) & (n >= 5) & ready, w, 0.0)

    def score(self, texts) -> dict[str, np.ndarray]:
        doc, bucket = _features(texts)
        return {t: np.clip(self.prior[t] + np.bincount(doc, self.weight[t][bucket], len(texts)), -12, 12) for t in TARGETS}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", (1 - F.col("quality")).cast("double").alias("bad"), F.col("toxic").cast("double").alias("toxic"))
    known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id", "bad", "toxic").limit(sample))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known, "doc_id").select("doc_id", "text", *TARGETS)
    return Model(_counted(rows).collect())


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, bad, toxic): log odds of each document by itself."""

    def run(batches):
        for b in batches:
            done = 0
            for ids, texts in text_chunks([b]):
                odds = model.score(texts)
                cols = [b.column(0).slice(done, len(ids)), b.column(2).slice(done, len(ids)), b.column(3).slice(done, len(ids)), *[pa.array(odds[t]) for t in TARGETS]]
                done += len(ids)
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "host", "path", *TARGETS])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, bad double, toxic double")


def _share(odds: str) -> Column:
    return 1 / (1 + F.exp(-F.col(odds)))


def _strength(rows: DataFrame, target: str, mean: Column | float) -> float:
    """The size of the Beta prior that gives the spread of children around their parents' means, from weighted moments."""
    m = F.lit(mean) if isinstance(mean, float) else mean
    r = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col(target) / F.col("n") - m, 2)).alias("ss"), F.sum(m * (1 - m)).alias("noise"), F.sum(F.col("n") * m * (1 - m)).alias("within"), F.count("*").alias("k")).first()
    if not r["n"] or r["k"] < 2:
        return 10.0
    between, within = (r["ss"] - r["noise"]) / r["n"], r["within"] / r["n"]
    return float(min(max(within / max(between, 1e-6) - 1, 1.0), 1e4))


def posteriors(found: DataFrame) -> DataFrame:
    """found: evidence() -> each row with its host's and path's posterior and its own, for each target."""
    shares = {t: F.sum(_share(t)).alias(t) for t in TARGETS}
    paths = cut(found.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), *shares.values()))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS])
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    prior = {t: min(max((total[t] or 0.0) / (total["n"] or 1.0), 1e-4), 1 - 1e-4) for t in TARGETS}
    top = {t: _strength(hosts, t, prior[t]) for t in TARGETS}
    hosts = hosts.select(F.col("host").alias("__host"), *[((F.col(t) + top[t] * prior[t]) / (F.col("n") + top[t])).alias(f"host_{t}") for t in TARGETS])
    sites = cut(paths.join(hosts, F.col("host").eqNullSafe(F.col("__host"))))
    low = {t: _strength(sites, t, F.col(f"host_{t}")) for t in TARGETS}
    sums = [x for t in TARGETS for x in (F.col(t).alias(f"__sum_{t}"), F.col(f"host_{t}"), ((F.col(t) + low[t] * F.col(f"host_{t}")) / (F.col("n") + low[t])).alias(f"path_{t}"))]
    sites = sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("n").alias("__n"), *sums)
    out = found.join(sites, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")))
    odds = lambda c: F.log(c / (1 - c))
    for t in TARGETS:
        # what the other documents of the path say: the document's own share is taken out again
        others = (F.greatest(F.col(f"__sum_{t}") - _share(t), F.lit(0.0)) + low[t] * F.col(f"host_{t}")) / (F.col("__n") - 1 + low[t])
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(t) + SITE * (odds(others) - float(np.log(prior[t] / (1 - prior[t]))))))))
    return out


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """(doc_id, host, path, host_*, path_*, p_bad, p_toxic, kept) of each row."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    found = cut(evidence(docs, fit(docs, labels), host, path))
    out = posteriors(found)
    return out.select("doc_id", "host", "path", *[f"{a}_{t}" for a in ("host", "path", "p") for t in TARGETS], ((F.col("p_bad") < MARGIN) & (F.col("p_toxic") < MARGIN)).alias("kept"))
