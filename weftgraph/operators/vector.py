"""Vectors: chunks, hashes, placeholder vectors, cosine search, context and citations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import KnowledgeSet


def chunk_entities(kg: KnowledgeSet) -> DataFrame:
    label = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c)))
    return kg.entities.select("id", F.concat_ws("\n", label("Name", "name"), label("Type", "type"), label("Domain", "domain"), label("Definition", "definition"), label("Symbol", "symbol")).alias("content"))


def embedding_hash(chunks: DataFrame, model: str, content_hash: str) -> DataFrame:
    return chunks.select("id", F.substring(F.sha2(F.concat(F.col("content"), F.lit(f"|{model}|{content_hash}")), 256), 1, 16).alias("hash"))


def placeholder_embed(chunks: DataFrame, dims: int = 8) -> DataFrame:
    """A deterministic vector from the text's hash, labelled as a placeholder."""
    h = F.sha2("content", 256)
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(h, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("double") / 65535 * 2 - 1)
    return chunks.select("id", v.alias("vector"), F.lit(True).alias("placeholder"))


def embed_with(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]], name: str) -> DataFrame:
    """Vectors of a caller's model, in batches; a model that fails fails the job, no vector is made up."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "vector": list(model(pdf["content"].tolist())), "model": name})

    return chunks.select("id", "content").mapInPandas(run, "id string, vector array<double>, model string")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _plain(name: str) -> Column:
    """A vector without nulls as doubles; with nulls it has no cosine, and is empty."""
    return F.when(F.coalesce(F.exists(name, lambda x: x.isNull()), F.lit(True)), F.array().cast("array<double>")).otherwise(F.col(name).cast("array<double>")).alias(name)


def _local_best(k: int):
    """A block of queries against a block of vectors: what can be among the k best of the block after rounding.

    Sums go dimension by dimension, as cosine() adds. Of equal scores the k smallest ids stay; apart from those, what is
    under the k-th by more than rounding can close goes.
    """

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        vectors = vectors.sort_values("id", kind="stable")
        ids, sizes, wanted = vectors["id"].to_numpy(), vectors["vector"].map(len).to_numpy(), queries["query"].map(len).to_numpy()
        for size in np.unique(wanted):
            own = queries[wanted == size]
            q = np.array(own["query"].tolist(), dtype=np.float64).reshape(len(own), size)
            same = sizes == size
            v = np.array(vectors["vector"][same].tolist(), dtype=np.float64).reshape(int(same.sum()), size)
            dots, qq, vv = np.zeros((len(q), len(v))), np.zeros(len(q)), np.zeros(len(v))
            with np.errstate(all="ignore"):
                for d in range(size):
                    dots += np.multiply.outer(q[:, d], v[:, d])
                    qq += q[:, d] * q[:, d]
                    vv += v[:, d] * v[:, d]
                norm = np.multiply.outer(np.sqrt(qq), np.sqrt(vv))
                score = np.zeros((len(q), len(ids)))
                score[:, same] = np.where(norm == 0, 0.0, dots / norm)
            rank = np.where(np.isnan(score), 9.0, score)  # Spark sorts NaN above all numbers
            for i, name in enumerate(own["query_id"]):
                r = rank[i]
                at = np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k] - 2e-6) if len(r) > k else np.arange(len(r))
                at = at[np.argsort(-r[at], kind="stable")]
                run_start = np.flatnonzero(np.diff(r[at], prepend=np.inf))
                at = at[np.arange(len(at)) - np.repeat(run_start, np.diff(np.append(run_start, len(at)))) < k]
                out.append(pd.DataFrame({"query_id": name, "id": ids[at], "score": score[i, at]}))
        return pd.concat(out)

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048, query_block: int = 512) -> DataFrame:
    """vectors(id, vector), queries(query_id, query) -> (query_id, rank, id, score), ties to the smaller id.

    Any number of queries: each block of queries meets each block of vectors by key and keeps its own k best.
    """
    n, m = (max(1, -(-df.count() // size)) for df, size in ((vectors, block), (queries, query_block)))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = lambda name, count: F.pmod(F.xxhash64(name), F.lit(count)).cast("int")
    v = vectors.select("id", _plain("vector"), own("id", n).alias("vb")).withColumn("qb", every(m))
    q = queries.select("query_id", _plain("query"), own("query_id", m).alias("qb")).withColumn("vb", every(n))
    types = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}
    met = v.groupBy("qb", "vb").cogroup(q.groupBy("qb", "vb"))
    run = _local_best(k)
    j = met.applyInPandas(lambda a, b: run(a, b) if len(a) and len(b) else pd.DataFrame({"query_id": [], "id": [], "score": []}), f"query_id {types['query_id']}, id {types['id']}, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return j.withColumn("score", F.round("score", 6)).withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def retrieve(vectors: DataFrame, questions: DataFrame, kg: KnowledgeSet, embed: Callable[[list[str]], list[list[float]]], model: str, k: int = 5, domain: str | None = None) -> DataFrame:
    """vectors(id, model, vector), questions(query_id, text) -> (query_id, rank, id, score, name, model): the k entities nearest to each question.

    Questions are embedded by the caller's hook, in batches; no vector is made up for a model that is not there. Vectors are those of the model and of entities of
    the domain; if there are none, all are searched, and `model` tells whose vector was found.
    """
    own = vectors.where(F.col("model") == model)
    if domain is not None:
        own = own.join(kg.entities.where(F.col("domain") == domain).select("id"), "id", "left_semi")
    own = vectors if own.isEmpty() else own
    asked = embed_with(questions.select(F.col("query_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("content")), embed, model).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    found = vector_topk(own.select("id", "vector"), asked, k)
    return found.join(kg.entities.select("id", "name"), "id", "left").join(own.select("id", "model"), "id").select("query_id", "rank", "id", "score", "name", "model")


def rag_citations(hits: DataFrame, kg: KnowledgeSet) -> DataFrame:
    """hits(query_id, rank, id) -> (query_id, rank, entity_id, source_ref, link): a row a citation, empty where the entity has no source or the source no link."""
    e = kg.entities.select("id", F.coalesce("source_ref", F.lit("")).alias("source_ref"))
    s = kg.sources.select(F.col("id").alias("source_ref"), F.col("url").alias("link"))
    return hits.join(e, "id").join(s, "source_ref", "left").select("query_id", "rank", F.col("id").alias("entity_id"), "source_ref", F.coalesce("link", F.lit("")).alias("link"))


def embeddings_preview(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", F.size("vector").alias("dimensions"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


def rag_context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One context text for each query, hits in order of rank, and the ids it cites."""
    j = hits.join(chunks, "id").select("query_id", F.struct("rank", "id", "content").alias("h"))
    g = j.groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("h"))
    text = F.array_join(F.transform("h", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["id"], F.lit("\n"), x["content"])), "\n\n")
    return g.select("query_id", text.alias("context"), F.transform("h", lambda x: x["id"]).alias("citations"))


def citations_grounded(answers: DataFrame, hits: DataFrame, kg: KnowledgeSet) -> DataFrame:
    """answers(query_id, refused, cited array) -> grounded: every citation was retrieved and exists; a refusal cites nothing."""
    got = hits.groupBy("query_id").agg(F.collect_set("id").alias("got"))
    cited = answers.select("query_id", F.explode("cited").alias("id")).join(kg.entities.select("id"), "id", "left_anti").groupBy("query_id").agg(F.count("*").alias("unknown"))
    j = answers.join(got, "query_id", "left").join(cited, "query_id", "left")
    fine = (F.size(F.array_except("cited", F.coalesce("got", F.array().cast("array<string>")))) == 0) & F.col("unknown").isNull()
    return j.select("query_id", F.when(F.col("refused"), F.size("cited") == 0).otherwise(fine).alias("grounded"))
