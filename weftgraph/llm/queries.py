"""One query for each operator, over its whole table with production parameters; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bayes, chat, langid, packing, pieces, pii, pivots, rules, secret_scan, simhash, spelling, substring, topk
from weftgraph.runtime import read, ship


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    out = packing.pack(read(spark, sf_dir, "documents"), max_tokens=1024, sink=packing.with_checksums, schema=packing.CHECKSUMS)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.digest(simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return secret_scan.digest(secret_scan.secrets(read(spark, sf_dir, "documents")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    says = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.turns(own.unionByName(probe)))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return substring.summary(read(spark, sf_dir, "documents"), threshold=13)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pieces.encode(read(spark, sf_dir, "documents"), row=pieces.digest, fields=pieces.DIGEST_FIELDS)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return topk.exact_top_k(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bayes.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.identify(read(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return pivots.cluster(read(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_simhash, op3_secrets, op4_chat, op5_substring, op6_sentencepiece, op7_pii, op8_topk, op9_quality, op10_rules, op11_langid, op12_clusters, op13_spelling)}

ORACLE = {
    "op4_chat": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 3) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens, CAST(0 AS BIGINT) AS placeholders
FROM rows GROUP BY conv_id
""",
    "op5_substring": """
WITH docs AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs WHERE len(words) >= 13)
), least AS (
  SELECT w, min(doc_id) AS least FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN least USING (w) WHERE doc_id > least
), marks AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT docs.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE [p[1] FOR p IN list_zip(words, range(1, len(words) + 1)) IF NOT list_contains(gone, p[2])] END, ' ')) AS kept_sha256
FROM docs LEFT JOIN marks USING (doc_id)
""",
    "op8_topk": topk.ORACLE,
    "op12_clusters": pivots.oracle(),
    "op13_spelling": spelling.oracle(),
}
