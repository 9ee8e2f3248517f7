"""A corpus pipeline of five stages, each a whole pass of one operator over what the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.

Cases, alike for all stages: an empty table gives no rows; null and empty texts are rejected by the rules, and by later
stages alone are kept as they are (near-dedup takes them for copies of each other, packing gives their end token);
very long texts are taken whole; rows with a null doc_id are judged, redacted and packed, but are neither copies
nor repeats of anything; equal rows of one doc_id share a verdict and all stay, or all go; ties go to the smaller
doc_id; further columns, whatever their names, are kept by all but the last stage, which ignores them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import near, packing, pii, rules, substring
from weftgraph.runtime import cut, read, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go (with them null and empty texts); others stay as they are."""
    return rules.clean(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a Jaccard of 0.8 of five-word shingles stays, the one with the smallest doc_id."""
    ship(spark)
    return near.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeats of 13 words and more are cut out of all documents but the one with the smallest doc_id; no row goes."""
    ship(spark)
    return substring.removal(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; no row goes."""
    return pii.redaction(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens; every row's ids lie in them once."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("PII", pii_redaction), ("packing", pack_sequences)]

#: Learned rules and a tokenizer cannot be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
