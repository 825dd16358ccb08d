"""Documents to tokens in five stages, each written as Parquet and read again by the next.

STAGES holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, with the columns of documents except for the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidmark.llm import bpe, mixing, ngram_join, pii, quality
from braidmark.llm.store import discard, settle
from braidmark.session import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their host's verdict reject go. Extra columns stay as they are, whatever their names."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"))
    failed = settle(quality.failures(quality.measure(rows, "__row.text")), "quality")
    hosts = settle(quality.host_verdicts(failed, "__row.source"), "hosts")
    return quality.judge(failed, hosts, "__row.source").filter("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the least doc_id stays (one row of it); rows without a doc_id stay.

    Rows that repeat a doc_id with other texts are judged by their own text's group.
    """
    judged = settle(ngram_join.judged_rows(docs).select("doc_id", F.col("text_hash").alias("__h"), "is_first"), "judged")
    # thin rows: which texts stay, and which of those come in several equal rows
    first = settle(judged.filter("is_first AND doc_id IS NOT NULL").groupBy("doc_id", "__h").agg((F.count(F.lit(1)) > 1).alias("__again")), "first")
    given = docs.select("*", F.col("doc_id").alias("__id"), ngram_join.text_hash(F.col("text")).alias("__h"))
    kept = given.join(first.withColumnRenamed("doc_id", "__id"), ["__id", "__h"])
    once = kept.filter("NOT __again").unionByName(kept.filter("__again").dropDuplicates(["__id", "__h"]))
    return once.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars follows the new text."""
    masked = pii.mask_documents(docs, settle)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of lighter sources again until the weights are met. Extra columns stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"))
    return mixing.mix_sources(rows, doc_id="__row.doc_id", source="__row.source", text="__row.text").select("__row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, a row for each row."""
    return bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]

#: No SQL for byte pairs; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
