"""A corpus pipeline: documents in, token ids out, each stage one of the operators.

Quality rules drop documents and failing lines, SimHash keeps one document of each group of
near-duplicates (five-word shingles, similarity 0.8 or more), decontamination drops
documents that hold a benchmark item, the secret scan replaces what it reports, and the last
stage encodes the texts and decodes them again.

Stages take and return the columns of documents, whatever others there are; only the last one
returns doc_id, n_tokens, ids and whether the ids decode to the text. An empty table passes
through. SQL can't express a fingerprint or an encoding, so there is no ORACLE_SQL; the tests
compare run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import byte_bpe, decontamination, quality_rules, secret_scans, simhash
from newsflow.llm.shared import drop_scratch, only, scratch_mark, scratch_table


def _replaced(docs: DataFrame, row: str, text: str) -> list:
    """The columns of docs from a struct of them, with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return [new.get(c, F.col(row)[c]).alias(c) for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality_rules.clean_lines(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    return only(judged, F.col("kept")).select(*_replaced(docs, "_row", "cleaned_text"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = [F.col("doc_id").isNull().alias("__newsflow_null"), F.coalesce("doc_id", F.lit(0)).alias("__newsflow_id"), F.xxhash64("text").alias("__newsflow_key")]
    found = decontamination.leaks(docs.select(*key, "text"), items, keep=("__newsflow_null", "__newsflow_id", "__newsflow_key")).select("__newsflow_null", "__newsflow_id", "__newsflow_key").distinct()
    return docs.select("*", *key).join(found, ["__newsflow_null", "__newsflow_id", "__newsflow_key"], "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = secret_scans.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else redacted


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_checked(docs, *byte_bpe.public_vocabulary())


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secret_scans", redact_secrets),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
        drop_scratch(mark, keep=1)  # what the stage has read and used on its way
    return STAGES[-1][1](spark, docs, sf_dir)
