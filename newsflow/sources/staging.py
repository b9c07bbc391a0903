"""Bulk loads by way of a staging table (S10, S11, F21): typed extraction, then checks that stop the load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a staged assignment and their types; lists are kept as JSON text.
ASSIGNMENT = {
    "request_id": "string", "event_id": "string", "channel": "string", "message_id": "long", "run_id": "string", "cluster_id": "int", "public_cluster_id": "string", "cluster_probability": "double",
    "bucket_id": "string", "topic_label": "string", "topic_summary": "string", "topic_keywords": "string", "primary_entities": "string", "event_type": "string",
}


def staged_lines(spark: SparkSession, path: str, fields: dict[str, str] = ASSIGNMENT) -> DataFrame:
    """(S10) JSON lines -> the fields, each cast to its type and null if it can't be, the line itself and whether it is JSON. Absent lists of keywords and entities are empty ones."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    pick = lambda name, kind: F.get_json_object("line", f"$.{name}").try_cast(kind)
    columns = [F.coalesce(pick(n, k), F.lit("[]")).alias(n) if n in ("topic_keywords", "primary_entities") else pick(n, k).alias(n) for n, k in fields.items()]
    return lines.where(F.trim("line") != "").select("line", *columns, F.get_json_object("line", "$").isNotNull().alias("is_json"))


def staged_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(S11) CSV with a header into a typed table; rows that don't fit have nulls and the row in _broken."""
    return spark.read.schema(f"{schema}, _broken string").option("header", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").csv(path)


def violations(staged: DataFrame, known: DataFrame) -> DataFrame:
    """staged(event_id, channel, message_id, run_id, cluster_id, public_cluster_id, cluster_probability), known messages(event_id, channel, message_id) -> one row of counts: runs, invalid, orphans, duplicates."""
    odd = (F.col("public_cluster_id") != F.concat_ws(":", "run_id", "cluster_id")) | (F.col("cluster_id") < -1) | (F.col("cluster_probability") < 0) | (F.col("cluster_probability") > 1)
    whole = staged.agg(F.count_distinct("run_id").alias("runs"), F.count_if(F.coalesce(odd, F.lit(True))).alias("invalid"))
    orphans = staged.join(known.select("event_id", "channel", "message_id"), ["event_id", "channel", "message_id"], "left_anti").agg(F.count("*").alias("orphans"))
    again = staged.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    return whole.join(orphans).join(again)  # one row each


def checked(staged: DataFrame, known: DataFrame) -> DataFrame:
    """staged, if it is exactly one run without violations; else a ValueError says what is wrong. The checks are jobs of their own."""
    found = violations(staged, known).first().asDict()
    wrong = {k: v for k, v in found.items() if v != (1 if k == "runs" else 0)}
    if wrong:
        raise ValueError("the load is refused: " + ", ".join(f"{k} {v}" for k, v in sorted(wrong.items())))
    return staged
