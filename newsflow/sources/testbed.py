"""News relations projected from the driver's tables, in Spark and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas by session and path, as a catalogue would have them: each footer is read once, not once for each use of a table.
_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores. Files with fewer row groups than there are cores (one of 15 MB, say) are dealt once, larger inputs stay as they are; for work that costs more than moving the rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


#: Rows of the larger table that one task of a join takes.
ROWS = 500_000


def joined(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left and right by key, where the larger table has so many rows: in more partitions than the session's if those would hold over ROWS each, so what a task sorts and groups doesn't grow with the table."""
    n = -(-rows // ROWS)
    if n > int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(n, key), right.repartition(n, key)
    return left.join(right, key)


def event_id(column: str):
    return F.col(column).cast("string").alias("event_id")


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        event_id("o_orderkey"), F.col("c_mktsegment").alias("channel"), F.col("o_orderkey").alias("message_id"), F.concat_ws(" ", "o_orderpriority", F.lit("order"), "c_name").alias("text"),
        F.col("o_orderdate").alias("message_date"), F.floor("o_totalprice").cast("long").alias("views"), (F.col("o_orderkey") % 7).alias("forwards"),
    )


def ner_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        event_id("l_orderkey"), F.col("p_brand").alias("entity_text"), F.when(F.col("l_linenumber") % 3 != 0, F.upper("p_brand")).alias("normalized_text"),
        F.split("p_type", " ")[0].alias("entity_type"), F.col("l_linenumber").alias("start_pos"), (F.col("l_quantity") / 50).alias("confidence"),
    )


def sentiment_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0")  # messages without a result exist
    first = F.substring("o_orderpriority", 1, 1)
    share = lambda n: F.when(F.col("o_orderkey") % 3 == 0, (F.col("o_orderkey") % n).cast("double") / 100)
    return o.select(
        event_id("o_orderkey"), F.when(first.isin("1", "2"), "positive").when(first == "3", "neutral").otherwise("negative").alias("sentiment_label"),
        ((F.col("o_orderkey") % 100).cast("double") / 100).alias("sentiment_score"), share(50).alias("positive_prob"), share(40).alias("negative_prob"),
    )


def cluster_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('run_a', '2024-01-01 00:00:00'), ('run_b', '2024-01-02 00:00:00') AS v(run_id, run_timestamp)")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    d = o.join(c, o.o_custkey == c.c_custkey).select(
        F.when(F.col("o_orderkey") % 2 == 0, "run_a").otherwise("run_b").alias("run_id"), (F.col("c_nationkey") - 1).alias("cluster_id"),
        event_id("o_orderkey"), ((F.col("o_orderkey") % 100).cast("double") / 100).alias("probability"),
    )
    return d.withColumn("public_cluster_id", F.concat_ws(":", "run_id", "cluster_id"))


CTES = {
    "raw_messages": """SELECT CAST(o_orderkey AS VARCHAR) AS event_id, c_mktsegment AS channel, o_orderkey AS message_id, concat_ws(' ', o_orderpriority, 'order', c_name) AS text,
        o_orderdate AS message_date, CAST(floor(o_totalprice) AS BIGINT) AS views, o_orderkey % 7 AS forwards FROM orders JOIN customer ON o_custkey = c_custkey""",
    "ner_results": """SELECT CAST(l_orderkey AS VARCHAR) AS event_id, p_brand AS entity_text, CASE WHEN l_linenumber % 3 <> 0 THEN upper(p_brand) END AS normalized_text,
        split_part(p_type, ' ', 1) AS entity_type, l_linenumber AS start_pos, l_quantity / 50 AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "sentiment_results": """SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'positive' WHEN o_orderpriority[1] = '3' THEN 'neutral' ELSE 'negative' END AS sentiment_label,
        CAST(o_orderkey % 100 AS DOUBLE) / 100 AS sentiment_score, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS DOUBLE) / 100 END AS positive_prob,
        CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 40 AS DOUBLE) / 100 END AS negative_prob FROM orders WHERE o_orderkey % 11 <> 0""",
    "cluster_runs": "SELECT * FROM (VALUES ('run_a', '2024-01-01 00:00:00'), ('run_b', '2024-01-02 00:00:00')) AS v(run_id, run_timestamp)",
    "assignments": """SELECT *, concat_ws(':', run_id, cluster_id) AS public_cluster_id FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'run_a' ELSE 'run_b' END AS run_id, c_nationkey - 1 AS cluster_id,
        CAST(o_orderkey AS VARCHAR) AS event_id, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS probability FROM orders JOIN customer ON o_custkey = c_custkey)""",
}
#: The signed sentiment in SQL.
SIGNED = """CASE WHEN positive_prob IS NOT NULL OR negative_prob IS NOT NULL THEN coalesce(positive_prob, 0) - coalesce(negative_prob, 0)
    WHEN lower(coalesce(sentiment_label, 'neutral')) = 'positive' THEN coalesce(sentiment_score, 0) WHEN lower(coalesce(sentiment_label, 'neutral')) = 'negative' THEN -coalesce(sentiment_score, 0) ELSE 0 END"""


def with_ctes(sql: str) -> str:
    """The query behind the CTEs that it names."""
    used = [name for name in CTES if name in sql]
    own = sql.replace("WITH RECURSIVE ", "WITH ", 1)
    head = "WITH RECURSIVE " if own != sql else "WITH "
    return head + ", ".join(f"{name} AS ({CTES[name]})" for name in used) + ("\n, " + own.removeprefix("WITH ") if own.startswith("WITH ") else "\n" + own) if used else sql
