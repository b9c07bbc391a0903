"""Writers (K01-K05, K14) for batches and for the batches of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_kafka(df: DataFrame, servers: str, topic: str, key: str = "event_id") -> None:
    """(K01) Keyed, acknowledged by all replicas."""
    out = df.select(F.col(key).alias("key"), F.to_json(F.struct("*")).alias("value"))
    out.write.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}).save()


#: Times in texts keep their microseconds.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def to_json_lines(df: DataFrame, path: str) -> None:
    """(K02) Replaces what is there."""
    df.write.mode("overwrite").options(**TIMES).json(path)


def to_csv(df: DataFrame, path: str) -> None:
    """(K03) Adds to what is there."""
    df.write.mode("append").options(header="true", **TIMES).csv(path)


def to_parquet(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    """(K05, K10) Replaces the partitions that the rows belong to."""
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
