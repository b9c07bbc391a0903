"""Message events (S01-S16): where they come from, their envelope, its rules and the normal form of a message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = (
    "message_id long, channel string, channel_id long, text string, date timestamp, views long, forwards long, reactions map<string,long>, media struct<type:string>,"
    " reply_to_message_id long, forward_from_channel string, forward_from_channel_id long, forward_from_message_id long, forward_origin_type string, permalink string, grouped_id long, status string"
)
ENVELOPE = f"event_id string, event_type string, event_timestamp string, event_version string, source_system string, trace_id string, payload struct<{PAYLOAD}>, _broken string"
#: Forms of the version and of an UUID, and the event types.
VERSION, UUID = r"^v\d+\.\d+\.\d+$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
TYPES = ("raw_message", "persisted", "preprocessed", "sentiment_enriched", "ner_enriched", "topic_assignment", "graph_update")
FIELDS = ("event_id", "event_type", "event_timestamp", "event_version", "source_system", "trace_id", "payload")


def kafka(spark: SparkSession, servers: str, topics: str, per_trigger: int = 10_000, stream: bool = True) -> DataFrame:
    """(S01, S02) One or several topics from the earliest offset; the checkpoint keeps what a consumer group would."""
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger)}).load().select(F.col("key").cast("string"), F.col("value").cast("string"))


def files(spark: SparkSession, path: str, kind: str = "parquet", schema: str | T.StructType | None = None, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(S05, S07, S10, S11) Parquet, CSV or JSON lines with projection and an optional cap."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.option("header", "true").csv(path) if kind == "csv" else reader.format(kind).load(path)
    df = df.select(*columns) if columns else df
    return df if most is None else df.limit(most)


def decode(raw: DataFrame) -> DataFrame:
    """(S03, S04, T05) raw(key, value) -> the envelope, its errors (at most five) and the reason for which it can't go on."""
    d = raw.withColumn("e", F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    d = d.withColumn("_extra", F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), F.array(*map(F.lit, FIELDS))))
    missing = lambda c, name: F.when(c.isNull(), F.lit(f"{name} is missing"))
    bad = lambda test, text: F.when(~F.coalesce(test, F.lit(True)), F.lit(text))
    rules = [
        *(missing(F.col(f"e.{name}"), name) for name in FIELDS), missing(F.col("e.payload.message_id"), "message_id"), missing(F.col("e.payload.channel"), "channel"),
        bad(F.col("e.payload.message_id") >= 1, "message_id is less than 1"), bad(F.col("e.event_version").rlike(VERSION), "event_version has another form"), bad(F.col("e.trace_id").rlike(UUID), "trace_id is no UUID"),
        bad(F.try_to_timestamp("e.event_timestamp").isNotNull() | F.col("e.event_timestamp").isNull(), "event_timestamp is no time"), bad(F.size("_extra") == 0, "unknown fields"),
    ]
    errors = F.slice(F.filter(F.array(*rules), lambda x: x.isNotNull()), 1, 5)
    own = F.concat_ws(":", "e.payload.channel", "e.payload.message_id")
    reason = (
        F.when(F.col("value").isNull() | F.col("e._broken").isNotNull() | F.col("e").isNull(), "invalid_json").when(F.size("errors") > 0, "invalid_schema").when(~F.col("e.event_type").isin(*TYPES), "unknown_event_type")
        .when(F.col("e.event_id") != own, "invalid_event_id").when(F.col("key").isNull(), "missing_key").when(F.col("key") != F.col("e.event_id"), "invalid_key")
        .when((F.col("e.event_type") == "persisted") & (F.col("e.payload.status") == "error"), "persisted_error")
    )
    return d.withColumn("errors", errors).withColumn("reason", reason).drop("_extra")


def _only(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), evaluated where it stands: pushed below the projections, the filter would parse the JSON again for each field that its rules read. What a generator makes is not pushed."""
    one = F.explode_outer(F.when(condition, F.array(F.lit(1)))).alias("_one")
    return df.select("*", one).where("_one is not null").drop("_one")


def valid(decoded: DataFrame) -> DataFrame:
    """Messages in the form of raw_messages."""
    p = lambda c: F.col(f"e.payload.{c}")
    return _only(decoded, F.col("reason").isNull()).select(
        "e.event_id", F.col("e.event_type"), F.try_to_timestamp("e.event_timestamp").alias("event_timestamp"), "e.trace_id", p("channel").alias("channel"), p("message_id").alias("message_id"), p("text").alias("text"),
        p("date").alias("message_date"), F.coalesce(p("views"), F.lit(0)).alias("views"), F.coalesce(p("forwards"), F.lit(0)).alias("forwards"), media_type(p("media.type")).alias("media_type"),
        p("channel_id").alias("channel_id"), p("reply_to_message_id").alias("reply_to_message_id"), p("forward_from_channel_id").alias("forward_from_channel_id"), p("forward_from_message_id").alias("forward_from_message_id"),
        (p("forward_from_channel_id").isNotNull() | p("forward_from_channel").isNotNull()).alias("is_forwarded"),
    )


def rejected(decoded: DataFrame) -> DataFrame:
    """(K14) What goes to the dead letters, with the original value."""
    return _only(decoded, F.col("reason").isNotNull()).select(F.coalesce("key", F.lit("unknown:0")).alias("key"), "value", "reason", F.array_join("errors", "; ").alias("errors"))


def media_type(kind: Column) -> Column:
    """(S14)"""
    low = F.lower(kind)
    out = F.when(kind.isNull(), None)
    for name in ("photo", "video", "audio", "voice", "sticker", "poll", "webpage", "document"):
        out = out.when(low.contains(name), name)
    return out.otherwise("other")


def days(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """(S08, S09) Half-open range."""
    return df.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def high_water(df: DataFrame) -> DataFrame:
    """(S12)"""
    return df.groupBy("channel").agg(F.max("message_id").alias("last_id"))


def targets(static: DataFrame, registry: DataFrame) -> DataFrame:
    """(S15) Both lists by name without case, the static entry first."""
    both = static.select("name", F.lit(0).alias("rank")).unionByName(registry.select("name", F.lit(1).alias("rank")))
    return both.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("rank", "name")).alias("name")).select("name")


def source_error(message: Column) -> Column:
    """(S16) struct(reason, retry_after, permanent) of an error text."""
    low = F.lower(message)
    reason = F.when(low.contains("flood"), "flood_wait").when(low.rlike("not found|no user|invalid username"), "not_found").when(low.contains("private"), "private").otherwise("inaccessible")
    wait = F.try_to_number(F.nullif(F.regexp_extract(low, r"(\d+)\s*s", 1), F.lit("")), F.lit("999999")).cast("int")
    return F.struct(reason.alias("reason"), F.when(reason == "flood_wait", wait).alias("retry_after"), reason.isin("not_found", "private").alias("permanent"))
