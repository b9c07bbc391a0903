"""Topic and message reads over (messages, sentiment, mentions, assignments): the aggregations and joins of the read API."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.semantics import contains_text, entity_key, entity_text, label_or_neutral, mean, optional, signed_sentiment, truncated, within


@dataclass
class Relations:
    """The relations that the reads work on."""

    raw: DataFrame
    ner: DataFrame
    sentiment: DataFrame
    runs: DataFrame
    assignments: DataFrame


def latest_run(runs: DataFrame) -> DataFrame:
    """One row: the id of the latest run."""
    return runs.agg(F.max_by("run_id", "run_timestamp").alias("run_id"))


def of_latest_run(r: Relations) -> DataFrame:
    """Assignments of the latest run without noise (F05, F09). The right side is one row."""
    return r.assignments.where("cluster_id >= 0").join(F.broadcast(latest_run(r.runs)), "run_id", "left_semi")


def of_all_runs(r: Relations) -> DataFrame:
    """(T10) The topic of each message in the latest run that covered it; the current view then holds more than the last batch."""
    last = r.assignments.where("cluster_id >= 0").join(r.runs, "run_id")
    return last.groupBy("event_id").agg(F.max_by("public_cluster_id", F.struct("run_timestamp", "run_id")).alias("public_cluster_id"))


def clustered(r: Relations, start, end) -> DataFrame:
    """Messages of the window with their topic."""
    return of_latest_run(r).join(r.raw.where(within("message_date", start, end)), "event_id")


def cluster_overview(r: Relations, start, end) -> DataFrame:
    """(G01, J02) One row per topic."""
    d = clustered(r, start, end).join(r.sentiment, "event_id", "left").withColumn("signed", signed_sentiment())
    return d.groupBy("public_cluster_id").agg(*_stats())


def _stats() -> list[Column]:
    return [
        F.count("*").alias("message_count"), F.countDistinct("channel").alias("channel_count"), F.coalesce(mean(F.col("signed")), F.lit(0.0)).alias("avg_sentiment"),
        F.min("message_date").alias("first_seen"), F.max("message_date").alias("last_seen"),
    ]


def of_cluster(r: Relations, cluster: str, start, end) -> DataFrame:
    """Messages of one topic; noise is not excluded here."""
    return optional(r.assignments, "public_cluster_id", cluster).join(r.raw.where(within("message_date", start, end)), "event_id")


def cluster_stats(r: Relations, cluster: str, start, end) -> DataFrame:
    """(G02) One row, also for an empty topic."""
    return of_cluster(r, cluster, start, end).join(r.sentiment, "event_id", "left").withColumn("signed", signed_sentiment()).agg(*_stats())


def totals(r: Relations, start, end) -> DataFrame:
    """(G03)"""
    return r.raw.where(within("message_date", start, end)).agg(F.count("*").alias("total_messages"), F.countDistinct("channel").alias("active_channels"))


def mention_counts(mentions: DataFrame, *keys: str) -> DataFrame:
    """Mentions by keys, entity and type."""
    d = mentions.withColumn("entity_key", entity_key())
    return d.groupBy(*keys, "entity_key", "entity_type").agg(entity_text().alias("entity_text"), F.count("*").alias("mention_count"))


def entities_per_cluster(r: Relations, start, end) -> DataFrame:
    """(G04, J04)"""
    return mention_counts(clustered(r, start, end).join(r.ner, "event_id"), "public_cluster_id")


def distinct_entities(counts: DataFrame, most: int) -> DataFrame:
    """(W06, W07) Each entity once per topic although it may have several types, the first ``most`` of them."""
    w = Window.partitionBy("public_cluster_id", "entity_key").orderBy(F.desc("mention_count"), "entity_text", "entity_type")
    once = counts.withColumn("n", F.row_number().over(w)).where("n = 1")
    top = Window.partitionBy("public_cluster_id").orderBy(F.desc("mention_count"), "entity_text", "entity_type")
    return once.withColumn("place", F.row_number().over(top)).where(F.col("place") <= most).drop("n")


def channels_per_cluster(r: Relations, start, end) -> DataFrame:
    """(G05)"""
    return clustered(r, start, end).groupBy("public_cluster_id", "channel").agg(F.count("*").alias("message_count"))


def cluster_channels(r: Relations, cluster: str, start, end) -> DataFrame:
    return of_cluster(r, cluster, start, end).groupBy("channel").agg(F.count("*").alias("message_count"))


def top_entities(r: Relations, start, end, most: int = 50, entity_type: str | None = None, cluster: str | None = None) -> DataFrame:
    """(G06, J03) Mentions over topics and channels; messages without topic count as one more."""
    d = r.raw.where(within("message_date", start, end)).join(optional(r.ner, "entity_type", entity_type), "event_id").join(of_latest_run(r).select("event_id", "public_cluster_id"), "event_id", "left")
    d = optional(d, "public_cluster_id", cluster).withColumn("topic", F.coalesce("public_cluster_id", F.lit("unclustered")))
    # counted by spelling, topic and channel first, by hash and before the shuffle; both distinct counts and the extremes of texts then work on few rows
    per = d.groupBy("normalized_text", "entity_text", "entity_type", "topic", "channel").agg(F.count("*").alias("n")).withColumn("entity_key", entity_key())
    counts = per.groupBy("entity_key", "entity_type").agg(
        entity_text().alias("entity_text"), F.sum("n").alias("mention_count"), F.countDistinct("topic").alias("topic_count"), F.countDistinct("channel").alias("channel_count")
    )
    return counts.orderBy(F.desc("mention_count"), "entity_text", "entity_type").limit(most)


def cluster_entities(r: Relations, cluster: str, start, end, most: int = 10) -> DataFrame:
    """(G07, O02)"""
    return mention_counts(of_cluster(r, cluster, start, end).join(r.ner, "event_id")).orderBy(F.desc("mention_count"), "entity_text", "entity_type").limit(most)


def sentiment_breakdown(r: Relations, cluster: str, start, end) -> DataFrame:
    """(G08)"""
    d = of_cluster(r, cluster, start, end).join(r.sentiment, "event_id", "left")
    return d.groupBy(label_or_neutral().alias("sentiment_label")).agg(F.count("*").alias("message_count"))


def volume(r: Relations, cluster: str, start, end, unit: str = "hour") -> DataFrame:
    """(G09)"""
    return of_cluster(r, cluster, start, end).groupBy(truncated(unit, "message_date").alias("bucket")).agg(F.count("*").alias("message_count"))


def sentiment_dynamics(r: Relations, start, end, unit: str = "day", channel: str | None = None, cluster: str | None = None) -> DataFrame:
    """(G10) Counts by bucket and label, absent ones zero."""
    d = optional(r.raw.where(within("message_date", start, end)), "channel", channel).join(r.sentiment, "event_id", "left").join(of_latest_run(r).select("event_id", "public_cluster_id"), "event_id", "left")
    d = optional(d, "public_cluster_id", cluster)
    return d.withColumn("label", label_or_neutral()).groupBy(truncated(unit, "message_date").alias("bucket")).pivot("label", ["positive", "neutral", "negative"]).count().na.fill(0)


def related_clusters(r: Relations, cluster: str, most: int = 10) -> DataFrame:
    """(G11, J05, J06) Topics of the same run that mention the same entities, by multiplicity."""
    mine = r.assignments.where(F.col("public_cluster_id") == cluster)
    keys = mine.join(r.ner, "event_id").select(entity_key().alias("entity_key")).distinct()
    others = r.assignments.where(F.col("public_cluster_id") != cluster).join(mine.select("run_id").distinct(), "run_id", "left_semi")
    hits = others.join(r.ner.withColumn("entity_key", entity_key()), "event_id").join(keys, "entity_key", "left_semi")
    counts = hits.groupBy("public_cluster_id").agg(F.count("*").alias("overlap"))
    top = counts.orderBy(F.desc("overlap"), "public_cluster_id").limit(most)
    return top.withColumn("similarity", F.least(F.lit(0.99), F.lit(0.35) + F.lit(0.08) * F.col("overlap")))


def sparkline(r: Relations, start, end, n: int = 12) -> DataFrame:
    """(G21) Counts per topic in n equal parts of the window, zeros included; an empty window is all zeros."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    a, b = seconds(F.lit(start).cast("timestamp_ntz")), seconds(F.lit(end).cast("timestamp_ntz"))
    d = clustered(r, start, end).withColumn("slot", F.when(b > a, F.least(F.greatest(F.floor((seconds(F.col("message_date")) - a) * n / (b - a)), F.lit(0)), F.lit(n - 1))))
    counts = d.where("slot is not null").groupBy("public_cluster_id", "slot").agg(F.count("*").alias("c"))
    lists = counts.groupBy("public_cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "c"))).alias("m"))
    return lists.select("public_cluster_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0))).alias("sparkline"))


def kpis(r: Relations, start, end, previous_start, recent) -> DataFrame:
    """(G22) Totals, change against the previous window, new topics and the mean of topic means. All sides have one row."""

    def of(a, b, name: str) -> DataFrame:
        return totals(r, a, b).select(F.col("total_messages").alias(f"{name}_messages"), F.col("active_channels").alias(f"{name}_channels"))

    topics = cluster_overview(r, start, end).agg(
        F.count("*").alias("topics"), F.count_if(F.col("first_seen") >= F.lit(recent).cast("timestamp_ntz")).alias("new_topics"), F.coalesce(mean(F.col("avg_sentiment")), F.lit(0.0)).alias("avg_sentiment")
    )
    one = of(start, end, "now").join(of(previous_start, start, "before")).join(topics)
    change = F.when(F.col("before_messages") == 0, F.when(F.col("now_messages") == 0, 0.0).otherwise(100.0)).otherwise((F.col("now_messages") - F.col("before_messages")) * 100 / F.col("before_messages"))
    return one.withColumn("message_change", change)


def messages(r: Relations, start, end, channel: str | None = None, cluster: str | None = None, search: str | None = None, label: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(F01-F03, J03, O01, O03) A page of messages, newest first."""
    d = optional(r.raw.where(within("message_date", start, end)), "channel", channel)
    d = d if search is None else d.where(contains_text("text", search))
    d = d.join(of_latest_run(r).select("event_id", "public_cluster_id"), "event_id", "left").join(r.sentiment, "event_id", "left")
    d = optional(d, "public_cluster_id", cluster).withColumns({"label": label_or_neutral(), "ui_sentiment_score": signed_sentiment()})
    d = optional(d, "label", label).orderBy(F.desc("message_date"), F.desc("event_id")).offset(offset).limit(limit)
    return d.select(
        "event_id", "channel", "message_id", "text", "message_date", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("forwards", F.lit(0)).alias("forwards"), "public_cluster_id",
        F.col("label").alias("sentiment_label"), F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment_confidence"), "ui_sentiment_score",
    )


def page_of(limit: Column, offset: Column, most: int = 200, default: int = 50) -> Column:
    """page for columns of text: struct of limit and offset."""
    number = lambda c, otherwise: F.coalesce(F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("int")), F.lit(otherwise))
    return F.struct(F.least(F.lit(most), F.greatest(F.lit(1), number(limit, default))).alias("limit"), F.greatest(F.lit(0), number(offset, 0)).alias("offset"))


def page(limit, offset, most: int = 200, default: int = 50) -> tuple[int, int]:
    """Limit and offset from user input."""

    def number(value, otherwise: int) -> int:
        try:
            return int(value)
        except (TypeError, ValueError):
            return otherwise

    return min(most, max(1, number(limit, default))), max(0, number(offset, 0))


def _since(now, days: int) -> Column:
    return F.col("message_date") >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))


def mentioned_lately(r: Relations, now, days: int = 7, most: int = 20) -> DataFrame:
    """(G30) The entities that most messages of the last days mention, with the mean sentiment of these messages."""
    pairs = r.ner.select("event_id", F.col("entity_type").alias("type"), entity_key().alias("name")).distinct()
    d = pairs.join(r.raw.where(_since(now, days)).select("event_id"), "event_id").join(r.sentiment, "event_id", "left")
    counts = d.groupBy("type", "name").agg(F.count("*").alias("mention_count"), mean(signed_sentiment()).alias("avg_sentiment"))
    return counts.orderBy(F.desc("mention_count"), "type", "name").limit(most)


def daily_sentiment(r: Relations, now, channel: str, days: int = 30) -> DataFrame:
    """(G30) Mean sentiment and messages of a channel by day."""
    d = r.raw.where(_since(now, days) & (F.col("channel") == channel)).join(r.sentiment, "event_id", "left")
    return d.groupBy(F.col("message_date").cast("date").alias("day")).agg(mean(signed_sentiment()).alias("avg_sentiment"), F.count("*").alias("message_count"))


def found_together(r: Relations, now, types: tuple[str, ...] = ("ORG", "PERSON", "GPE"), days: int = 7, least: int = 5, most: int = 100) -> DataFrame:
    """(G30) Pairs of entities of these types that several messages of the last days have both; pairs are made inside of a message."""
    e = r.ner.where(F.col("entity_type").isin(*types)).select("event_id", entity_key().alias("name"), F.col("entity_type").alias("type")).distinct()
    e = e.join(r.raw.where(_since(now, days)).select("event_id"), "event_id", "left_semi")
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.event_id") == F.col("b.event_id")) & (F.struct("a.name", "a.type") < F.struct("b.name", "b.type")))
    n = pairs.groupBy(F.col("a.name").alias("entity1"), F.col("b.name").alias("entity2"), F.col("a.type").alias("type1"), F.col("b.type").alias("type2")).agg(F.count("*").alias("together"))
    return n.where(F.col("together") >= least).orderBy(F.desc("together"), "entity1", "entity2", "type1", "type2").limit(most)
