"""What readers see of topics: lists with labels, one topic in full, first sources with their chain, both graphs.

A resolution is the source of a topic of one kind, exact or inferred; links are as
``first_source.propagation_links`` gives them; messages carry public_cluster_id, event_id,
channel, message_id, message_date and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.functions.semantics import shown_type
from newsflow.functions.text import graph_label, snippet, source_status, topic_label
from newsflow.operators import first_source, overview
from newsflow.operators.overview import Relations

#: Links of a chain, topics and messages of a graph, entities and channels of a listed topic, messages that stand for a topic, hours for which it is new.
LINKS, TOPICS, MESSAGES, ENTITIES, CHANNELS, SAMPLES, NEW = 12, 30, 30, 3, 10, 5, 24


def resolutions(messages: DataFrame, exact: DataFrame | None, inferred: DataFrame | None) -> DataFrame:
    """exact and inferred(public_cluster_id, source_type, confidence, source_event_id) -> public_cluster_id, exact, inferred, source_status, shown: the source of each kind with its message, and that which is shown."""
    known = messages.select(F.col("event_id").alias("source_event_id"), F.col("channel").alias("source_channel"), F.col("message_id").alias("source_message_id"), F.col("message_date").alias("source_message_date"), snippet(F.col("text")).alias("source_snippet"))

    def of(rows: DataFrame | None, kind: str) -> DataFrame:
        if rows is None:
            return messages.select("public_cluster_id", "event_id").limit(0).select("public_cluster_id", F.lit(None).cast(RESOLUTION).alias(kind))
        full = rows.join(known.join(rows.select("source_event_id").distinct(), "source_event_id", "left_semi").dropDuplicates(["source_event_id"]), "source_event_id", "left")
        one = F.struct(F.lit(kind).alias("resolution_kind"), "source_type", F.coalesce("confidence", F.lit(0.0)).cast("double").alias("source_confidence"), "source_event_id", "source_channel", F.col("source_message_id").cast("long").alias("source_message_id"), F.col("source_message_date").cast("timestamp_ntz").alias("source_message_date"), "source_snippet")
        return full.select("public_cluster_id", one.cast(RESOLUTION).alias(kind))

    both = of(exact, "exact").join(of(inferred, "inferred"), "public_cluster_id", "full")
    both = both.withColumn("source_status", source_status(F.col("exact.source_type"), F.col("inferred.source_type")))
    return both.withColumn("shown", F.when(F.col("source_status") == "exact", F.col("exact")).otherwise(F.col("inferred")))


RESOLUTION = "struct<resolution_kind: string, source_type: string, source_confidence: double, source_event_id: string, source_channel: string, source_message_id: bigint, source_message_date: timestamp_ntz, source_snippet: string>"


def first_links(messages: DataFrame, links: DataFrame, most: int = LINKS) -> DataFrame:
    """The first links of each topic with their place, by the time of the child (unknown ones last), then its id; of messages only ids and dates are read."""
    dates = messages.select(F.col("event_id").alias("child"), "message_date").groupBy("child").agg(F.first("message_date").alias("_date"))
    first = Window.partitionBy("public_cluster_id").orderBy(F.col("_date").asc_nulls_last(), "child")
    return links.drop("place").join(dates, "child", "left").withColumn("place", F.row_number().over(first)).where(F.col("place") <= most).drop("_date")


def chains(messages: DataFrame, links: DataFrame, most: int = LINKS) -> DataFrame:
    """(O06, R08) The first links of each topic's chain with both messages and the evidence between them. Where messages are dear, ``first_links`` tells which are needed."""
    few = first_links(messages, links, most)
    # whole messages are looked up for the links that stay
    own = lambda p: messages.join(few.select(F.col(p).alias("event_id")).distinct(), "event_id", "left_semi").select(F.col("event_id").alias(p), F.struct(*messages.columns).alias(f"{p}_row")).dropDuplicates([p])
    full = few.join(own("child"), "child", "left").join(own("parent"), "parent", "left")
    kind = F.when(F.col("link_type").startswith("exact"), "exact").otherwise("inferred")
    ends = [F.col(f"{p}_row.{c}").alias(f"{p}_{c}") for p in ("child", "parent") for c in ("channel", "message_id", "message_date")]
    able = {"text_hash", "url_fingerprints", "entities", "tokens", "simhash", "text"} <= set(messages.columns)
    proof = first_source.evidence(lambda c: F.col(f"child_row.{c}"), lambda c: F.col(f"parent_row.{c}")) if able else F.lit(None)
    return full.select("public_cluster_id", "place", "child", "parent", *ends, "link_type", F.col("confidence").alias("link_confidence"), kind.alias("resolution_kind"), proof.alias("evidence"))


def first_sources(messages: DataFrame, exact: DataFrame, inferred: DataFrame, links: DataFrame) -> DataFrame:
    """(R05-R08) One row for each topic: status, both sources, the shown one and the chain. Topics without resolution are unknown."""
    found = chains(messages, links)
    packed = found.groupBy("public_cluster_id").agg(F.array_sort(F.collect_list(F.struct("place", *(c for c in found.columns if c not in ("place", "public_cluster_id", "evidence")), F.to_json("evidence").alias("evidence")))).alias("chain"))
    topics = messages.where("public_cluster_id is not null").select("public_cluster_id").distinct()
    out = topics.join(resolutions(messages, exact, inferred), "public_cluster_id", "left").join(packed, "public_cluster_id", "left")
    return out.withColumn("source_status", F.coalesce("source_status", F.lit("unknown")))


def _entities(r: Relations, counts: DataFrame, most: int) -> DataFrame:
    """The topics' entities as they are shown, most mentioned first."""
    top = overview.distinct_entities(counts, most)
    kind = shown_type(F.col("entity_type"))
    one = F.struct("place", F.concat_ws(":", kind, "entity_key").alias("id"), F.col("entity_text").alias("text"), kind.alias("type"), F.col("mention_count").cast("long").alias("mention_count"))
    return top.groupBy("public_cluster_id").agg(F.array_sort(F.collect_list(one)).alias("top_entities"))


def _channels(counts: DataFrame, most: int) -> DataFrame:
    one = F.struct((-F.col("message_count")).alias("_n"), "channel", F.col("message_count").alias("count"))
    packed = counts.groupBy("public_cluster_id").agg(F.slice(F.array_sort(F.collect_list(one)), 1, most).alias("c"))
    return packed.select("public_cluster_id", F.transform("c", lambda x: F.struct(x["channel"].alias("channel"), x["count"].alias("count"))).alias("channels"))


def _labelled(topics: DataFrame, resolved: DataFrame, end, given: bool = False) -> DataFrame:
    """label (X14), source_status (X15) and is_new; with ``given`` resolved has labels that a model gave, exact_label and inferred_label."""
    known = topics.join(resolved, "public_cluster_id", "left")
    of = lambda c: F.col(c) if given else F.lit(None).cast("string")
    names = F.transform("top_entities", lambda e: e["text"])
    label = topic_label(of("inferred_label"), of("exact_label"), names, F.col("shown.source_snippet"), F.col("public_cluster_id"))
    new = F.coalesce(F.col("first_seen") >= F.lit(end).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(NEW)), F.lit(False))
    return known.withColumns({"label": label, "source_status": F.coalesce("source_status", F.lit("unknown")), "is_new": new})


def earliest_sources(r: Relations, start, end) -> DataFrame:
    """Resolutions of the latest run's topics from their messages alone: the earliest one."""
    m = overview.of_latest_run(r).join(r.raw, "event_id")
    return resolutions(m, None, first_source.cluster_inferred(m).withColumn("source_type", F.lit("earliest_in_cluster")))


def topic_list(r: Relations, start, end, resolved: DataFrame | None = None) -> DataFrame:
    """All topics of the window with counts, entities, channels, sparkline, label, status; see ``resolutions`` for resolved."""
    out = overview.cluster_overview(r, start, end).join(_entities(r, overview.entities_per_cluster(r, start, end), ENTITIES), "public_cluster_id", "left")
    out = out.join(_channels(overview.channels_per_cluster(r, start, end), CHANNELS), "public_cluster_id", "left").join(overview.sparkline(r, start, end), "public_cluster_id", "left")
    out = _labelled(out, earliest_sources(r, start, end) if resolved is None else resolved, end)
    return out.drop("exact", "inferred", "shown")


def topic_detail(r: Relations, topic: str, start, end, sources: DataFrame | None = None) -> DataFrame:
    """One row for a topic that has messages in the window, none for others. sources is as ``first_sources`` gives it."""
    named = lambda df: df.withColumn("public_cluster_id", F.lit(topic))
    mine = overview.of_cluster(r, topic, start, end)
    if sources is None:
        m = mine.withColumn("public_cluster_id", F.lit(topic))
        none = m.limit(0).select("public_cluster_id", F.lit("").alias("child"), F.lit("").alias("parent"), F.lit("").alias("link_type"), F.lit(0.0).alias("confidence"))
        none_exact = m.limit(0).select("public_cluster_id", F.lit("").alias("source_type"), F.lit(0.0).alias("confidence"), F.lit("").alias("source_event_id"))
        sources = first_sources(m, none_exact, first_source.cluster_inferred(m).withColumn("source_type", F.lit("earliest_in_cluster")), none)
    stats = named(overview.cluster_stats(r, topic, start, end)).where("message_count > 0").withColumn("avg_sentiment", F.round("avg_sentiment", 4))
    pack = lambda df, name, *order: named(df).groupBy("public_cluster_id").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order)))).alias(name))
    kind = shown_type(F.col("entity_type"))
    entities = overview.cluster_entities(r, topic, start, end).select((-F.col("mention_count")).alias("minus"), F.col("entity_text").alias("text"), F.concat_ws(":", kind, "entity_key").alias("id"), kind.alias("type"), "mention_count")
    channels = overview.cluster_channels(r, topic, start, end).select((-F.col("message_count")).alias("minus"), "channel", F.col("message_count").alias("count"))
    shown = documents(r, topic, start, end, SAMPLES).select(F.row_number().over(Window.orderBy(F.desc("message_date"), F.desc("event_id"))).alias("place"), "event_id", "channel", "message_id", "message_date", "text")
    related = overview.related_clusters(r, topic)
    related = related.select((-F.col("overlap")).alias("minus"), F.col("public_cluster_id").alias("cluster_id"), "overlap", "similarity")
    out = stats
    for part in (
        pack(entities, "top_entities", "minus", "text"), pack(channels, "channels", "minus", "channel"), pack(overview.sentiment_breakdown(r, topic, start, end), "sentiment_breakdown"),
        pack(overview.volume(r, topic, start, end), "volume_timeline", "bucket"), pack(shown, "representative_messages", "place"), pack(related, "related_topics", "minus", "cluster_id"),
    ):
        out = out.join(part, "public_cluster_id", "left")
    return _labelled(out, sources, end)


def documents(r: Relations, topic: str, start, end, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a topic's messages, newest first."""
    d = overview.of_cluster(r, topic, start, end).join(r.sentiment, "event_id", "left")
    return d.orderBy(F.desc("message_date"), F.desc("event_id")).offset(offset).limit(limit)


NODE = ["id", "label", "type", "weight", "source_status"]


def overview_graph(topics: DataFrame, focus: str | None = None, depth: int = 1, most: int = TOPICS) -> tuple[DataFrame, DataFrame]:
    """(N12) topics as ``topic_list`` gives them -> (nodes, edges) of the largest ones with their first channels and entities.

    focus ``topic-<id>`` keeps that topic, or the first one if it isn't among them. A node that
    several topics have keeps the weight of the first.
    """
    place = F.row_number().over(Window.orderBy(F.desc("message_count"), F.desc("last_seen"), "public_cluster_id"))
    top = topics.orderBy(F.desc("message_count"), F.desc("last_seen"), "public_cluster_id").limit(most).withColumn("place", place)
    if focus is not None and focus.startswith("topic-"):
        hit = F.max(F.col("public_cluster_id") == focus.removeprefix("topic-")).over(Window.partitionBy())
        top = top.withColumn("_hit", hit).where(F.when(F.col("_hit"), F.col("public_cluster_id") == focus.removeprefix("topic-")).otherwise(F.col("place") == 1)).drop("_hit")
    few = max(2, depth + 1)
    topic_id = F.concat(F.lit("topic-"), "public_cluster_id")
    channels = top.select("place", topic_id.alias("source"), F.posexplode(F.slice("channels", 1, few)).alias("pos", "c")).select("place", "source", "pos", F.concat(F.lit("ch-"), "c.channel").alias("target"), F.col("c.channel").alias("label"), F.lit("channel").alias("type"), F.col("c.count").alias("weight"), F.lit("publishes").alias("kind"))
    entities = top.select("place", topic_id.alias("source"), F.posexplode(F.slice("top_entities", 1, few)).alias("pos", "e")).select("place", "source", (F.col("pos") + 100).alias("pos"), F.concat(F.lit("ent-"), "e.id").alias("target"), F.col("e.text").alias("label"), F.concat(F.lit("entity_"), F.lower("e.type")).alias("type"), F.col("e.mention_count").alias("weight"), F.lit("mentions").alias("kind"))
    ends = channels.unionByName(entities)
    nodes = ends.groupBy(F.col("target").alias("id")).agg(F.min_by(F.struct("label", "type", "weight"), F.struct("place", "pos")).alias("n")).select("id", "n.*", F.lit(None).cast("string").alias("source_status"))
    own = top.select(topic_id.alias("id"), "label", F.lit("topic").alias("type"), F.col("message_count").alias("weight"), "source_status")
    return own.unionByName(nodes), ends.select("source", "target", "weight", F.col("kind").alias("type"))


def propagation_graph(messages: DataFrame, links: DataFrame, topic: str, statuses: DataFrame | None = None, label: Column | None = None, most: int = MESSAGES, most_links: int = LINKS) -> tuple[DataFrame, DataFrame]:
    """(N13) (nodes, edges) of a topic: it contains its newest messages, and its chain's links go from parent to child, weight in percent.

    statuses(event_id, source_status) are those of messages; a message that only the chain has
    takes the status of its link. A topic without messages has no graph.
    """
    mine = messages.where(F.col("public_cluster_id") == topic)
    shown = mine.orderBy(F.desc("message_date"), F.desc("event_id")).limit(most)
    shown = shown.join(statuses.select("event_id", "source_status"), "event_id", "left") if statuses is not None else shown.withColumn("source_status", F.lit(None).cast("string"))
    name = F.concat_ws(" #", "channel", "message_id")
    compact = graph_label(F.col("text"))
    weight = F.greatest(F.lit(1), F.coalesce(F.col("forwards"), F.lit(0)).cast("int") + 1) if "forwards" in messages.columns else F.lit(1)
    mark = lambda c: F.concat(F.lit("msg-"), c)
    first = shown.select(mark(F.col("event_id")).alias("id"), F.coalesce(F.nullif(compact, F.lit("")), name).alias("label"), F.lit("message").alias("type"), weight.cast("long").alias("weight"), "source_status", F.lit(0).alias("_rank"))
    chain = chains(messages, links.where(F.col("public_cluster_id") == topic), most_links)
    status = F.when(F.col("resolution_kind") == "exact", "exact").otherwise("probable")
    ends = [chain.select(mark(F.col(p)).alias("id"), F.concat_ws(" #", f"{p}_channel", f"{p}_message_id").alias("label"), F.lit("message").alias("type"), F.lit(w).cast("long").alias("weight"), status.alias("source_status"), (F.col("place") * 2 + side).alias("_rank")) for p, w, side in (("parent", 2, 0), ("child", 1, 1))]
    every = first.unionByName(ends[0]).unionByName(ends[1])
    nodes = every.groupBy("id").agg(F.min_by(F.struct("label", "type", "weight", "source_status"), "_rank").alias("n")).select("id", "n.*")
    whole = mine.groupBy("public_cluster_id").agg(F.count("*").alias("weight")).select(F.concat(F.lit("topic-"), "public_cluster_id").alias("id"), (F.col("public_cluster_id") if label is None else label).alias("label"), F.lit("topic").alias("type"), "weight", F.lit(None).cast("string").alias("source_status"))
    contains = shown.select(F.concat(F.lit("topic-"), "public_cluster_id").alias("source"), mark(F.col("event_id")).alias("target"), F.lit(1).alias("weight"), F.lit("contains").alias("kind"))
    spread = chain.select(mark(F.col("parent")).alias("source"), mark(F.col("child")).alias("target"), F.greatest(F.lit(1), F.round(F.col("link_confidence") * 100).cast("int")).alias("weight"), F.concat(F.lit("propagates_"), "resolution_kind").alias("kind"))
    return whole.unionByName(nodes), contains.unionByName(spread)
