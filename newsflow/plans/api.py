"""The eleven reads of the news API as functions of (spark, tables); times and topics are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators import graph, overview, topics
from newsflow.operators.overview import Relations
from newsflow.plans import relational


def topic_graph(r: Relations, topic: str, start, end) -> tuple[DataFrame, DataFrame]:
    m = overview.of_cluster(r, topic, start, end).join(r.ner, "event_id")
    return graph.build(overview.mention_counts(m, "public_cluster_id", "event_id", "channel").withColumnRenamed("public_cluster_id", "cluster"))


def _of(f):
    return lambda spark, d: f(relational.relations(spark, d))


S, E, C = relational.START, relational.END, relational.CLUSTER


def source_payloads(spark: SparkSession, d: str, topic: str | None = None) -> DataFrame:
    """First sources of one topic or all topics of the testbed's messages, both kinds computed from them.

    Of one topic only its own messages are prepared and compared; others are read for exact
    sources and for the parents of its links.
    """
    from newsflow.operators import first_source
    from newsflow.plans import analytics

    m, exact, inferred = analytics.source_sides(spark, d, topic)
    strict, likely = first_source.cluster_exact(exact), first_source.cluster_inferred(m).withColumn("source_type", F.lit("earliest_in_cluster"))
    links = analytics.written(first_source.propagation_links(exact, inferred))
    if topic is not None:
        ends = links.select(F.explode(F.array("child", "parent")).alias("event_id")).unionByName(strict.select(F.col("source_event_id").alias("event_id"))).distinct()
        others = analytics.source_messages(spark, d).where(F.col("public_cluster_id").isNull() | (F.col("public_cluster_id") != topic)).join(ends, "event_id", "left_semi")
        known = analytics.written(m.unionByName(others.select(*m.columns)))
    found = topics.first_sources(m if topic is None else known, strict.where("source_type <> 'unknown'"), likely, links)
    return found if topic is None else found.where(F.col("public_cluster_id") == topic)


ROUTES = {
    "overview": _of(lambda r: overview.kpis(r, S, E, relational.BEFORE, relational.MIDDLE)),
    "overview_clusters": _of(lambda r: topics.topic_list(r, S, E)),
    "cluster": _of(lambda r: topics.topic_detail(r, C, S, E)),
    "cluster_documents": _of(lambda r: topics.documents(r, C, S, E)),
    "cluster_first_source": lambda spark, d: source_payloads(spark, d, "run_b:1"),
    "cluster_related": _of(lambda r: overview.related_clusters(r, C)),
    "cluster_graph_metrics": _of(lambda r: graph.measures(*topic_graph(r, C, S, E))),
    "entities_top": _of(lambda r: overview.top_entities(r, S, E)),
    "sentiment_dynamics": _of(lambda r: overview.sentiment_dynamics(r, S, E)),
    "messages": _of(lambda r: overview.messages(r, S, E)),
    "graph": _of(lambda r: topics.overview_graph(topics.topic_list(r, S, E))[1]),
}
