"""Which pairs are scored for first sources, and the sources of one topic."""

from pyspark.sql import functions as F

from newsflow.operators import first_source, topics
from newsflow.plans import api, coverage


def test_close_fingerprints_alone_are_no_candidates(spark):
    """Different texts with nearly equal fingerprints whose words are too few in common can't reach the threshold; a near copy can."""
    rows = [("r:1", f"e{k}", k, f"h{k}", 1 << (k % 3), [f"w{k} {n}" for n in range(20)], ["x"], [f"u{k}"]) for k in range(40)]
    rows.append(("r:1", "near", 99, "own", 1, rows[0][5][:19] + ["other"], ["x"], ["u99"]))
    slim = spark.createDataFrame(rows, "public_cluster_id string, event_id string, message_date long, text_hash string, simhash long, tokens array<string>, entities array<string>, url_fingerprints array<string>")
    assert [tuple(r) for r in first_source._candidates(slim, 0.55).collect()] == [("r:1", "near", "e0")]


def test_one_topic_as_of_all(spark):
    d = "/root/testdata/sf0.001"
    shown = lambda df: df.select(F.to_json(F.struct(*df.columns))).collect()
    assert shown(api.source_payloads(spark, d, "run_b:1")) == shown(api.source_payloads(spark, d).where("public_cluster_id = 'run_b:1'"))


def test_messages_are_read_four_times(spark):
    """For the features, for the messages of some pair, for the earliest of each topic and for the result."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for part in batches:
            seen.add(len(part))
            yield part

    rows = [("r:1", f"e{k}", k, f"h{k % 3}", k % 3, [f"w{k % 3}"], ["x"], [f"u{k % 3}"], f'he "said again and again the same {k % 3}"') for k in range(8)]
    m = spark.createDataFrame(rows, "public_cluster_id string, event_id string, message_date long, text_hash string, simhash long, tokens array<string>, entities array<string>, url_fingerprints array<string>, text string")
    m = m.withColumn("message_date", F.timestamp_seconds("message_date"))
    out = first_source.inferred_sources(m.mapInPandas(count, m.schema)).collect()
    assert {r.event_id: (r.source_type, r.source_event_id) for r in out} == {"e0": ("unknown", None)} | {f"e{k}": ("earliest_in_cluster", "e0") for k in (1, 2)} | {f"e{k}": ("quoted", f"e{k % 3}") for k in range(3, 8)}
    assert seen.value == 4 * len(rows)


def test_sets_in_other_order_of_columns_are_not_the_same(spark):
    """What decides about copies keeps the columns and nulls apart."""
    rows = [(None, None, ["a", "b"], []), (None, None, ["a"], ["b"]), (None, None, ["a", "b"], None), ("", None, ["a", "b"], []), (None, 0, ["a", "b"], [])]
    slim = spark.createDataFrame(rows, "text_hash string, simhash long, tokens array<string>, entities array<string>")
    slim = slim.select(F.lit("r:1").alias("public_cluster_id"), F.lit("e").alias("event_id"), F.lit(1).alias("message_date"), "*", F.array().cast("array<string>").alias("url_fingerprints"))
    assert first_source._features(slim).select("same").distinct().count() == len(rows)


def test_only_messages_of_first_links_are_prepared(spark):
    d = "/root/testdata/sf0.001"
    m, e = coverage._exact(spark, d)
    links = first_source.propagation_links(e, coverage._inferred(m))
    known, few = coverage._linked(spark, d)
    ends = {x for r in few.collect() for x in (r.child, r.parent)}
    assert {r.event_id for r in known.select("event_id").collect()} == ends and len(ends) < m.count()
    shown = lambda df: sorted(tuple(r) for r in df.select("public_cluster_id", "place", F.to_json(F.struct(*df.columns))).collect())
    assert shown(topics.chains(known, few)) == shown(topics.chains(m, links))
