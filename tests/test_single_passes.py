"""Dear inputs are passed over once."""

import math

from pyspark.sql import functions as F

from newsflow.functions import text as tx
from newsflow.operators import enrich, names
from newsflow.plans import catalogue, relational
from newsflow.sources import testbed


def test_canonical_names_find_mentions_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for part in batches:
            seen.add(len(part))
            yield part

    rows = [("Anna Petrova", "PER"), ("Anny Petrovy", "PER"), (None, None)] * 5
    df = spark.createDataFrame(rows, "entity_text string, entity_type string")
    out = names.canonical_names(df.mapInPandas(count, df.schema)).collect()
    assert len(out) == len(rows) and seen.value == len(rows)


def test_cluster_terms_sum_a_term_without_a_join(spark):
    rows = [("a", "one two two"), ("b", "two six six six"), (None, "one six"), ("a", None)]
    out = enrich.cluster_terms(spark.createDataFrame(rows, "cluster string, text string"))
    got = {(r.cluster, r.term): r.score for r in out.collect()}
    tf = {("a", "one"): 1, ("a", "two"): 2, ("a", "one two"): 1, ("a", "two two"): 1, ("b", "two"): 1, ("b", "six"): 3, ("b", "two six"): 1, ("b", "six six"): 2, (None, "one"): 1, (None, "six"): 1, (None, "one six"): 1}
    whole = {}
    for (_, t), n in tf.items():
        whole[t] = whole.get(t, 0) + n
    mean = sum(tf.values()) / 2
    assert got.keys() == tf.keys() and all(abs(got[k] - n * math.log(1 + mean / whole[k[1]])) < 1e-9 for k, n in tf.items())
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_a_join_follow_the_rows(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = rows(relational.top_entities_view(spark, d))
    monkeypatch.setattr(testbed, "ROWS", 500)
    many = relational.top_entities_view(spark, d)
    parts = -(-testbed.table(spark, d, "lineitem").count() // 500)
    assert many._jdf.queryExecution().executedPlan().toString().count(f", {parts}), REPARTITION_BY_NUM") == 2
    assert rows(many) == plain


def test_blank_texts_are_found_without_rewriting_texts(spark):
    texts = [None, "", " ", "\n\t", "\x1c\x1f", "\x85", "\u00a0\u2003", "\u200b", "\n.", " a ", "\x00", "\u3000\u4e2d"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    found = [r[0] for r in df.select(tx.blank(df.text)).collect()]
    assert found == [r[0] == "" for r in df.select(tx.squeeze(F.coalesce("text", F.lit("")))).collect()] == [k < 7 for k in range(len(texts))]
    for judged in (enrich.sentiment(df), enrich.chunked_sentiment(df)):
        assert "regexp_replace" not in judged._jdf.queryExecution().optimizedPlan().toString()
        assert [r.score == 1 for r in judged.collect()] == found


def test_sentiment_is_dealt_over_all_cores(spark):
    for name in ("M01_sentiment", "M02b_all_documents"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
