"""The graph of all topics is built once: what follows reads a written table."""

from newsflow.operators import graph
from newsflow.plans import analytics

DIR = "/root/testdata/sf0.001"


def test_graph_is_read_from_written_tables(spark):
    nodes, edges = analytics.topic_graph(spark, DIR)
    for df in (nodes, edges):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and len(df.inputFiles()) > 0
        assert all(DIR not in f for f in df.inputFiles())
    plain = graph.build(analytics.topic_mentions(spark, DIR))
    for got, want in zip((nodes, edges), plain, strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
