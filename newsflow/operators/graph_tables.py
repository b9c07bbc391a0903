"""Measures of topic graphs as rounds of joins and sums over tables, all topics at once.

``graph.measures`` takes one topic's neighbour lists into a task; here no topic is one task's
work, for graphs of any size. nodes have cluster and id, edges cluster, a, b and weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.operators.components import components
from newsflow.operators.graph import DAMPING, ROUNDS
from newsflow.session import shared_folder


def transitions(edges: DataFrame) -> DataFrame:
    """edges both ways, weights of repeated ones added -> cluster, a, b, share of a's weight."""
    both = edges.select("cluster", "a", "b", "weight").unionByName(edges.where("a <> b").select("cluster", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    w = both.groupBy("cluster", "a", "b").agg(F.sum("weight").alias("weight"))
    out = w.groupBy("cluster", "a").agg(F.sum("weight").alias("out")).where("out > 0")
    return w.join(out, ["cluster", "a"]).select("cluster", "a", "b", (F.col("weight") / F.col("out")).alias("share"))


def page_ranks(nodes: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(N04) cluster, id, pagerank: so many steps of the weighted walk; what nodes without edges have is spread over their topic.

    A round is one join of the transitions with the ranks and one sum that is combined before
    its shuffle, so a node with very many edges is no single task's sum.
    """
    shared_folder(nodes.sparkSession)
    moves = transitions(edges).checkpoint()
    known = nodes.select("cluster", "id").distinct().join(moves.select("cluster", F.col("a").alias("id"), F.lit(True).alias("linked")).distinct(), ["cluster", "id"], "left")
    n = known.groupBy("cluster").agg(F.count("*").alias("n"))
    ranks = known.join(n, "cluster").select("cluster", "id", "n", F.coalesce("linked", F.lit(False)).alias("linked"), (1 / F.col("n")).alias("rank")).checkpoint()
    for _ in range(rounds):
        came = moves.join(ranks.select("cluster", F.col("id").alias("a"), "rank"), ["cluster", "a"]).groupBy("cluster", F.col("b").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        loose = ranks.groupBy("cluster").agg(F.sum(F.when(~F.col("linked"), F.col("rank")).otherwise(0.0)).alias("loose"))
        ranks = ranks.join(came, ["cluster", "id"], "left").join(loose, "cluster").select("cluster", "id", "n", "linked", ((1 - damping) / F.col("n") + damping * (F.coalesce("came", F.lit(0.0)) + F.col("loose") / F.col("n"))).alias("rank"))
        ranks = ranks.checkpoint()  # used three times in the next round
    return ranks.select("cluster", "id", F.col("rank").alias("pagerank"))


def component_numbers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(N06) cluster, id, component: connected components, numbered in each topic by their least id."""
    node = lambda c: F.struct("cluster", F.col(c).alias("id"))
    found = components(edges.select(node("a").alias("a"), node("b").alias("b"))).select("node.cluster", "node.id", F.col("root.id").alias("root"))
    rooted = nodes.select("cluster", "id").distinct().join(found, ["cluster", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    roots = rooted.where("root = id").select("cluster", "root", (F.row_number().over(Window.partitionBy("cluster").orderBy("root")) - 1).alias("component"))
    return rooted.join(roots, ["cluster", "root"]).select("cluster", "id", "component")
