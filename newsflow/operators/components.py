"""Connected components over distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.session import shared_folder


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """edges(a, b) -> node, root: root is the smallest node of the connected component. Nodes are of any type that has an order; a node without edges has no row.

    Star contraction: every node tells its larger neighbours of its smallest one, then its
    smaller ones, until no edge changes. Each round is written to the shared folder.
    """
    shared_folder(edges.sparkSession)
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = large.where("a <> b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(least.withColumnRenamed("m", "b")).where("a <> b").distinct().checkpoint()
        after = print_of(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
