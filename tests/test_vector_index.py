"""Similarity components over the index of cells: those of all pairs, with far fewer pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.operators import clustering


def tight(seed, n, groups, dims=24, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(centres[rng.integers(groups)] + rng.normal(size=dims) * 0.2).tolist() if rng.random() > noise else rng.normal(size=dims).tolist() for _ in range(n)]


def frame(spark, vectors):
    return spark.createDataFrame([("b", k // 3, f"e{k:05d}", v) for k, v in enumerate(vectors)], "bucket string, event_timestamp long, event_id string, embedding array<double>").repartition(6)


@pytest.mark.parametrize("least", [0.68, 0.2, 0.0, -0.1])
def test_same_components(spark, least):
    vectors = tight(1, 260, 12, dims=8, noise=0.3)
    vectors += [vectors[4]] * 150 + [(np.array(vectors[5]) * 2).tolist()] * 3 + [[0.0] * 8] * 4
    df = frame(spark, vectors).withColumns({"cell": F.lit("x"), "place": F.lit(1), "part": F.lit(2)})
    rows = lambda d: sorted((r.event_id, r.label, round(r.probability, 9), r.first) for r in d.collect())
    whole = rows(clustering.similarity_clusters(df, least))
    assert rows(clustering.similarity_clusters(df, least, together=48)) == whole
    assert {r[1] for r in whole} == set(range(len({r[1] for r in whole})))


def test_nulls_and_several_buckets(spark):
    vectors = tight(2, 90, 5, dims=6)
    rows = [(None if k % 3 == 0 else k % 3, None if k == 9 else k, None if k == 12 else f"e{k}", v) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "bucket int, event_timestamp long, event_id string, embedding array<double>")
    got = [sorted((str(r.bucket), str(r.event_id), r.label) for r in clustering.similarity_clusters(df, together=t).collect()) for t in (4096, 10)]
    assert got[0] == got[1]


def test_pairs_grow_with_the_rows(spark):
    """Ten times the rows in ten times the groups: a quarter of the growth of all pairs, and of all pairs a fiftieth."""
    compared = []
    for n, groups in ((400, 20), (4000, 200)):
        rows = spark.createDataFrame([("b", k, v) for k, v in enumerate(tight(3, n, groups, noise=0.0))], "b string, place long, embedding array<double>")
        met = clustering.visits(rows, 0.68, 64).groupBy("cell").agg(F.count_if("member").alias("m"), F.count("*").alias("r"))
        compared.append(met.agg(F.sum(F.col("m") * F.col("r"))).first()[0])
    assert compared[1] < 30 * compared[0] and compared[1] < 4000 * 4000 / 2 / 40


def test_connected_in_blocks(spark):
    """Rows of the largest component don't meet each other in blocks; far vectors in many dimensions, which pivots can't tell apart, meet once."""
    vectors = tight(4, 300, 3, dims=64, noise=0.2)
    rows = spark.createDataFrame([("b", k, v) for k, v in enumerate(vectors)], "b string, place long, embedding array<double>")
    label = clustering._labels(np.array(vectors), 0.68)
    first = {c: int(np.flatnonzero(label == c)[0]) for c in set(label.tolist())}
    assert {r.place: r.root for r in clustering.connected(rows, 0.68, 32).collect()} == {k: first[c] for k, c in enumerate(label.tolist())}
