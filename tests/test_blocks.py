"""Blocks of rows meet in pairs, each pair once, and what is written grows with the rows."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsflow.operators import blocks, clustering, first_source


def test_every_pair_meets_once(spark):
    rows = [(g, k, k % 5 != 0, k % 3, True) for g, n in (("a", 23), ("b", 4)) for k in range(n)] + [("c", k, True, 0, False) for k in range(3)] + [("d", 0, False, 0, False)]
    df = spark.createDataFrame(rows, "g string, k long, _lead boolean, _part int, _many boolean")

    def task(g, one, other, same):
        met = list(itertools.combinations_with_replacement(one["k"], 2)) if same else list(itertools.product(one["k"], other["k"]))
        return pd.DataFrame({"g": g, "x": [min(p) for p in met], "y": [max(p) for p in met]})

    got = [tuple(r) for r in blocks.met(df, "g", 11, task, "g string, x long, y long").collect()]
    expected = {(g, x, y) for g, x, lx, *_ in rows for h, y, ly, *_ in rows if g == h and x <= y and (lx or ly)}
    assert len(got) == len(set(got)) and set(got) == expected
    assert blocks.met(df.where("false"), "g", 0, task, "g string, x long, y long").count() == 0


def test_tokens_tell_long_texts_apart(spark):
    """Long texts that differ fill a sketch of 1,024 bits alike; a wide one leaves only the pair that can reach the threshold, in one block and in several."""
    own = lambda k: [f"t{k}-{i}" for i in range(1500)]
    rows = [("s", f"e{k:02d}", k, f"h{k}", 7, own(k), ["x", "y"], []) for k in range(12)] + [("s", "e99", 99, "h99", 7, own(3)[:-5], ["x", "y"], [])]
    slim = spark.createDataFrame(rows, "public_cluster_id string, event_id string, message_date long, text_hash string, simhash long, tokens array<string>, entities array<string>, url_fingerprints array<string>")
    for part in (first_source.PART, 4):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(first_source, "PART", part)
            assert [tuple(r) for r in first_source._candidates(slim, 0.55).collect()] == [("s", "e99", "e03")]


def stages(spark) -> list:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]


def test_shuffles_grow_with_the_rows(spark):
    """Vectors that link to nothing: four times the rows are sixteen times the pairs, but the rows that are shuffled stay under eight times as many."""
    wrote = []
    for n in (512, 2048):
        rng, before = np.random.default_rng(n), max((s.stageId() for s in stages(spark)), default=-1)
        rows = spark.createDataFrame([("b", k, v.tolist()) for k, v in enumerate(rng.normal(size=(n, 64)))], "b string, place long, embedding array<double>")
        assert clustering.connected(rows, 0.95, 16).where(F.col("place") != F.col("root")).count() == 0
        wrote.append(sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() > before))
    assert wrote[1] < 8 * wrote[0], wrote
