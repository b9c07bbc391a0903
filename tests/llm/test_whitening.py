"""Operator 13 against numpy over whole tables, with awkward rows."""

from math import inf, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.llm import queries, whitening


@pytest.mark.parametrize("kind", ["random", "tied", "flat", "blocks", "one", "two"])
def test_symmetric_qr(kind):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(40, 40))
    a = {"random": a @ a.T, "tied": np.eye(40), "flat": np.zeros((40, 40)), "blocks": np.kron(np.eye(10), np.ones((4, 4))), "one": np.array([[3.0]]), "two": np.array([[2.0, 1.0], [1.0, -2.0]])}[kind]
    values, vectors = whitening.symmetric_qr(a)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-12 * max(1, np.abs(a).max() * 40))
    assert np.allclose(vectors @ vectors.T, np.eye(len(a)), atol=1e-13)
    assert np.allclose(vectors.T * values @ vectors, a, atol=1e-12 * max(1, np.abs(a).max() * 40))


def test_states_merge():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 7)) + 1e8
    parts = []
    for part in np.array_split(x, [1, 200, 260]):
        parts.append(whitening.Moments.start(part[0]))
        parts[-1].add(part)
    whole = parts[0].merge(parts[1]).merge(parts[2].merge(parts[3]))
    exact = np.cov((x - 1e8).T, bias=True)
    assert whole.n == 500 and np.allclose(whole.products / 500, exact, rtol=1e-9, atol=1e-12)


def check(got, rows, components=16):
    """rows: (vec_id, integer vector), those that remain."""
    x = np.array([v for _, v in rows], np.int64)
    fitted = np.unique(x, axis=0)
    n, s = len(fitted), fitted.sum(axis=0)
    v = np.cov((fitted - fitted.mean(axis=0)).T, bias=True).reshape(x.shape[1], -1)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    k = min(components, x.shape[1])
    projected = (x - s / n) @ w[:, :k] / np.sqrt(e[:k])
    have = sorted(got, key=lambda r: (r.component, -1 if r.vec_id is None else r.vec_id, r.deviation))
    order = sorted(range(len(rows)), key=lambda i: (-1 if rows[i][0] is None else rows[i][0], int(((n * x[i] - s) ** 2).sum())))
    assert len(have) == k * len(rows)
    for c in range(k):
        part = have[c * len(rows) : (c + 1) * len(rows)]
        assert [r.vec_id for r in part] == [rows[i][0] for i in order]
        assert [r.deviation for r in part] == [int(((n * x[i] - s) ** 2).sum()) for i in order]
        mine, theirs = np.array([r.whitened for r in part]), projected[order, c]
        assert np.allclose(mine, theirs * np.sign(mine @ theirs), atol=1e-7)
        assert {r.n for r in part} == {n} and {r.component for r in part} == {c + 1}
        assert np.allclose([r.explained for r in part], e[c] / e.sum(), rtol=1e-9)
    assert len({r.identity_error for r in have}) == 1 and have[0].identity_error < 1e-9


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    good = [(k, rng.integers(-50, 50, 6).tolist()) for k in range(40)]
    good += [(40, good[3][1]), (3, good[3][1]), (None, good[5][1]), *[(100 + k, good[7][1]) for k in range(200)]]
    odd = [(50, None), (51, [1, 2, None, 4, 5, 6]), (52, []), (53, [1, 2]), (54, [1] * 7)]
    df = spark.createDataFrame(good + odd, "vec_id long, vector array<long>").withColumns({"component": F.lit("x"), "n": F.lit(0), "d": F.lit(9)}).repartition(6)
    check(whitening.whiten(df).collect(), good)
    check(whitening.whiten(df, components=2).collect(), good, 2)
    assert whitening.whiten(df.where("vec_id < 0")).count() == whitening.whiten(df.where("vec_id in (50, 51, 52)")).count() == 0
    single = whitening.whiten(df.where("vec_id = 0")).collect()
    assert len(single) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single} == {(1, 0, 0.0, 0.0, 0.0)}
    huge = spark.createDataFrame([(1, [4 * 10**18, 1]), (2, [-4 * 10**18, 2])], "vec_id long, vector array<long>")
    assert {r.deviation for r in whitening.whiten(huge).collect()} == {None}


def test_flat_directions(spark):
    rng = np.random.default_rng(6)
    plane = rng.integers(-9, 9, (60, 2))
    rows = [(k, [int(a), int(b), int(a + b), 5]) for k, (a, b) in enumerate(plane)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, vector array<long>")).collect()
    assert len(got) == 240 and {r.whitened for r in got if r.component > 2} == {0.0}
    assert max(r.identity_error for r in got) < 1e-9


def test_doubles(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)) + 1e6
    bad = [(200, [1.0, nan, 1.0, 1.0, 1.0]), (201, [1.0, inf, 1.0, 1.0, 1.0]), (202, [-inf] * 5)]
    got = whitening.whiten(spark.createDataFrame([*enumerate(x.tolist()), *bad], "vec_id long, vector array<double>")).collect()
    w = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(80, 5)
    assert np.allclose(np.cov(w.T, bias=True), np.eye(5), atol=1e-6) and {r.deviation for r in got} == {None}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, (np.floor(64 * np.array(r.embedding, float)) + 1_000_000).astype(int).tolist()) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.QUERIES["op13_whitening"](spark, sf).collect(), rows)
