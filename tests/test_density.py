"""Density topics against plain code that walks the whole dendrogram from the top."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.operators import clustering, density


def plain_clusters(vectors, least, samples):
    """{row: (cluster, probability)} of one bucket; clusters by first row."""
    unit = clustering._unit(np.asarray(vectors, float))
    d = density.squared_distances(unit, unit)
    n = len(d)
    core = np.array([sorted(np.delete(d[i], i))[min(samples, n - 1) - 1] if n > 1 else 0 for i in range(n)])
    pairs = sorted((max(d[i, j], core[i], core[j]), i, j) for i in range(n) for j in range(i + 1, n))
    node = {i: (frozenset([i]), None, None, None) for i in range(n)}
    of = list(range(n))
    for w, i, j in pairs:
        a, b = of[i], of[j]
        if a != b:
            new = (node[a][0] | node[b][0], w, node[a], node[b])
            node[a] = new
            for r in node[b][0]:
                of[r] = a
    leaves = []

    def cluster(tree):
        """One condensed cluster: follow the large child until two children are large."""
        out = {}
        while True:
            members, w, a, b = tree
            large = [x for x in (a, b) if x is not None and len(x[0]) >= least]
            if len(large) == 2:
                return [cluster(a), cluster(b)]
            for x in (a, b):
                if x is not None and len(x[0]) < least:
                    out |= dict.fromkeys(x[0], w)
            if not large:
                leaves.append(out)
                return out
            tree = large[0]

    if n < least:
        return {}
    root = cluster(node[of[0]])
    if isinstance(root, dict):
        return {}
    found = {}
    for k, leaf in enumerate(sorted(leaves, key=min)):
        low = min(leaf.values())
        found |= {r: (k, 1.0 if w == 0 else (low / w) ** 0.5) for r, w in leaf.items()}
    return found


def blobs(seed, n, noise=0.2, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    rows = [centres[k % 4] + rng.normal(size=6) * 0.25 if rng.random() > noise else rng.normal(size=6) for k in range(n)]
    return [r.round(3).tolist() for r in rows] + [rows[0].round(3).tolist()] * copies


def frame(spark, buckets):
    rows = [(b, f"e{b}-{k:04d}", k, v) for b, vs in buckets.items() for k, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "bucket int, event_id string, event_timestamp long, embedding array<double>")
    return df.withColumns({"place": F.lit("x"), "part": F.lit(0), "w": F.lit(1)}).repartition(5)


BUCKETS = {1: blobs(1, 90), 2: blobs(2, 60, 0.5), 3: blobs(3, 4), 4: blobs(4, 50, 0.0, copies=40), 5: [[1.0, 0.0, 0.0, 0.0, 0.0, 0.0]] * 30, 6: blobs(6, 1), 7: [[0.0] * 6] * 3}


@pytest.mark.parametrize(("least", "samples", "together", "most"), [(5, 3, 1024, 500_000), (5, 3, 16, 500_000), (8, 2, 25, 20), (3, 1, 1024, 7)])
def test_equals_plain_code(spark, least, samples, together, most):
    rows, clusters = density.density_rows(frame(spark, BUCKETS), least, samples, together, most)
    got = {b: {} for b in BUCKETS}
    for r in clusters.collect():
        got[int(r.b)][r.place] = (r.label, r.probability)
    assert rows.count() == sum(map(len, BUCKETS.values()))
    for b, vectors in BUCKETS.items():
        want = plain_clusters(vectors, least, samples)
        assert {k: v[0] for k, v in got[b].items()} == {k: v[0] for k, v in want.items()}, b
        assert all(abs(got[b][k][1] - p) < 1e-9 for k, (_, p) in want.items())


def test_topics(spark):
    got = {}
    for r in density.density_topics(frame(spark, BUCKETS)).collect():
        got.setdefault(r.bucket, {})[int(r.event_id.split("-")[1])] = r
    assert {b: len(rows) for b, rows in got.items()} == {b: len(v) for b, v in BUCKETS.items()}
    for b, vectors in BUCKETS.items():
        want = plain_clusters(vectors, 5, 3)
        n = len({k for k, _ in want.values()})
        assert all(got[b][k].label == c for k, (c, _) in want.items())
        noise = [k for k in range(len(vectors)) if k not in want]
        assert {got[b][k].strategy for k in got[b]} == {"similarity" if not n else "mixed" if noise else "density"}
        if noise:
            label = clustering._labels(np.array([vectors[k] for k in noise]), clustering.LINK)
            assert [got[b][k].label for k in noise] == [n + x for x in label]
    assert clustering.global_labels(density.density_topics(frame(spark, {1: BUCKETS[1], 3: BUCKETS[3]}))).count() == 94


def test_awkward_rows(spark):
    schema = "bucket int, event_id string, event_timestamp long, embedding array<double>"
    assert density.density_topics(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a", None, [1.0, 0.0]), (None, None, 3, None), (None, "a", 3, [1.0, 0.1]), (1, "a", 3, [0.0, 0.0])]
    got = density.density_topics(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.bucket or 0, r.event_id or "", r.label) for r in got) == [(0, "", 1), (0, "a", 0), (0, "a", 0), (1, "a", 0)]


def test_sweep(spark):
    settings = [(15, 5), (5, 3), (8, 5), (5, 1)]
    vectors = {b: BUCKETS[b] for b in (1, 2, 4)}
    total = sum(map(len, vectors.values()))
    for r in density.sweep(frame(spark, vectors), settings).collect():
        cuts = {b: plain_clusters(v, r.least, r.samples) for b, v in vectors.items()}
        sizes = [sum(c == k for c, _ in cut.values()) for cut in cuts.values() for k in {c for c, _ in cut.values()}]
        kept, largest = sum(sizes), max(sizes, default=0) / total
        assert (r.least, r.samples) == settings[r.setting] and r.n_clusters == len(sizes)
        assert abs(r.noise_ratio - (total - kept) / total) < 1e-12 and abs(r.largest_ratio - largest) < 1e-12
        noise = r.noise_ratio
        assert abs(r.score - ((largest <= 0.35) + (0.05 < noise < 0.9) + 0.5 * (len(sizes) > 2) + min(len(sizes) / 20, 1) - largest)) < 1e-12


def test_many_parts_need_no_rounds_over_tables(spark, monkeypatch):
    monkeypatch.setattr(density, "boruvka", lambda links: pytest.fail("rounds over tables for a bucket of one range"))
    rows = density.core_distances(clustering.numbered_rows(frame(spark, {1: BUCKETS[1]}), 10), [3, 5]).checkpoint()
    trees = {}
    for r in density.spanning_trees(rows, 2).collect():
        trees.setdefault(r.k, []).append((r.x, r.y, r.w))
    unit = clustering._unit(np.asarray(BUCKETS[1], float))
    d = density.squared_distances(unit, unit)
    np.fill_diagonal(d, np.inf)
    for k, samples in enumerate((3, 5)):
        core = np.sort(d, axis=1)[:, samples - 1]
        want = density.spanning_forest(np.maximum(d, np.maximum(core[:, None], core[None, :])))
        assert sorted((min(x, y), max(x, y)) for x, y, _ in want) == sorted((x, y) for x, y, _ in trees[k])
        assert abs(sum(w for *_, w in want) - sum(w for *_, w in trees[k])) < 1e-8
