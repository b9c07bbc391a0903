"""Chunked scores, terms of clusters and kept results against plain code."""

import math
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from newsflow.operators import cache, enrich

TEXTS = ["war crisis loss", "good growth", "", "  \n", None, "...", "good " * 900 + "war " * 300, "plain words only", "win " * 382, "win " * 383 + "loss"]


def plain(text, size=384, overlap=64, specials=2):
    """Chunks, probabilities: the loop that goes on until a chunk reaches the end."""
    if not (text or "").strip():
        return 0, [0.0, 1.0, 0.0]
    words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()]
    n, logits, at = size - specials, [], 0
    while words:
        part = words[at : at + n]
        count = lambda known: 2.0 * sum(w in known.split() for w in part)  # noqa: B023, E731
        logits.append([count(enrich.BAD), 1.0, count(enrich.GOOD)])
        if at + n >= len(words):
            break
        at += n - overlap
    mean = np.mean(logits, axis=0) if logits else np.zeros(3)
    e = np.exp(mean - mean.max())
    return len(logits), (e / e.sum()).tolist()


def same(got, text):
    chunks, probabilities = plain(text)
    best = max(probabilities)
    label = "neutral" if best < 0.55 else enrich.LABELS[probabilities.index(best)]
    return got.chunks == chunks and np.allclose(got.probabilities, probabilities) and got.label == label and math.isclose(got.score, best)


def test_chunked_sentiment(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")
    assert all(same(r, TEXTS[r.k]) for r in enrich.chunked_sentiment(df).collect())


def test_model_over_chunks(spark):
    """A tokenizer and a scorer that are plugged in see each chunk by itself."""
    known = {w: k for k, w in enumerate(sorted({*enrich.GOOD.split(), *enrich.BAD.split()}))}
    good, bad = ({known[w] for w in ws.split()} for ws in (enrich.GOOD, enrich.BAD))

    def tokenize(texts):
        return [[known.get(w, -1) for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for t in texts]

    def scorer(chunks):
        assert 0 < len(chunks) <= 4 and all(0 < len(c) <= 382 for c in chunks)
        return [[2.0 * sum(x in bad for x in c), 1.0, 2.0 * sum(x in good for x in c)] for c in chunks]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")
    got = enrich.score_chunks(df, tokenize, scorer, batch=4).collect()
    assert len(got) == len(TEXTS) and all(same(r, TEXTS[r.k]) for r in got)
    assert enrich.score_chunks(df.where("false"), tokenize, scorer).count() == 0


def test_tfidf_terms(spark):
    docs = [("a", "The cat sat, the cat ran"), ("a", None), ("b", "a dog sat"), ("b", ""), (None, "lost"), ("c", "cat dog cat dog")]
    got = enrich.tfidf_terms(spark.createDataFrame(docs, "cluster string, text string"), 20, ("the",), 8).collect()
    terms = {"a": ["cat", "sat", "cat", "ran", "cat sat", "sat cat", "cat ran"], "b": ["dog", "sat", "dog sat"], "c": ["cat", "dog", "cat", "dog", "cat dog", "dog cat", "cat dog"]}
    every = [t for ts in terms.values() for t in ts]
    kept = sorted(set(every), key=lambda t: (-every.count(t), t))[:8]
    for c, ts in terms.items():
        w = {t: ts.count(t) * (math.log(4 / (1 + sum(t in x for x in terms.values()))) + 1) for t in set(ts) & set(kept)}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want = sorted(((-round(x / norm, 9), t) for t, x in w.items()))
        assert [(r.term, r.score) for r in sorted(got, key=lambda r: r.place) if r.cluster == c] == [(t, -x) for x, t in want]


def test_read_through(spark):
    at = datetime.fromisoformat
    old = spark.createDataFrame([("kept", 1, at("2026-01-01 00:00:01")), ("old", 2, at("2026-01-01 00:00:00")), ("other", 3, at("2025-01-01 00:00:00"))], "cache_key string, n int, expires_at timestamp_ntz")
    wanted = spark.createDataFrame([("kept", 10), ("old", 20), ("new", 30), ("new", 30), (None, 40)], "cache_key string, x int")
    compute = lambda missing: missing.select("cache_key", F.col("x").alias("n"))
    answers, after = cache.read_through(old, wanted, compute, "2026-01-01 00:00:00", 5)
    assert sorted(map(tuple, answers.collect())) == [("kept", 1, True), ("new", 30, False), ("old", 20, False)]
    assert sorted(map(tuple, after.collect())) == [("kept", 1, at("2026-01-01 00:00:01")), ("new", 30, at("2026-01-01 00:01:00")), ("old", 20, at("2026-01-01 00:01:00")), ("other", 3, at("2025-01-01 00:00:00"))]
    forced, later = cache.read_through(old, wanted, compute, "2026-01-01 00:00:00", 3600, force=True)
    assert sorted(map(tuple, forced.collect())) == [("kept", 10, False), ("new", 30, False), ("old", 20, False)]
    assert {r.expires_at for r in later.where("cache_key <> 'other'").collect()} == {at("2026-01-01 01:00:00")}
    parts = spark.createDataFrame([("kept", "a"), ("old", "b"), ("other", "c")], "cache_key string, node string")
    new = spark.createDataFrame([("old", "d"), ("kept", "e")], "cache_key string, node string")
    assert sorted(map(tuple, cache.replace_parts(parts, answers, new).collect())) == [("kept", "a"), ("old", "d"), ("other", "c")]


def test_hashed_embeddings(spark):
    texts = ["the cat sat on the mat by the door today", "the cat sat on the mat by the door now", "entirely other words stand in this place", "", None, "one", "Long text " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("embedding", F.lit("x"))
    got = {r.k: np.array(r.embedding) for r in enrich.hashed_embeddings(df).collect()}
    assert all(len(v) == 64 for v in got.values()) and sorted(got) == list(range(len(texts)))
    assert [round(float(np.linalg.norm(got[k])), 9) for k in got] == [0.0 if not (texts[k] or "").strip() else 1.0 for k in got]
    assert got[0] @ got[1] > 0.6 > 0.4 > abs(got[0] @ got[2])
    hashes = [r[0] for r in spark.createDataFrame([("one",)], "w string").select(F.xxhash64("w")).collect()]
    assert np.allclose(got[5] * 8, [1.0 if hashes[0] >> k & 1 else -1.0 for k in range(64)])


def test_measures_over_tables(spark):
    from newsflow.operators import graph, graph_tables

    rng = np.random.default_rng(3)
    nodes = [(c, f"n{k:02d}") for c in ("a", "b") for k in range(30)] + [("c", "alone")]
    edges = [(c, f"n{i:02d}", f"n{j:02d}", float(rng.integers(1, 5))) for c, most in (("a", 50), ("b", 18)) for i, j in rng.integers(0, 30, (most, 2)) if i != j]
    nodes = spark.createDataFrame(nodes, "cluster string, id string").withColumns({"label": F.col("id"), "kind": F.lit("entity"), "weight": F.lit(1.0)})
    edges = spark.createDataFrame(edges, "cluster string, a string, b string, weight double").withColumn("kind", F.lit("co_occurs"))
    whole = {(r.cluster, r.id): r for r in graph.measures(nodes, edges).collect()}
    ranks = {(r.cluster, r.id): r.pagerank for r in graph_tables.page_ranks(nodes, edges).collect()}
    assert ranks.keys() == whole.keys() and all(abs(ranks[k] - r.pagerank) < 1e-12 for k, r in whole.items())
    numbers = {(r.cluster, r.id): r.component for r in graph_tables.component_numbers(nodes, edges).collect()}
    assert len({(k[0], numbers[k]) for k in numbers}) == len({(k[0], r.component) for k, r in whole.items()}) == len({(k[0], numbers[k], whole[k].component) for k in whole})
    assert graph_tables.page_ranks(nodes.where("false"), edges.where("false")).count() == 0


def test_texts_are_split_once(spark):
    """However often the logits are used, the text is split in one place of the plan."""
    df = spark.createDataFrame([("good war",)], "text string").repartition(1)
    plan = enrich.sentiment(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
