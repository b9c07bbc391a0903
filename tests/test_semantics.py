"""Fixtures with known results."""

import hashlib
import json
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.functions import fingerprints as fp
from newsflow.functions import text as tx
from newsflow.functions.semantics import title_case
from newsflow.operators import clustering, dml, enrich, first_source, graph, overview
from newsflow.sources import events
from newsflow.streaming import ingest


def one(spark, expr, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "language", "mode"), [("Центробанк повысил ключевую ставку", "ru", "full"), ("The central bank raised the interest rate", "en", "full"), ("El banco central subio la tasa", "other", "partial"), ("12345 !!!", "und", "unknown"), ("", "und", "unknown")])
def test_language(spark, text, language, mode):
    name = tx.language(F.col("t"))["language"]
    assert one(spark, name, t=text) == language
    assert one(spark, tx.analysis_mode(name), t=text) == mode


def test_urls(spark):
    a, b = "https://example.com/path/?utm_source=tg&b=2&a=1#fragment", "https://example.com/path/?a=1&b=2"
    assert one(spark, fp.normalized_url(F.lit(a))) == one(spark, fp.normalized_url(F.lit(b))) == "https://example.com/path?a=1&b=2"
    assert one(spark, fp.normalized_url(F.lit("WWW.Example.com:80//x//"))) == "http://www.example.com/x"
    assert one(spark, fp.normalized_url(F.lit("no link"))) is None
    found = tx.urls(F.lit("Breaking: https://example.com/path/?utm_campaign=x and https://example.com/path, www.a.org!"))
    assert one(spark, found) == ["https://example.com/path/?utm_campaign=x", "https://example.com/path", "www.a.org"]
    assert len(one(spark, fp.url_fingerprints(found))) == 2


def test_cleaning(spark):
    assert one(spark, tx.cleaned(F.lit("Рост 5% — см. https://x.y/z #тег #tag @name 😀!"))) == "рост 5% см тег"
    assert one(spark, tx.sentences(F.lit("a. b! c"))) == 3
    assert one(spark, tx.sentences(F.lit("  "))) == 0
    assert one(spark, title_case(F.lit("o'neil anna-maria"))) == "O'Neil Anna-Maria"
    names = {"@Rbc_News": "Rbc_News", "https://t.me/banksta": "banksta", "t.me/Cbpub": "Cbpub", "https://t.me/+privateInvite": None, "https://example.com/channel": None}
    for reference, name in names.items():
        assert one(spark, tx.channel_name(F.lit(reference))) == name


def test_simhash(spark):
    words = "a b b c c c d".split()
    votes = [0] * 64
    for w, n in Counter(words).items():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        for k in range(64):
            votes[k] += n if h >> k & 1 else -n
    value = sum(1 << k for k in range(64) if votes[k] > 0)
    df = spark.createDataFrame([(" ".join(words),), ("",), (None,)], "t string").select(fp.simhash64("t").alias("x")).collect()
    assert [r.x for r in df] == [value - (1 << 64) if value >> 63 else value, None, None]


def message(event, minutes, **more):
    base = dict(public_cluster_id="r:1", event_id=event, channel="demo", message_id=int(event.split(":")[1]), message_date=datetime(2026, 4, 9, 12, minutes), text="x", tokens=["x"], entities=["a"], url_fingerprints=[], text_hash=event, simhash=0,
                primary_url=None, channel_id=1, reply_to_message_id=None, forward_from_channel_id=None, forward_from_message_id=None)
    return base | more


SCHEMA = "public_cluster_id string, event_id string, channel string, message_id long, message_date timestamp_ntz, text string, tokens array<string>, entities array<string>, url_fingerprints array<string>, text_hash string, simhash long, primary_url string, channel_id long, reply_to_message_id long, forward_from_channel_id long, forward_from_message_id long"


def test_first_source(spark):
    words = "Original statement with concrete wording here"
    quote = f'Follow-up says "{words}" in full'
    rows = [message("demo:1", 0, text=words, tokens=words.lower().split(), entities=["a", "b"], simhash=123456, url_fingerprints=["u"]), message("demo:2", 10, text=quote, tokens=quote.lower().split(), entities=["a", "b"], simhash=123458)]
    m = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    found = {r.event_id: r for r in first_source.inferred_sources(m, threshold=0.4).collect()}
    assert found["demo:1"].source_type == "unknown"
    assert (found["demo:2"].source_type, found["demo:2"].source_event_id) == ("quoted", "demo:1")
    assert found["demo:2"].confidence == pytest.approx(0.2 + 0.2 * len({*words.lower().split()} & {*quote.lower().split()}) / len({*words.lower().split()} | {*quote.lower().split()}) + 0.2 + 0.01 + 600 / 86400 * 0.01)
    low = {r.event_id: r for r in first_source.inferred_sources(m, threshold=0.98).collect()}
    assert (low["demo:2"].source_type, low["demo:2"].confidence) == ("earliest_in_cluster", 0.35)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.55, 0.62, 0.7])
def test_inferred_sources_against_all_pairs(spark, threshold):
    """Copies, ties in time, unknown times, few and many bits apart: what is left out can't reach the threshold."""
    rng = np.random.default_rng(11)
    some = lambda names, most: [names[k] for k in sorted(rng.choice(len(names), int(rng.integers(0, most + 1)), replace=False))]
    rows, base = [], [int(x) for x in rng.integers(-(2**62), 2**62, 4)]
    for k in range(90):
        flips = sum(1 << int(b) for b in rng.choice(62, int(rng.choice([0, 2, 6, 12, 30])), replace=False))
        more = dict(public_cluster_id=str(rng.choice(["r:1", "r:2"])), tokens=some(list("abcd"), 4), entities=some(list("xyz"), 3), url_fingerprints=some(["u1", "u2"], int(rng.integers(0, 3))), text_hash=str(rng.choice(["h1", "h2", f"own{k}"])), simhash=base[int(rng.integers(4))] ^ flips)
        row = message(f"demo:{k}", int(rng.integers(0, 50)), **more)
        rows.append(row if k % 3 or not rows else {**rows[-1], "event_id": f"demo:{k}", "message_date": row["message_date"] if k % 9 else None})
    m = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    of = lambda prefix: lambda name: F.col(f"{prefix}.{name}")
    earlier = F.struct("c.message_date", "c.event_id") < F.struct("t.message_date", "t.event_id")
    pairs = m.alias("t").join(m.alias("c"), (F.col("t.public_cluster_id") == F.col("c.public_cluster_id")) & earlier)
    scored = pairs.select(F.col("t.event_id").alias("t"), F.col("c.event_id").alias("c"), F.col("c.message_date").alias("date"), first_source.pair_confidence(of("t"), of("c")).alias("sure")).collect()
    when = lambda r: (r.date is not None, r.date or datetime.min, r.c)
    expected = {r["event_id"]: ("unknown", 0.0, None) for r in rows}
    for t in {r.t for r in scored}:
        best, first = min((r for r in scored if r.t == t), key=lambda r: (-r.sure, when(r))), min((r for r in scored if r.t == t), key=when)
        expected[t] = ("inferred_semantic", best.sure, best.c) if best.sure >= threshold else ("earliest_in_cluster", 0.35, first.c)
    got = {r.event_id: (r.source_type, r.confidence, r.source_event_id) for r in first_source.inferred_sources(m, threshold).collect()}
    assert got == expected
    assert {"inferred_semantic", "earliest_in_cluster", "unknown"} == {v[0] for v in got.values()}


def test_exact_sources(spark):
    rows = [message("demo:1", 0, primary_url="u"), message("demo:2", 1, forward_from_channel_id=1, forward_from_message_id=1), message("demo:3", 2, reply_to_message_id=2), message("demo:4", 3, primary_url="u"), message("demo:5", 4, reply_to_message_id=6), message("demo:6", 5)]
    m = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    e = first_source.exact_sources(m, m)
    got = {r.event_id: (r.source_type, r.source_event_id) for r in e.collect()}
    assert got == {"demo:1": ("unknown", None), "demo:2": ("exact_forward", "demo:1"), "demo:3": ("exact_reply", "demo:2"), "demo:4": ("exact_url", "demo:1"), "demo:5": ("unknown", None), "demo:6": ("unknown", None)}
    assert first_source.cluster_exact(e).first().source_event_id == "demo:1"
    assert {r.child for r in first_source.propagation_links(e, first_source.inferred_sources(m)).collect()} == {f"demo:{k}" for k in range(2, 7)}


def test_graph(spark):
    rows = [("t", "a:1", "a", "bank", "ORG", "Bank", 1), ("t", "a:1", "a", "rate", "MISC", "Rate", 1), ("t", "b:2", "b", "bank", "ORG", "Bank", 1), ("t", "b:2", "b", "market", "MISC", "Market", 1)]
    m = spark.createDataFrame(rows, "cluster string, event_id string, channel string, entity_key string, entity_type string, entity_text string, mention_count int")
    nodes, edges = graph.build(m)
    got = {r.id: r for r in graph.measures(nodes, edges).collect()}
    assert len(got) == 5 and max(got.values(), key=lambda r: r.pagerank).id == "ent-ORG:bank"
    assert got["ent-ORG:bank"].is_bridge and got["ent-ORG:bank"].articulation
    assert sum(r.pagerank for r in got.values()) == pytest.approx(1)
    assert graph.summary(nodes, edges).first().density == pytest.approx(0.6)


def test_graph_parts(spark):
    """Sources dealt into parts give the same betweenness; a node without links has its row."""
    rng = np.random.default_rng(7)
    names = [f"n{k:02d}" for k in range(30)]
    links = [("t", names[a], names[b], float(w)) for a, b, w in zip(*np.triu_indices(29, 1), rng.integers(0, 25, 406), strict=True) if w > 21]
    nodes = spark.createDataFrame([("t", n) for n in names] + [("u", "alone")], "cluster string, id string")
    edges = spark.createDataFrame(links, "cluster string, a string, b string, weight double")
    got = {(r.cluster, r.id): r for r in graph.measures(nodes, edges, together=4).collect()}
    w = np.zeros((30, 30))
    for _, a, b, x in links:
        w[names.index(a), names.index(b)] = w[names.index(b), names.index(a)] = x
    assert [got["t", n].betweenness for n in names] == pytest.approx(graph.betweenness(w > 0))
    out = w.sum(axis=1)
    step, rank = np.divide(w, out[:, None], out=np.full_like(w, 1 / 30), where=out[:, None] > 0), np.full(30, 1 / 30)
    for _ in range(graph.ROUNDS):
        rank = (1 - graph.DAMPING) / 30 + graph.DAMPING * rank @ step
    assert [got["t", n].pagerank for n in names] == pytest.approx(rank)
    assert (got["u", "alone"].betweenness, got["u", "alone"].is_bridge, got["u", "alone"].pagerank) == (0, False, pytest.approx(1))


def test_graph_measures_against_plain_code():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(3, 12))
        a = np.triu(rng.random((n, n)) < 0.3, 1)
        a = a | a.T
        expected = np.zeros(n)
        for s in range(n):
            paths, dist, queue = {s: 1}, {s: 0}, [s]
            for v in queue:
                for w in np.flatnonzero(a[v]):
                    if w not in dist:
                        dist[w], paths[w] = dist[v] + 1, 0
                        queue.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
            share = dict.fromkeys(queue, 0.0)
            for w in reversed(queue):
                for v in np.flatnonzero(a[w]):
                    if dist.get(v) == dist[w] - 1:
                        share[v] += paths[v] / paths[w] * (1 + share[w])
                if w != s:
                    expected[w] += share[w]
        assert graph.betweenness(a) == pytest.approx(expected / ((n - 1) * (n - 2)))
        parts = lambda x: len(set(graph.component_labels(x).tolist()))
        for k in range(n):
            rest = [i for i in range(n) if i != k]
            assert graph.articulation(a)[k] == (parts(a[np.ix_(rest, rest)]) > parts(a) - (not a[k].any()))


def test_clusters(spark):
    rows = [("b", "demo:1", 1, [1.0, 0.0]), ("b", "demo:2", 2, [0.0, 1.0]), ("b", "demo:3", 3, [0.9, 0.1]), ("c", "demo:4", 9, [0.0, 0.0])]
    m = spark.createDataFrame(rows, "bucket string, event_id string, event_timestamp long, embedding array<double>")
    got = {r.event_id: r for r in clustering.global_labels(clustering.similarity_clusters(m)).collect()}
    assert [got[f"demo:{k}"].cluster_id for k in (1, 2, 3, 4)] == [0, 1, 0, 2]
    assert got["demo:2"].probability == 1 and 0.55 <= got["demo:1"].probability <= 0.99
    ids = spark.createDataFrame([("a",), ("b",)], "i string")
    assert ids.agg(clustering.run_id(F.col("i"))).first() == ids.orderBy(F.desc("i")).agg(clustering.run_id(F.col("i"))).first()


def test_clusters_of_a_dealt_bucket(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 12))
    vectors = [(centres[k % 9] + rng.normal(size=12) * 0.5 if k % 5 else rng.normal(size=12) * (k > 0)).tolist() for k in range(140)]
    m = spark.createDataFrame([("b" if k < 120 else "c", f"demo:{k}", 1000 - k // 2, v) for k, v in enumerate(vectors)], "bucket string, event_id string, event_timestamp long, embedding array<double>")
    rows = lambda df: sorted((r.bucket, r.event_id, r.label, round(r.probability, 9), r.first) for r in df.collect())
    whole = rows(clustering.similarity_clusters(m))
    assert len({r[2] for r in whole if r[0] == "b"}) > 5
    for together in (25, 50):
        assert rows(clustering.similarity_clusters(m, together=together)) == whole


def test_relations_and_names(spark):
    spans = spark.createDataFrame([(1, "ЦБ", "Центральный Банк", 0), (1, "Банк России", "Центральный Банк", 4), (1, "Москва", "Москва", 18)], "event_id int, entity_text string, normalized_text string, start_pos int")
    assert [(r.subject, r.object) for r in enrich.relations(spans).collect()] == [("центральный банк", "москва")]
    people = spark.createDataFrame([("Anna Neil",), ("Anna Neil",), ("Bo Neil",), ("Neil",)], "name string")
    assert [tuple(r) for r in enrich.full_names(people).collect()] == [("Neil", "Anna Neil")]
    assert [r.label for r in enrich.sentiment(spark.createDataFrame([("profit growth",), ("",), ("crisis",)], "text string")).collect()] == ["positive", "neutral", "negative"]


def envelope(n, **change):
    e = {"event_id": f"c:{n}", "event_type": "raw_message", "event_timestamp": "2026-01-01T00:00:00Z", "event_version": "v1.0.0", "source_system": "s", "trace_id": "00000000-0000-0000-0000-000000000000", "payload": {"message_id": n, "channel": "c", "text": "t", "date": "2026-01-01T00:00:00Z"}}
    return json.dumps({k: v for k, v in (e | change).items() if v is not None})


CASES = [("c:1", envelope(1), None), ("c:2", None, "invalid_json"), ("c:3", "{bad", "invalid_json"), ("c:4", envelope(4, event_version=None), "invalid_schema"), ("c:5", envelope(5, extra=1), "invalid_schema"), ("c:6", envelope(6, event_id="c:7"), "invalid_event_id"),
         ("c:9", envelope(8), "invalid_key"), (None, envelope(9), "missing_key"), ("c:10", envelope(10, trace_id="x"), "invalid_schema"), ("c:11", envelope(11, event_type="other"), "unknown_event_type")]


def test_decode(spark):
    got = events.decode(spark.createDataFrame([c[:2] for c in CASES], "key string, value string")).select("reason").collect()
    assert [r.reason for r in got] == [c[2] for c in CASES]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [json.dumps({"key": k, "value": v}) for k, v, _ in [*CASES, CASES[0]]]
    (source / "a.json").write_text("\n".join(lines[5:]))
    (source / "b.json").write_text("\n".join(lines[:5]))
    raw = ingest.replay(spark, str(source), "key string, value string")
    for q in ingest.start(raw, str(tmp_path / "out"), str(tmp_path / "cp")):
        q.awaitTermination()
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "out/messages")).collect()] == ["c:1"]
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == len(CASES) - 1


def test_dml(spark):
    old, new = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, v string, t int"), spark.createDataFrame([(2, "c", 1), (3, None, 9)], "k int, v string, t int")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(dml.insert_ignore(old, new, ["k"])) == [(1, "a", 5), (2, "b", 5), (3, None, 9)]
    assert got(dml.upsert(old, new.where("v is not null"), ["k"])) == [(1, "a", 5), (2, "c", 1)]
    assert got(dml.merge_upsert(old, new, ["k"], {"v": "newest", "t": "greatest"})) == [(1, "a", 5), (2, "c", 5), (3, None, 9)]
    assert overview.page("x", -3) == (50, 0) and overview.page(1000, 2) == (200, 2)


def test_entities_keep_every_mention(spark):
    """A later mention and a name that also stands inside an earlier word keep their own places."""
    text = "We saw Bobcat near, and Bob met Bob in \U0001f600 New York."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "event_id long, text string")
    got = sorted((r.event_id, r.entity_text, r.start_pos, r.end_pos) for r in enrich.entities(df).collect())
    assert [(t, a) for _, t, a, _ in got] == [("Bob", text.index("Bob met")), ("Bob", text.index("Bob in")), ("Bobcat", 7), ("York", text.index("York"))]
    assert all(text[a:b] == t for _, t, a, b in got)
