"""Stateful streams against their batch twins."""

import json
import os
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.operators import clustering
from newsflow.session import shared_folder
from newsflow.streaming import ingest, jobs

LOG = "channel string, job_date date, at timestamp, outcome string, permanent boolean, priority int"
BEGIN = datetime(2026, 1, 1, tzinfo=UTC)


def log_of(channel, day, outcomes, start=0, step=60, **more):
    return [{"channel": channel, "job_date": f"2026-01-{day:02d}", "at": (BEGIN + timedelta(seconds=start + k * step)).isoformat(), "outcome": o, **more} for k, o in enumerate(outcomes)]


def run(spark, tmp_path, batches, schema, build, name="out"):
    """Each list of rows is one micro-batch; the rows that the stream writes."""
    source = tmp_path / f"in-{name}"
    source.mkdir()
    for k, rows in enumerate(batches):
        (source / f"{k:03d}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(source / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = build(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"cp-{name}")).option("path", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_job_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [r for c in ("a", "b") for day in range(1, 6) for r in log_of(c, day, ["planned", *rng.choices(["running", "failed", "failed", "completed"], k=rng.randrange(7))], rng.randrange(100), 50)]
    rows.sort(key=lambda r: r["at"])
    rows += [{"channel": None, "job_date": "2026-01-01", "at": rows[-1]["at"], "outcome": "failed"}]
    batches = [rows[k : k + 9] for k in range(0, len(rows), 9)]
    out = run(spark, tmp_path, batches, LOG, lambda s: jobs.job_stream(s, most_attempts=3, late="1 hour"))
    log = spark.createDataFrame([(r["channel"], r["job_date"], datetime.fromisoformat(r["at"]), r["outcome"]) for r in rows if r["channel"]], "channel string, job_date string, at timestamp, outcome string")
    want = {(r.channel, r.job_date): (r.state, r.failures, r.wait_seconds) for r in ingest.job_states(log, 3).collect()}
    assert {(r.channel, r.job_date): (r.state, r.failures, r.wait_seconds) for r in jobs.last_states(out).collect()} == want


def test_five_attempts_then_dead_letter(spark, tmp_path):
    # a timer fires in the first micro-batch whose watermark, that of the batches before, has passed it
    fail = [part for k in range(5) for part in (log_of("a", 1, ["failed"], 100 * k + 10), log_of("z", 1, ["planned"], 100 * k + 50), log_of("z", 2, ["planned"], 100 * k + 60))]
    out = run(spark, tmp_path, [log_of("a", 1, ["planned"]), *fail], LOG, jobs.job_stream)
    rows = sorted((r.at, r.event, r.failures, r.wait_seconds) for r in out.where("channel = 'a'").collect())
    assert [(e, f, w) for _, e, f, w in rows if e == "failed"] == [("failed", k + 1, 2**k) for k in range(4)]
    assert [(e, f) for _, e, f, _ in rows if e == "dead_letter"] == [("dead_letter", 5)]
    due = [(a, f) for a, e, f, _ in rows if e == "due"]
    failed = {f: a for a, e, f, _ in rows if e == "failed"}
    assert due == [(failed[k + 1] + 2**k * 1_000_000, k + 1) for k in range(4)]


def test_permanent_and_leases(spark, tmp_path):
    batches = [
        [*log_of("a", 1, ["planned"], priority=0), *log_of("a", 2, ["planned"], priority=0), *log_of("a", 3, ["planned"], priority=-1)],
        log_of("a", 2, ["failed"], 10), log_of("a", 1, ["completed"], 20), log_of("a", 2, ["completed"], 90), log_of("a", 3, ["failed"], 95, permanent=True), log_of("b", 1, ["planned"], 500), log_of("b", 1, ["completed"], 600),
    ]
    out = run(spark, tmp_path, batches, LOG, lambda s: jobs.job_stream(s, lease=True))
    rows = sorted((r.at, r.event == "leased", r.job_date[-2:], r.event, r.state) for r in out.where("channel = 'a'").collect())
    leased = [(day, at // 1_000_000 - int(BEGIN.timestamp())) for at, _, day, event, _ in rows if event == "leased"]
    # the newest day first; its retry waits, so the other day of that priority runs; then the retry, then the low priority
    assert [day for day, _ in leased] == ["02", "01", "02", "03"]
    assert [(day, state) for _, _, day, event, state in rows if event == "dead_letter"] == [("03", "failed")]


def test_upstream_that_comes_later(spark, tmp_path):
    schema = "side string, channel string, message_id long, at timestamp"
    row = lambda side, n, s: {"side": side, "channel": "c", "message_id": n, "at": (BEGIN + timedelta(seconds=s)).isoformat()}
    batches = [[row("m", 1, 0), row("m", 2, 1), row("u", 3, 2)], [row("u", 1, 30), row("m", 3, 31)], [row("m", 9, 4000), row("u", 9, 4001)], [row("m", 10, 9000), row("u", 10, 9000)], [row("m", 11, 9100), row("u", 11, 9100)]]
    sides = lambda s: ingest.with_late_upstream(s.where("side = 'm'"), s.where("side = 'u'"), "10 minutes").select("message_id", "missing_upstream")
    got = {r.message_id: r.missing_upstream for r in run(spark, tmp_path, batches, schema, sides).collect()}
    assert got == {1: False, 2: True, 3: False, 9: False, 10: False, 11: False}
    table = spark.createDataFrame([(r["side"], "c", r["message_id"], datetime.fromisoformat(r["at"])) for b in batches for r in b], schema)
    assert {r.message_id: r.missing_upstream for r in sides(table).collect()} == got


@pytest.mark.parametrize(("least", "most", "runs"), [(6, 100, 2), (6, 4, 4), (100, 100, 0)])
def test_clustering_in_runs(spark, tmp_path, least, most, runs):
    shared_folder(spark)
    rng = np.random.default_rng(1)
    rows = [{"event_id": f"e{k:02d}", "bucket": "b", "event_timestamp": k, "embedding": rng.normal(size=4).tolist()} for k in range(14)]
    source = tmp_path / "in"
    source.mkdir()
    for k, part in enumerate((rows[:3], rows[3:7], rows[7:9], [rows[0], *rows[9:13]])):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # micro-batches follow the files' times
    schema = "event_id string, bucket string, event_timestamp long, embedding array<double>"

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        cluster = lambda m: clustering.global_labels(clustering.similarity_clusters(m))
        ingest.start_clustering(stream, str(tmp_path / "out"), str(tmp_path / "cp"), cluster, least, 3600, most).awaitTermination()

    go()
    if not runs:
        assert not (tmp_path / "out/assigned").exists() and spark.read.parquet(str(tmp_path / "out/pending")).count() == 14
        return
    got = spark.read.parquet(str(tmp_path / "out/assigned"))
    assert got.select("run_id").distinct().count() == runs
    assert sorted(r.event_id for r in got.select("event_id").collect()) == [f"e{k:02d}" for k in range(13)]
    (source / "9.json").write_text(json.dumps(rows[13]))  # one more row is not enough for a run
    go()
    assert spark.read.parquet(str(tmp_path / "out/assigned")).count() == 13
    assert got.where(F.col("cluster_id") < 0).count() == 0


def test_resolution_of_pending_topics(spark, tmp_path):
    from newsflow.operators import first_source
    from newsflow.plans import analytics

    d = "/root/testdata/sf0.001"
    messages = lambda: analytics.source_messages(spark, d).withColumn("primary_url", F.lit(None).cast("string"))
    rows = [{"event_id": r.event_id, "public_cluster_id": f"run_b:{r.message_id // 40}", "cluster_id": r.message_id // 40} for r in messages().select("event_id", "message_id").collect()]
    rows.append({"event_id": "nobody:1", "public_cluster_id": "run_b:99", "cluster_id": 99})
    source = tmp_path / "in"
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows if (r["cluster_id"] > 2) == k))
    stream = spark.readStream.schema("event_id string, public_cluster_id string, cluster_id long").option("maxFilesPerTrigger", 1).json(str(source))
    ingest.start_resolution(stream, messages, str(tmp_path / "out"), str(tmp_path / "cp"), most=2).awaitTermination()
    own = spark.createDataFrame([tuple(r.values()) for r in rows], "event_id string, public_cluster_id string, cluster_id long")
    m = messages().drop("public_cluster_id").join(own, "event_id").checkpoint()
    exact = first_source.exact_sources(m, messages())
    want = {("exact", r.public_cluster_id): (r.source_event_id, r.source_type) for r in first_source.cluster_exact(exact).collect()}
    want |= {("inferred", r.public_cluster_id): (r.source_event_id, "earliest_in_cluster") for r in first_source.cluster_inferred(m).collect()}
    want |= {(kind, "run_b:99"): (None, None) for kind in ("exact", "inferred")}
    got = spark.read.parquet(str(tmp_path / "out/resolutions")).collect()
    assert {(r.resolution_kind, r.public_cluster_id): (r.source_event_id, r.source_type) for r in got} == want and len(got) == len(want)
    links = first_source.propagation_links(exact, first_source.inferred_sources(m))
    assert sorted((r.child, r.parent) for r in spark.read.parquet(str(tmp_path / "out/links")).collect()) == sorted((r.child, r.parent) for r in links.collect())
