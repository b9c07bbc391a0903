"""Staged loads: typed fields, broken lines, and checks that stop a load."""

import json

import pytest

from newsflow.sources import staging


def rows(**change):
    one = {"event_id": "c:1", "channel": "c", "message_id": 1, "run_id": "r", "cluster_id": 4, "public_cluster_id": "r:4", "cluster_probability": 0.5}
    return one | change


def load(spark, tmp_path, *lines):
    path = tmp_path / "staged.jsonl"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return staging.staged_lines(spark, str(path))


def test_fields(spark, tmp_path):
    got = load(spark, tmp_path, rows(topic_keywords=["a", "b"]), rows(event_id="c:2", cluster_id="no number", message_id="7"), "{broken", "", "  ").collect()
    assert [(r.event_id, r.message_id, r.cluster_id, r.topic_keywords, r.is_json) for r in got] == [("c:1", 1, 4, '["a","b"]', True), ("c:2", 7, None, "[]", True), (None, None, None, "[]", False)]


def test_checks(spark, tmp_path):
    known = spark.createDataFrame([("c:1", "c", 1), ("c:2", "c", 2)], "event_id string, channel string, message_id long")
    assert staging.checked(load(spark, tmp_path, rows(), rows(event_id="c:2", message_id=2, cluster_id=-1, public_cluster_id="r:-1")), known).count() == 2
    for bad, said in (
        (rows(run_id="s", public_cluster_id="s:4", event_id="c:2", message_id=2), "runs 2"), (rows(event_id="c:2", message_id=2, cluster_probability=1.5), "invalid 1"), (rows(event_id="c:2", message_id=2, cluster_id=-2, public_cluster_id="r:-2"), "invalid 1"),
        (rows(event_id="c:2", message_id=2, public_cluster_id="r:5"), "invalid 1"), (rows(event_id="c:2", message_id=3), "orphans 1"), (rows(), "duplicates 1"), (rows(event_id="c:2", message_id=2, cluster_id=None), "invalid 1"),
    ):
        with pytest.raises(ValueError, match=said):
            staging.checked(load(spark, tmp_path, rows(), bad), known)
    with pytest.raises(ValueError, match="runs 0"):
        staging.checked(load(spark, tmp_path, ""), known)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,name,x\n1,"a, b",2.5\nbad,c,1\n3,,\n')
    got = staging.staged_csv(spark, str(tmp_path / "a.csv"), "k long, name string, x double").collect()
    assert [(r.k, r.name, r.x, r._broken is None) for r in got] == [(1, "a, b", 2.5, True), (None, "c", 1.0, False), (3, None, None, True)]
