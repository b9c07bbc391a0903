"""What follows decoding parses an envelope once."""

import pytest

from newsflow.sources import events


@pytest.mark.parametrize("of", [events.valid, events.rejected])
def test_json_is_parsed_once(spark, of):
    raw = spark.createDataFrame([("k", "{}")], "key string, value string").repartition(1)
    plan = of(events.decode(raw))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
