"""(K13) Results that are kept for a time: read, computed where they are missing or too old, and written back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.operators.dml import replace_by_key, upsert

#: Fixed value: a result is kept for at least so many seconds.
LEAST_SECONDS = 60


def live(cache: DataFrame, now: str) -> DataFrame:
    """Rows of cache(cache_key, ..., expires_at) that can still be read."""
    return cache.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))


def read_through(cache: DataFrame, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], now: str, seconds: int, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(answers, cache afterwards) for wanted(cache_key, ...).

    What the cache has and is not expired is a hit. compute(rows of wanted without one) gives
    cache_key and the cache's other columns; it replaces expired rows and counts from now for
    ``seconds``, but LEAST_SECONDS at least. Expired rows that nobody asked for stay, as readers
    don't see them. With ``force`` everything is computed anew. Keys are wanted once each, null
    keys not at all. compute's rows are used twice: write what is dear to a table first.
    """
    columns = [c for c in cache.columns if c != "expires_at"]
    wanted = wanted.where("cache_key is not null").dropDuplicates(["cache_key"])
    fresh = live(cache, now).limit(0) if force else live(cache, now)
    hits = fresh.join(wanted.select("cache_key"), "cache_key", "left_semi").select(*columns, F.lit(True).alias("hit"))
    made = compute(wanted.join(fresh.select("cache_key"), "cache_key", "left_anti")).select(*columns)
    until = F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(max(LEAST_SECONDS, seconds)))
    return hits.unionByName(made.withColumn("hit", F.lit(False))), upsert(cache, made.withColumn("expires_at", until), ["cache_key"]).select(*cache.columns)


def replace_parts(parts: DataFrame, answers: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that hang on cached results (top nodes, communities): those of computed results are replaced by new(cache_key, ...), also by none, those of hits stay."""
    made = answers.where(~F.col("hit")).select("cache_key")
    kept = parts.join(made, "cache_key", "left_anti")
    return replace_by_key(kept, new.join(made, "cache_key", "left_semi").select(*parts.columns), ["cache_key"])
