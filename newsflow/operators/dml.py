"""Writes as expressions: what a table holds after an insert, upsert, merge or delete, and checks of staged data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the least order columns for each key; aggregates before it shuffles."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_m")).select(*keys, "_m.*")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m")).select(*keys, "_m.*")


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(K06) The first row per key stays."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(K07) The new row per key wins."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merge_upsert(table: DataFrame, new: DataFrame, keys: list[str], how: dict[str, str]) -> DataFrame:
    """(K09) Column by column: newest keeps the old value where the new one is null; greatest and least ignore nulls."""
    a, b = table.alias("a"), new.alias("b")
    pick = {"newest": lambda c: F.coalesce(f"b.{c}", f"a.{c}"), "greatest": lambda c: F.greatest(f"a.{c}", f"b.{c}"), "least": lambda c: F.least(f"a.{c}", f"b.{c}")}
    return a.join(b, keys, "full").select(*keys, *(pick[kind](c).alias(c) for c, kind in how.items()))


def replace_by_key(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(K10) All rows of a key are replaced by the new ones."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def retained(df: DataFrame, column: str, now: str, days: int) -> DataFrame:
    """(K12)"""
    return df.where(F.col(column) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days)))


def cache_key(*parts: Column) -> Column:
    """(K13)"""
    return F.sha2(F.concat_ws("|", *parts), 256)


def staged_violations(staged: DataFrame, known: DataFrame) -> DataFrame:
    """Counts that must be 1, 0, 0 and 0 before staged assignments are taken over."""
    whole = staged.agg(F.countDistinct("run_id").alias("runs"), F.count_if((F.col("probability") < 0) | (F.col("probability") > 1)).alias("out_of_range"))
    orphans = staged.join(known.select("event_id"), "event_id", "left_anti").agg(F.count("*").alias("orphans"))
    again = staged.groupBy("event_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicates"))
    return whole.join(orphans).join(again)  # one row each


def record_errors(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(F22, S03) Rows that break a rule, with the names of the rules."""
    found = F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("errors", found).where(F.size("errors") > 0)


def request_ids(df: DataFrame, order: str) -> DataFrame:
    """(W02) Numbers over the whole result; meant for a bounded request list, since it takes one task."""
    return df.withColumn("request_id", F.concat(F.lit("req_"), F.lpad(F.row_number().over(Window.orderBy(order)).cast("string"), 4, "0")))


def two_cuts(edges: DataFrame, per_src: int, per_dst: int) -> DataFrame:
    """(W05) The heaviest edges of each source, then of each destination among those."""
    a, b = Window.partitionBy("src").orderBy(F.desc("w"), "dst"), Window.partitionBy("dst").orderBy(F.desc("w"), "src")
    first = edges.withColumn("r", F.row_number().over(a)).where(F.col("r") <= per_src)
    return first.withColumn("r", F.row_number().over(b)).where(F.col("r") <= per_dst).drop("r")


def backfill_dates(spark: SparkSession, start: str, today: str, lookback: int) -> DataFrame:
    """(O07) Days to fetch, newest first: from the start, but no more than lookback days back."""
    low, high = F.greatest(F.lit(start).cast("date"), F.date_sub(F.lit(today).cast("date"), lookback)), F.lit(today).cast("date")
    days = F.when(low <= high, F.sequence(high, low, F.expr("interval -1 day")))
    return spark.range(1).select(F.explode(days).alias("job_date"))


def backfill_jobs(channels: DataFrame, today: str, lookback: int) -> DataFrame:
    """(O07) channels(channel, start date) -> channel, job_date, place: the days to fetch of each channel, newest first from 0; none where the start lies ahead."""
    high = F.lit(today).cast("date")
    low = F.greatest("start", F.date_sub(high, lookback))
    days = F.when(low <= high, F.sequence(high, low, F.expr("interval -1 day")))
    return channels.where("start is not null").select("channel", F.posexplode(days).alias("place", "job_date"))


def claim(processed: DataFrame, arrived: DataFrame) -> DataFrame:
    """(K08) processed(event_id, status, retry_count) after arrived(event_id) asked for work: claimed tells who may process. What is completed stays, what is known gets one more try."""
    a = arrived.select("event_id").distinct().withColumn("asked", F.lit(True))
    j = processed.join(a, "event_id", "full")
    claimed = F.col("asked") & (F.coalesce("status", F.lit("")) != "completed")
    claimed = F.coalesce(claimed, F.lit(False))
    tries = F.when(F.col("status").isNull(), 0).when(claimed, F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    return j.select("event_id", F.when(claimed, "processing").otherwise(F.col("status")).alias("status"), tries.alias("retry_count"), claimed.alias("claimed"))


def set_visibility(state: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(K16) state(channel, visible), changes(channel, visible, admin, at) -> the new state and an audit row with the old and the new value for each channel."""
    last = latest(changes, ["channel"], ["at", "admin"])
    j = state.withColumnRenamed("visible", "old").join(last, "channel", "full")
    shown = lambda c: F.when(c.isNotNull(), F.to_json(F.struct(c.alias("visible"))))
    audit = j.where("admin is not null").select("admin", F.lit("set_visibility").alias("action"), F.col("channel").alias("target_id"), shown(F.col("old")).alias("old_value"), shown(F.col("visible")).alias("new_value"), F.col("at").alias("created_at"))
    return j.select("channel", F.coalesce("visible", "old").alias("visible")), audit


def rotate_sessions(sessions: DataFrame, used: DataFrame, now: str, days: int) -> DataFrame:
    """(K17) sessions(token, user_id, expires_at): expired ones go, a used token is replaced by a new one of the same user."""
    now_ = F.lit(now).cast("timestamp_ntz")
    live = sessions.where(F.col("expires_at") > now_)
    fresh = live.join(used.select("token").distinct(), "token", "left_semi").select(F.sha2(F.concat_ws("|", "token", F.lit(now)), 256).alias("token"), "user_id", (now_ + F.make_dt_interval(days=F.lit(days))).alias("expires_at"))
    return live.join(used.select("token"), "token", "left_anti").unionByName(fresh)


def audit_page(log: DataFrame, action: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(O09) A page of 1 to 500 rows of the audit log, newest first."""
    found = log if action is None else log.where(F.col("action") == action)
    return found.orderBy(F.desc("created_at"), F.desc("id")).offset(max(0, offset)).limit(min(500, max(1, limit)))


def applied_commands(graph: DataFrame, commands: DataFrame, applied: DataFrame) -> DataFrame:
    """(N17) graph(id, count, first_seen, last_seen) after commands(idempotency_key, id, increment, at): each key counts once, also if it was applied before."""
    new = first_per_key(commands, ["idempotency_key"], ["at", "id"]).join(applied.select("idempotency_key"), "idempotency_key", "left_anti")
    folded = new.groupBy("id").agg(F.sum("increment").alias("more"), F.min("at").alias("low"), F.max("at").alias("high"))
    j = graph.join(folded, "id", "full")
    return j.select("id", (F.coalesce("count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("count"), F.least("first_seen", "low").alias("first_seen"), F.greatest("last_seen", "high").alias("last_seen"))
