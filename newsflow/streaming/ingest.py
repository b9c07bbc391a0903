"""Streaming ingest (T01-T14): decode, reject, deduplicate, write once.

At-least-once input becomes exactly-once output: the checkpoint holds the offsets, and every
micro-batch replaces its own partition, so a batch that runs again leaves the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from newsflow.operators import first_source
from newsflow.sources import events


def deduplicated(messages: DataFrame, days: int = 7) -> DataFrame:
    """(T03) One row per event within the retention time; works on streams and on batches."""
    if messages.isStreaming:
        return messages.withWatermark("event_timestamp", f"{days} days").dropDuplicatesWithinWatermark(["event_id"])
    return messages.dropDuplicates(["event_id"])


def start(raw: DataFrame, out: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] = lambda df: df, trigger: dict | None = None) -> list[StreamingQuery]:
    """(T01, T05, T08) Two queries on one source: messages to out/messages, the rest to out/rejected. Each has its own checkpoint."""

    def sink(df: DataFrame, name: str) -> StreamingQuery:
        def write(part: DataFrame, batch_id: int) -> None:
            part.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/{name}")

        return df.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**(trigger or {"availableNow": True})).start()

    decoded = events.decode(raw)
    return [sink(enrich(deduplicated(events.valid(decoded))), "messages"), sink(events.rejected(decoded), "rejected")]


def with_upstream(stream: DataFrame, table: DataFrame) -> DataFrame:
    """(T07) Stream joined to a static table on channel and message; rows without a partner are marked for another try."""
    known = table.select("channel", "message_id", F.lit(True).alias("known")).dropDuplicates(["channel", "message_id"])
    return stream.join(known, ["channel", "message_id"], "left").withColumn("missing_upstream", F.col("known").isNull()).drop("known")


def with_late_upstream(stream: DataFrame, upstream: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """(T07) stream(channel, message_id, at, ...) with its upstream row(channel, message_id, at), which may come up to ``wait`` before or after it.

    Both sides may be streams: a row waits in the join's state until its partner comes, and is
    given up, with missing_upstream set, when the watermark has passed its time and the wait.
    Several partners give one row each on streams; a stream of them should be deduplicated.
    """
    other = upstream.select(F.col("channel").alias("_channel"), F.col("message_id").alias("_message_id"), F.col("at").alias("upstream_at"))
    if stream.isStreaming:
        stream, other = stream.withWatermark("at", wait), other.withWatermark("upstream_at", wait)
    else:
        other = other.dropDuplicates(["_channel", "_message_id"])
    near = F.expr(f"upstream_at >= at - interval {wait} and upstream_at <= at + interval {wait}")
    joined = stream.join(other, (F.col("channel") == F.col("_channel")) & (F.col("message_id") == F.col("_message_id")) & near, "left")
    return joined.withColumn("missing_upstream", F.col("upstream_at").isNull()).drop("_channel", "_message_id")


def start_clustering(
    stream: DataFrame, folder: str, checkpoint: str, cluster: Callable[[DataFrame], DataFrame], least: int = 50, seconds: int = 30, most: int = 100_000, trigger: dict | None = None
) -> StreamingQuery:
    """(T09, C01) A stream of messages(event_id, ...) into folder/pending, and from there in runs into folder/assigned.

    After each micro-batch a run is due when ``least`` rows are pending or the oldest waits for
    ``seconds``; runs of up to ``most`` rows, oldest first, follow until nothing is pending.
    Micro-batches come one at a time, so there is one run at a time. cluster(messages) gives
    rows with event_id. A batch that is done again replaces its own rows; what a run has assigned
    isn't pending any more, and run_id is a hash of its ids, so a run that is done again
    replaces itself.
    """

    def step(part: DataFrame, batch_id: int) -> None:
        spark = part.sparkSession
        dynamic = lambda df, name, by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{folder}/{name}")
        dynamic(part.withColumns({"arrived": F.current_timestamp(), "batch_id": F.lit(batch_id)}), "pending", "batch_id")
        running = False
        while True:
            waiting = spark.read.parquet(f"{folder}/pending").dropDuplicates(["event_id"])
            if _exists(spark, f"{folder}/assigned"):
                waiting = waiting.join(spark.read.parquet(f"{folder}/assigned").select("event_id"), "event_id", "left_anti")
            n, age = waiting.agg(F.count("*"), F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.min("arrived"))).first()
            if not n or not running and n < least and age < seconds:
                return
            running = True
            chosen = waiting.orderBy("arrived", "event_id").limit(most).checkpoint()
            run = chosen.agg(F.concat(F.lit("run_"), F.substring(F.sha1(F.concat_ws("|", F.sum(F.xxhash64("event_id").cast("decimal(38,0)")), F.count("*"), F.min("event_id"), F.max("event_id"))), 1, 12))).first()[0]
            dynamic(cluster(chosen.drop("arrived", "batch_id")).withColumn("run_id", F.lit(run)), "assigned", "run_id")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def start_resolution(
    assigned: DataFrame, messages: Callable[[], DataFrame], folder: str, checkpoint: str, most: int = 20, trigger: dict | None = None
) -> StreamingQuery:
    """(T11, R09) A stream of assigned(event_id, public_cluster_id, cluster_id) into folder/resolutions and folder/links.

    After each micro-batch (every 300 seconds, say, as the trigger has it) the topics without an
    exact or an inferred resolution are resolved, ``most`` at once, until none is left.
    messages() reads all messages as ``first_source.exact_sources`` takes them. Each topic is a
    partition of both tables and is written as a whole, so a batch that is done again leaves the
    same tables.
    """

    def step(part: DataFrame, batch_id: int) -> None:
        spark = part.sparkSession
        write = lambda df, name, by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{folder}/{name}")
        write(part.select("event_id", "public_cluster_id", "cluster_id").dropDuplicates(["event_id"]).withColumn("batch_id", F.lit(batch_id)), "assigned", "batch_id")
        known = spark.read.parquet(f"{folder}/assigned").dropDuplicates(["event_id"])
        while True:
            done = spark.read.parquet(f"{folder}/resolutions") if _exists(spark, f"{folder}/resolutions") else spark.createDataFrame([], "public_cluster_id string, resolution_kind string")
            topics = first_source.pending(known, done, most).checkpoint()
            if topics.isEmpty():
                return
            everything = messages().drop("public_cluster_id")
            m = everything.join(known.join(topics, "public_cluster_id", "left_semi").select("event_id", "public_cluster_id"), "event_id").checkpoint()
            exact, inferred = first_source.exact_sources(m, everything).checkpoint(), first_source.inferred_sources(m)
            strict = first_source.cluster_exact(exact).withColumn("resolution_kind", F.lit("exact"))
            likely = first_source.cluster_inferred(m).withColumns({"source_type": F.lit("earliest_in_cluster"), "resolution_kind": F.lit("inferred")})
            write(first_source.propagation_links(exact, inferred), "links", "public_cluster_id")
            # topics whose messages are unknown are resolved, too: to nothing
            kinds = topics.withColumn("resolution_kind", F.explode(F.array(F.lit("exact"), F.lit("inferred"))))
            write(kinds.join(strict.unionByName(likely), ["public_cluster_id", "resolution_kind"], "left"), "resolutions", "public_cluster_id")

    return assigned.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def windowed(stream: DataFrame, ts: str = "ts", every: str = "6 hours", late: str = "1 day", *keys: str) -> DataFrame:
    """Event-time counts with a watermark: an extension, since readers only know calendar buckets."""
    grouped = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return grouped.groupBy(F.window(ts, every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), *keys, "n")


def sessions(stream: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 day", *keys: str) -> DataFrame:
    """Event-time sessions, an extension as well."""
    grouped = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return grouped.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), *keys, "n")


def job_states(log: DataFrame, most_attempts: int = 3) -> DataFrame:
    """(T14, T04) log(channel, job_date, at, outcome) -> state of each job: the last outcome decides, failures retry up to most_attempts."""
    g = log.groupBy("channel", "job_date").agg(F.max_by("outcome", "at").alias("last"), F.count_if(F.col("outcome") == "failed").alias("failures"))
    state = F.when(F.col("last") == "completed", "completed").when(F.col("last") == "running", "running").when((F.col("last") == "failed") & (F.col("failures") < most_attempts), "retrying").when(F.col("last") == "failed", "failed").otherwise("pending")
    backoff = F.when(state == "retrying", F.least(F.lit(30), F.pow(F.lit(2), F.col("failures") - 1))).cast("int")
    return g.select("channel", "job_date", state.alias("state"), "failures", backoff.alias("wait_seconds"))


def pick_jobs(states: DataFrame) -> DataFrame:
    """(W04, F10) The next job of each channel without a running one: the newest day first."""
    busy = states.where("state = 'running'").select("channel").distinct()
    open_ = states.where("state in ('pending', 'retrying')").join(busy, "channel", "left_anti")
    return open_.groupBy("channel").agg(F.max("job_date").alias("job_date"))


def progress(states: DataFrame) -> DataFrame:
    """(K11, X20) Status of each channel from its jobs."""
    n = lambda s: F.count_if(F.col("state") == s)
    g = states.groupBy("channel").agg(F.count("*").alias("total"), n("completed").alias("completed"), n("failed").alias("failed"), n("running").alias("running"), F.min(F.when(F.col("state") == "completed", F.col("job_date"))).alias("last_date"))
    status = F.when(F.col("running") > 0, "backfilling").when(F.col("completed") == F.col("total"), "ready").when(F.col("failed") > 0, "partial").otherwise("pending")
    return g.withColumn("status", status)


def replay(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file source as a stream, for tests and backfills (T11: run it with availableNow)."""
    return spark.readStream.schema(schema).json(path)


def processing_id(consumer: str, event: Column) -> Column:
    """(T02) Consumers that share a table of processed events don't meet in it."""
    return F.concat_ws(":", F.lit(consumer), event)


def backoff(attempt: Column, most: int = 30) -> Column:
    """(T04) Seconds before the next attempt: doubled each time."""
    return F.least(F.lit(most), F.pow(F.lit(2), attempt)).cast("int")


def due(pending: DataFrame, now: str, least: int = 50, seconds: int = 30) -> DataFrame:
    """(T09) pending(key, at) -> whether a run is due: enough rows or an old one. As a stream: trigger(processingTime), one batch at a time."""
    age = F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))
    return pending.groupBy("key").agg(F.count("*").alias("n"), ((F.count("*") >= least) | (age >= seconds * 1_000_000)).alias("due"))


def latencies(events_: DataFrame, begun: str, done: str, *keys: str) -> DataFrame:
    """(T12) Number, mean and greatest seconds between two times."""
    micros = F.unix_micros(F.col(done).cast("timestamp")) - F.unix_micros(F.col(begun).cast("timestamp"))
    return events_.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(micros) / F.count("*") / 1e6).alias("mean_seconds"), (F.max(micros) / 1e6).alias("max_seconds"))


class Metrics(StreamingQueryListener):
    """(T12) Rows, rates and event-time lag of every micro-batch, kept by query id for whoever exports them."""

    def __init__(self) -> None:
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.last[str(event.id)] = {"batches": 0, "rows": 0}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        own = self.last.setdefault(str(p.id), {"batches": 0, "rows": 0})
        own |= {"batches": own["batches"] + 1, "rows": own["rows"] + p.numInputRows, "rate": p.processedRowsPerSecond, "watermark": dict(p.eventTime).get("watermark")}

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.last.setdefault(str(event.id), {"batches": 0, "rows": 0})["error"] = event.exception
