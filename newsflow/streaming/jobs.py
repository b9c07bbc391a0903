"""Jobs of a backfill as a stateful stream (T14, T04): states, retries with backoff, leases.

The input is a log of what happened to jobs; the output has one row for each transition. Each
channel is a key with the states of its jobs, and a timer for each backoff, so a retry comes
due when its time has passed and not when the next row happens to come. ``ingest.job_states``
folds the same log at once; the last transitions of the stream are its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRANSITIONS = "channel string, job_date string, at long, state string, failures int, wait_seconds int, event string"


def stateful(spark: SparkSession) -> SparkSession:
    """Keyed states with timers need the state store that keeps them on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class JobMachine(StatefulProcessor):
    """The jobs of one channel. Times are microseconds; a job's state, failures, time of its last row, time at which a retry is due (0 without) and priority are kept by job_date."""

    def __init__(self, most_attempts: int, most_wait: int, lease: bool):
        self.most_attempts, self.most_wait, self.lease = most_attempts, most_wait, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_date string", "state string, failures int, at long, due long, priority int")

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame([(key[0], *row) for row in out], columns=[c.split()[0] for c in TRANSITIONS.split(", ")])
        yield frame.astype({"failures": "Int32", "wait_seconds": "Int32", "at": "int64"})

    def _lease(self, now: int) -> list[tuple]:
        """The next job of a channel without a running one: by priority, then the newest day."""
        held = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        if not self.lease or any(v[0] == "running" for v in held.values()):
            return []
        open_ = [(v[4], day) for day, v in held.items() if v[0] == "pending" or v[0] == "retrying" and v[3] <= now]
        if not open_:
            return []
        day = max(open_)[1]
        _, failures, at, _, priority = held[day]
        self.jobs.updateValue((day,), ("running", failures, max(at, now), 0, priority))
        return [(day, max(at, now), "running", failures, None, "leased")]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out, now = [], 0
        for row in pd.concat(list(rows)).sort_values(["at_us", "job_date"]).itertuples():
            day, now = (row.job_date,), max(now, int(row.at_us))
            state, failures, at, due, priority = tuple(self.jobs.getValue(day)) if self.jobs.containsKey(day) else ("pending", 0, -1, 0, 0)
            priority = priority if pd.isna(row.priority) else int(row.priority)
            failures += row.outcome == "failed"
            wait, event = None, row.outcome
            if row.at_us >= at:  # a row that comes late counts as a failure, but decides nothing
                at, due = int(row.at_us), 0
                if row.outcome in ("completed", "running"):
                    state = row.outcome
                elif row.outcome != "failed":
                    state = "pending"
                else:
                    state = "failed" if failures >= self.most_attempts or row.permanent is True else "retrying"
                    event = "dead_letter" if state == "failed" else event
            elif state == "retrying" and failures >= self.most_attempts:
                state, due, event = "failed", 0, "dead_letter"
            if state == "retrying":
                wait = min(self.most_wait, 2 ** (failures - 1))
                due = at + wait * 1_000_000
                self.handle.registerTimer(due // 1000)
            self.jobs.updateValue(day, (state, failures, at, due, priority))
            out.append((row.job_date, at, state, failures, wait, event))
        yield from self._rows(key, out + self._lease(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999, []
        for day, value in list(self.jobs.iterator()):
            state, failures, _, due, _ = tuple(value)
            if state == "retrying" and 0 < due <= now:
                out.append((day[0], due, state, failures, 0, "due"))
        yield from self._rows(key, out + self._lease(now) if out else [])


def job_stream(log: DataFrame, most_attempts: int = 5, most_wait: int = 30, late: str = "0 seconds", lease: bool = False) -> DataFrame:
    """log(channel, job_date, at, outcome, permanent, priority), a stream -> a row for each transition of a job.

    Outcomes: planned, running, completed, failed. A failure is retried after 1, 2, 4, ... up to
    ``most_wait`` seconds (event ``due``), the ``most_attempts``-th or a permanent one is the
    last (event ``dead_letter``). With ``lease`` the machine itself starts the next job of a
    channel that has none running (event ``leased``). Rows without a channel, day or time are left out.
    """
    stateful(log.sparkSession)
    rows = log.where("channel is not null and job_date is not null and at is not null").withWatermark("at", late)
    rows = rows.select("at", "channel", F.col("job_date").cast("string").alias("job_date"), F.unix_micros("at").alias("at_us"), "outcome", "permanent", F.col("priority").cast("int").alias("priority"))
    return rows.groupBy("channel").transformWithStateInPandas(JobMachine(most_attempts, most_wait, lease), TRANSITIONS, "Append", "EventTime")


def last_states(transitions: DataFrame) -> DataFrame:
    """Transitions that a stream has written -> the state of each job, as ``ingest.job_states`` gives it."""
    rows = transitions.where("event <> 'due'").groupBy("channel", "job_date").agg(F.max_by(F.struct("state", "failures", "wait_seconds"), F.struct("at", "failures")).alias("s"))
    return rows.select("channel", "job_date", "s.*")
