"""Event logs as streams: failure streaks, idle sessions, deadline alerts, append-only sinks.

Batch twins are in ``operators.ordered``; tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T


def failure_streaks(events: DataFrame, limit: int = 5) -> DataFrame:
    """``user_id, event_id, streak, locks`` for each failure of ``events(user_id, event_id, ts, failed, reset)``.

    The state of a user is one number, and none is kept while the streak is zero. Within a micro-batch rows are taken in the order of time and id; across
    batches in the order of arrival.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        out = []
        # the four columns that count, of one user in one micro-batch
        for _, event, failed, reset in sorted(r for b in batches for r in zip(b["ts"], b["event_id"], b["failed"], b["reset"], strict=True)):
            streak = 0 if reset else streak
            if failed:
                streak += 1
                out.append((key[0], event, streak, streak == limit))
        if streak:
            state.update((streak,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "streak", "locks"])

    return events.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, streak long, locks boolean", "streak long", "append", GroupStateTimeout.NoTimeout
    )


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions closed by silence, emitted once the watermark has passed them."""
    own = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return own.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def deadline_alerts(items: DataFrame, as_of: str, days: tuple[int, ...] = (7, 3, 1)) -> DataFrame:
    """Pending ``items(item_id, due, pending)`` due in so many days of a stated day; (item, days) is the key that keeps reruns from alerting twice."""
    left = F.datediff(F.col("due"), F.lit(as_of).cast("date"))
    return items.where("pending").select("item_id", left.alias("days_left")).where(F.col("days_left").isin(*days))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything available, appended to Parquet exactly once."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


AGENT = 255


def login_rows(logins: DataFrame) -> DataFrame:
    """Rows of the login log from ``logins(user_id, ts, forwarded, peer, agent, success)``: the client's address, and the agent cut to ``AGENT`` characters."""
    return logins.select("user_id", "ts", T.client_ip(F.col("forwarded"), F.col("peer")).alias("ip"), F.substring(F.coalesce("agent", F.lit("")), 1, AGENT).alias("agent"), "success")


#: Buckets of notifications; a batch reads those that its keys fall into.
BUCKETS = 64


def notify(alerts: DataFrame, path: str, checkpoint: str, keys: list[str], opted_out: DataFrame | None = None) -> StreamingQuery:
    """Appends alerts to a table of notifications, each key once however often a batch is run or a day is repeated.

    The table is parted by ``bucket``, a hash of the keys, and a batch looks for sent ones in its own buckets only.
    ``opted_out`` holds who wants which alerts no more, by columns that the alerts have (a user, or a user and a kind).
    """

    def send(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        if opted_out is not None:
            batch = batch.join(opted_out.distinct(), opted_out.columns, "left_anti")
        new = batch.dropDuplicates(keys).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            here = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most BUCKETS
            sent = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(here))
            new = new.join(sent.select(*keys), keys, "left_anti")
        new.write.mode("append").partitionBy("bucket").parquet(path)

    return alerts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale_jobs(jobs: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """``job_id, started`` of ``jobs(job_id, ts, status)`` that have been processing for ``minutes`` when the watermark passes.

    A job's state is its start; any other status ends it, and a job that starts again begins anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["job_id", "started"]
        if state.hasTimedOut:
            started = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "started": [pd.Timestamp(started, unit="us")]}, columns=names)
            return
        started = state.get[0] if state.exists else None
        for b in batches:
            for ts, status in b.sort_values("ts")[["ts", "status"]].itertuples(index=False):
                started = int(ts.value // 1000) if status == "processing" else None
        if started is not None:
            state.update((started,))
            state.setTimeoutTimestamp(max(started // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"job_id": [], "started": []}, columns=names)

    own = jobs.withWatermark("ts", late).groupBy("job_id")
    return own.applyInPandasWithState(step, "job_id long, started timestamp", "started long", "append", GroupStateTimeout.EventTimeTimeout)
