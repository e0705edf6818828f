"""Online counters as Structured Streaming queries."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.session import shared_dir
from corpusloom.sources.tables import table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    # a glob: the path may be a file or a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def daily_counts(events: DataFrame) -> DataFrame:
    """Counts and sums by day and type; a day closes an hour after its end."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    out = w.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, in append mode, into a table of the shared folder; read that back."""
    spark = stream.sparkSession
    folder = os.path.join(shared_dir(spark), "corpusloom", f"{name}-{uuid.uuid4().hex}")
    out = stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


CLOSED_SQL = "WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)"


@query(
    "stream_equals_batch",
    CLOSED_SQL + " SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, m WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= mark GROUP BY ALL",
)
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by an incremental query that gives a day out once the watermark has closed it: all days but the open ones."""
    return run_to_table(daily_counts(event_stream(spark, sf_dir)), "daily")


@query(
    "stream_sessions",
    CLOSED_SQL
    + """, e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e), g AS (SELECT user_id, k, count(*) AS n, max(ts) + INTERVAL 6 HOUR AS stop FROM s GROUP BY ALL)
SELECT user_id, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_events FROM g, m WHERE stop <= mark GROUP BY user_id""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by event time, closed by six hours of silence, as the stream gives them out; the watermark bounds the state."""
    events = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")
    s = events.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "n")
    return run_to_table(s, "sessions").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


@query("stream_replay", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that delivers every event twice, without the second ones: identifiers are remembered as long as the watermark allows."""
    both = event_stream(spark, sf_dir).unionByName(event_stream(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))
    once = both.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")
    return run_to_table(once, "replay").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "sliding_counts",
    "SELECT CAST(d AS DATE) AS first_day, count(*) AS n, round(sum(value), 4) AS total FROM events, unnest([CAST(ts AS DATE), CAST(ts AS DATE) - INTERVAL 1 DAY]) t(d) GROUP BY 1",
)
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days that begin every day."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.to_date("w.start").alias("first_day"), "n", "total")


def online_mean(events: DataFrame, keep_hours: float | None = None) -> DataFrame:
    """The running mean of each user's values, kept as state between batches: (user_id, n, mean) after every batch.

    With ``keep_hours`` (and a watermark on ``ts``) the state of a user without events
    for so long is dropped, and a later one starts anew; so state stays bounded.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        last = 0
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
            last = max(last, int(f["ts"].max().timestamp() * 1000)) if keep_hours else 0
        state.update((n, total))
        if keep_hours:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + int(keep_hours * 3_600_000))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [total / max(1, n)]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, mean double", "n bigint, total double", "update", "EventTimeTimeout" if keep_hours else "NoTimeout")
