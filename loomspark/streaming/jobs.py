"""Streaming forms of the batch operators; with ``availableNow`` they end when the input does."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspark.config import DEFAULTS, Config
from loomspark.operators.sinks import merge_into
from loomspark.operators.sync import latest


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream, with the schema of what lies there now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_metrics(events: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of each kind per window of event time; a window is final once the watermark has passed it."""
    return (
        events.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("w"), F.col(kind).alias("kind"))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), "kind", "n", "total")
    )


def sync_stream(spark: SparkSession, items: DataFrame, base: str, checkpoint: str, keys: list[str], order: str, unique: str):
    """Keeps the newest item of each key in versioned Parquet below ``base``; returns the query.

    Micro-batch n writes version n + 1 over version n, so a batch that is
    delivered again replaces its own version, and the stream's checkpoint,
    which belongs to this folder, is all the state there is.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        changes = latest(batch, keys, F.col(order).desc_nulls_last(), F.col(unique).desc())
        if batch_id:
            # an item that is older than the one already kept doesn't replace it
            old = spark.read.parquet(f"{base}/v{batch_id}").select(*keys, F.col(order).alias("_kept"))
            changes = changes.join(old, keys, "left").where(F.col("_kept").isNull() | (F.col(order) >= F.col("_kept"))).drop("_kept")
        merge_into(spark, base, batch_id, changes, keys)

    return items.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limit_stream(events: DataFrame, config: Config = DEFAULTS, late: str = "1 day") -> DataFrame:
    """(event_id, user, allowed) of a stream (event_id, user, ts in seconds): the rate limiter with state per user.

    The state is the times of the events allowed in the last window; within
    a micro-batch a user's events are taken in order of time. A user's
    state goes once the watermark has passed the last event by a window, when
    it can't decide anything any more; events later than ``late`` and events
    without a time have no row.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        verdicts = []
        for t in pdf["ts"]:
            times = [x for x in times if x > t - config.rate_window_s]
            ok = len(times) < config.rate_limit and sum(x > t - 1 for x in times) < config.rate_burst
            if ok:
                times.append(t)
            verdicts.append(ok)
        state.update((times,))
        state.setTimeoutTimestamp(int((max(pdf["ts"].iloc[-1], *times, 0.0) + config.rate_window_s) * 1000) + 1)
        yield pdf[["event_id"]].assign(user=key[0], allowed=verdicts)[["event_id", "user", "allowed"]]

    # a stream's first watermark is 1970; what isn't later would be late
    at = F.greatest(F.timestamp_seconds("ts"), F.timestamp_seconds(F.lit(0.001)))
    timed = events.where("ts IS NOT NULL").withColumn("at", at).withWatermark("at", late)
    return timed.groupBy("user").applyInPandasWithState(
        decide, "event_id bigint, user string, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is available into a table in memory; for tests and small reports."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def each_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``work`` on every micro-batch of what is available."""
    return df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
