"""Measures of a running service."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS, Config
from loomspark.session import small, stored


def rate_limited(events: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """Adds ``allowed`` to events (event_id, user, ts in seconds): a sliding window and a burst limit that count allowed events only.

    The decision depends on earlier decisions, but only of the last window:
    a gap of a window or more without events clears the state. Runs between
    such gaps are independent of each other, and those within both limits need
    no walk; the rest is walked in order, so a busy user is many runs.
    A null or blank user is 'anonymous'; events without a time are left out.
    """
    user = F.when(F.trim("user") == "", None).otherwise(F.col("user"))
    rows = events.where("ts IS NOT NULL").select("event_id", F.coalesce(user, F.lit("anonymous")).alias("user"), "ts")
    order = Window.partitionBy("user").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(order) < config.rate_window_s, 0).otherwise(1)
    runs = rows.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(order)).drop("_f")
    sized = runs.withColumn("_n", F.count("*").over(Window.partitionBy("user", "run")))
    short = F.col("_n") <= min(config.rate_limit, config.rate_burst)
    plain = sized.where(short).select("event_id", "user", F.lit(True).alias("allowed"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, allowed_at = None, deque()
        for pdf in batches:
            verdicts = []
            for user, run, t in zip(pdf["user"], pdf["run"], pdf["ts"], strict=True):
                if (user, run) != key:
                    key, allowed_at = (user, run), deque()
                while allowed_at and allowed_at[0] <= t - config.rate_window_s:
                    allowed_at.popleft()
                burst = sum(x > t - 1 for x in islice(reversed(allowed_at), config.rate_burst))
                ok = len(allowed_at) < config.rate_limit and burst < config.rate_burst
                if ok:
                    allowed_at.append(t)
                verdicts.append(ok)
            yield pdf[["event_id", "user"]].assign(allowed=verdicts)

    # runs are streamed through a task in order; its state is one window of one user
    long = sized.where(~short).repartition("user", "run").sortWithinPartitions("user", "run", "ts", "event_id")
    return plain.unionByName(long.select("event_id", "user", "run", "ts").mapInPandas(decide, "event_id bigint, user string, allowed boolean"))


def exact_quantile(df: DataFrame, key: str, value: str, q: float, accuracy: int = 10_000) -> DataFrame:
    """(key, quantile): the interpolated quantile of the values of each key; null where it has no value.

    A sketch gives two values between which the quantile must lie; counted
    are the values below, and only what lies between is sorted, equal values
    as one row. So a hot key is never sorted or held as a whole.
    """
    v = df.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    e = 3 / accuracy
    bounds = stored(v.groupBy("_k").agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", F.lit(max(0.0, q - e)), F.lit(accuracy)).alias("_lo"),
        F.percentile_approx("_v", F.lit(min(1.0, q + e)), F.lit(accuracy)).alias("_hi"),
    ), "bounds")
    limits = bounds.select(F.col("_k").alias("_r"), "_lo", "_hi")
    near = v.join(small(limits), F.col("_k").eqNullSafe(F.col("_r")))
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    near = near.where("_v IS NOT NULL").withColumns({"_side": side, "_x": F.when(side == 0, F.col("_v"))})
    # what lies below or above is one row with its number and the value next to the bounds
    counted = near.groupBy("_k", "_side", "_x").agg(F.count("*").alias("_c"), F.max("_v").alias("_most"), F.min("_v").alias("_least"))
    at = F.when(F.col("_side") > 0, F.col("_least")).otherwise(F.col("_most"))
    upto = F.sum("_c").over(Window.partitionBy("_k").orderBy("_side", "_x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select("_k", at.alias("_at"), upto.alias("_upto"))
    place = (F.col("_n") - 1) * F.lit(q)
    j = bounds.join(ranked.withColumnRenamed("_k", "_r"), F.col("_k").eqNullSafe(F.col("_r")), "left")
    # values are in order, so the smallest of those that reach a place stands there
    low = F.min(F.when(F.col("_upto") >= F.floor(place) + 1, F.col("_at")))
    high = F.min(F.when(F.col("_upto") >= F.ceil(place) + 1, F.col("_at")))
    out = j.groupBy("_k", "_n").agg(low.alias("_a"), high.alias("_b"))
    return out.select(F.col("_k").alias(key), (F.col("_a") + (F.col("_b") - F.col("_a")) * (place - F.floor(place))).alias("quantile"))
