"""State of conversations, from their turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS, Config


def leading_run(df: DataFrame, key: str, at: Column, tie: Column, condition: Column, newest: int = 10) -> DataFrame:
    """(key, run): how many of the newest rows in a row meet the condition, at most ``newest``."""
    order = Window.partitionBy(key).orderBy(at.desc(), tie)
    rows = df.select(key, F.row_number().over(order).alias("r"), F.coalesce(condition, F.lit(False)).alias("ok")).where(F.col("r") <= newest)
    broken = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy(key).orderBy("r"))
    return rows.withColumn("b", broken).groupBy(key).agg(F.count_if(F.col("b") == 0).alias("run"))


def trimmed_history(df: DataFrame, key: str, position: str, tokens: str, config: Config = DEFAULTS) -> DataFrame:
    """(key, position): the newest turns that fit the budget; one that doesn't fit is skipped, older ones may still fit."""
    newest = Window.partitionBy(key).orderBy(F.col(position).desc())
    rows = df.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= config.history_turns)
    arr = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", F.col(position).alias("p"), F.col(tokens).cast("bigint").alias("n")))).alias("ts"))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(acc, t):
        fits = acc["n"] + t["n"] <= config.history_tokens
        return F.struct(
            F.when(fits, acc["n"] + t["n"]).otherwise(acc["n"]).alias("n"),
            F.when(fits, F.concat(acc["out"], F.array(t["p"].cast("bigint")))).otherwise(acc["out"]).alias("out"),
        )

    return arr.select(key, F.explode(F.aggregate("ts", zero, step, lambda a: a["out"])).alias(position))


def sessions(df: DataFrame, key: str, at: str, minutes: int) -> DataFrame:
    """(key, session, started, ended, n): runs of rows whose gaps are at most so many minutes."""
    order = Window.partitionBy(key).orderBy(at)
    gap = F.col(at).cast("double") - F.lag(F.col(at).cast("double")).over(order)
    starts = F.when(gap.isNull() | (gap > minutes * 60), 1).otherwise(0)
    rows = df.select(key, at, starts.alias("_s")).withColumn("session", F.sum("_s").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"))
