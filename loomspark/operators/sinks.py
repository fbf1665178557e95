"""Writes: immutable versions, artefacts, and keyed tables that are replaced as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.sync import upserted


def write_immutable(df: DataFrame, path: str) -> None:
    """Writes a version once; a path that exists is an error, never overwritten."""
    df.write.mode("errorifexists").parquet(path)


def write_mutable(df: DataFrame, path: str, key: str) -> None:
    """Replaces what lies at the key, but a raw version (four parts, the last ``raw.bin``) is written once."""
    parts = [p for p in key.split("/") if p]
    raw = len(parts) == 4 and parts[-1] == "raw.bin"
    df.write.mode("errorifexists" if raw else "overwrite").parquet(f"{path}/{'/'.join(parts)}")


def verified_contents(df: DataFrame, content: str = "content", checksum: str = "checksum") -> DataFrame:
    """Adds ``intact``: whether the content has the checksum that it should have. A null checksum or content isn't intact."""
    return df.withColumn("intact", F.coalesce(F.sha2(content, 256) == F.lower(checksum), F.lit(False)))


def write_artifacts(df: DataFrame, path: str) -> None:
    """One JSON line for each row."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.mode("errorifexists").text(path)


def merge_into(spark: SparkSession, base: str, version: int, changes: DataFrame, keys: list[str]) -> int:
    """Puts changes over version ``version`` of a keyed table and writes the next one beside it; returns its number.

    Readers keep the old version until they are given the new number, and a
    failed write leaves nothing that is read. Writing a version that exists
    gives the same rows again, so a repeated batch changes nothing.
    """
    new = upserted(spark.read.parquet(f"{base}/v{version}"), changes, keys) if version else changes
    new.write.mode("overwrite").parquet(f"{base}/v{version + 1}")
    return version + 1
