"""Incremental synchronisation of sources, as joins of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order given, which should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def fetch_decisions(listed: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``fetch`` and ``reason`` to listed items (keys, modified, checksum) against the state (keys, seen_modified, seen_checksum).

    Fetched are items without a state, with a later time, or with another
    checksum that isn't null; nulls decide nothing.
    """
    s = state.select(*keys, "seen_modified", "seen_checksum", F.lit(True).alias("_known"))
    j = listed.join(s, keys, "left")
    reason = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("seen_modified").isNull() | (F.col("modified") > F.col("seen_modified")), "modified")
        .when(F.col("checksum").isNotNull() & ~F.col("checksum").eqNullSafe(F.col("seen_checksum")), "checksum")
        .otherwise("unchanged")
    )
    return j.withColumn("reason", reason).withColumn("fetch", F.col("reason") != "unchanged").drop("_known")


def tombstones(known: DataFrame, listed: DataFrame, complete: DataFrame, keys: list[str], scope: str) -> DataFrame:
    """Known keys that a complete listing of their scope no longer has; an incomplete listing deletes nothing."""
    authoritative = complete.where("listing_complete").select(scope).distinct()
    return known.select(*keys).distinct().join(listed.select(*keys).distinct(), keys, "left_anti").join(authoritative, scope, "left_semi")


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The current rows with the changes put over them; both have the same columns, changes are unique by key."""
    kept = current.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes)


def survivors(df: DataFrame, keys: list[str], id_column: str, *order: Column) -> DataFrame:
    """(id, keep_id): every row's id and the id of the first row of its key; rows are relinked through this mapping."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(F.col(id_column).alias("id"), F.first(id_column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("keep_id"))


def inserted(current: DataFrame, new: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Adds ``kept_id`` and ``created`` to the rows of ``new`` (keys, id): insert if the key is new, else the id that is there.

    Of new rows with one key the smallest id is inserted. Keys are compared
    with nulls equal; ``current`` (keys, id) may hold a key several times, the
    smallest id counts. Both sides are aggregated to one row for each key, so
    a hot key meets one row. New rows without an id are left out where their key has none.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    mine = [f"_k{i}" for i in range(len(keys))]
    # the stored ids count before the new ones
    both = current.select(*named, F.col(id_column).alias("_old"), F.lit(None).cast(new.schema[id_column].dataType).alias("_new")).unionByName(
        new.select(*named, F.lit(None).cast(new.schema[id_column].dataType).alias("_old"), F.col(id_column).alias("_new"))
    )
    kept = both.groupBy(*mine).agg(F.min("_old").alias("_old"), F.min("_new").alias("_new")).where("_new IS NOT NULL")
    same = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, mine, strict=True)]
    rows = new.join(kept, same).withColumn("kept_id", F.coalesce("_old", "_new"))
    return rows.withColumn("created", F.col("_old").isNull() & (F.col(id_column) == F.col("_new"))).drop(*mine, "_old", "_new")


def without_duplicates(df: DataFrame, mapping: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Rows less those that a mapping (keys, id, keep_id) replaces by another."""
    gone = mapping.where("id <> keep_id").select(*keys, F.col("id").alias(id_column))
    return df.join(gone, [*keys, id_column], "left_anti")
