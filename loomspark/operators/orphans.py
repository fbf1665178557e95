"""References to records that do not exist (any more, or not yet).

A broadcast Bloom filter of the parents' keys, whose size follows their number
up to a stated memory, proves most keys that never existed to be orphans
without a shuffle. The references that pass the filter are verified
by an exact anti-join against the lives of the parents. Hot keys are found
with a mergeable heavy-hitter sketch and salted, so that no task gets all
references of one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.keys import hex_key
from loomspark.operators.bloom import blocks_for, bloom_table, with_maybe
from loomspark.session import stored

#: The sketch tracks so many keys; a key with more than a TRACKED-th of the references is surely among them.
TRACKED = 10_000
#: At most so many keys are salted; each has at least a SALTED-th of the references, so there can't be more.
SALTED = 500
SALTS = 32


def references(df: DataFrame, name: str, row_key, ref: str, at: str) -> DataFrame:
    """The references of one table as (ref_table, row_key, ref_key, at); null and blank keys refer to nothing."""
    return df.select(
        F.lit(name).alias("ref_table"), row_key.alias("row_key"), hex_key(ref).alias("ref_key"), F.col(at).alias("at")
    ).where(F.col("ref_key").isNotNull())


def lives(df: DataFrame, key: str, born: str, died: str) -> DataFrame:
    """The lives of parents as (ref_key, born, died), copies removed. A life without a start never holds."""
    return df.select(hex_key(key).alias("ref_key"), F.col(born).alias("born"), F.col(died).alias("died")).where(
        F.col("ref_key").isNotNull() & F.col("born").isNotNull()
    )


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys that hold more than a SALTED-th of the rows; at most SALTED."""
    row = df.agg(
        F.count(key).alias("n"), F.expr(f"approx_top_k({key}, {SALTED}, {TRACKED})").alias("top")
    ).first()
    return [r["item"] for r in row["top"] or [] if r["count"] * SALTED > row["n"]]


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` (ref_table, row_key, ref_key, at) that no life in ``parents`` holds.

    A reference holds if a life of the same key has ``born <= at`` and
    ``died`` null or ``> at``. Adds ``proof``: 'filter' if the key was never
    seen, else 'join'. Rows come out as often as they go in. A reference
    without a time never holds. Empty parents: every reference is an orphan;
    empty references: none. Both sides are read once: the lives are written
    without copies, the references with what the filter says of them.
    """
    parents = stored(parents.distinct(), "lives")
    keys = parents.agg(F.approx_count_distinct("ref_key")).first()[0]
    blocks = blocks_for(keys)
    tagged = stored(with_maybe(refs, "ref_key", bloom_table(parents, "ref_key", blocks), blocks), "tagged")
    sure = tagged.where(~F.col("_maybe")).select(*refs.columns, F.lit("filter").alias("proof"))
    maybe = tagged.where("_maybe").drop("_maybe")
    hot = hot_keys(maybe, "ref_key")
    is_hot = F.col("ref_key").isin(hot) if hot else F.lit(False)
    salt = F.when(is_hot, F.pmod(F.xxhash64("row_key", "at"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = parents.select(F.col("ref_key").alias("_key"), "born", "died", F.explode(salts).alias("_s"))
    rest = maybe.withColumn("_salt", salt).join(
        spread,
        (F.col("ref_key") == F.col("_key"))
        & (F.col("_salt") == F.col("_s"))
        & (F.col("born") <= F.col("at"))
        & (F.col("died").isNull() | (F.col("died") > F.col("at"))),
        "left_anti",
    ).select(*refs.columns, F.lit("join").alias("proof"))
    return sure.unionByName(rest)


def orphan_report(refs: DataFrame, found: DataFrame) -> DataFrame:
    """References, orphans and their distinct keys per referring table and month."""
    period = F.date_format("at", "yyyy-MM").alias("period")
    total = refs.groupBy("ref_table", period).agg(F.count("*").alias("n_references"))
    bad = found.groupBy("ref_table", period).agg(
        F.count("*").alias("n_orphans"), F.count_distinct("ref_key").alias("n_orphan_keys")
    )
    left, right = total.alias("a"), bad.alias("b")
    return left.join(
        right, (F.col("a.ref_table") == F.col("b.ref_table")) & F.col("a.period").eqNullSafe(F.col("b.period")), "left"
    ).select(
        "a.ref_table",
        "a.period",
        "n_references",
        F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"),
        F.coalesce("n_orphan_keys", F.lit(0)).alias("n_orphan_keys"),
    )
