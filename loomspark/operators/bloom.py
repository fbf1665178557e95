"""A Bloom filter as a table of pages, joined by page number.

A key falls into one 64-bit word of the filter (by its hash) and sets four of
its bits; PAGE words make a row. The filter is an ordinary DataFrame made by
grouping; a broadcast equi-join on the page number tests a key. Its size
follows the number of keys up to a stated memory: FILTER_BYTES, which is also
what an executor holds. Beyond that the filter only lets more keys through;
``let_through`` says how many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a page (8 KB), and the most memory that a filter takes.
PAGE, FILTER_BYTES = 1024, 128 << 20
KEYS_PER_WORD, BITS = 4, 4


def blocks_for(n_keys: int, most_bytes: int = FILTER_BYTES) -> int:
    """The number of words: a power of two, about one for KEYS_PER_WORD keys, at most ``most_bytes`` in all."""
    want = max(1, -(-n_keys // KEYS_PER_WORD))
    return min(max(16, most_bytes // 8), max(16, 1 << (want - 1).bit_length()))


def let_through(n_keys: int, blocks: int) -> float:
    """The expected share of absent keys that a filter of so many words lets through."""
    mean = n_keys / blocks
    most = int(mean + 12 * math.sqrt(mean) + 30)
    share, p = 0.0, math.exp(-mean) if mean < 700 else 0.0
    for k in range(most + 1):
        share += p * (1 - (1 - 1 / 64) ** (BITS * k)) ** BITS
        p *= mean / (k + 1)
    return share if mean < 700 else 1.0


def _word(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1).cast("bigint"))


def _mask(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(7))
    mask = F.lit(0).cast("bigint")
    for i in range(BITS):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return mask


def bloom_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_bloom_page, _bloom_words) of the keys that aren't null; words that no key sets are 0."""
    k = F.col(key)
    page = min(PAGE, blocks)
    words = keys.where(k.isNotNull()).select(_word(k, blocks).alias("w"), _mask(k).alias("m"))
    every = keys.sparkSession.range(blocks).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("m"))
    return (
        words.groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .unionByName(every)
        .groupBy("w")
        .agg(F.bit_or("m").alias("m"))
        .groupBy(F.floor(F.col("w") / page).alias("_bloom_page"))
        .agg(F.array_sort(F.collect_list(F.struct("w", "m"))).alias("p"))  # exactly ``page`` entries
        .select("_bloom_page", F.transform("p", lambda x: x["m"]).alias("_bloom_words"))
    )


def with_maybe(df: DataFrame, key: str, bloom: DataFrame, blocks: int, flag: str = "_maybe") -> DataFrame:
    """Adds a boolean: false if the key is certainly not in the filter. A null key is never in it.

    ``bloom`` is broadcast: it holds 8 * ``blocks`` bytes, at most FILTER_BYTES.
    """
    if 8 * blocks > FILTER_BYTES:
        raise ValueError("the filter is larger than what may be broadcast")
    k = F.col(key)
    page = min(PAGE, blocks)
    word = F.get("_bloom_words", F.pmod(F.col("_bloom_at"), F.lit(page)).cast("int"))
    hit = word.bitwiseAND(_mask(k)) == _mask(k)
    return (
        df.withColumn("_bloom_at", _word(k, blocks))
        .withColumn("_bloom_page", F.floor(F.col("_bloom_at") / page))
        .join(F.broadcast(bloom), "_bloom_page", "left")
        .withColumn(flag, F.coalesce(hit & k.isNotNull(), F.lit(False)))
        .drop("_bloom_page", "_bloom_words", "_bloom_at")
    )
