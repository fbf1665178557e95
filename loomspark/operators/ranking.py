"""Scoring and ranking of candidates, many queries at once.

A candidate is a row (query, chunk, raw scores). Everything that a single
query does with its whole list is a window or a group over the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS, Config
from loomspark.functions.vectors import unit


def term_overlap(pairs: DataFrame, questions: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, chunk, overlap) of every pair: the sum over the question's distinct terms of the smaller count on either side, over their number.

    ``questions`` (query, terms) and ``texts`` (chunk, terms), arrays; pairs
    without either have no row, a question without terms has 0. Terms are
    counted once a question and once a text and meet in a join, so the cost
    is linear in the texts.
    """
    q = questions.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count("*").alias("_q"))
    t = texts.select("chunk", F.explode("terms").alias("term")).groupBy("chunk", "term").agg(F.count("*").alias("_t"))
    both = pairs.join(questions.select("query", F.size(F.array_distinct("terms")).alias("_n")), "query").join(texts.select("chunk"), "chunk")
    common = pairs.join(q, "query").join(t, ["chunk", "term"]).groupBy("query", "chunk").agg(F.sum(F.least("_q", "_t")).alias("_common"))
    return both.join(common, ["query", "chunk"], "left").select(
        "query", "chunk", (F.coalesce("_common", F.lit(0)) / F.greatest(F.lit(1), "_n")).alias("overlap")
    )


def minmax(c: Column, by: list[str]) -> Column:
    """Scaled to [0, 1] within the group; 1 where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((c - lo) / (hi - lo))


def dedup_max(df: DataFrame, keys: list[str], scores: list[str], first: list[str], order: str) -> DataFrame:
    """One row for each key: the largest of each score, the other columns of the row that comes first."""
    return df.groupBy(*keys).agg(
        *(F.max(s).alias(s) for s in scores), *(F.min_by(c, order).alias(c) for c in first), F.count("*").alias("n_rows")
    )


def hybrid_rank(df: DataFrame, query: str, chunk: str, lex: str, vec: str, config: Config = DEFAULTS, preference: str | None = None) -> DataFrame:
    """Adds lex_norm, vec_norm, final and rank to candidates that are unique in (query, chunk).

    Null scores count as 0; lexical scores are floored at 0, vector scores
    clipped to [-1, 1] and moved to [0, 1]; both are scaled within the query.
    Order: final, then preference, descending; then the chunk.
    """
    raw_lex = F.greatest(F.coalesce(F.col(lex), F.lit(0.0)), F.lit(0.0))
    raw_vec = unit(F.coalesce(F.col(vec), F.lit(0.0)))
    out = df.withColumns({"lex_norm": minmax(raw_lex, [query]), "vec_norm": minmax(raw_vec, [query])})
    final = config.weight_vector * F.col("vec_norm") + config.weight_lexical * F.col("lex_norm")
    # differences that are below the rounding would depend on the order of the sums
    out = out.withColumn("final", F.round(final, 9))
    keys = [F.col("final").desc(), *([F.coalesce(preference, F.lit(0)).desc()] if preference else []), F.col(chunk)]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*keys)))


def memory_boosts(trace: DataFrame, conversation: str, config: Config = DEFAULTS) -> DataFrame:
    """(conversation, document, chunk, boost) from the newest trace rows (conversation, document, chunk, used, at, tie).

    Rank counts all rows, the newest is 0; used rows among the first
    ``boost_rows`` give cap * max(floor, 1 - step * rank); repeats keep the
    largest.
    """
    newest = Window.partitionBy(conversation).orderBy(F.col("at").desc(), F.col("tie"))
    r = F.row_number().over(newest) - 1
    return (
        trace.withColumn("_r", r)
        .where((F.col("_r") < config.boost_rows) & F.col("used"))
        .withColumn("boost", config.boost_cap * F.greatest(F.lit(config.boost_floor), 1 - config.boost_step * F.col("_r")))
        .groupBy(conversation, "document", "chunk")
        .agg(F.max("boost").alias("boost"))
    )


def boosted(ranked: DataFrame, boosts: DataFrame, keys: list[str], config: Config = DEFAULTS) -> DataFrame:
    """``ranked`` (query, chunk, final, ...) with ``boosts`` (keys, boost) added to ``final``, at most the cap, and ranked again.

    Adds boost (0 where there is none) and replaces final and rank; order: final descending, then the chunk.
    """
    capped = F.least(F.lit(config.boost_cap), F.coalesce("boost", F.lit(0.0)))
    out = ranked.drop("rank").join(boosts, keys, "left").withColumn("boost", capped)
    out = out.withColumn("final", F.round(F.col("final") + F.col("boost"), 9))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("final").desc(), "chunk")))


def vector_topk(queries: DataFrame, data: DataFrame, k: int, by: str | None = None, query_block: int = 1024, data_block: int = 8192, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query, id, distance, rank): for each of a stated set of queries its k nearest rows of all data, by Euclidean distance.

    ``queries`` (query, v) and ``data`` (id, v) are cut into blocks by hash;
    a task compares one block of each and keeps k rows a query, so neither
    side is broadcast or gathered. With ``by`` (a tenant, say) only rows of
    the query's own group are compared. Null vectors are left out; vectors of
    another length than the query's are no neighbours; ties go to the
    smaller id.
    """
    queries, data = queries.where("v IS NOT NULL"), data.where("v IS NOT NULL")
    nq, nd = blocks or (max(1, -(-queries.count() // query_block)), max(1, -(-data.count() // data_block)))
    group = (F.col(by) if by else F.lit(0)).alias("g")
    q = queries.select(
        group, F.pmod(F.xxhash64("query"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("db"),
        F.lit(True).alias("is_query"), F.col("query").alias("id"), F.col("v").cast("array<double>").alias("v"),
    )
    d = data.select(
        group, F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(nd)).cast("int").alias("db"),
        F.lit(False).alias("is_query"), "id", F.col("v").cast("array<double>").alias("v"),
    )
    kind = data.schema["id"].dataType.simpleString()

    def search(t: pa.Table) -> pa.Table:
        ids, isq = np.array(t.column("id").to_pylist()), t.column("is_query").to_numpy()
        lists = t.column("v").combine_chunks()
        start, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        size = np.diff(start)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(size[isq]):
            qi, di = np.flatnonzero((size == n) & isq), np.flatnonzero((size == n) & ~isq)
            if not len(di):
                continue
            di = di[np.argsort(ids[di])]
            x, y = (flat[start[i][:, None] + np.arange(n)] for i in (qi, di))
            # squares by a matrix product choose a few rows, whose distances are then computed exactly
            sx, sy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
            for i in range(0, len(qi), 256):
                near = sx[i : i + 256, None] + sy - 2 * x[i : i + 256] @ y.T
                least = np.partition(near, min(k, len(di)) - 1, axis=1)[:, min(k, len(di)) - 1]
                slack = 1e-7 * (1 + sx[i : i + 256] + sy.max())
                row, col = np.nonzero(near <= (least + slack)[:, None])
                dist = np.round(np.sqrt(((x[i + row] - y[col]) ** 2).sum(1)), 9)
                order = np.lexsort((col, dist, row))
                row, col, dist = row[order], col[order], dist[order]
                first = np.concatenate([[True], row[1:] != row[:-1]])
                top = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) < k
                out.append((ids[qi[i + row[top]]], ids[di[col[top]]], dist[top]))
        cat = [np.concatenate([o[j] for o in out]) if out else [] for j in range(3)]
        id_type = t.schema.field("id").type
        return pa.table({"query": pa.array(cat[0], id_type), "id": pa.array(cat[1], id_type), "distance": pa.array(cat[2], pa.float64())})

    found = q.unionByName(d).groupBy("g", "qb", "db").applyInArrow(search, f"query {kind}, id {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
