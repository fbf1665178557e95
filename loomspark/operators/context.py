"""From ranked candidates to the context of an answer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS, Config
from loomspark.functions.text import estimated_tokens, truncated
from loomspark.functions.unicode import token_count
from loomspark.functions.vectors import cosine


def neighbours(anchors: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(query, chunk, document, ordinal, anchor, distance): chunks near an anchor in its document, each with its nearest anchor.

    ``anchors`` (query, document, ordinal, chunk, base): base is the rank of
    the anchor, the smaller wins ties. ``chunks`` (document, ordinal, chunk).
    Each anchor asks for the places around it, so the band join is an
    equi-join on (document, ordinal). Anchors of a query are no neighbours.
    """
    around = anchors.select(
        "query", "document", F.col("chunk").alias("anchor"), "base",
        F.explode(F.filter(F.sequence(F.lit(-window), F.lit(window)), lambda o: o != 0)).alias("off"), "ordinal",
    ).withColumn("ordinal", F.col("ordinal") + F.col("off"))
    got = around.join(chunks, ["document", "ordinal"]).withColumn("distance", F.abs("off"))
    nearest = Window.partitionBy("query", "chunk").orderBy("distance", "base", "anchor")
    return (
        got.withColumn("_r", F.row_number().over(nearest))
        .where("_r = 1")
        .join(anchors.select("query", "chunk"), ["query", "chunk"], "left_anti")
        .select("query", "chunk", "document", "ordinal", "anchor", "distance")
    )


def expanded(ranked: DataFrame, chunks: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(query, chunk, document, ordinal, score, is_base): the first top_k of each query and their neighbours, up to the cap.

    ``ranked`` (query, chunk, document, ordinal, score, rank). A neighbour's
    score is its anchor's times the decay. Base rows come first into the cap,
    then neighbours by the rank of their anchor, document and ordinal.
    """
    base = ranked.where(F.col("rank") <= config.top_k)
    near = neighbours(base.select("query", "document", "ordinal", "chunk", F.col("rank").alias("base")), chunks, config.neighbour_window)
    a = base.select("query", F.col("chunk").alias("anchor"), F.col("score").alias("_s"), F.col("rank").alias("base"))
    extra = near.join(a, ["query", "anchor"]).select(
        "query", "chunk", "document", "ordinal", F.greatest(F.lit(0.0), F.col("_s") * config.decay_score).alias("score"), F.lit(False).alias("is_base"), "base"
    )
    both = base.select("query", "chunk", "document", "ordinal", "score", F.lit(True).alias("is_base"), F.col("rank").alias("base")).unionByName(extra)
    order = Window.partitionBy("query").orderBy(F.col("is_base").desc(), "base", "document", "ordinal", "chunk")
    return both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= config.expansion_cap).drop("_r", "base")


def expanded_by_document(ranked: DataFrame, chunks: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(query, chunk, document, ordinal, score, is_base, document_rank): the best candidates and neighbours of the best one of each chosen document.

    The documents of the first ``expansion_base`` candidates are ordered by
    their best score (ties: document); the first ``expansion_docs`` are
    chosen. A chosen document adds the chunks around its best candidate that
    aren't there yet, in order of ordinal and chunk, at most
    ``extra_per_document``, and all together at most ``extra_total`` in the
    order of the documents. The score of what is added decays.
    """
    base = ranked.where(F.col("rank") <= config.expansion_base)
    best = Window.partitionBy("query", "document").orderBy(F.col("score").desc(), "ordinal", "chunk")
    anchors = base.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "document"))
    anchors = anchors.withColumn("document_rank", rank).where(F.col("document_rank") <= config.expansion_docs)
    around = anchors.select(
        "query", "document", "document_rank", "score", F.explode(F.sequence(F.col("ordinal") - config.neighbour_window, F.col("ordinal") + config.neighbour_window)).alias("ordinal")
    )
    near = around.join(chunks.select("document", "ordinal", "chunk"), ["document", "ordinal"]).join(base.select("query", "chunk"), ["query", "chunk"], "left_anti")
    in_doc = F.row_number().over(Window.partitionBy("query", "document").orderBy("ordinal", "chunk"))
    near = near.withColumn("_d", in_doc).where(F.col("_d") <= config.extra_per_document)
    in_all = F.row_number().over(Window.partitionBy("query").orderBy("document_rank", "ordinal", "chunk"))
    near = near.withColumn("_a", in_all).where(F.col("_a") <= config.extra_total)
    added = near.select("query", "chunk", "document", "ordinal", (F.col("score") * config.decay_score).alias("score"), F.lit(False).alias("is_base"))
    both = base.select("query", "chunk", "document", "ordinal", "score", F.lit(True).alias("is_base")).unionByName(added)
    ranks = anchors.select("query", "document", "document_rank")
    return both.join(ranks, ["query", "document"], "left").select("query", "chunk", "document", "ordinal", "score", "is_base", "document_rank")


def document_depth(ranked: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(query, n_documents, depth, top_document, follows_links): the documents of the best candidates.

    Depth is the mean number of candidates of a chosen document. Links are
    followed where it is small or where not all documents are chosen.
    """
    base = ranked.where(F.col("rank") <= config.expansion_base)
    docs = base.groupBy("query", "document").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "document")
    chosen = docs.withColumn("r", F.row_number().over(order))
    first = F.col("r") <= config.expansion_docs
    g = chosen.groupBy("query").agg(
        F.count("*").alias("n_documents"), F.avg(F.when(first, F.col("n"))).alias("depth"), F.min_by("document", "r").alias("top_document"), F.count_if(first).alias("n_chosen")
    )
    follow = (F.col("depth") < config.link_depth) | (F.col("n_documents") > F.col("n_chosen"))
    return g.select("query", "n_documents", "depth", "top_document", follow.alias("follows_links"))


def assembled_context(rows: DataFrame, max_tokens: int, margin: int, factor: float = DEFAULTS.words_to_tokens) -> DataFrame:
    """(query, chunk, text, tokens, truncated): the context of each query within ``max_tokens`` less the margin.

    Rows (query, chunk, score, text): those of the lowest score (ties:
    smallest chunk) are dropped until the rest fits. Where nothing fits, the
    best one (ties: smallest chunk) stays, cut to the budget and marked.
    """
    budget = max(0, max_tokens - margin)
    sized = rows.withColumn("tokens", estimated_tokens("text", factor))
    kept = context_budget(sized, budget).where("kept")
    text = F.when(F.col("truncated"), truncated("text", budget, factor=factor)).otherwise(F.col("text"))
    return kept.select("query", "chunk", text.alias("text"), "truncated").withColumn("tokens", estimated_tokens("text", factor))


def context_log(rows: DataFrame, context: DataFrame, factor: float = DEFAULTS.words_to_tokens) -> DataFrame:
    """(query, n_before, n_dropped, initial_tokens, final_tokens, trimmed_tokens, words_before, words_after, truncated) of a context and what it came from."""
    before = rows.groupBy("query").agg(
        F.count("*").alias("n_before"), F.sum(estimated_tokens("text", factor)).alias("initial_tokens"), F.sum(token_count("text")).alias("words_before")
    )
    after = context.groupBy("query").agg(
        F.count("*").alias("_n"), F.sum("tokens").alias("final_tokens"), F.sum(token_count("text")).alias("words_after"), F.bool_or("truncated").alias("truncated")
    )
    # what is cut down to fit was dropped first
    return before.join(after, "query").select(
        "query", "n_before", (F.col("n_before") - F.when(F.col("truncated"), 0).otherwise(F.col("_n"))).alias("n_dropped"), "initial_tokens", "final_tokens",
        F.greatest(F.lit(0), F.col("initial_tokens") - F.col("final_tokens")).alias("trimmed_tokens"), "words_before", "words_after", "truncated",
    )


def context_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Adds ``kept``: rows (query, chunk, score, tokens) whose lowest ones are dropped until the rest fits; the best stays anyway (truncated later)."""
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("chunk").desc())
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "chunk"))
    total = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumns({"running": total, "_b": best}).withColumn("kept", F.col("running") <= budget)
    none = ~F.bool_or("kept").over(Window.partitionBy("query"))
    return out.withColumn("truncated", none & (F.col("_b") == 1)).withColumn("kept", F.col("kept") | F.col("truncated")).drop("_b")


def budget_select(rows: DataFrame, budget: int, config: Config = DEFAULTS) -> DataFrame:
    """The rows (query, chunk, document, ordinal, score, tokens, v) of the longest prefix that gains and fits.

    In order of score, a row passes if its score, less what its largest
    cosine with an earlier row exceeds the threshold by, reaches the least
    gain, and if the running total of tokens fits; the first that fails ends
    the selection. So the selection is a prefix, and the largest cosine is
    over all earlier rows. Rows beyond the budget or below the least gain by
    score alone can't pass and are cut first: what is then compared pairwise
    is what fits into a context.
    """
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "document", "ordinal", "chunk")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("r", F.row_number().over(order)).withColumn("_fits", F.sum("tokens").over(upto) <= budget)
    r = r.where(F.col("_fits") & (F.round("score", 9) >= config.min_gain)).drop("_fits")
    left = r.select("query", "r", F.col("v").alias("_v"))
    right = r.select(F.col("query").alias("_q"), F.col("r").alias("_e"), F.col("v").alias("_w"))
    worst = left.join(right, (F.col("query") == F.col("_q")) & (F.col("_e") < F.col("r"))).groupBy("query", "r").agg(
        F.max(cosine("_v", "_w")).alias("most_similar")
    )
    gain = F.col("score") - F.greatest(F.lit(0.0), F.coalesce("most_similar", F.lit(0.0)) - config.redundancy_threshold)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.round(gain, 9) >= config.min_gain
    out = r.join(worst, ["query", "r"], "left").withColumn("_ok", ok)
    return out.withColumn("_all", F.bool_and("_ok").over(run)).where("_all").select("query", "chunk", "r", "score", "tokens")


def redundancy_filter(rows: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(query, chunk): rows (query, chunk, score, hash, path, v) that repeat no kept row of their query.

    In order of score a row is dropped if its text's hash was kept, or if a
    kept row of the same path has a cosine of at least the threshold. What is
    dropped changes later decisions, so a query's rows are streamed through a
    task in order; its state is the kept rows of one query.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, hashes, kept = object(), set(), {}
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                if row.query != query:
                    query, hashes, kept = row.query, set(), {}
                v = np.asarray(row.v if row.v is not None else [], float)
                n = np.sqrt((v * v).sum()) if len(v) else 0.0
                u = v / n if n > 0 else None
                same = kept.setdefault(row.path, [])
                twin = row.hash in hashes or (
                    u is not None and any(len(w) == len(u) and float(w @ u) >= config.redundancy_threshold for w in same)
                )
                if not twin:
                    hashes.add(row.hash)
                    if u is not None:
                        same.append(u)
                    out.append((row.query, row.chunk))
            yield pd.DataFrame(out, columns=["query", "chunk"])

    ordered = rows.repartition("query").sortWithinPartitions("query", F.col("score").desc_nulls_last(), F.col("chunk").asc_nulls_last())
    return ordered.mapInPandas(walk, "query string, chunk string")
