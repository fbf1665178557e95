"""Links between documents, and contexts that follow them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS, Config
from loomspark.functions.text import links, urls
from loomspark.operators.context import document_depth, expanded_by_document


def document_links(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(from_document, link_url, n_mentions, to_document): what documents link to, once for each document and target.

    ``docs`` (document, text), ``targets`` (document, url). Links are those of
    markdown and bare web addresses. A fragment is ignored when the target is
    looked up; of documents with one address the smallest is the target, none
    gives null. Mentions are counted within a document before the lookup, so
    a target that is linked from everywhere is one row a document.
    """
    found = docs.select(F.col("document").alias("from_document"), F.explode(F.concat(links("text"), urls("text"))).alias("link_url"))
    once = found.groupBy("from_document", "link_url").agg(F.count("*").alias("n_mentions"))
    at = targets.where("url IS NOT NULL AND url <> ''").groupBy(F.col("url").alias("_u")).agg(F.min("document").alias("to_document"))
    return once.join(at, F.regexp_replace("link_url", "#.*$", "") == F.col("_u"), "left").select("from_document", "link_url", "n_mentions", "to_document")


def expanded_with_links(ranked: DataFrame, chunks: DataFrame, linked: DataFrame, asked: DataFrame, vectors: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(query, chunk, document, ordinal, score, is_base, document_rank, added_by): candidates, their neighbours, and chunks of documents they link to.

    As ``expanded_by_document``; where the gate of ``document_depth`` is open,
    the first ``link_docs`` targets (by document; repeats count) of the chosen
    documents' links add their ``link_chunks`` chunks that are nearest to the
    query (ties: ordinal, chunk) and aren't there yet, while ``extra_total``
    isn't reached. ``linked`` (from_document, to_document), ``asked`` (query,
    v), ``vectors`` (chunk, v). What a link adds is scored by its distance.
    """
    grown = expanded_by_document(ranked, chunks, config)
    grown = grown.withColumn("added_by", F.when(~F.col("is_base"), "neighbour"))
    chosen = grown.where("is_base AND document_rank IS NOT NULL").select("query", F.col("document").alias("from_document")).distinct()
    open_gate = document_depth(ranked, config).where("follows_links").select("query")
    first = Window.partitionBy("query").orderBy("to_document")
    targets = (
        chosen.join(open_gate, "query", "left_semi").join(linked.where("to_document IS NOT NULL"), "from_document")
        .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= config.link_docs)
        .select("query", F.col("to_document").alias("document")).distinct()
    )
    rows = targets.join(chunks.select("chunk", "document", "ordinal"), "document").join(vectors.withColumnRenamed("v", "_v"), "chunk").join(asked, "query")
    square = F.aggregate(F.zip_with(F.col("v").cast("array<double>"), F.col("_v").cast("array<double>"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = Window.partitionBy("query", "document").orderBy("_d", "ordinal", "chunk")
    rows = rows.withColumn("_d", F.round(F.sqrt(square), 9)).withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= config.link_chunks)
    rows = rows.join(grown.select("query", "chunk"), ["query", "chunk"], "left_anti")
    room = grown.groupBy("query").agg((F.lit(config.extra_total) - F.count_if(~F.col("is_base"))).alias("_room"))
    in_all = F.row_number().over(Window.partitionBy("query").orderBy("document", "_n"))
    added = rows.join(room, "query").withColumn("_a", in_all).where("_a <= _room").select(
        "query", "chunk", "document", "ordinal", (1 / (1 + F.col("_d"))).alias("score"), F.lit(False).alias("is_base"),
        F.lit(None).cast("int").alias("document_rank"), F.lit("link").alias("added_by"),
    )
    return grown.unionByName(added)
