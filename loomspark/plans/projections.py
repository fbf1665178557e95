"""Queries on what is shown, audited and ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.embed import embedded, hashed
from loomspark.functions.keys import hex_key
from loomspark.operators import markdown as M
from loomspark.operators.sync import latest
from loomspark.plans.retrieval import _CAND, _CHUNKS, _RANK, _TRACE, chunk_rows, hex_sql, ranked, trace
from loomspark.plans.text import strip_sql
from loomspark.session import table

_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def scoring_trace(spark: SparkSession, d: str) -> DataFrame:
    """Raw and normalised scores of every candidate; missing raw scores are 0, a missing rerank score falls back to the fused one."""
    r = ranked(spark, d)
    return r.select(
        "query", "chunk", F.coalesce("lex", F.lit(0.0)).alias("lex_raw"), F.coalesce("vec", F.lit(0.0)).alias("vec_raw"),
        F.round(F.coalesce("rerank", "final"), 6).alias("rerank_score"), "rank",
    )


def reranked(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by their rerank score, the rank before deciding ties; a single candidate passes as it is."""
    r = ranked(spark, d)
    n = F.count("*").over(Window.partitionBy("query"))
    w = Window.partitionBy("query").orderBy(F.when(F.col("n") > 1, F.col("rerank")).desc_nulls_last(), "rank")
    return r.withColumn("n", n).withColumn("new_rank", F.row_number().over(w)).select("query", "chunk", "rank", "new_rank")


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Used chunks of each turn with a snippet of 200 characters, in the order of their citation."""
    used = trace(spark, d).where("used").groupBy("query", "chunk").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("query").orderBy("pos", "chunk")
    c = chunk_rows(spark, d).where("text IS NOT NULL").select("chunk", "document", "path", F.substring("text", 1, 200).alias("snippet"))
    return used.withColumn("citation", F.row_number().over(w)).join(c, "chunk").select(
        "query", "citation", "chunk", "document", "snippet", F.size(F.split("path", "/")).alias("depth")
    )


def audited_rows(spark: SparkSession, d: str) -> DataFrame:
    """Trace rows per turn that an audit keeps: those whose chunk and turn are well-formed UUIDs."""
    t = table(spark, d, "retrieval_trace_items").distinct()
    ok = F.coalesce(F.col("chunk_id").rlike(_UUID) & F.col("turn_id").rlike(_UUID), F.lit(False))
    return t.groupBy(hex_key("tenant_id").alias("tenant")).agg(
        F.count("*").alias("n_rows"), F.count_if(ok).alias("n_kept"), F.count_if(ok & F.col("used_in_answer")).alias("n_used")
    )


def top_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The two chunks of each document that were retrieved most often."""
    n = trace(spark, d).groupBy("chunk").agg(F.count("*").alias("n_retrieved"))
    c = chunk_rows(spark, d).where("document IS NOT NULL").select("chunk", "document", "ordinal").join(n, "chunk")
    w = Window.partitionBy("document").orderBy(F.col("n_retrieved").desc(), "ordinal", "chunk")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 2")


def diversity(spark: SparkSession, d: str) -> DataFrame:
    """Documents among each turn's candidates, coverage of its answer, and the depth of the document that is hit most."""
    t = trace(spark, d).join(chunk_rows(spark, d).select("chunk", "document"), "chunk", "left")
    per = t.groupBy("query", "document").agg(F.count_distinct("chunk").alias("n"), F.count_if("used").alias("u"))
    return per.groupBy("query").agg(
        F.count("document").alias("n_documents"), F.max("n").alias("deepest"), F.round(F.try_divide(F.sum("u"), F.sum("n")), 6).alias("coverage")
    )


def answers_without_model(spark: SparkSession, d: str) -> DataFrame:
    """The answer that needs no model: the first two candidates' texts, blank ones left out."""
    c = chunk_rows(spark, d).select("chunk", T.strip("text").alias("text"))
    two = ranked(spark, d).where("rank <= 2").join(c, "chunk").where("text <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return two.groupBy("query").agg(F.sha2(F.array_join(parts, "\n\n"), 256).alias("answer_hash"), F.count("*").alias("n_parts"))


def ingested_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The newest delivery of every item, normalised, chunked, with stable ids: what an ingest writes."""
    items = latest(
        table(spark, d, "source_items").where("external_ref IS NOT NULL"), ["tenant_id", "source_type", "external_ref"],
        F.col("fetched_at").desc_nulls_last(), F.col("item_id").desc(),
    )
    n = M.normalized(items, "item_id", "markdown").join(items.select("item_id", "tenant_id", "external_ref"), "item_id")
    c = M.chunks(n, "item_id", "markdown").join(n, "item_id")
    body = F.expr("substring(markdown, int(char_start) + 1, int(char_end - char_start))")
    return c.select(
        "item_id", "ordinal", "kind", "heading_path", "tokens",
        T.stable_id("tenant_id", "external_ref", F.sha2("markdown", 256), "ordinal", T.canonical(body)).alias("chunk_id"),
        F.sha2(T.embedding_input("heading_path", body), 256).alias("input_hash"),
    )


def embedded_titles(spark: SparkSession, d: str) -> DataFrame:
    """Words that an embedding of all titles uses, and the vectors' lengths; the model is the hashed stand-in."""
    e = embedded(table(spark, d, "documents"), "doc_id", "title", hashed(32), 32)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return e.select("doc_id", "n_words", F.round(norm, 6).alias("norm"))


QUERIES = {
    f.__name__: f
    for f in (scoring_trace, reranked, citations, audited_rows, top_chunks, diversity, answers_without_model, ingested_chunks, embedded_titles)
}

SQL = {
    "scoring_trace": f"""
WITH {_TRACE}, {_CAND}, {_RANK}
SELECT query, chunk, coalesce(lex, 0) AS lex_raw, coalesce(vec, 0) AS vec_raw, round(coalesce(rerank, final), 6) AS rerank_score, rank FROM ranked""",
    "reranked": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, c AS (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM ranked)
SELECT query, chunk, rank, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN n > 1 THEN rerank END DESC NULLS LAST, rank) AS new_rank FROM c""",
    "citations": f"""
WITH {_TRACE}, {_CHUNKS},
u AS (SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY min(pos), chunk) AS citation FROM trace WHERE used GROUP BY query, chunk)
SELECT u.query, citation, u.chunk, document, substr(text, 1, 200) AS snippet, CASE WHEN path IS NULL THEN NULL ELSE len(string_split(path, '/')) END AS depth
FROM u JOIN chunk_rows c ON c.chunk = u.chunk WHERE text IS NOT NULL""",
    "audited_rows": f"""
WITH t AS (SELECT DISTINCT * FROM retrieval_trace_items),
o AS (SELECT *, coalesce(regexp_matches(chunk_id, '{_UUID}') AND regexp_matches(turn_id, '{_UUID}'), FALSE) AS ok FROM t)
SELECT {hex_sql("tenant_id")} AS tenant, count(*) AS n_rows, count(CASE WHEN ok THEN 1 END) AS n_kept, count(CASE WHEN ok AND used_in_answer THEN 1 END) AS n_used FROM o GROUP BY 1""",
    "top_chunks": f"""
WITH {_TRACE}, {_CHUNKS}, n AS (SELECT chunk, count(*) AS n_retrieved FROM trace GROUP BY 1)
SELECT c.chunk, document, ordinal, n_retrieved, row_number() OVER (PARTITION BY document ORDER BY n_retrieved DESC, ordinal NULLS FIRST, c.chunk) AS r
FROM chunk_rows c JOIN n ON n.chunk = c.chunk WHERE document IS NOT NULL QUALIFY r <= 2""",
    "diversity": f"""
WITH {_TRACE}, {_CHUNKS},
p AS (SELECT t.query, c.document, count(DISTINCT t.chunk) AS n, count(CASE WHEN used THEN 1 END) AS u FROM trace t LEFT JOIN chunk_rows c ON c.chunk = t.chunk GROUP BY 1, 2)
SELECT query, count(document) AS n_documents, max(n) AS deepest, round(CAST(sum(u) AS DOUBLE) / sum(n), 6) AS coverage FROM p GROUP BY 1""",
    "answers_without_model": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS},
x AS (SELECT r.query, r.rank, {strip_sql("c.text")} AS text FROM ranked r JOIN chunk_rows c ON c.chunk = r.chunk WHERE r.rank <= 2)
SELECT query, sha256(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS answer_hash, count(*) AS n_parts FROM x WHERE text <> '' GROUP BY 1""",
}
