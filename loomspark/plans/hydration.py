"""Queries that give whole rows: chunks with their document and vector, links, and contexts that follow links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS
from loomspark.functions import text as T
from loomspark.functions.embed import embedded, hashed
from loomspark.functions.keys import hex_key
from loomspark.operators import links as L
from loomspark.operators.sync import latest
from loomspark.plans import retrieval as R
from loomspark.plans.retrieval import _ANCHORED, _CAND, _CHUNKS, _EXPAND, _RANK, _TRACE, _VECTORS, chunk_rows, hex_sql
from loomspark.session import table


def _hydrated(spark: SparkSession, d: str) -> DataFrame:
    """(tenant, chunk, document, ordinal, path, text, title, url, author, v): chunks whose document and vector belong to the same tenant."""
    c = table(spark, d, "chunks").select(
        hex_key("tenant_id").alias("tenant"), hex_key("chunk_id").alias("chunk"), hex_key("document_id").alias("document"), "ordinal", F.col("chunk_path").alias("path"),
        F.col("chunk_text").alias("text"), "indexed_at", "deleted_at",
    )
    c = c.where("tenant IS NOT NULL AND chunk IS NOT NULL AND document IS NOT NULL AND text IS NOT NULL").distinct()
    c = latest(c, ["tenant", "chunk"], F.col("indexed_at").desc_nulls_last(), F.col("deleted_at").desc_nulls_first(), F.col("document"), F.col("ordinal"))
    docs = table(spark, d, "documents").select(hex_key("tenant_id").alias("tenant"), hex_key("document_id").alias("document"), "doc_id", "title", "url", "author")
    docs = docs.where("tenant IS NOT NULL AND document IS NOT NULL").groupBy("tenant", "document").agg(
        *(F.min_by(x, "doc_id").alias(x) for x in ("title", "url", "author"))
    )
    v = table(spark, d, "chunk_vectors").select(hex_key("tenant_id").alias("tenant"), hex_key("chunk_id").alias("chunk"), F.col("updated_at").alias("u"), F.col("embedding").alias("e"))
    good = v.where((F.size("e") == 64) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.col("tenant").isNotNull() & F.col("chunk").isNotNull())
    good = good.groupBy("tenant", "chunk").agg(F.max(F.struct("u", "e"))["e"].alias("v"))
    return c.join(docs, ["tenant", "document"]).join(good, ["tenant", "chunk"]).drop("indexed_at", "deleted_at")


def hydrated_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of each turn's candidates: chunk, document and vector, all of the turn's tenant."""
    t = table(spark, d, "retrieval_trace_items").select(hex_key("tenant_id").alias("tenant"), hex_key("turn_id").alias("query"), hex_key("chunk_id").alias("chunk"))
    t = t.where("tenant IS NOT NULL AND query IS NOT NULL AND chunk IS NOT NULL").distinct()
    return t.join(_hydrated(spark, d), ["tenant", "chunk"]).select(
        "query", "chunk", "document", "tenant", "ordinal", "path", "title", "url", "author", F.md5("text").alias("text_hash"), F.size("v").alias("dim")
    )


def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each document that have a vector, in order, numbered from 1."""
    place = F.row_number().over(Window.partitionBy("tenant", "document").orderBy("ordinal", "chunk"))
    return _hydrated(spark, d).select("tenant", "document", "chunk", place.alias("place"), F.md5("text").alias("text_hash"))


def ordinal_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What a tenant's search falls back to without a query vector: its chunks of the smallest ordinals (ties: chunk), with score 0."""
    r = F.row_number().over(Window.partitionBy("tenant").orderBy("ordinal", "chunk"))
    h = _hydrated(spark, d).select("tenant", "chunk", "ordinal").withColumn("rank", r).where(F.col("rank") <= DEFAULTS.fetch_vector)
    return h.select("tenant", "chunk", "rank", F.lit(0.0).alias("score"))


def backfilled_tenants(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with the tenant of their chunk where it has none or another one."""
    v = table(spark, d, "chunk_vectors").select(hex_key("chunk_id").alias("chunk"), hex_key("tenant_id").alias("tenant")).where("chunk IS NOT NULL").distinct()
    c = table(spark, d, "chunks").select(hex_key("chunk_id").alias("chunk"), hex_key("tenant_id").alias("owner")).where("chunk IS NOT NULL AND owner IS NOT NULL")
    j = v.join(c.groupBy("chunk").agg(F.min("owner").alias("owner")), "chunk", "left")
    return j.select("chunk", F.coalesce("owner", "tenant").alias("tenant"), F.coalesce(F.col("owner") != F.col("tenant"), F.col("owner").isNotNull()).alias("changed")).distinct()


def _links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(hex_key("document_id").alias("document"), "text", "url").where("document IS NOT NULL")
    return L.document_links(docs.select("document", "text"), docs.select("document", "url"))


def document_links(spark: SparkSession, d: str) -> DataFrame:
    """What the texts of documents link to, how often, and the document at that address."""
    return _links(spark, d)


def expand_links(spark: SparkSession, d: str) -> DataFrame:
    """The best candidates of each turn with neighbours and, where the gate is open, chunks of linked documents; the best candidate's vector stands for the question's."""
    c = chunk_rows(spark, d).where("document IS NOT NULL AND ordinal IS NOT NULL").select("chunk", "document", "ordinal")
    ranked, vectors = R._anchored(spark, d), R._vectors(spark, d)
    asked = ranked.where("rank = 1").select("query", "chunk").join(vectors, "chunk").select("query", "v")
    return L.expanded_with_links(ranked, c, _links(spark, d), asked, vectors).withColumn("score", F.round("score", 6))


def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Vector indexing: every living chunk that has no vector, its heading path and whole text embedded; the model is the hashed stand-in.

    (chunk, embedding, embedding_dim, n_words).
    """
    c = chunk_rows(spark, d).where("text IS NOT NULL").join(R.missing_vectors(spark, d), "chunk", "left_semi")
    return embedded(c.select("chunk", T.embedding_input("path", "text").alias("input")), "chunk", "input", hashed(64), 64).select(
        "chunk", F.col("v").alias("embedding"), F.size("v").alias("embedding_dim"), "n_words"
    )


QUERIES = {
    f.__name__: f
    for f in (hydrated_candidates, document_chunks, ordinal_candidates, backfilled_tenants, document_links, expand_links, embedded_chunks)
}

_HYDRATED = f"""
hc AS (
  SELECT {hex_sql("tenant_id")} AS tenant, {hex_sql("chunk_id")} AS chunk, {hex_sql("document_id")} AS document, ordinal, chunk_path AS path, chunk_text AS text, indexed_at, deleted_at
  FROM chunks WHERE trim(tenant_id) <> '' AND trim(chunk_id) <> '' AND trim(document_id) <> '' AND chunk_text IS NOT NULL),
hd AS (
  SELECT {hex_sql("tenant_id")} AS tenant, {hex_sql("document_id")} AS document, min_by(title, doc_id) AS title, min_by(url, doc_id) AS url, min_by(author, doc_id) AS author
  FROM documents WHERE trim(tenant_id) <> '' AND trim(document_id) <> '' GROUP BY 1, 2),
hv AS (
  SELECT DISTINCT {hex_sql("tenant_id")} AS tenant, {hex_sql("chunk_id")} AS chunk FROM chunk_vectors
  WHERE trim(tenant_id) <> '' AND trim(chunk_id) <> '' AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
h AS MATERIALIZED (
  SELECT c.tenant, c.chunk, c.document, ordinal, path, text, title, url, author
  FROM (SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY tenant, chunk ORDER BY indexed_at DESC NULLS LAST, deleted_at DESC NULLS FIRST, document, ordinal NULLS FIRST) = 1) c
  JOIN hd ON hd.tenant = c.tenant AND hd.document = c.document JOIN hv ON hv.tenant = c.tenant AND hv.chunk = c.chunk)"""
_LINK = r"\[[^\]]+\]\(([^)]+)\)"
_LINKS = rf"""
docs AS (SELECT {hex_sql("document_id")} AS document, text, url FROM documents WHERE trim(document_id) <> ''),
found AS (
  SELECT document AS from_document, unnest(regexp_extract_all(text, '{_LINK}', 1) || regexp_extract_all(regexp_replace(text, '{_LINK}', ' ', 'g'), 'https?://[^\s<>()\[\]"]*[^\s<>()\[\]".,;:!?]')) AS link_url
  FROM docs WHERE text IS NOT NULL),
pages AS (SELECT url, min(document) AS to_document FROM docs WHERE url <> '' GROUP BY 1),
links AS MATERIALIZED (
  SELECT from_document, link_url, n_mentions, to_document FROM (SELECT from_document, link_url, count(*) AS n_mentions FROM found GROUP BY 1, 2) f
  LEFT JOIN pages p ON p.url = regexp_replace(f.link_url, '#.*$', ''))"""

SQL = {
    "hydrated_candidates": f"""
WITH {_HYDRATED}, t AS (
  SELECT DISTINCT {hex_sql("tenant_id")} AS tenant, {hex_sql("turn_id")} AS query, {hex_sql("chunk_id")} AS chunk FROM retrieval_trace_items
  WHERE trim(tenant_id) <> '' AND trim(turn_id) <> '' AND trim(chunk_id) <> '')
SELECT query, h.chunk, document, h.tenant, ordinal, path, title, url, author, md5(text) AS text_hash, 64 AS dim FROM t JOIN h ON h.tenant = t.tenant AND h.chunk = t.chunk""",
    "document_chunks": f"""
WITH {_HYDRATED}
SELECT tenant, document, chunk, row_number() OVER (PARTITION BY tenant, document ORDER BY ordinal NULLS FIRST, chunk) AS place, md5(text) AS text_hash FROM h""",
    "ordinal_candidates": f"""
WITH {_HYDRATED}
SELECT tenant, chunk, row_number() OVER (PARTITION BY tenant ORDER BY ordinal NULLS FIRST, chunk) AS rank, CAST(0 AS DOUBLE) AS score FROM h QUALIFY rank <= 20""",
    "backfilled_tenants": f"""
WITH o AS (SELECT {hex_sql("chunk_id")} AS chunk, min({hex_sql("tenant_id")}) AS owner FROM chunks WHERE trim(chunk_id) <> '' AND trim(tenant_id) <> '' GROUP BY 1),
v AS (SELECT DISTINCT {hex_sql("chunk_id")} AS chunk, {hex_sql("tenant_id")} AS tenant FROM chunk_vectors WHERE trim(chunk_id) <> '')
SELECT DISTINCT v.chunk, coalesce(owner, tenant) AS tenant, owner IS NOT NULL AND owner IS DISTINCT FROM tenant AS changed FROM v LEFT JOIN o ON o.chunk = v.chunk""",
    "document_links": f"WITH {_LINKS} SELECT * FROM links",
    "expand_links": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS}, {_ANCHORED}, {_EXPAND}, {_VECTORS}, {_LINKS},
n AS (SELECT query, document, count(*) AS n FROM base GROUP BY 1, 2),
gate AS (
  SELECT n.query FROM n LEFT JOIN chosen c ON c.query = n.query AND c.document = n.document GROUP BY 1
  HAVING avg(CASE WHEN c.document IS NOT NULL THEN n.n END) < 1.5 OR count(*) > count(c.document)),
targets AS (
  SELECT c.query, l.to_document AS document FROM chosen c JOIN links l ON l.from_document = c.document WHERE l.to_document IS NOT NULL AND c.query IN (SELECT query FROM gate)
  QUALIFY row_number() OVER (PARTITION BY c.query ORDER BY l.to_document) <= 1),
closest AS (
  SELECT t.query, c.chunk, c.document, c.ordinal, round(list_distance(CAST(q.v AS DOUBLE[]), CAST(v.v AS DOUBLE[])), 9) AS dist
  FROM targets t JOIN chunk_rows c ON c.document = t.document AND c.ordinal IS NOT NULL JOIN vectors v ON v.chunk = c.chunk
  JOIN anchored a ON a.query = t.query AND a.rank = 1 JOIN vectors q ON q.chunk = a.chunk
  QUALIFY row_number() OVER (PARTITION BY t.query, c.document ORDER BY dist, c.ordinal, c.chunk) <= 2),
room AS (SELECT query, 12 - count(CASE WHEN NOT is_base THEN 1 END) AS room FROM expanded GROUP BY 1)
SELECT query, chunk, document, ordinal, round(score, 6) AS score, is_base, document_rank, CASE WHEN NOT is_base THEN 'neighbour' END AS added_by FROM expanded
UNION ALL SELECT c.query, chunk, document, ordinal, round(1 / (1 + dist), 6), FALSE, NULL, 'link' FROM closest c JOIN room r ON r.query = c.query
WHERE (c.query, chunk) NOT IN (SELECT query, chunk FROM expanded)
QUALIFY row_number() OVER (PARTITION BY c.query ORDER BY document, dist, ordinal, chunk) <= room""",
}
