"""Queries on incremental synchronisation and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.keys import hex_key
from loomspark.operators import sync as S
from loomspark.plans.retrieval import hex_sql
from loomspark.session import small, table

_KEYS = ["tenant_id", "source_type", "external_ref"]


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Items with their number among the deliveries of one reference, the newest first."""
    items = table(spark, d, "source_items").where("tenant_id IS NOT NULL AND source_type IS NOT NULL AND external_ref IS NOT NULL")
    w = Window.partitionBy(*_KEYS).orderBy(F.col("fetched_at").desc_nulls_last(), F.col("item_id").desc())
    return items.select(*_KEYS, "item_id", "fetched_at", F.sha2(F.coalesce("markdown", F.lit("")), 256).alias("checksum"), F.row_number().over(w).alias("r"))


def fetch_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What a sync would fetch: the newest delivery of each reference against the one before it."""
    rows = _deliveries(spark, d)
    listed = rows.where("r = 1").select(*_KEYS, "item_id", F.col("fetched_at").alias("modified"), "checksum")
    state = rows.where("r = 2").select(*_KEYS, F.date_trunc("month", "fetched_at").alias("seen_modified"), F.col("checksum").alias("seen_checksum"))
    return S.fetch_decisions(listed, state, _KEYS).select("item_id", "reason", "fetch")


def tombstones(spark: SparkSession, d: str) -> DataFrame:
    """References that were delivered before the last complete month of their kind, but not in it."""
    rows = _deliveries(spark, d).where("fetched_at IS NOT NULL")
    last = rows.groupBy("source_type").agg(F.date_trunc("month", F.max("fetched_at")).alias("m"), F.count("*").alias("n"))
    at = rows.join(small(last), "source_type")
    return S.tombstones(
        rows, at.where(F.col("fetched_at") >= F.col("m")), last.select("source_type", (F.col("n") > 1).alias("listing_complete")), _KEYS, "source_type"
    )


def version_survivors(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a source with one content: the newest survives, the others are mapped to it."""
    v = table(spark, d, "source_versions").select(
        hex_key("source_version_id").alias("version"), hex_key("source_id").alias("source"), "checksum", "discovered_at"
    ).where("version IS NOT NULL AND source IS NOT NULL AND checksum IS NOT NULL").groupBy("version", "source", "checksum").agg(F.max("discovered_at").alias("at"))
    return S.survivors(v, ["source", "checksum"], "version", F.col("at").desc_nulls_last(), F.col("version"))


def relinked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one source: how many point to a version, how many to a survivor after relinking."""
    docs = table(spark, d, "documents").select("doc_id", hex_key("source_id").alias("source"), hex_key("source_version_id").alias("version"))
    m = version_survivors(spark, d).groupBy("id").agg(F.min("keep_id").alias("keep_id"))
    j = docs.join(m, F.col("version") == F.col("id"), "left").withColumn("linked", F.coalesce("keep_id", "version"))
    return j.groupBy("source").agg(F.count("*").alias("n_documents"), F.count_distinct("version").alias("n_versions"), F.count_distinct("linked").alias("n_linked"))


def upserted_sources(spark: SparkSession, d: str) -> DataFrame:
    """The state of all references after the newest deliveries are put over the oldest."""
    rows = _deliveries(spark, d)
    w = Window.partitionBy(*_KEYS).orderBy(F.col("r").desc())
    old = rows.withColumn("o", F.row_number().over(w)).where("o = 1").select(*_KEYS, "item_id", "checksum")
    new = rows.where("r = 1").select(*_KEYS, "item_id", "checksum")
    return S.upserted(old, new, _KEYS)


def document_lives(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document: all, living, and lives per chunk."""
    c = table(spark, d, "chunks").select(hex_key("document_id").alias("document"), hex_key("chunk_id").alias("chunk"), "indexed_at", "deleted_at").distinct()
    return c.where("document IS NOT NULL").groupBy("document").agg(
        F.count_distinct("chunk").alias("n_chunks"), F.count_distinct(F.when(F.col("deleted_at").isNull(), F.col("chunk"))).alias("n_living"), F.count("*").alias("n_lives")
    )


def _versions(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "source_versions").select(hex_key("source_version_id").alias("version"), hex_key("source_id").alias("source"), "checksum", "discovered_at")
    return v.where("version IS NOT NULL AND source IS NOT NULL AND checksum IS NOT NULL").groupBy("version", "source", "checksum").agg(F.max("discovered_at").alias("at"))


def version_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Versions of the last month put into those before: which are created, and which find their content there."""
    v = _versions(spark, d)
    month = F.lit(v.agg(F.date_trunc("month", F.max("at"))).first()[0])
    old = F.coalesce(F.col("at") < month, F.lit(True))
    return S.inserted(v.where(old).select("source", "checksum", "version"), v.where(~old).select("source", "checksum", "version"), ["source", "checksum"], "version")


def deduplicated_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions that are left when those with the content of a newer one are deleted."""
    v = _versions(spark, d)
    w = Window.partitionBy("source", "checksum").orderBy(F.col("at").desc_nulls_last(), "version")
    m = v.select("source", "checksum", F.col("version").alias("id"), F.first("version").over(w).alias("keep_id"))
    return S.without_duplicates(v, m, ["source", "checksum"], "version").select("version", "source", "checksum")


QUERIES = {f.__name__: f for f in (fetch_decisions, tombstones, version_survivors, relinked_documents, upserted_sources, document_lives, version_inserts, deduplicated_versions)}

_D = """
d AS (
  SELECT tenant_id, source_type, external_ref, item_id, fetched_at, sha256(coalesce(markdown, '')) AS checksum,
         row_number() OVER (PARTITION BY tenant_id, source_type, external_ref ORDER BY fetched_at DESC NULLS LAST, item_id DESC) AS r
  FROM source_items WHERE tenant_id IS NOT NULL AND source_type IS NOT NULL AND external_ref IS NOT NULL)"""
_V = f"""
v AS (
  SELECT version, source, checksum, max(discovered_at) AS t
  FROM (SELECT {hex_sql("source_version_id")} AS version, {hex_sql("source_id")} AS source, checksum, discovered_at FROM source_versions)
  WHERE version IS NOT NULL AND source IS NOT NULL AND checksum IS NOT NULL GROUP BY 1, 2, 3),
m AS (SELECT version AS id, first_value(version) OVER (PARTITION BY source, checksum ORDER BY t DESC NULLS LAST, version) AS keep_id FROM v)"""

SQL = {
    "fetch_decisions": f"""
WITH {_D}
SELECT item_id, reason, reason <> 'unchanged' AS fetch FROM (
  SELECT a.item_id, CASE WHEN b.item_id IS NULL THEN 'new' WHEN b.fetched_at IS NULL OR a.fetched_at > date_trunc('month', b.fetched_at) THEN 'modified'
                         WHEN a.checksum IS DISTINCT FROM b.checksum THEN 'checksum' ELSE 'unchanged' END AS reason
  FROM (SELECT * FROM d WHERE r = 1) a LEFT JOIN (SELECT * FROM d WHERE r = 2) b
  ON a.tenant_id = b.tenant_id AND a.source_type = b.source_type AND a.external_ref = b.external_ref)""",
    "tombstones": f"""
WITH {_D}, f AS (SELECT * FROM d WHERE fetched_at IS NOT NULL),
l AS (SELECT source_type, date_trunc('month', max(fetched_at)) AS m, count(*) AS n FROM f GROUP BY 1)
SELECT DISTINCT tenant_id, source_type, external_ref FROM f WHERE source_type IN (SELECT source_type FROM l WHERE n > 1)
AND (tenant_id, source_type, external_ref) NOT IN (SELECT tenant_id, f.source_type, external_ref FROM f JOIN l ON l.source_type = f.source_type WHERE fetched_at >= m)""",
    "version_survivors": f"WITH {_V} SELECT id, keep_id FROM m",
    "relinked_documents": f"""
WITH {_V}, k AS (SELECT id, min(keep_id) AS keep_id FROM m GROUP BY 1)
SELECT source, count(*) AS n_documents, count(DISTINCT version) AS n_versions, count(DISTINCT coalesce(keep_id, version)) AS n_linked
FROM (SELECT {hex_sql("source_id")} AS source, {hex_sql("source_version_id")} AS version FROM documents) x LEFT JOIN k ON k.id = x.version GROUP BY 1""",
    "version_inserts": f"""
WITH {_V}, b AS (SELECT date_trunc('month', max(t)) AS m FROM v), x AS (SELECT v.*, coalesce(t < (SELECT m FROM b), TRUE) AS old FROM v),
g AS (SELECT source, checksum, min(CASE WHEN old THEN version END) AS was, min(CASE WHEN NOT old THEN version END) AS first FROM x GROUP BY 1, 2)
SELECT x.source, x.checksum, x.version, coalesce(was, first) AS kept_id, was IS NULL AND x.version = first AS created
FROM x JOIN g ON g.source = x.source AND g.checksum = x.checksum WHERE NOT old""",
    "deduplicated_versions": f"""
WITH {_V} SELECT version, source, checksum FROM v QUALIFY row_number() OVER (PARTITION BY source, checksum ORDER BY t DESC NULLS LAST, version) = 1""",
    "upserted_sources": f"WITH {_D} SELECT tenant_id, source_type, external_ref, item_id, checksum FROM d WHERE r = 1",
    "document_lives": f"""
SELECT document, count(DISTINCT chunk) AS n_chunks, count(DISTINCT CASE WHEN deleted_at IS NULL THEN chunk END) AS n_living, count(*) AS n_lives
FROM (SELECT DISTINCT {hex_sql("document_id")} AS document, {hex_sql("chunk_id")} AS chunk, indexed_at, deleted_at FROM chunks) WHERE document IS NOT NULL GROUP BY 1""",
}
