"""Queries on referential integrity (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.keys import hex_key
from loomspark.operators.orphans import lives, orphan_report, orphans, references
from loomspark.session import table


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All references of the three tables and the lives of all parents.

    Parents of different kinds stay apart through a prefix of the key.
    """
    items, vectors, docs = (table(spark, d, t) for t in ("retrieval_trace_items", "chunk_vectors", "documents"))
    row = F.concat(F.coalesce(hex_key("turn_id"), F.lit("")), F.lit("/"), F.coalesce(F.col("ordinal").cast("string"), F.lit("")))
    to_chunks = references(items, "retrieval_trace_items", row, "chunk_id", "created_at").unionByName(
        references(vectors, "chunk_vectors", hex_key("chunk_id"), "chunk_id", "updated_at")
    )
    to_versions = references(docs, "documents", F.coalesce(hex_key("document_id"), F.lit("")), "source_version_id", "ingested_at")
    chunk = lives(table(spark, d, "chunks"), "chunk_id", "indexed_at", "deleted_at")
    version = lives(table(spark, d, "source_versions"), "source_version_id", "discovered_at", "deleted_at")
    mark = lambda df, p: df.withColumn("ref_key", F.concat(F.lit(p), "ref_key"))
    return mark(to_chunks, "c").unionByName(mark(to_versions, "v")), mark(chunk, "c").unionByName(mark(version, "v"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference that doesn't hold, once."""
    return (
        orphans(*_sides(spark, d))
        .select("ref_table", "row_key", F.expr("substring(ref_key, 2)").alias("ref_key"))
        .distinct()
    )


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """References and orphans per table and month; exact copies of a reference count once."""
    refs, parents = _sides(spark, d)
    refs = refs.distinct()
    return orphan_report(refs, orphans(refs, parents))


_REFS = r"""
refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'retrieval_trace_items' AS ref_table,
           coalesce(CASE WHEN trim(turn_id) <> '' THEN regexp_replace(lower(turn_id), '[^0-9a-f]', '', 'g') END, '')
             || '/' || coalesce(CAST(ordinal AS VARCHAR), '') AS row_key,
           regexp_replace(lower(chunk_id), '[^0-9a-f]', '', 'g') AS ref_key, created_at AS t, 'c' AS kind
    FROM retrieval_trace_items WHERE trim(chunk_id) <> ''
    UNION ALL
    SELECT 'chunk_vectors', regexp_replace(lower(chunk_id), '[^0-9a-f]', '', 'g'),
           regexp_replace(lower(chunk_id), '[^0-9a-f]', '', 'g'), updated_at, 'c'
    FROM chunk_vectors WHERE trim(chunk_id) <> ''
    UNION ALL
    SELECT 'documents',
           coalesce(CASE WHEN trim(document_id) <> '' THEN regexp_replace(lower(document_id), '[^0-9a-f]', '', 'g') END, ''),
           regexp_replace(lower(source_version_id), '[^0-9a-f]', '', 'g'), ingested_at, 'v'
    FROM documents WHERE trim(source_version_id) <> '')),
parents AS (
  SELECT DISTINCT 'c' AS kind, regexp_replace(lower(chunk_id), '[^0-9a-f]', '', 'g') AS k, indexed_at AS born, deleted_at AS died FROM chunks
  UNION
  SELECT DISTINCT 'v', regexp_replace(lower(source_version_id), '[^0-9a-f]', '', 'g'), discovered_at, deleted_at FROM source_versions),
bad AS (
  SELECT r.* FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.kind = r.kind AND p.k = r.ref_key AND p.born <= r.t AND (p.died IS NULL OR p.died > r.t)))
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": f"WITH {_REFS} SELECT DISTINCT ref_table, row_key, ref_key FROM bad",
    "p2_report": f"""WITH {_REFS}
SELECT r.ref_table, r.period, r.n_references, coalesce(b.n_orphans, 0) AS n_orphans, coalesce(b.n_orphan_keys, 0) AS n_orphan_keys
FROM (SELECT ref_table, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS n_references FROM refs GROUP BY 1, 2) r
LEFT JOIN (SELECT ref_table, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS period, count(*) AS n_orphans, count(DISTINCT ref_key) AS n_orphan_keys
           FROM bad GROUP BY 1, 2) b
ON r.ref_table = b.ref_table AND r.period IS NOT DISTINCT FROM b.period""",
}
