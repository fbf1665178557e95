"""Queries on events and on the consistency of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.keys import hex_key
from loomspark.operators import ops as O
from loomspark.plans.retrieval import hex_sql
from loomspark.session import table

#: Shares of the request timeout of 30 s in ms, here set against the events' values (fixed values).
BUDGETS = {"click": 20.0, "purchase": 60.0, "error": 25.0, "signup": 35.0, "view": 10.0}


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    """Count, sum, mean and latest value of each kind of event."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"),
        F.max_by("value", F.struct("ts", "event_id")).alias("latest"),
    )


def stage_p95(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile of each kind of event, interpolated."""
    return O.exact_quantile(table(spark, d, "events"), "event_type", "value", 0.95).select("event_type", F.round(F.coalesce("quantile", F.lit(0.0)), 6).alias("p95"))


def budget_breaches(spark: SparkSession, d: str) -> DataFrame:
    """Events above the budget of their kind, per user."""
    budget = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in BUDGETS.items()))
    e = table(spark, d, "events").where(F.col("value") > budget)
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n_breaches"), F.round(F.max("value"), 6).alias("worst"))


def hourly_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Events of each kind per hour."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total"
    )


def rate_limits(spark: SparkSession, d: str) -> DataFrame:
    """Which events a rate limiter would let through, per user."""
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp").cast("double").alias("ts"))
    r = O.rate_limited(e)
    return r.groupBy("user").agg(F.count("*").alias("n_events"), F.count_if("allowed").alias("n_allowed"))


def drift(spark: SparkSession, d: str) -> DataFrame:
    """Keys of tenants that one table knows and another doesn't, both ways."""
    tenants = table(spark, d, "tenants").select(hex_key("tenant_id").alias("k")).where("k IS NOT NULL").distinct()
    out = None
    for name in ("documents", "chunks", "chunk_vectors", "conversations", "conversation_turns", "retrieval_trace_items", "source_items"):
        used = table(spark, d, name).select(hex_key("tenant_id").alias("k")).where("k IS NOT NULL").distinct()
        both = used.subtract(tenants).select("k", F.lit("unknown").alias("drift")).unionByName(tenants.subtract(used).select("k", F.lit("unused").alias("drift")))
        part = both.select(F.lit(name).alias("table_name"), "k", "drift")
        out = part if out is None else out.unionByName(part)
    return out


def recent_orders(spark: SparkSession, d: str) -> DataFrame:
    """The 100 newest orders (a top-k report)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(100)
    return o.select("o_orderkey", "o_orderstatus")


def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """Documents, chunks and vectors of each tenant."""
    docs, chunks, vecs = (
        table(spark, d, t).select(hex_key("tenant_id").alias("tenant"), hex_key(k).alias("k")).where("tenant IS NOT NULL").groupBy("tenant").agg(F.count_distinct("k").alias(f"n_{t}"))
        for t, k in (("documents", "document_id"), ("chunks", "chunk_id"), ("chunk_vectors", "chunk_id"))
    )
    j = docs.join(chunks, "tenant", "full_outer").join(vecs, "tenant", "full_outer")
    return j.select("tenant", *(F.coalesce(f"n_{t}", F.lit(0)).alias(f"n_{t}") for t in ("documents", "chunks", "chunk_vectors")))


def supplier_volume(spark: SparkSession, d: str) -> DataFrame:
    """Line items, quantities and distinct parts of each nation and month: a star join."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name", "month").agg(
        F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count_distinct("l_partkey").alias("n_parts")
    )


QUERIES = {
    f.__name__: f
    for f in (metric_summary, stage_p95, budget_breaches, hourly_metrics, rate_limits, drift, recent_orders, ingest_counters, supplier_volume)
}

_TABLES = ("documents", "chunks", "chunk_vectors", "conversations", "conversation_turns", "retrieval_trace_items", "source_items")
_USED = " UNION ".join(f"SELECT DISTINCT '{t}' AS table_name, {hex_sql('tenant_id')} AS k FROM {t} WHERE trim(tenant_id) <> ''" for t in _TABLES)

SQL = {
    "metric_summary": """
SELECT event_type, count(*) AS n, round(coalesce(sum(value), 0), 4) AS total, round(coalesce(avg(value), 0), 6) AS mean, arg_max_null(value, (ts, event_id)) AS latest
FROM events GROUP BY 1""",
    "stage_p95": "SELECT event_type, round(coalesce(quantile_cont(value, 0.95), 0), 6) AS p95 FROM events GROUP BY 1",
    "budget_breaches": f"""
SELECT user_id, event_type, count(*) AS n_breaches, round(max(value), 6) AS worst FROM events
WHERE value > CASE event_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in BUDGETS.items())} END GROUP BY 1, 2""",
    "hourly_metrics": """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "drift": f"""
WITH t AS (SELECT DISTINCT {hex_sql("tenant_id")} AS k FROM tenants WHERE trim(tenant_id) <> ''), u AS ({_USED}),
n AS (SELECT unnest([{", ".join(f"'{t}'" for t in _TABLES)}]) AS table_name)
SELECT table_name, k, 'unknown' AS drift FROM u WHERE k NOT IN (SELECT k FROM t)
UNION ALL SELECT table_name, t.k, 'unused' FROM t, n WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.table_name = n.table_name AND u.k = t.k)""",
    "recent_orders": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "ingest_counters": f"""
WITH x AS (
  SELECT {hex_sql("tenant_id")} AS tenant, {hex_sql("document_id")} AS k, 'd' AS t FROM documents
  UNION ALL SELECT {hex_sql("tenant_id")}, {hex_sql("chunk_id")}, 'c' FROM chunks
  UNION ALL SELECT {hex_sql("tenant_id")}, {hex_sql("chunk_id")}, 'v' FROM chunk_vectors)
SELECT tenant, count(DISTINCT CASE WHEN t = 'd' THEN k END) AS n_documents, count(DISTINCT CASE WHEN t = 'c' THEN k END) AS n_chunks,
       count(DISTINCT CASE WHEN t = 'v' THEN k END) AS n_chunk_vectors FROM x WHERE tenant IS NOT NULL GROUP BY 1""",
    "supplier_volume": """
SELECT n_name, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_partkey) AS n_parts
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
}
