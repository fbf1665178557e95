"""Queries on the state of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS
from loomspark.functions import text as T
from loomspark.functions.keys import hex_key
from loomspark.functions.unicode import strip
from loomspark.operators import dialogue as D
from loomspark.plans.retrieval import hex_sql, trace
from loomspark.plans.text import WS, strip_sql, words_sql
from loomspark.session import small, table


def turns(spark: SparkSession, d: str) -> DataFrame:
    """(conversation, idx, role, text, at): one row for each place of a conversation; of several deliveries the smallest values."""
    t = table(spark, d, "conversation_turns").select(
        hex_key("conversation_id").alias("conversation"), F.col("turn_index").alias("idx"), F.lower(strip("role")).alias("label"), "text", F.col("created_at").alias("at")
    )
    roles = table(spark, d, "role_aliases").select("label", "role_name").distinct()
    t = t.where("conversation IS NOT NULL AND idx IS NOT NULL").join(small(roles), "label", "left")
    return t.groupBy("conversation", "idx").agg(F.min("role_name").alias("role"), F.min("text").alias("text"), F.min("at").alias("at"))


def conversation_state(spark: SparkSession, d: str) -> DataFrame:
    """Next index, newest turn and whether a summary is due."""
    g = turns(spark, d).groupBy("conversation").agg(
        (F.coalesce(F.max("idx"), F.lit(0)) + 1).alias("next_index"), F.max_by("role", "idx").alias("last_role"), F.count("*").alias("n_turns"),
        F.max(F.when(F.col("role") == "user", F.col("idx"))).alias("last_user_index"),
    )
    return g.withColumn("summary_due", F.col("n_turns") >= 12)


def unused_runs(spark: SparkSession, d: str) -> DataFrame:
    """How many of a conversation's newest retrieved rows in a row went unused."""
    t = trace(spark, d).where("conversation IS NOT NULL AND at IS NOT NULL")
    tie = F.concat_ws("/", "query", F.lpad(F.col("pos").cast("string"), 6, "0"), "chunk")
    return D.leading_run(t, "conversation", F.col("at"), tie, ~F.col("used"))


def trimmed_history(spark: SparkSession, d: str) -> DataFrame:
    """The newest turns of each conversation that fit the history's budget."""
    t = turns(spark, d).where("text IS NOT NULL").withColumn("tokens", T.floor_tokens("text"))
    return D.trimmed_history(t, "conversation", "idx", "tokens")


def idle_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a conversation without a pause of more than 30 minutes."""
    s = D.sessions(turns(spark, d).where("at IS NOT NULL"), "conversation", "at", 30)
    return s.select("conversation", "session", "n", (F.col("ended").cast("double") - F.col("started").cast("double")).cast("decimal(20,3)").cast("double").alias("seconds"))


def asked_before(spark: SparkSession, d: str) -> DataFrame:
    """For each answer the index of the question before it."""
    w = Window.partitionBy("conversation").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    q = F.last(F.when(F.col("role") == "user", F.col("idx")), ignorenulls=True).over(w)
    return turns(spark, d).withColumn("question_index", q).where("role = 'assistant'").select("conversation", "idx", "question_index")


def conversation_digests(spark: SparkSession, d: str) -> DataFrame:
    """What a summary of each conversation starts from: its newest 12 turns that aren't blank, cut to 240 characters, as hashed lines; and the masked form."""
    newest = Window.partitionBy("conversation").orderBy(F.col("idx").desc())
    t = turns(spark, d).withColumn("r", F.row_number().over(newest)).where(F.col("r") <= DEFAULTS.summary_turns).withColumn("said", T.strip("text"))
    role = F.coalesce("role", F.lit("unknown"))
    rows = t.where("said <> ''").select("conversation", "idx", role.alias("role"), F.substring("said", 1, 240).alias("said"))
    g = rows.groupBy("conversation").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "said"))).alias("t"))
    lines = F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["role"], F.lit(": "), x["said"])), "\n")
    topics = F.array_join(F.slice(F.transform("t", lambda x: F.concat(x["role"], F.lit(":topic"))), 1, 6), ", ")
    return g.select("conversation", F.size("t").alias("n_turns"), F.md5(lines).alias("lines_hash"), topics.alias("masked"), T.token_count(T.first_words(lines, 120)).alias("n_words"))


QUERIES = {f.__name__: f for f in (conversation_state, unused_runs, trimmed_history, idle_sessions, asked_before, conversation_digests)}

_T = f"""
turns AS (
  SELECT {hex_sql("conversation_id")} AS conversation, turn_index AS idx, min(a.role_name) AS role, min(text) AS text, min(created_at) AS made
  FROM conversation_turns c LEFT JOIN (SELECT DISTINCT label, role_name FROM role_aliases) a ON a.label = lower({strip_sql("c.role")})
  WHERE trim(conversation_id) <> '' AND turn_index IS NOT NULL GROUP BY 1, 2)"""

SQL = {
    "conversation_digests": f"""
WITH {_T}, n AS (SELECT conversation, idx, coalesce(role, 'unknown') AS role, {strip_sql("text")} AS said FROM turns QUALIFY row_number() OVER (PARTITION BY conversation ORDER BY idx DESC) <= 12),
s AS (SELECT *, row_number() OVER (PARTITION BY conversation ORDER BY idx) AS k FROM n WHERE said <> ''),
g AS (SELECT conversation, count(*) AS n_turns, string_agg('- ' || role || ': ' || substr(said, 1, 240), chr(10) ORDER BY idx) AS lines,
             string_agg(role || ':topic', ', ' ORDER BY idx) FILTER (k <= 6) AS masked FROM s GROUP BY 1)
SELECT conversation, n_turns, md5(lines) AS lines_hash, masked, least(120, {words_sql("lines")}) AS n_words FROM g""",
    "conversation_state": f"""
WITH {_T}
SELECT conversation, max(idx) + 1 AS next_index, arg_max_null(role, idx) AS last_role, count(*) AS n_turns, max(CASE WHEN role = 'user' THEN idx END) AS last_user_index,
       count(*) >= 12 AS summary_due FROM turns GROUP BY 1""",
    "unused_runs": f"""
WITH t AS (
  SELECT DISTINCT {hex_sql("conversation_id")} AS conversation, {hex_sql("turn_id")} AS query, {hex_sql("document_id")} AS doc, {hex_sql("chunk_id")} AS chunk, ordinal AS pos, score_lex_raw,
         score_vec_raw, score_rerank_raw, score_final, used_in_answer, used_in_context, created_at
  FROM retrieval_trace_items WHERE trim(turn_id) <> '' AND trim(chunk_id) <> '' AND trim(conversation_id) <> '' AND created_at IS NOT NULL),
r AS (SELECT conversation, NOT coalesce(used_in_answer, TRUE) AS ok,
             row_number() OVER (PARTITION BY conversation ORDER BY created_at DESC, concat_ws('/', query, lpad(CAST(pos AS VARCHAR), 6, '0'), chunk)) AS r FROM t),
b AS (SELECT conversation, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY conversation ORDER BY r) AS b FROM r WHERE r <= 10)
SELECT conversation, count(CASE WHEN b = 0 THEN 1 END) AS run FROM b GROUP BY 1""",
    "trimmed_history": f"""
WITH RECURSIVE {_T},
n AS (
  SELECT conversation, idx, row_number() OVER (PARTITION BY conversation ORDER BY idx DESC) AS r,
         CASE WHEN w = 0 THEN 0 ELSE greatest(1, CAST(floor(w * CAST(1.33 AS DOUBLE)) AS INT)) END AS tokens
  FROM (SELECT *, coalesce(len(regexp_extract_all(text, '[^{WS}]+')), 0) AS w FROM turns WHERE text IS NOT NULL)),
walk AS (
  SELECT conversation, idx, r, tokens <= 2048 AS keep, CASE WHEN tokens <= 2048 THEN tokens ELSE 0 END AS total FROM n WHERE r = 1
  UNION ALL
  SELECT n.conversation, n.idx, n.r, w.total + n.tokens <= 2048, CASE WHEN w.total + n.tokens <= 2048 THEN w.total + n.tokens ELSE w.total END
  FROM walk w JOIN n ON n.conversation = w.conversation AND n.r = w.r + 1 WHERE n.r <= 6)
SELECT conversation, idx FROM walk WHERE keep""",
    "idle_sessions": f"""
WITH {_T},
g AS (SELECT conversation, made, CASE WHEN epoch_us(made) - epoch_us(lag(made) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS s FROM turns WHERE made IS NOT NULL
      WINDOW w AS (PARTITION BY conversation ORDER BY made)),
n AS (SELECT *, sum(s) OVER (PARTITION BY conversation ORDER BY made) AS session FROM g)
SELECT conversation, session, count(*) AS n, round((epoch_us(max(made)) - epoch_us(min(made))) / 1e6, 3) AS seconds FROM n GROUP BY 1, 2""",
    "asked_before": f"""
WITH {_T}
SELECT conversation, idx, question_index FROM (
  SELECT *, max(CASE WHEN role = 'user' THEN idx END) OVER (PARTITION BY conversation ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question_index FROM turns)
WHERE role = 'assistant'""",
}
