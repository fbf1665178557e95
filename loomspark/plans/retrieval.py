"""Queries on retrieval: candidates of a turn are the rows of its trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS
from loomspark.functions import text as T
from loomspark.functions.keys import hex_key
from loomspark.functions.vectors import cosine
from loomspark.operators import context as C
from loomspark.operators import grounding as G
from loomspark.operators import lexical as L
from loomspark.operators import ranking as R
from loomspark.operators.sync import latest
from loomspark.plans.text import WS, words_sql
from loomspark.session import stored, table

#: Context sizes that make the budgets bite on short lists.
CONTEXT_TOKENS, CONTEXT_MARGIN = 512, 256


def trace(spark: SparkSession, d: str) -> DataFrame:
    """The trace without copies, keys in one spelling; rows without turn or chunk are left out."""
    t = table(spark, d, "retrieval_trace_items").select(
        hex_key("conversation_id").alias("conversation"), hex_key("turn_id").alias("query"), hex_key("document_id").alias("cited_document"),
        hex_key("chunk_id").alias("chunk"), F.col("ordinal").alias("pos"), F.col("score_lex_raw").alias("lex"), F.col("score_vec_raw").alias("vec"),
        F.col("score_rerank_raw").alias("rerank"), F.col("score_final").alias("score"), F.col("used_in_context").alias("in_context"),
        F.col("used_in_answer").alias("used"), F.col("created_at").alias("at"),
    )
    return t.where(F.col("query").isNotNull() & F.col("chunk").isNotNull()).distinct()


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """(chunk, document, ordinal, path, text): the newest life of each chunk."""
    c = table(spark, d, "chunks").select(
        hex_key("chunk_id").alias("chunk"), hex_key("document_id").alias("document"), "ordinal", F.col("chunk_path").alias("path"),
        F.col("chunk_text").alias("text"), "indexed_at", "deleted_at",
    )
    return latest(c.where("chunk IS NOT NULL").distinct(), ["chunk"], F.col("indexed_at").desc_nulls_last(), F.col("deleted_at").desc_nulls_first())


def turn_texts(spark: SparkSession, d: str) -> DataFrame:
    """(query, question): the text of each turn; of different deliveries the smallest."""
    t = table(spark, d, "conversation_turns").select(hex_key("turn_id").alias("query"), "text")
    return t.where("query IS NOT NULL AND text IS NOT NULL").groupBy("query").agg(F.min("text").alias("question"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """(query, chunk, lex, vec, score, ...): one row for each candidate of a turn, with its best scores."""
    return R.dedup_max(trace(spark, d), ["query", "chunk"], ["lex", "vec", "rerank", "score"], ["pos"], "pos")


def ranked(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid_rank(candidates(spark, d), "query", "chunk", "lex", "vec")


def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each turn, copies merged."""
    return candidates(spark, d)


def hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    """Fused, ordered candidates of each turn (the flagship query)."""
    return ranked(spark, d).select(
        "query", "chunk", F.round("lex_norm", 6).alias("lex_norm"), F.round("vec_norm", 6).alias("vec_norm"), F.round("final", 6).alias("final"), "rank"
    )


def question_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Lexical overlap of each turn's text with the chunks that were retrieved for it."""
    t = trace(spark, d).select("query", "chunk").distinct()
    q = turn_texts(spark, d).select("query", T.tokens("question").alias("terms"))
    c = chunk_rows(spark, d).where("text IS NOT NULL").select("chunk", T.tokens("text").alias("terms"))
    return R.term_overlap(t, q, c).withColumn("overlap", F.round("overlap", 6))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest rows of every row whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    k = R.vector_topk(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)
    return k.select("query", "id", F.round("distance", 6).alias("distance"), F.round(1 / (1 + F.col("distance")), 6).alias("score"), "rank")


def topic_resets(spark: SparkSession, d: str) -> DataFrame:
    """Whether the topic changes from one vector to the next."""
    e = table(spark, d, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("v")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("w"))
    j = a.join(b, "vec_id").withColumn("c", cosine("v", "w"))
    return j.select("vec_id", F.round("c", 5).alias("cosine"), (F.round("c", 9) < 0.35).alias("reset"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 50 = 0")
    q = docs.select(F.col("doc_id").alias("query"), F.array_distinct(T.tokens("title")).alias("terms"))
    return q.where(F.size("terms") > 0)


def _document_text():
    return F.concat_ws(" ", "title", F.array_join("labels", " "), "text")


def fts_match(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold all terms of a title; titles of every document whose id is divisible by 50."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.array_distinct(T.tokens(_document_text())).alias("terms"))
    return L.match_all(_titles(spark, d), docs)


def fts_rank(spark: SparkSession, d: str) -> DataFrame:
    """The same matches with their cover-density score: titles weigh most, then labels, then texts."""
    docs = table(spark, d, "documents")
    index = docs.select(F.col("doc_id").alias("key"), F.array_distinct(T.tokens(_document_text())).alias("terms"))
    q = _titles(spark, d)
    labels = F.coalesce(F.array_join("labels", " "), F.lit(""))
    terms = L.weighted_terms(docs, "doc_id", [("A", T.tokens("title")), ("B", T.tokens(labels)), ("C", T.tokens("text"))])
    s = L.cover_rank(L.match_all(q, index), q, terms)
    return s.select("query", "key", F.round("score", 6).alias("score"))


def _owned(spark: SparkSession, d: str) -> DataFrame:
    """(tenant, chunk, document, ordinal, title, labels, path, text): chunks with their document, where both belong to one tenant."""
    t = table(spark, d, "chunks").select(hex_key("chunk_id").alias("chunk"), hex_key("tenant_id").alias("tenant"), "indexed_at", "deleted_at").where("chunk IS NOT NULL")
    owner = latest(t.distinct(), ["chunk"], F.col("indexed_at").desc_nulls_last(), F.col("deleted_at").desc_nulls_first()).select("chunk", "tenant")
    docs = table(spark, d, "documents").select(
        hex_key("document_id").alias("document"), hex_key("tenant_id").alias("tenant"), "doc_id", "title", F.coalesce(F.array_join("labels", " "), F.lit("")).alias("labels")
    )
    docs = docs.where("document IS NOT NULL AND tenant IS NOT NULL").groupBy("document", "tenant").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("title", "doc_id").alias("title"), F.min_by("labels", "doc_id").alias("labels")
    )
    return chunk_rows(spark, d).where("text IS NOT NULL").join(owner, "chunk").join(docs, ["document", "tenant"])


def _fetched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(query, chunk, lex, vec) and the chunks they come from: the union of the best lexical and vector candidates of each question, in its own tenant.

    Questions are the titles of all documents whose id is divisible by 50,
    with the vector of their first chunk that has one. The tenant is part of
    every key that a question and a chunk meet in.
    """
    owned = stored(_owned(spark, d), "owned")
    vectors = owned.select("tenant", "chunk", "document", "ordinal", "doc_id").join(_vectors(spark, d), "chunk")
    asked = owned.where("doc_id % 50 = 0").groupBy("doc_id", "tenant").agg(F.min("title").alias("title")).select(
        F.col("doc_id").alias("query"), "tenant", F.array_distinct(T.tokens("title")).alias("terms")
    )
    scoped = lambda terms: F.transform(terms, lambda t: F.concat_ws("/", "tenant", t))
    q = asked.where(F.size("terms") > 0).select("query", scoped(F.col("terms")).alias("terms"))
    parts = [("A", scoped(T.tokens("title"))), ("B", scoped(T.tokens("labels"))), ("B", scoped(T.tokens(F.coalesce("path", F.lit(""))))), ("C", scoped(T.tokens("text")))]
    index = owned.select(F.col("chunk").alias("key"), F.array_distinct(F.concat(*(p for _, p in parts))).alias("terms"))
    lexical = L.cover_rank(L.match_all(q, index), q, L.weighted_terms(owned, "chunk", parts))
    top = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 9).desc(), "key"))
    lexical = lexical.withColumn("_r", top).where(F.col("_r") <= DEFAULTS.fetch_lexical).select("query", F.col("key").alias("chunk"), F.col("score").alias("lex"))
    first = vectors.where("doc_id % 50 = 0").groupBy(F.col("doc_id").alias("query"), "tenant").agg(F.min_by("v", F.struct("ordinal", "chunk")).alias("v"))
    # a query is known by its number, a row by its chunk; both are strings in the search
    near = R.vector_topk(first.withColumn("query", F.col("query").cast("string")), vectors.select(F.col("chunk").alias("id"), "tenant", "v"), DEFAULTS.fetch_vector, by="tenant")
    near = near.select(F.col("query").cast("bigint").alias("query"), F.col("id").alias("chunk"), (1 / (1 + F.col("distance"))).alias("vec"))
    return lexical.join(near, ["query", "chunk"], "full"), vectors.select("chunk", "document", "ordinal", "tenant")


def candidate_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid candidates of each question within its tenant: lexical and vector search, united, hydrated and ranked."""
    both, hydrated = _fetched(spark, d)
    r = R.hybrid_rank(both.join(hydrated, "chunk"), "query", "chunk", "lex", "vec")
    return r.select(
        "query", "tenant", "chunk", "document", "ordinal", F.round(F.coalesce("lex", F.lit(0.0)), 6).alias("lex"), F.round(F.coalesce("vec", F.lit(0.0)), 6).alias("vec"),
        F.round("final", 6).alias("final"),
    )


def boosted_rank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each turn with what recent use of the same chunk in the conversation adds, ranked again."""
    t = trace(spark, d)
    b = _boosts(t)
    # a chunk that turns of a conversation cite under several documents has its boost under each
    where = t.where("conversation IS NOT NULL").groupBy("query", "chunk").agg(F.min("conversation").alias("conversation"), F.min("cited_document").alias("document"))
    r = ranked(spark, d).select("query", "chunk", "final", "rank").join(where, ["query", "chunk"], "left")
    out = R.boosted(r, b, ["conversation", "document", "chunk"])
    return out.select("query", "chunk", F.round("boost", 6).alias("boost"), F.round("final", 6).alias("final"), "rank")


def fts_postings(spark: SparkSession, d: str) -> DataFrame:
    """Documents and occurrences of each term in titles (A), labels (B) and texts (C)."""
    p = L.postings(
        table(spark, d, "documents"), "doc_id",
        {"title": ("A", T.tokens("title")), "labels": ("B", T.tokens(F.array_join("labels", " "))), "text": ("C", T.tokens("text"))},
    )
    return p.groupBy("term", "part").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_occurrences"))


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    """Ranked candidates that are stored chunks, with their place; ranks are counted anew."""
    c = chunk_rows(spark, d).where("document IS NOT NULL AND ordinal IS NOT NULL")
    r = ranked(spark, d).select("query", "chunk", F.col("final").alias("score"), F.col("rank").alias("_r")).join(c.select("chunk", "document", "ordinal"), "chunk")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("_r"))).drop("_r")


def neighbour_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each turn's three best candidates, with the nearest one."""
    c = chunk_rows(spark, d).where("document IS NOT NULL AND ordinal IS NOT NULL").select("chunk", "document", "ordinal")
    a = _anchored(spark, d).where("rank <= 3").select("query", "document", "ordinal", "chunk", F.col("rank").alias("base"))
    return C.neighbours(a, c, 2)


def expanded_context(spark: SparkSession, d: str) -> DataFrame:
    """The best candidates of each turn with their neighbours, up to the cap."""
    c = chunk_rows(spark, d).where("document IS NOT NULL AND ordinal IS NOT NULL").select("chunk", "document", "ordinal")
    return C.expanded(_anchored(spark, d), c).withColumn("score", F.round("score", 6))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    # counted and hashed once a chunk, before the join repeats it
    c = chunk_rows(spark, d).where("text IS NOT NULL").select(
        "chunk", "document", "ordinal", "path", T.estimated_tokens("text").alias("tokens"), T.text_hash("text").alias("hash")
    )
    return ranked(spark, d).select("query", "chunk", F.col("final").alias("score")).join(c, "chunk")


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Which candidates of each turn stay in a small context."""
    kept = C.context_budget(_sized(spark, d).select("query", "chunk", "score", "tokens"), CONTEXT_TOKENS)
    return kept.select("query", "chunk", "tokens", "kept", "truncated")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "chunk_vectors").select(hex_key("chunk_id").alias("chunk"), F.col("updated_at").alias("u"), F.col("embedding").alias("e"))
    good = v.where((F.size("e") == 64) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return good.where("chunk IS NOT NULL").groupBy("chunk").agg(F.max(F.struct("u", "e"))["e"].alias("v"))


def budget_select(spark: SparkSession, d: str) -> DataFrame:
    """The prefix of each turn's candidates that gains and fits."""
    rows = _sized(spark, d).join(_vectors(spark, d), "chunk", "left")
    return C.budget_select(rows, CONTEXT_TOKENS).select("query", "chunk", "r", "tokens", F.round("score", 6).alias("score"))


def redundancy_filter(spark: SparkSession, d: str) -> DataFrame:
    """Each turn's candidates without repeated texts and near copies of the same path."""
    rows = _sized(spark, d).join(_vectors(spark, d), "chunk", "left")
    return C.redundancy_filter(rows.select("query", "chunk", "score", "hash", "path", "v"))


def _boosts(t: DataFrame) -> DataFrame:
    t = t.where("conversation IS NOT NULL AND at IS NOT NULL").select(
        "conversation", F.col("cited_document").alias("document"), "chunk", "used", "at", F.concat_ws("/", "query", F.lpad(F.col("pos").cast("string"), 6, "0"), "chunk").alias("tie")
    )
    return R.memory_boosts(t, "conversation")


def memory_boosts(spark: SparkSession, d: str) -> DataFrame:
    """What recently used chunks of a conversation are worth."""
    return _boosts(trace(spark, d)).withColumn("boost", F.round("boost", 6))


def expand_doc_neighbour(spark: SparkSession, d: str) -> DataFrame:
    """The best candidates of each turn, with the neighbours of the best one of each chosen document."""
    c = chunk_rows(spark, d).where("document IS NOT NULL AND ordinal IS NOT NULL").select("chunk", "document", "ordinal")
    return C.expanded_by_document(_anchored(spark, d), c).withColumn("score", F.round("score", 6))


def context_order(spark: SparkSession, d: str) -> DataFrame:
    """The expanded candidates of each turn in the order of a context: by the rank of their document, document, place and chunk."""
    rows = expand_doc_neighbour(spark, d)
    last = F.coalesce("document_rank", F.lit(DEFAULTS.expansion_docs + 1))
    at = F.row_number().over(Window.partitionBy("query").orderBy(last, "document", "ordinal", "chunk"))
    return rows.select("query", "chunk", at.alias("position"))


def document_depth(spark: SparkSession, d: str) -> DataFrame:
    """Documents among the best candidates of each turn, chunks a chosen document, the best document, and whether links would be followed."""
    return C.document_depth(_anchored(spark, d)).withColumn("depth", F.round("depth", 6))


def vector_literals(spark: SparkSession, d: str) -> DataFrame:
    """The newest vector of each chunk as text, hashed."""
    return _vectors(spark, d).select("chunk", F.md5(T.vector_literal("v")).alias("literal_hash"))


def context_with_margin(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each turn's candidates in a context of few tokens with a margin: dropped, kept, cut."""
    c = chunk_rows(spark, d).where("text IS NOT NULL").select("chunk", "text")
    rows = ranked(spark, d).select("query", "chunk", F.col("final").alias("score")).join(c, "chunk")
    return C.context_log(rows, C.assembled_context(rows, CONTEXT_TOKENS, CONTEXT_MARGIN))


def citation_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Used citations of each turn: how many name a stored chunk of the document they name."""
    used = trace(spark, d).where("used").select("query", "chunk", F.col("cited_document").alias("document"))
    g = G.grounded(used, chunk_rows(spark, d).select("chunk", "document"), ["chunk", "document"])
    return g.groupBy("query").agg(F.count("*").alias("n_citations"), F.count_if("grounded").alias("n_grounded"))


def answer_support(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each answer and how many of them its used chunks support."""
    used = trace(spark, d).where("used").select(F.col("query").alias("answer"), "chunk").distinct()
    e = chunk_rows(spark, d).where("text IS NOT NULL").select(F.col("chunk").alias("source"), "text")
    a = turn_texts(spark, d).select(F.col("query").alias("answer"), F.col("question").alias("text")).join(used.select("answer").distinct(), "answer", "left_semi")
    return G.sentence_support(a, used.withColumnRenamed("chunk", "source"), e)


def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Living chunks that have no vector yet."""
    c = chunk_rows(spark, d).where("deleted_at IS NULL").select("chunk")
    v = table(spark, d, "chunk_vectors").where("embedding IS NOT NULL").select(hex_key("chunk_id").alias("chunk"))
    return c.join(v, "chunk", "left_anti")


def hydrated_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates per source that have chunk, document and vector."""
    docs = table(spark, d, "documents").select(hex_key("document_id").alias("document"), "source").where("document IS NOT NULL").distinct()
    c = chunk_rows(spark, d).select("chunk", "document").join(docs, "document").join(_vectors(spark, d).select("chunk"), "chunk", "left_semi")
    return trace(spark, d).select("query", "chunk").distinct().join(c, "chunk").groupBy("source").agg(
        F.count("*").alias("n_candidates"), F.count_distinct("chunk").alias("n_chunks"), F.count_distinct("query").alias("n_turns")
    )


QUERIES = {
    f.__name__: f
    for f in (
        candidate_scores, hybrid_rank, question_overlap, vector_topk, topic_resets, fts_match, fts_rank, fts_postings, neighbour_chunks, expanded_context,
        candidate_fetch, boosted_rank, context_order, document_depth, vector_literals, expand_doc_neighbour, context_with_margin, context_budget, budget_select, redundancy_filter, memory_boosts, citation_grounding, answer_support, missing_vectors, hydrated_counts,
    )
}


def hex_sql(c: str) -> str:
    return f"CASE WHEN trim({c}) <> '' THEN regexp_replace(lower({c}), '[^0-9a-f]', '', 'g') END"


def tokens_sql(c: str) -> str:
    return f"coalesce(regexp_extract_all(lower({c}), '[^{WS}]+'), [])"


_TRACE = f"""
trace AS MATERIALIZED (
  SELECT DISTINCT {hex_sql("conversation_id")} AS conversation, {hex_sql("turn_id")} AS query, {hex_sql("document_id")} AS cited_document,
         {hex_sql("chunk_id")} AS chunk, ordinal AS pos, score_lex_raw AS lex, score_vec_raw AS vec, score_rerank_raw AS rerank, score_final AS score,
         used_in_answer AS used, used_in_context AS in_context, created_at AS made
  FROM retrieval_trace_items WHERE trim(turn_id) <> '' AND trim(chunk_id) <> '')"""
_CHUNKS = f"""
chunk_rows AS MATERIALIZED (
  SELECT * FROM (SELECT {hex_sql("chunk_id")} AS chunk, {hex_sql("document_id")} AS document, ordinal, chunk_path AS path, chunk_text AS text, indexed_at, deleted_at
                 FROM chunks WHERE trim(chunk_id) <> '')
  QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY indexed_at DESC NULLS LAST, deleted_at DESC NULLS FIRST) = 1)"""
_TURNS = f"""
turns AS MATERIALIZED (SELECT {hex_sql("turn_id")} AS query, min(text) AS question FROM conversation_turns WHERE trim(turn_id) <> '' AND text IS NOT NULL GROUP BY 1)"""
_CAND = """
cand AS (SELECT query, chunk, max(lex) AS lex, max(vec) AS vec, max(rerank) AS rerank, max(score) AS score, min_by(pos, pos) AS pos, count(*) AS n_rows FROM trace GROUP BY 1, 2)"""
_RANK = """
norm AS (
  SELECT *, CASE WHEN max(l) OVER q = min(l) OVER q THEN 1.0 ELSE (l - min(l) OVER q) / (max(l) OVER q - min(l) OVER q) END AS lex_norm,
         CASE WHEN max(v) OVER q = min(v) OVER q THEN 1.0 ELSE (v - min(v) OVER q) / (max(v) OVER q - min(v) OVER q) END AS vec_norm
  FROM (SELECT *, greatest(coalesce(lex, 0), 0) AS l, (least(greatest(coalesce(vec, 0), -1), 1) + 1) / 2 AS v FROM cand) WINDOW q AS (PARTITION BY query)),
ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY final DESC, chunk) AS rank
  FROM (SELECT *, round(CAST(0.7 AS DOUBLE) * vec_norm + CAST(0.3 AS DOUBLE) * lex_norm, 9) AS final FROM norm))"""
_ANCHORED = """
anchored AS (
  SELECT r.query, r.chunk, r.final AS score, c.document, c.ordinal, row_number() OVER (PARTITION BY r.query ORDER BY r.rank) AS rank
  FROM ranked r JOIN chunk_rows c ON c.chunk = r.chunk WHERE c.document IS NOT NULL AND c.ordinal IS NOT NULL)"""


def _near_sql(top: int, window: int) -> str:
    return f"""
near AS (
  SELECT * FROM (
    SELECT a.query, c.chunk, c.document, c.ordinal, a.chunk AS anchor, abs(c.ordinal - a.ordinal) AS distance, a.rank AS base, a.score
    FROM anchored a JOIN chunk_rows c ON c.document = a.document AND c.ordinal BETWEEN a.ordinal - {window} AND a.ordinal + {window} AND c.ordinal <> a.ordinal
    WHERE a.rank <= {top})
  WHERE (query, chunk) NOT IN (SELECT query, chunk FROM anchored WHERE rank <= {top})
  QUALIFY row_number() OVER (PARTITION BY query, chunk ORDER BY distance, base, anchor) = 1)"""


_SIZED = f"""
sized AS (
  SELECT r.query, r.chunk, r.final AS score, c.document, c.ordinal, c.text,
         greatest(1, CAST(round_even(len(regexp_extract_all(c.text, '[^{WS}]+')) * CAST(1.33 AS DOUBLE), 0) AS INT)) AS tokens
  FROM ranked r JOIN chunk_rows c ON c.chunk = r.chunk WHERE c.text IS NOT NULL)"""
_VECTORS = f"""
vectors AS MATERIALIZED (
  SELECT * FROM (SELECT {hex_sql("chunk_id")} AS chunk, embedding AS v, updated_at FROM chunk_vectors
                 WHERE trim(chunk_id) <> '' AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
  QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY updated_at DESC NULLS LAST, v DESC) = 1)"""
_DOCTEXT = "concat_ws(' ', title, array_to_string(labels, ' '), text)"


_EXPAND = """
base AS (SELECT * FROM anchored WHERE rank <= 8),
best AS (SELECT * FROM base QUALIFY row_number() OVER (PARTITION BY query, document ORDER BY score DESC, ordinal, chunk) = 1),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS document_rank FROM best QUALIFY document_rank <= 4),
near AS (
  SELECT b.query, c.chunk, c.document, c.ordinal, b.score * CAST(0.92 AS DOUBLE) AS score, b.document_rank
  FROM chosen b JOIN chunk_rows c ON c.document = b.document AND c.ordinal BETWEEN b.ordinal - 1 AND b.ordinal + 1
  WHERE (b.query, c.chunk) NOT IN (SELECT query, chunk FROM base)),
few AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query, document ORDER BY ordinal, chunk) <= 6),
added AS (SELECT * FROM few QUALIFY row_number() OVER (PARTITION BY query ORDER BY document_rank, ordinal, chunk) <= 12),
expanded AS (
  SELECT b.query, b.chunk, b.document, b.ordinal, b.score, TRUE AS is_base, c.document_rank FROM base b LEFT JOIN chosen c ON c.query = b.query AND c.document = b.document
  UNION ALL SELECT query, chunk, document, ordinal, score, FALSE, document_rank FROM added)"""


def cover_sql(matches: str) -> str:
    """CTEs from ``hits0`` (query, key, pos, term, w) of the relation ``matches`` (query, key, n) to ``covers`` (query, key, score)."""
    return f"""
hits AS MATERIALIZED (
  SELECT h.*, m.n, row_number() OVER k AS at, sum(CAST(1 AS DOUBLE) / w) OVER k AS inv
  FROM hits0 h JOIN {matches} m ON m.query = h.query AND m.key = h.key WINDOW k AS (PARTITION BY h.query, h.key ORDER BY pos)),
latest AS (
  SELECT h.query, h.key, h.pos, h.n, l.term, max(l.pos) AS last FROM hits h JOIN hits l ON h.query = l.query AND h.key = l.key AND l.pos <= h.pos GROUP BY ALL),
ends AS (SELECT query, key, pos, min(last) AS begun FROM latest GROUP BY query, key, pos, n HAVING count(*) = n),
cover AS (SELECT query, key, begun, min(pos) AS ended FROM ends GROUP BY ALL),
covers AS (
  SELECT c.query, c.key, sum((b.at - a.at + 1) / (b.inv - a.inv + 1 / a.w) / (1 + (c.ended - c.begun) - (b.at - a.at))) AS score
  FROM cover c JOIN hits a ON a.query = c.query AND a.key = c.key AND a.pos = c.begun JOIN hits b ON b.query = c.query AND b.key = c.key AND b.pos = c.ended GROUP BY ALL)"""


def positions_sql(relation: str, parts: list[tuple[float, str]]) -> str:
    """SELECT key, pos, term, w of the parts (weight, array of terms) of a relation with a key, one after the other."""
    terms = " || ".join(f"[{{'term': t, 'w': CAST({w} AS DOUBLE)}} FOR t IN {e}]" for w, e in parts)
    return f"SELECT key, i - 1 AS pos, z[i].term AS term, z[i].w AS w FROM (SELECT key, z, unnest(range(1, len(z) + 1)) AS i FROM (SELECT key, {terms} AS z FROM {relation}))"


SQL = {
    "candidate_scores": f"WITH {_TRACE}, {_CAND} SELECT * FROM cand",
    "hybrid_rank": f"WITH {_TRACE}, {_CAND}, {_RANK} SELECT query, chunk, round(lex_norm, 6) AS lex_norm, round(vec_norm, 6) AS vec_norm, round(final, 6) AS final, rank FROM ranked",
    "question_overlap": f"""
WITH {_TRACE}, {_CHUNKS}, {_TURNS}
SELECT query, chunk, round(CAST(coalesce(list_sum([least(len([y FOR y IN q IF y = x]), len([y FOR y IN t IF y = x])) FOR x IN list_distinct(q)]), 0) AS DOUBLE) / greatest(1, len(list_distinct(q))), 6) AS overlap
FROM (SELECT p.query, p.chunk, {tokens_sql("u.question")} AS q, {tokens_sql("c.text")} AS t
      FROM (SELECT DISTINCT query, chunk FROM trace) p JOIN turns u ON u.query = p.query JOIN chunk_rows c ON c.chunk = p.chunk WHERE c.text IS NOT NULL)""",
    "vector_topk": """
SELECT query, id, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS score, rank
FROM (SELECT q.vec_id AS query, e.vec_id AS id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS distance,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9), e.vec_id) AS rank
      FROM embeddings q JOIN embeddings e ON len(q.embedding) = len(e.embedding) WHERE q.vec_id % 50 = 0)
WHERE rank <= 10""",
    "topic_resets": """
SELECT vec_id, round(c, 5) AS cosine, round(c, 9) < 0.35 AS reset
FROM (SELECT a.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""",
    "fts_match": f"""
WITH q AS (SELECT doc_id AS query, list_distinct({tokens_sql("title")}) AS terms FROM documents WHERE doc_id % 50 = 0 AND len({tokens_sql("title")}) > 0),
i AS MATERIALIZED (SELECT doc_id AS key, list_distinct({tokens_sql(_DOCTEXT)}) AS terms FROM documents)
SELECT query, key FROM q JOIN i ON list_has_all(i.terms, q.terms)""",
    "fts_rank": f"""
WITH q AS (SELECT doc_id AS query, list_distinct({tokens_sql("title")}) AS terms FROM documents WHERE doc_id % 50 = 0 AND len({tokens_sql("title")}) > 0),
d AS MATERIALIZED (SELECT doc_id AS key, {tokens_sql("title")} AS a, {tokens_sql("array_to_string(labels, ' ')")} AS b, {tokens_sql("text")} AS c FROM documents),
m AS MATERIALIZED (SELECT query, key, len(q.terms) AS n, q.terms FROM q JOIN d ON list_has_all(a || b || c, q.terms)),
p AS ({positions_sql("d WHERE key IN (SELECT key FROM m)", [(1.0, "a"), (0.4, "b"), (0.2, "c")])}),
hits0 AS (SELECT m.query, p.* FROM m JOIN p ON p.key = m.key AND list_contains(m.terms, p.term)), {cover_sql("m")}
SELECT query, key, round(score, 6) AS score FROM covers""",
    "candidate_fetch": f"""
WITH {_CHUNKS}, {_VECTORS},
owner AS (
  SELECT chunk, tenant FROM (SELECT {hex_sql("chunk_id")} AS chunk, {hex_sql("tenant_id")} AS tenant, indexed_at, deleted_at FROM chunks WHERE trim(chunk_id) <> '')
  QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY indexed_at DESC NULLS LAST, deleted_at DESC NULLS FIRST) = 1),
docs AS (
  SELECT document, tenant, min(doc_id) AS doc_id, arg_min(title, doc_id) AS title, arg_min(labels, doc_id) AS labels
  FROM (SELECT {hex_sql("document_id")} AS document, {hex_sql("tenant_id")} AS tenant, doc_id, title, coalesce(array_to_string(labels, ' '), '') AS labels FROM documents)
  WHERE document IS NOT NULL AND tenant IS NOT NULL GROUP BY 1, 2),
owned AS MATERIALIZED (
  SELECT c.*, o.tenant, d.doc_id, d.title, d.labels FROM chunk_rows c JOIN owner o ON o.chunk = c.chunk JOIN docs d ON d.document = c.document AND d.tenant = o.tenant WHERE c.text IS NOT NULL),
q AS MATERIALIZED (SELECT doc_id AS query, tenant, list_distinct({tokens_sql("min(title)")}) AS terms FROM owned WHERE doc_id % 50 = 0 GROUP BY doc_id, tenant),
d AS MATERIALIZED (SELECT chunk AS key, tenant, {tokens_sql("title")} AS a, {tokens_sql("labels")} AS b, {tokens_sql("coalesce(path, '')")} AS b2, {tokens_sql("text")} AS c FROM owned),
m AS MATERIALIZED (SELECT query, key, len(q.terms) AS n, q.terms FROM q JOIN d ON d.tenant = q.tenant AND len(q.terms) > 0 AND list_has_all(a || b || b2 || c, q.terms)),
p AS ({positions_sql("d WHERE key IN (SELECT key FROM m)", [(1.0, "a"), (0.4, "b"), (0.4, "b2"), (0.2, "c")])}),
hits0 AS (SELECT m.query, p.* FROM m JOIN p ON p.key = m.key AND list_contains(m.terms, p.term)), {cover_sql("m")},
lexical AS (SELECT query, key AS chunk, score AS lex FROM covers QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) <= 20),
hydrated AS MATERIALIZED (SELECT o.tenant, o.chunk, o.document, o.ordinal, o.doc_id, v.v FROM owned o JOIN vectors v ON v.chunk = o.chunk),
first AS (SELECT doc_id AS query, tenant, v FROM hydrated WHERE doc_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id, tenant ORDER BY ordinal NULLS FIRST, chunk) = 1),
near AS (
  SELECT f.query, h.chunk, round(list_distance(CAST(f.v AS DOUBLE[]), CAST(h.v AS DOUBLE[])), 9) AS distance FROM first f JOIN hydrated h ON h.tenant = f.tenant),
vec AS (SELECT query, chunk, 1 / (1 + distance) AS vec FROM near QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, chunk) <= 20),
cand AS (
  SELECT query, chunk, lex, vec, h.tenant, h.document, h.ordinal
  FROM (SELECT coalesce(l.query, v.query) AS query, coalesce(l.chunk, v.chunk) AS chunk, lex, vec FROM lexical l FULL JOIN vec v ON v.query = l.query AND v.chunk = l.chunk) u
  JOIN hydrated h USING (chunk)), {_RANK}
SELECT query, tenant, chunk, document, ordinal, round(coalesce(lex, 0), 6) AS lex, round(coalesce(vec, 0), 6) AS vec, round(final, 6) AS final FROM ranked""",
    "boosted_rank": f"""
WITH {_TRACE}, {_CAND}, {_RANK},
n AS (SELECT conversation, cited_document AS document, chunk, used,
             row_number() OVER (PARTITION BY conversation ORDER BY made DESC, concat_ws('/', query, lpad(CAST(pos AS VARCHAR), 6, '0'), chunk)) - 1 AS r
      FROM trace WHERE conversation IS NOT NULL AND made IS NOT NULL),
boosts AS (
  SELECT conversation, document, chunk, max(CAST(0.12 AS DOUBLE) * greatest(CAST(0.3 AS DOUBLE), 1 - CAST(0.2 AS DOUBLE) * r)) AS boost FROM n WHERE used AND r < 20 GROUP BY 1, 2, 3),
place AS (SELECT query, chunk, min(conversation) AS conversation, min(cited_document) AS document FROM trace WHERE conversation IS NOT NULL GROUP BY 1, 2),
b AS (
  SELECT r.query, r.chunk, least(CAST(0.12 AS DOUBLE), coalesce(x.boost, 0)) AS boost, round(r.final + least(CAST(0.12 AS DOUBLE), coalesce(x.boost, 0)), 9) AS final
  FROM ranked r LEFT JOIN place p ON p.query = r.query AND p.chunk = r.chunk
  LEFT JOIN boosts x ON x.conversation = p.conversation AND x.document = p.document AND x.chunk = r.chunk)
SELECT query, chunk, round(boost, 6) AS boost, round(final, 6) AS final, row_number() OVER (PARTITION BY query ORDER BY b.final DESC, chunk) AS rank FROM b""",
    "vector_literals": f"""
WITH {_VECTORS} SELECT chunk, md5('[' || array_to_string([printf('%.8f', CAST(x AS DOUBLE)) FOR x IN v], ',') || ']') AS literal_hash FROM vectors""",
    "document_depth": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS}, {_ANCHORED},
docs AS (SELECT query, document, count(*) AS n, max(score) AS score FROM anchored WHERE rank <= 8 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, document) AS r FROM docs),
g AS (SELECT query, count(*) AS n_documents, avg(CASE WHEN r <= 4 THEN n END) AS depth, arg_min(document, r) AS top_document, count(CASE WHEN r <= 4 THEN 1 END) AS c FROM r GROUP BY 1)
SELECT query, n_documents, round(depth, 6) AS depth, top_document, depth < 1.5 OR n_documents > c AS follows_links FROM g""",
    "context_order": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS}, {_ANCHORED}, {_EXPAND}
SELECT query, chunk, row_number() OVER (PARTITION BY query ORDER BY coalesce(document_rank, 5), document, ordinal, chunk) AS position FROM expanded""",
    "expand_doc_neighbour": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS}, {_ANCHORED}, {_EXPAND}
SELECT query, chunk, document, ordinal, round(score, 6) AS score, is_base, document_rank FROM expanded""",
    "context_with_margin": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS},
s AS (SELECT r.query, r.chunk, r.final AS score, {words_sql("c.text")} AS w FROM ranked r JOIN chunk_rows c ON c.chunk = r.chunk WHERE c.text IS NOT NULL),
t AS (SELECT *, greatest(1, CAST(round_even(w * CAST(1.33 AS DOUBLE), 0) AS INT)) AS tokens FROM s),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY query ORDER BY score DESC, chunk DESC ROWS UNBOUNDED PRECEDING) <= {CONTEXT_TOKENS - CONTEXT_MARGIN} AS fits,
               row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS b FROM t),
f AS (SELECT *, b = 1 AND NOT bool_or(fits) OVER (PARTITION BY query) AS cut FROM run),
-- a text that is cut keeps its first words and a mark of one word
c AS (SELECT *, CASE WHEN cut THEN least(w, {int((CONTEXT_TOKENS - CONTEXT_MARGIN) / 1.33)} + 1) ELSE w END AS w2 FROM f),
e AS (SELECT *, greatest(1, CAST(round_even(w2 * CAST(1.33 AS DOUBLE), 0) AS INT)) AS tokens2 FROM c)
SELECT query, count(*) AS n_before, count(*) - count(CASE WHEN fits AND NOT cut THEN 1 END) AS n_dropped, sum(tokens) AS initial_tokens,
       sum(CASE WHEN fits OR cut THEN tokens2 END) AS final_tokens, greatest(0, sum(tokens) - sum(CASE WHEN fits OR cut THEN tokens2 END)) AS trimmed_tokens,
       sum(w) AS words_before, sum(CASE WHEN fits OR cut THEN w2 END) AS words_after, bool_or(cut) AS truncated
FROM e GROUP BY query""",
    "fts_postings": f"""
SELECT term, part, count(DISTINCT doc_id) AS n_documents, count(*) AS n_occurrences FROM (
  SELECT doc_id, 'A' AS part, unnest({tokens_sql("title")}) AS term FROM documents
  UNION ALL SELECT doc_id, 'B', unnest({tokens_sql("array_to_string(labels, ' ')")}) FROM documents
  UNION ALL SELECT doc_id, 'C', unnest({tokens_sql("text")}) FROM documents) GROUP BY 1, 2""",
    "neighbour_chunks": f"WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS}, {_ANCHORED}, {_near_sql(3, 2)} SELECT query, chunk, document, ordinal, anchor, distance FROM near",
    "expanded_context": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS}, {_ANCHORED}, {_near_sql(5, 1)}
SELECT query, chunk, document, ordinal, round(score, 6) AS score, is_base FROM (
  SELECT query, chunk, document, ordinal, score, TRUE AS is_base, rank AS base FROM anchored WHERE rank <= 5
  UNION ALL SELECT query, chunk, document, ordinal, greatest(0, score * CAST(0.92 AS DOUBLE)), FALSE, base FROM near)
QUALIFY row_number() OVER (PARTITION BY query ORDER BY is_base DESC, base, document, ordinal, chunk) <= 12""",
    "context_budget": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS}, {_SIZED},
run AS (SELECT *, sum(tokens) OVER (PARTITION BY query ORDER BY score DESC, chunk DESC ROWS UNBOUNDED PRECEDING) <= {CONTEXT_TOKENS} AS fits,
               row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS b FROM sized),
flag AS (SELECT *, b = 1 AND NOT bool_or(fits) OVER (PARTITION BY query) AS truncated FROM run)
SELECT query, chunk, tokens, fits OR truncated AS kept, truncated FROM flag""",
    "budget_select": f"""
WITH {_TRACE}, {_CAND}, {_RANK}, {_CHUNKS}, {_SIZED}, {_VECTORS},
r AS MATERIALIZED (SELECT s.*, v.v, row_number() OVER (PARTITION BY query ORDER BY score DESC, document, ordinal, s.chunk) AS r FROM sized s LEFT JOIN vectors v ON v.chunk = s.chunk),
worst AS (
  SELECT a.query, a.r, max(CASE WHEN isfinite(list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[]))) THEN list_cosine_similarity(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) ELSE 0 END) AS c
  FROM r a JOIN r b ON a.query = b.query AND b.r < a.r GROUP BY 1, 2),
ok AS (
  SELECT r.*, round(score - greatest(0, coalesce(c, 0) - CAST(0.92 AS DOUBLE)), 9) >= 0.01 AND sum(tokens) OVER (PARTITION BY r.query ORDER BY r.r) <= {CONTEXT_TOKENS} AS ok
  FROM r LEFT JOIN worst w ON w.query = r.query AND w.r = r.r)
SELECT query, chunk, r, tokens, round(score, 6) AS score FROM (SELECT *, bool_and(ok) OVER (PARTITION BY query ORDER BY r) AS pass FROM ok) WHERE pass""",
    "memory_boosts": f"""
WITH {_TRACE},
n AS (SELECT conversation, cited_document AS document, chunk, used,
             row_number() OVER (PARTITION BY conversation ORDER BY made DESC, concat_ws('/', query, lpad(CAST(pos AS VARCHAR), 6, '0'), chunk)) - 1 AS r
      FROM trace WHERE conversation IS NOT NULL AND made IS NOT NULL)
SELECT conversation, document, chunk, round(max(CAST(0.12 AS DOUBLE) * greatest(CAST(0.3 AS DOUBLE), 1 - CAST(0.2 AS DOUBLE) * r)), 6) AS boost FROM n WHERE used AND r < 20 GROUP BY 1, 2, 3""",
    "citation_grounding": f"""
WITH {_TRACE}, {_CHUNKS}
SELECT t.query, count(*) AS n_citations, count(c.chunk) AS n_grounded
FROM trace t LEFT JOIN chunk_rows c ON c.chunk = t.chunk AND c.document = t.cited_document WHERE t.used GROUP BY 1""",
    "answer_support": f"""
WITH {_TRACE}, {_CHUNKS}, {_TURNS},
used AS (SELECT DISTINCT query, chunk FROM trace WHERE used),
s AS (
  SELECT query, i, {tokens_sql("parts[i]")} AS st
  FROM (SELECT query, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT query, [y FOR y IN [regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g') FOR x IN string_split(
      regexp_replace(regexp_replace(question, '^[{WS}]+|[{WS}]+$', '', 'g'), '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1))] IF y <> ''] AS parts
    FROM turns WHERE query IN (SELECT query FROM used)))),
t AS (
  SELECT s.query, s.i, bool_or(
    CAST(len(list_intersect(list_distinct(st), et)) AS DOUBLE) / greatest(1, len(list_distinct(st))) >= 0.25
    OR round(sqrt(CAST(len([x FOR x IN st IF list_contains(et, x)]) AS DOUBLE) / greatest(1, len(st))), 9) >= 0.65) AS ok
  FROM s JOIN used u ON u.query = s.query JOIN (SELECT chunk, list_distinct({tokens_sql("text")}) AS et FROM chunk_rows WHERE text IS NOT NULL) c ON c.chunk = u.chunk
  GROUP BY 1, 2)
SELECT a.query AS answer, count(s.i) AS n_sentences, count(CASE WHEN t.ok THEN 1 END) AS n_supported
FROM (SELECT query FROM turns WHERE query IN (SELECT query FROM used)) a LEFT JOIN s ON s.query = a.query LEFT JOIN t ON t.query = s.query AND t.i = s.i GROUP BY 1""",
    "missing_vectors": f"""
WITH {_CHUNKS}
SELECT chunk FROM chunk_rows WHERE deleted_at IS NULL AND chunk NOT IN (SELECT {hex_sql("chunk_id")} FROM chunk_vectors WHERE embedding IS NOT NULL AND trim(chunk_id) <> '')""",
    "hydrated_counts": f"""
WITH {_TRACE}, {_CHUNKS}, {_VECTORS}
SELECT d.source, count(*) AS n_candidates, count(DISTINCT t.chunk) AS n_chunks, count(DISTINCT t.query) AS n_turns
FROM (SELECT DISTINCT query, chunk FROM trace) t JOIN chunk_rows c ON c.chunk = t.chunk
JOIN (SELECT DISTINCT {hex_sql("document_id")} AS document, source FROM documents WHERE trim(document_id) <> '') d ON d.document = c.document
WHERE c.chunk IN (SELECT chunk FROM vectors) GROUP BY 1""",
}
