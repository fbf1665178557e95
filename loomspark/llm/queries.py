"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import conversations as conv
from loomspark.llm import neighbours, packing, splitting, tokenizing
from loomspark.llm import near_duplicates as dups
from loomspark.llm import quality as qual
from loomspark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's 5 most similar, at a cosine of at least 0.85."""
    return neighbours.similar_pairs(neighbours.usable_vectors(table(spark, d, "chunk_vectors")))


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar other chunks of every chunk that has a usable vector."""
    n = neighbours.similar_vectors(neighbours.usable_vectors(table(spark, d, "chunk_vectors")))
    return n.withColumn("cosine", F.round("cosine", 6))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The conversations that must be dropped."""
    return conv.broken_conversations(table(spark, d, "conversations"), table(spark, d, "conversation_turns"), table(spark, d, "role_aliases"))


def p3_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the sound conversations, in order."""
    return conv.sound_conversations(table(spark, d, "conversations"), table(spark, d, "conversation_turns"), table(spark, d, "role_aliases"))


def _duplicates(spark: SparkSession, d: str) -> dups.NearDuplicates:
    return dups.near_duplicates(dups.records_of(table(spark, d, "chunks"), table(spark, d, "documents")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicate chunks and titles."""
    return dups.key_pairs(_duplicates(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk and title that is long enough, with its class, its number of links and its group."""
    return dups.groups(_duplicates(spark, d))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return splitting.records_of(table(spark, d, "source_items"), table(spark, d, "chunks"))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of the oversized items and chunks."""
    return splitting.split_oversized(_records(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The oversized items and chunks: those that the splitter had to cut."""
    return (
        splitting.split_oversized(_records(spark, d), with_text=False)
        .where("piece = 0")
        .select("record_table", "record_key")
        .distinct()
    )


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document under byte_bpe_50k, without special tokens."""
    return tokenizing.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document (or piece of an oversized one) with its container of 2,048 tokens of byte_bpe_50k."""
    sizes = tokenizing.token_sizes(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "key")
    return packing.fill_containers(sizes).withColumnRenamed("key", "doc_id")


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    """The quality figures of every document whose text isn't null or blank."""
    # the list of function words is fixed; it doesn't grow with the data
    words = [r["word"] for r in table(spark, d, "common_words").select("word").distinct().collect()]
    return qual.quality(table(spark, d, "documents"), "doc_id", "text", words)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that aren't natural prose."""
    return p8_quality(spark, d).where(~F.col("is_prose")).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p3_found": p3_found,
    "p3_conversations": p3_conversations,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_quality": p8_quality,
}

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ZW = r"\x{180e}\x{200b}-\x{200f}\x{2060}\x{feff}"
_HEX = "CASE WHEN trim({0}) <> '' THEN regexp_replace(lower({0}), '[^0-9a-f]', '', 'g') END"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_TURNS = f"""
known AS (SELECT DISTINCT {_HEX.format("conversation_id")} AS c FROM conversations),
t AS (
  SELECT DISTINCT c, idx, coalesce(a.role_name, 'unknown: ' || r.label, 'unknown') AS role, a.role_name IS NULL AS no_role, text
  FROM (SELECT {_HEX.format("conversation_id")} AS c, turn_index AS idx, lower({_strip("role")}) AS label,
               CASE WHEN text IS NOT NULL AND NOT regexp_full_match(text, '[{_WS}{_ZW}]*') THEN {_strip("text")} END AS text
        FROM conversation_turns) r
  LEFT JOIN role_aliases a ON a.label = r.label
  WHERE c IN (SELECT c FROM known)),
said AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY idx) AS k FROM t WHERE role <> 'system'),
bad AS (
  SELECT c FROM t GROUP BY c
  HAVING bool_or(no_role) OR bool_or(idx IS NULL) OR count(*) <> count(DISTINCT idx) OR min(idx) <> 1 OR max(idx) <> count(*)
  UNION
  SELECT c FROM said GROUP BY c
  HAVING bool_or((role = 'user') <> (k % 2 = 1)) OR max_by(role, k) <> 'assistant' OR bool_or(text IS NULL)
  UNION
  SELECT c FROM known WHERE c NOT IN (SELECT c FROM said WHERE text IS NOT NULL AND NOT no_role))
"""

SQL = {
    "p3_found": f"WITH {_TURNS} SELECT c AS conversation_id FROM known WHERE c IS NOT NULL AND c IN (SELECT c FROM bad)",
    "p3_conversations": f"""WITH {_TURNS}
SELECT c AS conversation_id, idx AS turn_index, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY idx) AS exchange, role, text
FROM t WHERE c NOT IN (SELECT c FROM bad)""",
    "p5_found": f"""
SELECT DISTINCT record_table, record_key FROM (
  SELECT 'source_items' AS record_table, CAST(item_id AS VARCHAR) AS record_key, markdown AS text FROM source_items
  UNION ALL SELECT 'chunks', {_HEX.format("chunk_id")}, chunk_text FROM chunks)
WHERE len(regexp_extract_all(text, '[^{_WS}]+')) > 900""",
}

_JACCARD = """
SELECT '{name}' AS record_table, a.k AS key_a, b.k AS key_b
FROM (SELECT x.k AS ka, y.k AS kb, count(*) AS common
      FROM {name}_s x JOIN {name}_s y ON x.s = y.s AND x.k < y.k GROUP BY 1, 2) p
JOIN {name}_n a ON a.k = p.ka JOIN {name}_n b ON b.k = p.kb
WHERE p.common * {d} >= (a.n + b.n - p.common) * {n}"""

SQL["p4_found"] = rf"""
WITH chunks_w AS (
  SELECT k, regexp_extract_all(lower(chunk_text), '[\p{{L}}\p{{N}}]+') AS w
  FROM (SELECT DISTINCT {_HEX.format("chunk_id")} AS k, chunk_text FROM chunks) WHERE k IS NOT NULL AND chunk_text IS NOT NULL),
chunks_s AS MATERIALIZED (
  SELECT DISTINCT k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM chunks_w WHERE len(w) >= 25)),
chunks_n AS MATERIALIZED (SELECT k, count(*) AS n FROM chunks_s GROUP BY k),
documents_w AS (
  SELECT k, array_to_string(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}]+'), ' ') AS t
  FROM (SELECT DISTINCT {_HEX.format("document_id")} AS k, title FROM documents) WHERE k IS NOT NULL AND title IS NOT NULL),
documents_s AS MATERIALIZED (
  SELECT DISTINCT k, substr(t, i, 3) AS s FROM (SELECT k, t, unnest(range(1, len(t) - 1)) AS i FROM documents_w WHERE len(t) >= 30)),
documents_n AS MATERIALIZED (SELECT k, count(*) AS n FROM documents_s GROUP BY k)
{_JACCARD.format(name="chunks", n=3, d=5)}
UNION ALL
{_JACCARD.format(name="documents", n=13, d=20)}
"""

SQL["p1_found"] = f"""
WITH newest AS (
  SELECT k, embedding AS e FROM (SELECT {_HEX.format("chunk_id")} AS k, embedding, updated_at FROM chunk_vectors WHERE trim(chunk_id) <> '')
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY updated_at DESC NULLS LAST, embedding DESC NULLS LAST) = 1),
v AS MATERIALIZED (
  SELECT k, CAST(e AS DOUBLE[]) AS e FROM newest
  WHERE len(e) = 64 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
near AS (
  SELECT a.k AS me, b.k AS other, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a JOIN v b ON a.k <> b.k WHERE list_cosine_similarity(a.e, b.e) >= 0.85),
best AS (SELECT me, other FROM near QUALIFY row_number() OVER (PARTITION BY me ORDER BY c DESC, other) <= 5)
SELECT DISTINCT least(me, other) AS chunk_id_a, greatest(me, other) AS chunk_id_b FROM best"""
