"""Queries on texts, markdown and identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.keys import hex_key
from loomspark.functions.unicode import token_count
from loomspark.operators import markdown as M
from loomspark.session import table

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def canonical_sql(c: str) -> str:
    return f"regexp_replace({strip_sql(c)}, '[{WS}]+', ' ', 'g')"


def words_sql(c: str) -> str:
    return f"coalesce(len(regexp_extract_all({c}, '[^{WS}]+')), 0)"


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Three estimates of the number of tokens of every document."""
    return table(spark, d, "documents").select(
        "doc_id", token_count("text").alias("words"), T.estimated_tokens("text").alias("estimate"), T.floor_tokens("text").alias("floor_estimate")
    )


def text_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Groups of chunks whose texts are equal up to case and spacing."""
    c = table(spark, d, "chunks").where("chunk_text IS NOT NULL")
    return (
        c.select(T.text_hash("chunk_text").alias("text_hash"), hex_key("chunk_id").alias("k"))
        .groupBy("text_hash")
        .agg(F.count_distinct("k").alias("n_chunks"), F.min("k").alias("first_chunk"))
    )


def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """Links in items: every target with its position."""
    items = table(spark, d, "source_items").select("item_id", F.posexplode(T.links("markdown")).alias("pos", "url"))
    return items.select("item_id", (F.col("pos") + 1).alias("pos"), "url")


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every turn and the length of the longest."""
    t = table(spark, d, "conversation_turns").where("text IS NOT NULL").select("turn_id", "created_at", T.sentences("text").alias("s")).distinct()
    return t.select("turn_id", F.size("s").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"))


def sanitized_turns(spark: SparkSession, d: str) -> DataFrame:
    """User texts without lines that try to steer the model."""
    t = table(spark, d, "conversation_turns").where("text IS NOT NULL").select("turn_id", "turn_index", T.sanitized("text").alias("s")).distinct()
    return t.select("turn_id", "turn_index", F.col("s.text").alias("clean"), F.col("s.n_tool").alias("n_tool"), F.col("s.n_override").alias("n_override"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic chunk ids from tenant, document, ordinal and canonical text."""
    c = table(spark, d, "chunks").where("chunk_text IS NOT NULL AND document_id IS NOT NULL AND tenant_id IS NOT NULL AND ordinal IS NOT NULL")
    return c.select("chunk_id", "ordinal", T.stable_id("tenant_id", "document_id", "ordinal", T.canonical("chunk_text")).alias("stable_id")).distinct()


def chunk_inputs(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded, cited and cut of every chunk."""
    c = table(spark, d, "chunks").where("chunk_text IS NOT NULL")
    return c.select(
        "chunk_id",
        F.sha2(T.embedding_input("chunk_path", "chunk_text"), 256).alias("input_hash"),
        F.substring("chunk_text", 1, 200).alias("snippet"),
        T.truncated("chunk_text", 40).alias("short_text"),
    ).distinct()


def normalized_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Items with normalised line ends and spacing; code and table rows keep theirs."""
    n = M.normalized(table(spark, d, "source_items"), "item_id", "markdown")
    return n.select("item_id", F.sha2("markdown", 256).alias("checksum"), F.length("markdown").alias("n_chars"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The structural blocks of every item."""
    b = M.blocks(table(spark, d, "source_items"), "item_id", "markdown")
    return b.select("item_id", "block", "kind", "line_from", "line_to", "char_start", "char_end", "tokens")


def markdown_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Structure-aware, token-budgeted chunks of every item."""
    return M.chunks(table(spark, d, "source_items"), "item_id", "markdown")


def client_meta(spark: SparkSession, d: str) -> DataFrame:
    """Turns per client, as the JSON of a turn names it."""
    t = table(spark, d, "conversation_turns").distinct()
    return t.select(F.get_json_object("meta", "$.client").alias("client")).groupBy("client").agg(F.count("*").alias("n_turns"))


def parsed_versions(spark: SparkSession, d: str) -> DataFrame:
    """Metadata and dates of source versions through the parsers: the first JSON object of a noisy text, ISO text and back, seconds, ETags."""
    v = table(spark, d, "source_versions").distinct()
    noisy = F.concat(F.lit("metadata: "), F.coalesce("metadata_json", F.lit("")), F.lit(" (end)"))
    iso = T.iso_text("discovered_at")
    seconds = F.unix_micros("discovered_at") / 1_000_000
    return v.select(
        "source_version_id", "version_label", T.first_json_object(noisy).alias("metadata"), iso.alias("discovered"), (T.iso_timestamp(iso) == F.col("discovered_at")).alias("same"),
        F.abs(F.unix_micros(T.epoch_timestamp(seconds)) - F.unix_micros("discovered_at")).cast("bigint").alias("off"),
        T.etag_checksum(F.concat(F.lit('"'), F.md5("checksum"), F.lit('"'))).alias("etag"), T.error_text("version_label", 3).alias("short_label"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        token_counts, text_hashes, link_targets, sentence_counts, sanitized_turns, stable_ids, chunk_inputs, normalized_markdown,
        markdown_blocks, markdown_chunks, client_meta, parsed_versions,
    )
}

_HIT = "regexp_matches(x, '(?i){}')"
_TOOL = _HIT.format("|".join(f"(?:{p})" for p in T.TOOL_PATTERNS))
_OVER = _HIT.format("|".join(f"(?:{p})" for p in T.OVERRIDE_PATTERNS))

#: The lines with their ends, as blocks see them.
_WHOLE = rf"""
lines AS (
  SELECT item_id, i - 1 AS line, parts[i] AS t, coalesce(sum(length(parts[i])) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT item_id, regexp_extract_all(regexp_replace(markdown, '\r\n|\r', chr(10), 'g'), '[^{M.BREAKS}]*[{M.BREAKS}]|[^{M.BREAKS}]+') AS parts FROM source_items WHERE markdown <> ''))),"""
_PLAIN = r"""
lines AS (
  SELECT item_id, i - 1 AS line, parts[i] AS t
  FROM (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT item_id, string_split(regexp_replace(markdown, '\r\n|\r', chr(10), 'g'), chr(10)) AS parts FROM source_items WHERE markdown <> ''))),"""
_FENCED = f"""
fenced AS (
  SELECT *, {strip_sql("t")} AS s, starts_with({strip_sql("t")}, '```') AS fence,
         coalesce(sum(CASE WHEN starts_with({strip_sql("t")}, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY line), 0) AS fences,
         length(t) - length(replace(t, '|', '')) AS pipes
  FROM lines)"""

SQL = {
    "token_counts": f"""
SELECT doc_id, w AS words, greatest(1, CAST(round_even(w * CAST(1.33 AS DOUBLE), 0) AS INT)) AS estimate,
       CASE WHEN w = 0 THEN 0 ELSE greatest(1, CAST(floor(w * CAST(1.33 AS DOUBLE)) AS INT)) END AS floor_estimate
FROM (SELECT doc_id, {words_sql("text")} AS w FROM documents)""",
    "text_hashes": f"""
SELECT sha256(lower({canonical_sql("chunk_text")})) AS text_hash, count(DISTINCT k) AS n_chunks, min(k) AS first_chunk
FROM (SELECT chunk_text, CASE WHEN trim(chunk_id) <> '' THEN regexp_replace(lower(chunk_id), '[^0-9a-f]', '', 'g') END AS k
      FROM chunks WHERE chunk_text IS NOT NULL) GROUP BY 1""",
    "link_targets": r"""
SELECT item_id, i AS pos, u[i] AS url
FROM (SELECT item_id, u, unnest(range(1, len(u) + 1)) AS i
      FROM (SELECT item_id, regexp_extract_all(markdown, '\[[^\]]+\]\(([^)]+)\)', 1) AS u FROM source_items WHERE markdown IS NOT NULL))""",
    "sentence_counts": f"""
SELECT turn_id, len(s) AS n_sentences, coalesce(list_max([length(x) FOR x IN s]), 0) AS longest
FROM (SELECT DISTINCT turn_id, created_at, [{strip_sql("x")} FOR x IN string_split(regexp_replace({strip_sql("text")}, '([.!?])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)) IF {strip_sql("x")} <> ''] AS s
      FROM conversation_turns WHERE text IS NOT NULL)""",
    "sanitized_turns": f"""
SELECT DISTINCT turn_id, turn_index, CASE WHEN len(l) = 0 THEN '' WHEN clean = '' THEN '{T.NOTHING_LEFT}' ELSE clean END AS clean, n_tool, n_override
FROM (SELECT turn_id, turn_index, l, {strip_sql("array_to_string([x FOR x IN l IF NOT (" + _TOOL + " OR " + _OVER + ")], chr(10))")} AS clean,
             len([x FOR x IN l IF {_TOOL}]) AS n_tool, len([x FOR x IN l IF NOT {_TOOL} AND {_OVER}]) AS n_override
      FROM (SELECT turn_id, turn_index, [y FOR y IN string_split_regex(text, '{T.LINE_END}') IF {strip_sql("y")} <> ''] AS l FROM conversation_turns WHERE text IS NOT NULL))""",
    "stable_ids": f"""
SELECT DISTINCT chunk_id, ordinal, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS stable_id
FROM (SELECT chunk_id, ordinal, sha256(tenant_id || '|' || document_id || '|' || ordinal || '|' || {canonical_sql("chunk_text")}) AS h
      FROM chunks WHERE chunk_text IS NOT NULL AND document_id IS NOT NULL AND tenant_id IS NOT NULL AND ordinal IS NOT NULL)""",
    "chunk_inputs": f"""
SELECT DISTINCT chunk_id,
       sha256(CASE WHEN coalesce({strip_sql("chunk_path")}, '') = '' THEN chunk_text ELSE '[H] ' || {strip_sql("chunk_path")} || chr(10) || chunk_text END) AS input_hash,
       substr(chunk_text, 1, 200) AS snippet,
       CASE WHEN len(w) <= 30 THEN chunk_text ELSE array_to_string(w[1:30], ' ') || chr(10) || '[TRUNCATED_BY_TOKEN_BUDGET]' END AS short_text
FROM (SELECT *, regexp_extract_all(chunk_text, '[^{WS}]+') AS w FROM chunks WHERE chunk_text IS NOT NULL)""",
    "normalized_markdown": f"""
WITH {_PLAIN} {_FENCED},
done AS (
  SELECT item_id, line,
         CASE WHEN fence OR (fences % 2 = 1) THEN t
              WHEN pipes >= 2 THEN regexp_extract(t, '^[ \\t]*') || regexp_replace(substr(t, length(regexp_extract(t, '^[ \\t]*')) + 1), '[{WS}]+$', '')
              ELSE regexp_extract(t, '^[ \\t]*') || regexp_replace(regexp_replace(substr(t, length(regexp_extract(t, '^[ \\t]*')) + 1), '[ \\t]+', ' ', 'g'), '[{WS}]+$', '') END AS t
  FROM fenced)
SELECT item_id, sha256(m) AS checksum, length(m) AS n_chars FROM (SELECT item_id, string_agg(t, chr(10) ORDER BY line) AS m FROM done GROUP BY item_id)""",
    "markdown_blocks": f"""
WITH {_WHOLE} {_FENCED},
sep AS (
  SELECT *, regexp_full_match(s, '[|]*(?:[{WS}]*:?-{{3,}}:?[{WS}]*|[{WS}]*)(?:[|](?:[{WS}]*:?-{{3,}}:?[{WS}]*|[{WS}]*))*') AND pipes > 0 AS is_sep,
         fence OR fences % 2 = 1 AS code
  FROM fenced),
head AS (
  SELECT *, pipes >= 2 AND NOT code AND NOT is_sep AND regexp_matches(s, '[^|{WS}]')
            AND coalesce(lead(is_sep AND NOT code) OVER (PARTITION BY item_id ORDER BY line), FALSE) AS starts_table,
         sum(CASE WHEN pipes >= 2 AND NOT code THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY line) AS run
  FROM sep),
typed AS (
  SELECT *, CASE WHEN code THEN 'code'
                 WHEN regexp_matches(s, '^#{{1,6}}[{WS}]') THEN 'heading'
                 WHEN pipes >= 2 AND line >= min(CASE WHEN starts_table THEN line END) OVER (PARTITION BY item_id, run) THEN 'table'
                 WHEN pipes < 2 AND line - 1 = min(CASE WHEN starts_table THEN line END) OVER (PARTITION BY item_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AND is_sep THEN 'table'
                 WHEN s = '' THEN 'blank' WHEN starts_with(s, '>') THEN 'quote'
                 WHEN regexp_matches(s, '^[-*+][{WS}]+') OR regexp_matches(s, '^[0-9]+[.][{WS}]+') THEN 'list' ELSE 'paragraph' END AS kind
  FROM head),
cut AS (
  SELECT *, CASE WHEN kind = 'code' THEN (fence AND fences % 2 = 1) OR lag(kind) OVER w IS DISTINCT FROM 'code'
                 ELSE kind IS DISTINCT FROM lag(kind) OVER w END AS first
  FROM typed WINDOW w AS (PARTITION BY item_id ORDER BY line)),
numbered AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY line) AS b FROM cut)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY b) - 1 AS block, kind, line_from, line_to, char_start, char_end, tokens
FROM (SELECT item_id, b, any_value(kind) AS kind, min(line) AS line_from, max(line) AS line_to, min(pos) AS char_start, max(pos + length(t)) AS char_end,
             sum({words_sql("t")}) AS tokens
      FROM numbered WHERE kind NOT IN ('blank', 'heading') GROUP BY item_id, b)""",
    "parsed_versions": f"""
SELECT source_version_id, version_label, coalesce(metadata_json, '{{}}') AS metadata,
       coalesce(strftime(discovered_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || 'Z', '') AS discovered,
       CASE WHEN discovered_at IS NOT NULL THEN TRUE END AS same, CASE WHEN discovered_at IS NOT NULL THEN 0 END AS off, md5(checksum) AS etag,
       CASE WHEN {strip_sql("version_label")} <> '' THEN substr({strip_sql("version_label")}, 1, 3) END AS short_label
FROM (SELECT DISTINCT source_version_id, version_label, metadata_json, discovered_at, checksum, source_id, s3_raw_uri, s3_markdown_uri, deleted_at FROM source_versions)""",
    "client_meta": """
SELECT json_extract_string(meta, '$.client') AS client, count(*) AS n_turns FROM (SELECT DISTINCT * FROM conversation_turns) GROUP BY 1""",
}
