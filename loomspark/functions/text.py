"""Text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.unicode import SPACE, strip, token_count, words

#: Lines that try to call tools, lines that try to override instructions, what stands for a text of which
#: nothing is left, and the mark of a truncated text.
TOOL_PATTERNS = (
    r"\b(use|run|execute|call)\b.{0,40}\b(shell|terminal|bash|powershell|python|tool|browser|curl|wget)\b",
    r"\b(install|pip\s+install|apt\s+install|brew\s+install)\b",
    r"\b(read|open|print)\b.{0,40}\b(/etc/passwd|\.env|secret|token|key)\b",
)
OVERRIDE_PATTERNS = (
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"(reveal|show|print)\s+(the\s+)?system\s+prompt",
    r"(you\s+are\s+now|act\s+as)\s+(a\s+)?system",
    r"override\s+(safety|policy|guardrails?)",
)
NOTHING_LEFT = "[sanitized user request]"
TRUNCATED = "\n[TRUNCATED_BY_TOKEN_BUDGET]"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(c: Column | str) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.array_join(words(c), " ")


def text_hash(c: Column | str) -> Column:
    """SHA-256 of the canonical text in lower case; texts that differ in case and spacing only are equal."""
    return F.sha2(F.lower(canonical(c)), 256)


def tokens(c: Column | str) -> Column:
    """The runs of characters that aren't white space, in lower case; null gives an empty list."""
    return F.coalesce(words(F.lower(col(c))), F.array().cast("array<string>"))


def estimated_tokens(c: Column | str, factor: float = 1.33) -> Column:
    """At least 1: words times a factor, rounded half to even."""
    return F.greatest(F.lit(1), F.bround(token_count(c) * F.lit(factor), 0).cast("int"))


def floor_tokens(c: Column | str, factor: float = 1.33) -> Column:
    """0 for blank texts, else at least 1: words times a factor, rounded down."""
    n = token_count(c)
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(factor)).cast("int")))


def sentences(c: Column | str) -> Column:
    """The text split behind . ! ? that white space follows; trimmed, none empty."""
    parts = F.split(strip(c), f"(?<=[.!?])[{SPACE}]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def links(c: Column | str) -> Column:
    """Targets of markdown links, in order, repeats kept."""
    return F.regexp_extract_all(col(c), F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))


def urls(c: Column | str) -> Column:
    """Bare web addresses outside of markdown links, without marks at their end, in order, repeats kept."""
    bare = F.regexp_replace(col(c), r"\[[^\]]+\]\(([^)]+)\)", " ")
    return F.regexp_extract_all(bare, F.lit(r"https?://[^\s<>()\[\]\"]*[^\s<>()\[\]\".,;:!?]"), F.lit(0))


def first_words(c: Column | str, n: int) -> Column:
    """At most the first ``n`` words, joined by single blanks where any are cut."""
    w = words(c)
    return F.when(F.size(w) <= n, col(c)).otherwise(F.array_join(F.slice(w, 1, n), " "))


def truncated(c: Column | str, budget: int, marker: str = TRUNCATED, factor: float = 1.33) -> Column:
    """The first words that a token budget allows, then a marker; shorter texts come out as they are."""
    n = max(1, int(budget / factor))
    return F.when(F.size(words(c)) <= n, col(c)).otherwise(F.concat(F.array_join(F.slice(words(c), 1, n), " "), F.lit(marker)))


def embedding_input(path: Column | str, text: Column | str) -> Column:
    """The text with its heading path, if there is one, as a first line."""
    p = F.coalesce(strip(path), F.lit(""))
    return F.when(p == "", col(text)).otherwise(F.concat(F.lit("[H] "), p, F.lit("\n"), col(text)))


def sanitized(c: Column | str) -> Column:
    """struct(text, n_tool, n_override): the text without blank lines and lines that try to steer the model.

    A line that meets both kinds of patterns counts as one of the first kind.
    A null or blank text gives an empty one.
    """
    lines = F.filter(F.split(col(c), LINE_END), lambda x: strip(x) != "")
    meets = lambda line, ps: line.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps))
    tool = F.filter(lines, lambda x: meets(x, TOOL_PATTERNS))
    override = F.filter(lines, lambda x: ~meets(x, TOOL_PATTERNS) & meets(x, OVERRIDE_PATTERNS))
    kept = strip(F.array_join(F.filter(lines, lambda x: ~meets(x, TOOL_PATTERNS + OVERRIDE_PATTERNS)), "\n"))
    text = F.when(strip(F.coalesce(col(c), F.lit(""))) == "", F.lit("")).when(kept == "", F.lit(NOTHING_LEFT)).otherwise(kept)
    return F.struct(text.alias("text"), F.greatest(F.size(tool), F.lit(0)).alias("n_tool"), F.greatest(F.size(override), F.lit(0)).alias("n_override"))


def stable_id(*parts: Column | str) -> Column:
    """A UUID from the SHA-256 of the parts, joined by bars; the same input has the same id in every run."""
    h = F.sha2(F.concat_ws("|", *[col(p).cast("string") for p in parts]), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)


def iso_timestamp(c: Column | str) -> Column:
    """A timestamp from ISO-8601 text, with Z or an offset (UTC without either); null for anything else."""
    s = strip(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.try_to_timestamp(s))


def iso_text(c: Column | str) -> Column:
    """ISO-8601 text of a timestamp in UTC (of the session's zone), to microseconds; the empty string for null."""
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), F.lit(""))


def epoch_timestamp(c: Column | str) -> Column:
    """A timestamp from seconds since 1970, fractions included."""
    return F.timestamp_micros((col(c) * 1_000_000).cast("bigint"))


def etag_checksum(c: Column | str) -> Column:
    """The checksum that an ETag states: 32 hexadecimal digits, in lower case and without quotes; null for any other, as of uploads in parts."""
    tag = F.lower(F.regexp_replace(strip(c), '^"|"$', ""))
    return F.when(tag.rlike("^[0-9a-f]{32}$"), tag)


def error_text(c: Column | str, length: int = 512) -> Column:
    """The first characters of an error message; null for empty and blank ones."""
    s = strip(c)
    return F.when(s != "", F.substring(s, 1, length))


def first_json_object(c: Column | str) -> Column:
    """From the first { to the last } of a text, if that is a JSON object; else the empty object."""
    inner = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner).otherwise(F.lit("{}"))


def json_errors(c: Column | str, fields: dict[str, str]) -> Column:
    """What a JSON object lacks, one error a field: "f: missing" or "f: not a <kind>"; ``fields`` name kinds as Spark's types (string, double, boolean, ...)."""
    shape = ", ".join(f"`{f}` {kind}" for f, kind in fields.items())
    typed = F.from_json(col(c), shape, {"mode": "PERMISSIVE"})
    there = F.coalesce(F.json_object_keys(col(c)), F.array().cast("array<string>"))
    wrong = [
        F.when(~F.array_contains(there, f), F.lit(f"{f}: missing")).when(typed[f].isNull(), F.lit(f"{f}: not a {kind}")) for f, kind in fields.items()
    ]
    return F.array_compact(F.array(*wrong))


def vector_literal(c: Column | str) -> Column:
    """A vector as text with eight decimals, halves rounded to even, as vector databases read it; null where a number has more than 20 digits before the point."""
    rounded = lambda x: F.bround(F.abs(x.cast("double")).try_cast("decimal(38,18)"), 8).cast("string")
    sign = lambda x: F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.concat(F.lit("["), F.array_join(F.transform(col(c), lambda x: F.concat(sign(x), rounded(x))), ","), F.lit("]"))


def as_labels(c: Column | str) -> Column:
    """Labels from null, a JSON list, or any other text, which is one label."""
    s = col(c)
    parsed = F.from_json(s, "array<string>")
    return F.when(s.isNull(), F.array().cast("array<string>")).when(strip(s).startswith("["), F.coalesce(parsed, F.array(s))).otherwise(F.array(s))
