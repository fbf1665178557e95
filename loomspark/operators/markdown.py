"""Markdown as rows of lines: normalising, structural blocks and chunks.

Lines are exploded; fences, tables and blocks are runs of lines, found with
window functions over the document, which sort and spill like any other. What
depends on all that came before (the headings above a block, which chunk it
goes to) is walked: the blocks of a document, numbers and headings only, are
streamed in order through a task, which holds the open chunk and no more. All
is linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS, Config
from loomspark.functions.unicode import SPACE, strip, token_count
from loomspark.session import stored


#: Characters that end a line once \\r\\n and \\r are \\n (fixed values).
BREAKS = r"\n\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}"


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, t): the lines without their ends, which are \\n, \\r\\n or \\r. Null and empty texts have none."""
    parts = F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), "\n")
    return df.where(F.col(text) != "").select(F.col(key), F.posexplode(parts).alias("line", "t"))


def whole_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, t, at): the lines with their ends, any of BREAKS, and the code point each starts at, \\r\\n and \\r made \\n."""
    parts = F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), f"(?<=[{BREAKS}])")
    along = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.select(F.col(key), F.posexplode(parts).alias("line", "t"))
        .where(F.col("t") != "")
        .withColumn("at", F.coalesce(F.sum(F.length("t")).over(along), F.lit(0)))
    )


def fenced(rows: DataFrame, key: str) -> DataFrame:
    """Adds s (the stripped line), fence, fences (their running number), pipes and code."""
    along = Window.partitionBy(key).orderBy("line")
    out = rows.withColumns(
        {"s": strip("t"), "pipes": F.length("t") - F.length(F.regexp_replace("t", r"\|", ""))}
    ).withColumn("fence", F.col("s").startswith("```"))
    out = out.withColumn("fences", F.sum(F.col("fence").cast("int")).over(along))
    return out.withColumn("code", F.col("fence") | (F.col("fences") % 2 == 1))


def normalized(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): code as it is, rows of tables without white space at the end, other lines also with single blanks inside."""
    indent = F.regexp_extract("t", r"^[ \t]*", 0)
    body = F.expr("substring(t, length(regexp_extract(t, '^[ \\\\t]*', 0)) + 1)")
    end = f"[{SPACE}]+$"
    line = (
        F.when(F.col("code"), F.col("t"))
        .when(F.col("pipes") >= 2, F.concat(indent, F.regexp_replace(body, end, "")))
        .otherwise(F.concat(indent, F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), end, "")))
    )
    rows = fenced(lines(df, key, text), key).select(key, "line", line.alias("t"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias(text))


def typed_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines with their kind (code, table, list, quote, paragraph, heading, blank) and the number of their block ``b``."""
    along = Window.partitionBy(key).orderBy("line")
    ws = SPACE
    cell = rf"(?:[{ws}]*:?-{{3,}}:?[{ws}]*|[{ws}]*)"
    rows = fenced(whole_lines(df, key, text), key)
    rows = rows.withColumn("is_sep", (F.col("pipes") > 0) & F.col("s").rlike(rf"^[|]*{cell}(?:[|]{cell})*$"))
    piped = (F.col("pipes") >= 2) & ~F.col("code")
    next_sep = F.coalesce(F.lead(F.col("is_sep") & ~F.col("code")).over(along), F.lit(False))
    rows = rows.withColumns(
        {
            "starts_table": piped & ~F.col("is_sep") & F.col("s").rlike(rf"[^|{ws}]") & next_sep,
            "run": F.sum(F.when(piped, 0).otherwise(1)).over(along),
        }
    )
    start = F.min(F.when(F.col("starts_table"), F.col("line"))).over(Window.partitionBy(key, "run"))
    kind = (
        F.when(F.col("code"), "code")
        .when(F.col("s").rlike(rf"^#{{1,6}}[{ws}]"), "heading")
        .when((F.col("pipes") >= 2) & (F.col("line") >= start), "table")
        .when(F.col("is_sep") & (F.col("pipes") < 2) & F.coalesce(F.lag("starts_table").over(along), F.lit(False)), "table")
        .when(F.col("s") == "", "blank")
        .when(F.col("s").startswith(">"), "quote")
        .when(F.col("s").rlike(rf"^[-*+][{ws}]+") | F.col("s").rlike(rf"^[0-9]+[.][{ws}]+"), "list")
        .otherwise("paragraph")
    )
    rows = rows.withColumn("kind", kind)
    before = F.lag("kind").over(along)
    opens = F.when(
        F.col("kind") == "code", (F.col("fence") & (F.col("fences") % 2 == 1)) | ~before.eqNullSafe(F.lit("code"))
    ).otherwise(~before.eqNullSafe(F.col("kind")))
    return rows.withColumn("_o", opens.cast("int")).withColumn("b", F.sum("_o").over(along))


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, kind, line_from, line_to, char_start, char_end, tokens): runs of lines of one kind, blank lines and headings left out.

    A block ends where the next line starts: its offsets take in the end of its last line.
    """
    return _blocks(typed_lines(df, key, text).withColumns({"w": F.length("t"), "n": token_count("t")}), key)


def _blocks(typed: DataFrame, key: str) -> DataFrame:
    g = typed.where("kind NOT IN ('blank', 'heading')").groupBy(key, "b").agg(
        F.first("kind").alias("kind"),
        F.min("line").alias("line_from"),
        F.max("line").alias("line_to"),
        F.min("at").alias("char_start"),
        F.max(F.col("at") + F.col("w")).alias("char_end"),
        F.sum("n").alias("tokens"),
    )
    return g.withColumn("block", F.row_number().over(Window.partitionBy(key).orderBy("b")) - 1)


def chunks(df: DataFrame, key: str, text: str, config: Config = DEFAULTS) -> DataFrame:
    """(key, ordinal, kind, heading_path, char_start, char_end, tokens, block_from, block_to): blocks packed up to the target, larger blocks split.

    A chunk is closed when it reaches the target, or when the next block
    would take it over the maximum and it has the minimum. Code is never
    split; tables, lists and quotes are split between lines; of paragraphs
    windows of the maximum with overlap are made. Offsets are code points of
    the text with \\n line ends; a chunk's text lies between them.
    """
    # three steps below read the lines; they are typed once
    typed = stored(
        typed_lines(df, key, text).select(key, "line", "at", "kind", "b", F.length("t").alias("w"), token_count("t").alias("n"), F.when(F.col("kind") == "heading", F.col("s")).alias("s")),
        "markdown-lines",
    )
    b = stored(_placed(typed, key, config), "markdown-blocks")
    big = b.where(F.col("tokens") > config.chunk_max)
    return _ordered(_packed(b, key, config).unionByName(_windows(big, df, key, text, config)).unionByName(_lines_packed(big, typed, key, config)), key)


def _streamed(rows: DataFrame, by: list[str], order: str, start: Callable, step: Callable, out: str, add: str) -> DataFrame:
    """``rows`` in order within each group, with what ``step(state, row)`` gives for each as (new state, value or None); rows with None are left out.

    The rows are spread by the first column of ``by`` and streamed; a task holds one state.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = object(), None
        for pdf in batches:
            values = []
            for row in pdf.itertuples(index=False):
                mine = tuple(getattr(row, c) for c in by)
                if mine != group:
                    group, state = mine, start()
                state, value = step(state, row)
                values.append(value)
            pdf[out] = values
            yield pdf[pdf[out].notna()]

    return rows.repartition(by[0]).sortWithinPartitions(*by, order).mapInPandas(walk, f"{fields}, {add}")


def _placed(typed: DataFrame, key: str, config: Config) -> DataFrame:
    """The blocks with the headings above them and the chunk that each goes to: (c, path). A block above the maximum stands alone.

    A heading of level n replaces those from the n-th on.
    """
    level = F.length(F.regexp_extract("s", "^(#+)", 1))
    heads = typed.where("kind = 'heading'").select(
        F.col(key).alias("key"), F.col("line").alias("line_from"), level.alias("level"), strip(F.regexp_replace("s", "^#+", "")).alias("title")
    )
    b = _blocks(typed, key).withColumnRenamed(key, "key").withColumns({"level": F.lit(0), "title": F.lit(None).cast("string")})
    zero = {c: F.lit(0).cast(b.schema[c].dataType) for c in ("block", "line_to", "char_start", "char_end", "tokens")}
    heads = heads.withColumns(zero | {"kind": F.lit("heading"), "b": F.lit(0).cast(b.schema["b"].dataType)})
    most, least, target = config.chunk_max, config.chunk_min, config.chunk_target

    def step(state, row):
        path, c, n = state
        if row.level:
            return ([*path[: row.level - 1], row.title], c, n), None
        big = row.tokens > most
        if n and (big or (n + row.tokens > most and n >= least)):
            c, n = c + 1, 0
        mine, n = c, n + row.tokens
        if big or n >= target:
            c, n = c + 1, 0
        return (path, c, n), {"c": mine, "path": "/".join(path)}

    out = _streamed(b.unionByName(heads), ["key"], "line_from", lambda: ([], 0, 0), step, "at", "at struct<c: bigint, path: string>")
    return out.select(F.col("key").alias(key), "block", "kind", "line_from", "line_to", "char_start", "char_end", "tokens", "at.c", "at.path")


def _packed(b: DataFrame, key: str, config: Config) -> DataFrame:
    """The chunks of whole blocks; of those above the maximum only code."""
    return b.where((F.col("tokens") <= config.chunk_max) | (F.col("kind") == "code")).groupBy(key, "c").agg(
        F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed").alias("kind"),
        F.min_by("path", "block").alias("heading_path"),
        F.min("char_start").alias("char_start"),
        F.max("char_end").alias("char_end"),
        F.sum("tokens").alias("tokens"),
        F.min("block").alias("block_from"),
        F.max("block").alias("block_to"),
    ).drop("c")


def _windows(big: DataFrame, df: DataFrame, key: str, text: str, config: Config) -> DataFrame:
    """Oversized paragraphs: windows of the maximum, each starting max - overlap words after the one before; a closed form."""
    most, step = config.chunk_max, config.chunk_max - config.chunk_overlap
    src = df.select(F.col(key).alias("_k"), F.regexp_replace(text, r"\r\n|\r", "\n").alias("_t"))
    joined = big.where("kind = 'paragraph'").join(src, F.col(key) == F.col("_k")).withColumn("_p", F.expr("substring(_t, int(char_start) + 1, int(char_end - char_start))"))
    # the words with the gaps before them give every word's place
    gaps = F.regexp_extract_all("_p", F.lit(f"(?:^|[{SPACE}])[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    words = joined.select(key, "block", "path", "char_start", "tokens", F.posexplode(gaps).alias("i", "g"))
    along = Window.partitionBy(key, "block").orderBy("i")
    words = words.withColumn("end", F.sum(F.length("g")).over(along)).withColumn("start", F.col("end") - F.length(F.regexp_replace("g", f"^[{SPACE}]+", "")))
    last = F.greatest(F.lit(0), F.ceil((F.col("tokens") - most) / step)).cast("int")
    # a word starts the window of its number, if that is a multiple of the step, and ends the one that is full with it, or the last
    opens = F.when((F.col("i") % step == 0) & (F.col("i") / step <= last), (F.col("i") / step).cast("int"))
    closes = F.when(F.col("i") == F.col("tokens") - 1, last).when((F.col("i") + 1 >= most) & ((F.col("i") + 1 - most) % step == 0), ((F.col("i") + 1 - most) / step).cast("int"))
    ends = words.select(key, "block", "path", "char_start", "i", "start", "end", F.explode(F.array(F.struct(opens.alias("w"), F.lit(True).alias("open")), F.struct(closes.alias("w"), F.lit(False).alias("open")))).alias("e"))
    pick = lambda c, is_open: F.max(F.when(F.col("e.open") == is_open, F.col(c)))
    w = ends.where("e.w IS NOT NULL").groupBy(key, "block", "path", "char_start", "e.w").agg(
        pick("start", True).alias("s"), pick("end", False).alias("z"), (pick("i", False) - pick("i", True) + 1).cast("bigint").alias("tokens")
    )
    return w.select(
        key, F.lit("mixed").alias("kind"), F.col("path").alias("heading_path"), (F.col("char_start") + F.col("s")).alias("char_start"), (F.col("char_start") + F.col("z")).alias("char_end"),
        "tokens", F.col("block").alias("block_from"), F.col("block").alias("block_to"),
    )


def _lines_packed(big: DataFrame, typed: DataFrame, key: str, config: Config) -> DataFrame:
    """Oversized tables, lists and quotes: lines packed up to the maximum; a table's header stays with its separator."""
    wide = big.where(F.col("kind").isin("table", "list", "quote")).select(F.col(key).alias("_k"), "block", F.col("kind").alias("of"), "line_from", "line_to", "path")
    rows = wide.join(typed, (F.col("_k") == F.col(key)) & F.col("line").between(F.col("line_from"), F.col("line_to"))).select(
        F.col("_k").alias("key"), "block", "of", "path", "line_from", "line", "at", "w", "n"
    )
    most = config.chunk_max

    def step(state, row):
        c, n = state
        if n and n + row.n > most and not (row.of == "table" and row.line == row.line_from + 1):
            c, n = c + 1, 0
        return (c, n + row.n), c

    g = _streamed(rows, ["key", "block"], "line", lambda: (0, 0), step, "c", "c bigint").groupBy(F.col("key").alias(key), "block", "c").agg(
        F.first("of").alias("kind"),
        F.first("path").alias("heading_path"),
        F.min("at").alias("char_start"),
        F.max(F.col("at") + F.col("w")).alias("char_end"),
        F.sum("n").alias("tokens"),
    )
    return g.select(key, "kind", "heading_path", "char_start", "char_end", "tokens", F.col("block").alias("block_from"), F.col("block").alias("block_to"))


def _ordered(c: DataFrame, key: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy("char_start", "char_end")
    return c.select(key, (F.row_number().over(by) - 1).alias("ordinal"), "kind", "heading_path", "char_start", "char_end", "tokens", "block_from", "block_to")
