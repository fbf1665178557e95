"""Splitting oversized texts at natural boundaries.

A hierarchy of separators: sections (headings), paragraphs (blank lines),
lines and rows, sentences, words, characters. A text is cut at the first
level; units that still exceed the limit are cut at the next level, and so
on. Neighbouring units are packed greedily up to the limit; every piece but
the first starts with the last ``overlap`` tokens of its predecessor.

The texts are spread by Spark; within a task one text is handled at a time,
by arrays of token offsets, in time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.keys import hex_key

LIMIT, OVERLAP = 900, 80
LEVELS = ("section", "paragraph", "line", "sentence", "word", "character")

_TOKEN = re.compile(r"\S+")
_FENCE = re.compile(r"[ \t]*(```|~~~)")
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]+\S")
_SENTENCE_END = re.compile(r"""[.!?…。！？]["'”»)\]]*$""")


def boundary_levels(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token but the first the index in LEVELS of the strongest boundary before it."""
    n = len(starts)
    level = np.full(n, LEVELS.index("word"), np.int8)
    fenced, opened = False, ""
    previous_end = 0
    for i in range(n):
        gap = text[previous_end : starts[i]]
        previous_end = ends[i]
        breaks = gap.count("\n") + gap.count("\r") - gap.count("\r\n")
        at_line = breaks > 0 or i == 0
        line_end = len(text)
        if at_line:
            cut = text.find("\n", starts[i])
            line_end = cut if cut >= 0 else len(text)
        fence = at_line and _FENCE.match(text, starts[i], line_end)
        was = fenced
        if fence:
            if not fenced:
                fenced, opened = True, fence[1]
            elif fence[1] == opened:
                fenced = False
        if i == 0:
            continue
        if at_line and not was and not fence and _HEADING.match(text, starts[i], line_end):
            level[i] = 0
        elif breaks > 1 and not (was and fenced):
            level[i] = 1
        elif breaks:
            level[i] = 2
        elif _SENTENCE_END.search(text, max(starts[i - 1], ends[i - 1] - 8), ends[i - 1]):
            level[i] = 3
    return level


def cores(level: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first token, end token, level of the cut at the end) of the pieces without their overlaps; they tile the tokens.

    Works down the separators with a stack, so that depth doesn't grow with
    the text: a range at a level is packed greedily from the units of that
    level, and a unit over the budget is handed to the next level.
    """
    n = len(level)
    word = LEVELS.index("word")
    out: list[tuple[int, int]] = []

    def budget() -> int:
        return limit if not out else limit - overlap

    stack = [(0, n, 0)]
    while stack:
        lo, hi, at = stack.pop()
        if hi - lo <= budget():
            out.append((lo, hi))
            continue
        if at >= word:
            while lo < hi:
                out.append((lo, min(hi, lo + budget())))
                lo = out[-1][1]
            continue
        cuts = lo + 1 + np.flatnonzero(level[lo + 1 : hi] <= at)
        if not len(cuts):
            stack.append((lo, hi, at + 1))
            continue
        bounds = np.concatenate([[lo], cuts, [hi]])
        # as many whole units as fit from lo on; else the first unit goes one level down, what follows stays on this level
        k = int(np.searchsorted(bounds, lo + budget(), "right")) - 1
        if k >= 1:
            out.append((lo, int(bounds[k])))
            stack.append((int(bounds[k]), hi, at))
        else:
            stack.append((int(bounds[1]), hi, at))
            stack.append((lo, int(bounds[1]), at + 1))
    return [(a, b, int(level[b]) if b < n else 0) for a, b in out if a < b]


def pieces(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, max_chars: int | None = None) -> list[dict]:
    """The pieces of one text, in order.

    ``core_start``/``core_end`` tile the whole text; ``char_start``/``char_end``
    add the overlap in front and leave out white space at the ends. Offsets
    count code points. Null, empty and blank texts have no pieces; a text
    within the limit is one piece. ``max_chars`` bounds a piece's characters
    too: pieces above it are cut between words where possible, else between
    characters (the last level).
    """
    if not text:
        return []
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return []
    starts, ends = np.array(spans, np.int64).T
    level = boundary_levels(text, starts, ends) if len(starts) > limit else np.full(len(starts), 4, np.int8)
    out = []
    for k, (a, b, cut) in enumerate(cores(level, limit, overlap)):
        front = max(0, a - overlap) if k else a
        out.append(
            {
                "core_start": int(starts[a]) if k else 0,
                "core_end": int(starts[b]) if b < len(starts) else len(text),
                "char_start": int(starts[front]),
                "char_end": int(ends[b - 1]),
                "tokens": int(b - front),
                "overlap_tokens": int(a - front),
                "cut_at": LEVELS[cut] if b < len(starts) else "end",
            }
        )
    if max_chars is None:
        return out
    short = []
    for p in out:
        while p["char_end"] - p["char_start"] > max_chars:
            stop = p["char_start"] + max_chars
            space = max((m.start() for m in re.finditer(r"\s+", text[p["char_start"] : stop])), default=0)
            stop, why = (p["char_start"] + space, "word") if space else (stop, "character")
            head = text[p["char_start"] : stop]
            short.append(p | {"char_end": stop, "core_end": stop, "tokens": len(head.split()), "cut_at": why})
            p = p | {"core_start": stop, "char_start": stop, "overlap_tokens": 0, "tokens": len(text[stop : p["char_end"]].split())}
        short.append(p)
    return short


SCHEMA = (
    "record_table string, record_key string, record_tokens bigint, piece int, n_pieces int, core_start bigint, core_end bigint, "
    "char_start bigint, char_end bigint, tokens int, overlap_tokens int, cut_at string, piece_text string"
)
_ARROW = pa.schema(
    [("record_table", pa.string()), ("record_key", pa.string()), ("record_tokens", pa.int64()), ("piece", pa.int32()), ("n_pieces", pa.int32())]
    + [(c, pa.int64()) for c in ("core_start", "core_end", "char_start", "char_end")]
    + [("tokens", pa.int32()), ("overlap_tokens", pa.int32()), ("cut_at", pa.string()), ("piece_text", pa.string())]
)


def split_oversized(records: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """The pieces of the records (record_table, record_key, text) that have more than ``limit`` tokens.

    A token is a maximal run of characters that aren't white space. Exact
    copies of a record give pieces once; records whose text is null, blank or
    within the limit give none; a text with n tokens has at least 2n - 1
    characters, which drops most of the others before Python sees them.
    """
    rows = records.select("record_table", "record_key", "text").where(F.length("text") >= 2 * limit + 1).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, key, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                n = len(text.split())
                if n <= limit:
                    continue
                ps = pieces(text, limit, overlap)
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "record_table": table.as_py(), "record_key": key.as_py(), "record_tokens": n, "piece": i, "n_pieces": len(ps),
                            "piece_text": text[p["char_start"] : p["char_end"]] if with_text else None,
                        } | p
                        for i, p in enumerate(ps)
                    ],
                    schema=_ARROW,
                )

    return rows.mapInArrow(run, SCHEMA)


def records_of(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items (key: item_id) and chunks (key: hexadecimal digits of chunk_id) as (record_table, record_key, text)."""
    return items.select(
        F.lit("source_items").alias("record_table"), F.col("item_id").cast("string").alias("record_key"), F.col("markdown").alias("text")
    ).unionByName(
        chunks.select(F.lit("chunks").alias("record_table"), hex_key("chunk_id").alias("record_key"), F.col("chunk_text").alias("text"))
    )
