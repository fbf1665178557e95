"""Per-document text statistics that tell natural prose from lists, tables and junk.

A text is cut into chunks of a fixed number of characters. The statistics of
a chunk are a state that can be merged with its neighbour's: what is complete
inside the chunk is summed; its first and last word, which may go on in the
neighbouring chunks, and its first and last sentence stay open. Merging joins
the word and the sentence that meet at the boundary. States are merged in a
tree of fan-in FAN, so that no task sees more than FAN states of a document;
a document of one chunk is finished where its state is made. Sums of words
are runs (``Runs``), many at once: all chunks of a batch, or one merge.

Sentences end at closing punctuation or an empty line. A sentence counts as
prose by its words: enough function words of the given list, mostly letters,
no row of bullets. Texts of a language without a list are thus not prose.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.unicode import is_blank
from loomspark.session import stored

CHUNK, FAN = 8192, 64
#: Chunks of a block, and chunks whose words are looked up at once.
BLOCK, AT_ONCE = 128, 512
#: Columns of a word's figures, which add up over a sentence and over a document.
FIGURES = ("nonspace", "letters", "digits", "symbols", "words", "word_chars", "common", "bullets", "lines", "lines_punct")
PUNCTUATION = frozenset(".,;:!?…'\"()«»„“”‚‘’-–—")
CLOSERS = "\"'”»“’)]*_"
#: Characters that an open token keeps at its ends; a longer word is no function word, and its last characters tell how it ends.
HEAD, TAIL = 48, 12
_I = {name: i for i, name in enumerate(FIGURES)}
_N = len(FIGURES)


@dataclass(frozen=True)
class ProseRule:
    """When a sentence is prose (parameters): words, the share of function words in it and in a long one, letters, and words for each bullet."""

    least_words: int = 3
    most_words: int = 80
    common_share: float = 0.075
    long_words: int = 20
    long_common_share: float = 0.12
    letter_share: float = 0.68
    words_per_bullet: int = 9


RULE = ProseRule()


def word_figures(head: str, tail: str, length: int, letters: int, digits: int, symbols: int, common: frozenset) -> tuple:
    """(the figures of one complete token, whether it ends a sentence, whether it ends with punctuation)."""
    is_word = letters > 0
    core = head.strip("".join(c for c in set(head) if not c.isalpha())).lower() if is_word and length <= HEAD else ""
    bare = tail.rstrip(CLOSERS)
    closes = bare[-1:] in ".!?…" if bare else False
    number = length <= 4 and letters == 0 and digits > 0
    bullet = (letters == 0 and digits == 0 and length <= 3) or (number and bare[-1:] in ".)")
    return (
        (length, letters, digits, symbols, int(is_word), letters if is_word else 0, int(core in common), int(bullet), 0, 0),
        closes and not bullet and (letters > 0 or digits > 0),
        tail[-1:] in PUNCTUATION,
    )


def prose_mask(s: np.ndarray, rule: ProseRule = RULE) -> np.ndarray:
    """Which sentences (rows of FIGURES) are prose.

    A list without closing marks is one long run of words with few function
    words, on however many lines it stands; single line breaks don't count.
    """
    words, common, bullets = (s[:, _I[name]] for name in ("words", "common", "bullets"))
    return (
        (words >= rule.least_words)
        & (words <= rule.most_words)
        & (common >= 1)
        & (common >= np.where(words > rule.long_words, rule.long_common_share, rule.common_share) * words)
        & (s[:, _I["letters"]] >= rule.letter_share * s[:, _I["nonspace"]])
        & ((bullets < 2) | (words >= rule.words_per_bullet * bullets))
    )


class Token:
    """A token that may be open at either side: enough of it to judge it once it is complete."""

    __slots__ = ("digits", "head", "length", "letters", "symbols", "tail")

    def __init__(self, head: str, tail: str, length: int, letters: int, digits: int, symbols: int):
        self.head, self.tail, self.length, self.letters, self.digits, self.symbols = head, tail, length, letters, digits, symbols

    @classmethod
    def of(cls, t: str) -> Token:
        letters = sum(c.isalpha() for c in t)
        alnum = sum(c.isalnum() for c in t)
        punct = sum(c in PUNCTUATION for c in t)
        return cls(t[:HEAD], t[-TAIL:], len(t), letters, alnum - letters, len(t) - alnum - punct)

    def figures(self, common: frozenset) -> np.ndarray:
        """The figures of the complete token, whether it ends a sentence and whether it ends with punctuation."""
        figures, closes, punct = word_figures(self.head, self.tail, self.length, self.letters, self.digits, self.symbols, common)
        return np.array((*figures, closes, punct), np.int64)

    def joined(self, o: Token) -> Token:
        return Token(
            (self.head + o.head)[:HEAD] if self.length < HEAD else self.head,
            (self.tail + o.tail)[-TAIL:] if o.length < TAIL else o.tail,
            self.length + o.length, self.letters + o.letters, self.digits + o.digits, self.symbols + o.symbols,
        )

    def dump(self) -> list:
        return [self.head, self.tail, self.length, self.letters, self.digits, self.symbols]


class Runs:
    """Complete tokens in a row, of n stretches at once: the sentence open at the left, the sums of closed ones and of their prose, the one open at the right.

    A stretch that isn't broken has no sentence's end inside; all of it is ``left``.
    """

    __slots__ = ("broken", "closed", "left", "prose", "right")

    def __init__(self, left: np.ndarray, closed: np.ndarray, prose: np.ndarray, right: np.ndarray, broken: np.ndarray):
        self.left, self.closed, self.prose, self.right, self.broken = left, closed, prose, right, broken

    @classmethod
    def empty(cls, n: int, broken: bool = False) -> Runs:
        zero = np.zeros((n, _N), np.int64)
        return cls(zero, zero, np.zeros(n, np.int64), zero, np.full(n, broken))

    @classmethod
    def single(cls, figures: np.ndarray, newlines: np.ndarray, there: np.ndarray | None = None) -> Runs:
        """Of one token each (rows of figures, closes, punct) and the gap behind it; empty where it isn't ``there``."""
        left = figures[:, :_N].copy()
        left[:, _I["lines"]] = newlines > 0
        left[:, _I["lines_punct"]] = (newlines > 0) & (figures[:, _N + 1] > 0)
        broken = (figures[:, _N] > 0) | (newlines > 1)
        if there is not None:
            left, broken = left * there[:, None], broken & there
        zero = np.zeros_like(left)
        return cls(left, zero, np.zeros(len(left), np.int64), zero, broken)

    @classmethod
    def of(cls, figures: np.ndarray, breaks: np.ndarray, size: np.ndarray) -> Runs:
        """Of stretches that stand one after the other: tokens (rows of figures, closes, punct), line breaks behind each, tokens of each stretch."""
        out = cls.empty(len(size))
        full = np.flatnonzero(size)
        if not len(full):
            return out
        rows = figures[:, :_N].copy()
        rows[:, _I["lines"]] = breaks > 0
        rows[:, _I["lines_punct"]] = (breaks > 0) & (figures[:, _N + 1] > 0)
        closes = (figures[:, _N] > 0) | (breaks > 1)
        opens = np.concatenate([[True], closes[:-1]])
        begin = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        opens[begin] = True
        starts = np.flatnonzero(opens)
        sentences = np.add.reduceat(rows, starts, axis=0)
        at = np.searchsorted(starts, begin)
        is_left = np.zeros(len(starts), bool)
        is_left[at] = True
        ends = np.concatenate([starts[1:], [len(rows)]]) - 1
        is_last = np.concatenate([is_left[1:], [True]])
        is_right = is_last & ~closes[ends] & ~is_left
        inner = ~is_left & ~is_right
        whose = full[np.cumsum(is_left) - 1]
        out.left, out.right = out.left.copy(), out.right.copy()
        out.left[full] = sentences[is_left]
        out.right[whose[is_right]] = sentences[is_right]
        out.closed = out.closed.copy()
        out.closed[full] = np.add.reduceat(sentences * inner[:, None], at, axis=0)
        out.prose[full] = np.add.reduceat(sentences[:, 0] * (inner & prose_mask(sentences)), at)
        out.broken = np.bincount(whose[closes[ends]], minlength=len(size)) > 0
        return out

    def plus(self, o: Runs) -> Runs:
        a, b = self.broken[:, None], o.broken[:, None]
        middle = self.right + o.left
        whole = middle * (a & b)  # the sentence that meets at the boundary, closed on either side
        return Runs(
            np.where(a, self.left, self.left + o.left),
            self.closed + o.closed + whole,
            self.prose + o.prose + whole[:, 0] * prose_mask(whole),
            np.where(b, o.right, middle * a),
            self.broken | o.broken,
        )

    def dump(self) -> list:
        return [x[0].tolist() for x in (self.left, self.closed, self.prose, self.right, self.broken)]

    @classmethod
    def load(cls, d: list) -> Runs:
        return cls(*(np.array([x]) for x in d))

    def row(self, i: int) -> Runs:
        return Runs(*(x[i : i + 1] for x in (self.left, self.closed, self.prose, self.right, self.broken)))


def finished(first: np.ndarray, gap: np.ndarray, runs: Runs, last: np.ndarray, has_last: np.ndarray) -> np.ndarray:
    """FIGURES and the characters in prose of n texts, once nothing comes before or after: first token, gap behind it, what is between, last token."""
    n = len(first)
    end = np.ones(n, np.int64)
    edge = Runs.empty(n, broken=True)
    whole = Runs.single(first, np.where(has_last, gap, end)).plus(runs).plus(Runs.single(last, end, has_last))
    out = edge.plus(whole).plus(edge)
    return np.concatenate([out.closed, out.prose[:, None]], axis=1)


def single_run(token: Token, newlines: int, common: frozenset) -> Runs:
    """The run of one complete token and the gap behind it."""
    return Runs.single(token.figures(common)[None], np.array([newlines]))


class State:
    """The mergeable statistics of a stretch of text.

    ``first`` and ``last`` are its first and last token (the same if it has
    one), ``gap`` the line breaks behind the first, ``run`` the tokens
    between; ``lead``/``trail`` the line breaks at its ends, or -1 where the
    text starts or ends inside a token.
    """

    __slots__ = ("first", "gap", "last", "lead", "run", "trail")

    def __init__(self, lead: int, first: Token | None, gap: int, run: Runs, last: Token | None, trail: int):
        self.lead, self.first, self.gap, self.run, self.last, self.trail = lead, first, gap, run, last, trail

    def dumps(self) -> str:
        d = lambda t: t.dump() if t else None
        return json.dumps([self.lead, d(self.first), self.gap, self.run.dump(), d(self.last), self.trail])

    @classmethod
    def loads(cls, s: str) -> State:
        lead, first, gap, run, last, trail = json.loads(s)
        t = lambda x: Token(*x) if x else None
        return cls(lead, t(first), gap, Runs.load(run), t(last), trail)

    def merged(self, o: State, common: frozenset) -> State:
        """This stretch followed by ``o``. ``last`` is None if the stretch has a single token, ``first`` None if it has none."""
        if self.first is None:
            if o.first is None:
                return State(self.lead + o.lead, None, 0, Runs.empty(1), None, self.trail + o.trail)
            return State(self.lead + max(o.lead, 0), o.first, o.gap, o.run, o.last, o.trail)
        if o.first is None:
            return State(self.lead, self.first, self.gap, self.run, self.last, max(self.trail, 0) + o.trail)
        if self.trail >= 0 or o.lead >= 0:
            between = max(self.trail, 0) + max(o.lead, 0)
            first, gap, run = self.first, self.gap, self.run
            if self.last is None:
                gap = between
            else:
                run = run.plus(single_run(self.last, between, common))
            if o.last is None:
                return State(self.lead, first, gap, run, o.first, o.trail)
            return State(self.lead, first, gap, run.plus(single_run(o.first, o.gap, common)).plus(o.run), o.last, o.trail)
        # a token goes on across the boundary
        token = (self.last or self.first).joined(o.first)
        if self.last is None and o.last is None:
            return State(self.lead, token, 0, Runs.empty(1), None, o.trail)
        if self.last is None:
            return State(self.lead, token, o.gap, o.run, o.last, o.trail)
        if o.last is None:
            return State(self.lead, self.first, self.gap, self.run, token, o.trail)
        return State(self.lead, self.first, self.gap, self.run.plus(single_run(token, o.gap, common)).plus(o.run), o.last, o.trail)

    @staticmethod
    def totals(states: list[State], common: frozenset) -> np.ndarray:
        """FIGURES and the characters in prose of texts that hold a token."""
        none = Token("", "", 0, 0, 0, 0)
        figures = lambda tokens: np.array([t.figures(common) for t in tokens])
        run = Runs(*(np.concatenate([getattr(x.run, name) for x in states]) for name in ("left", "closed", "prose", "right", "broken")))
        has_last = np.array([x.last is not None for x in states])
        return finished(figures([x.first for x in states]), np.array([x.gap for x in states]), run, figures([x.last or none for x in states]), has_last)


class Vocabulary:
    """The figures of the tokens seen so far, as rows of an array; bounded."""

    LIMIT = 300_000

    def __init__(self, common: frozenset):
        self.common = common
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.array = np.zeros((4096, len(FIGURES) + 2), np.int64)

    def id(self, t: str) -> int:
        self.ids[t] = k = len(self.ids)
        if k == len(self.array):
            self.array = np.concatenate([self.array, np.zeros_like(self.array)])
        self.array[k] = Token.of(t).figures(self.common)
        return k

    def lookup(self, tokens: list[str]) -> np.ndarray:
        """The figures of the tokens, and whether each ends a sentence and ends with punctuation."""
        ids, new = self.ids, self.id
        found = [ids[t] if t in ids else new(t) for t in tokens]
        out = self.array[found]
        if len(ids) > self.LIMIT:
            self.clear()
        return out


#: A mark for a line break among the tokens; the character itself is replaced in texts.
_BREAK = "\x00"


def _tokens(text: str) -> tuple[list[str], np.ndarray]:
    """The tokens and the line breaks behind each; the first entry of the breaks is for those before the first token."""
    flat = text.replace(_BREAK, "�").replace("\r\n", "\n").replace("\r", "\n").replace("\n", f" {_BREAK} ").split()
    marks = np.fromiter((t == _BREAK for t in flat), bool, len(flat))
    where = np.flatnonzero(~marks)
    breaks = np.diff(np.concatenate([[-1], where, [len(flat)]])) - 1
    return [t for t in flat if t != _BREAK], breaks


class Chunks:
    """The states of many chunks at once; ``tokens`` holds every chunk's tokens, ``figures`` what they count for."""

    def __init__(self, texts: list[str], vocabulary: Vocabulary):
        self.texts, self.tokens, self.breaks = texts, [], []
        for t in texts:
            tokens, breaks = _tokens(t)
            self.tokens.append(tokens)
            self.breaks.append(breaks)
        size = np.array([len(t) for t in self.tokens], np.int64)
        figures = vocabulary.lookup([t for tokens in self.tokens for t in tokens])
        behind = np.concatenate([b[1:] for b in self.breaks]) if texts else np.zeros(0, np.int64)
        start = np.cumsum(size) - size
        place = np.arange(len(figures)) - np.repeat(start, size)
        inside = (place > 0) & (place < np.repeat(size, size) - 1)
        self.size, self.runs = size, Runs.of(figures[inside], behind[inside], np.maximum(size - 2, 0))
        self.figures, self.behind, self.start = figures, behind, start

    def totals(self, rows: np.ndarray) -> np.ndarray:
        """Of the chunks in ``rows``, which are whole texts and hold a token."""
        first, last = self.start[rows], self.start[rows] + self.size[rows] - 1
        r = self.runs
        some = Runs(r.left[rows], r.closed[rows], r.prose[rows], r.right[rows], r.broken[rows])
        return finished(self.figures[first], self.behind[first], some, self.figures[last], self.size[rows] > 1)

    def state(self, i: int) -> State:
        text, tokens, breaks = self.texts[i], self.tokens[i], self.breaks[i]
        if not tokens:
            n = int(breaks.sum())
            return State(n, None, 0, Runs.empty(1), None, n)
        lead = int(breaks[0]) if text[0].isspace() else -1
        trail = int(breaks[-1]) if text[-1].isspace() else -1
        if len(tokens) == 1:
            return State(lead, Token.of(tokens[0]), 0, Runs.empty(1), None, trail)
        return State(lead, Token.of(tokens[0]), int(breaks[1]), self.runs.row(i), Token.of(tokens[-1]), trail)


_STATS = ", ".join(f"{f} bigint" for f in (*FIGURES, "prose"))


def text_totals(docs: DataFrame, key: str, text: str, common_words: list[str], chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key, FIGURES..., prose) of the documents whose text isn't null or blank; keys must be unique."""
    common = frozenset(w.lower() for w in common_words)
    kind = docs.schema[key].dataType.simpleString()
    # line ends are made equal first, so that none is cut in two
    rows = docs.select(F.col(key).alias("key"), F.regexp_replace(text, r"\r\n?", "\n").alias("text")).where(~is_blank("text"))
    # a substring is found by counting from the start, so a long text is cut into blocks of chunks before it is cut into chunks
    block = chunk * BLOCK
    cut = lambda c, size: F.transform(F.sequence(F.lit(0), F.ceil(F.length(c) / size).cast("int") - 1), lambda i: F.substring(c, i * size + 1, F.lit(size)))
    blocks = rows.select("key", F.ceil(F.length("text") / chunk).cast("int").alias("n"), F.posexplode(cut("text", block)).alias("b", "text"))
    chunks = blocks.select("key", "n", "b", F.posexplode(cut("text", chunk)).alias("i", "part")).select("key", "n", (F.col("b") * BLOCK + F.col("i")).alias("no"), "part")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(common)
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, b.num_rows, AT_ONCE)):
            whole = batch.column(1).to_numpy() == 1
            chunks = Chunks(batch.column(3).to_pylist(), vocabulary)
            t = np.zeros((len(whole), _N + 1), np.int64)
            t[whole] = chunks.totals(np.flatnonzero(whole))
            states = [None if w else chunks.state(i).dumps() for i, w in enumerate(whole)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(states, pa.string()), *(pa.array(c) for c in t.T.copy())],
                names=["key", "n", "no", "state", *FIGURES, "prose"],
            )

    parts = stored(chunks.mapInArrow(partial, f"key {kind}, n int, no int, state string, {_STATS}"), "quality-parts")
    one = parts.where("n = 1").select("key", *FIGURES, "prose")
    states = parts.where("n > 1").select("key", "no", "state")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        s = None
        for x in pdf["state"]:
            s = State.loads(x) if s is None else s.merged(State.loads(x), common)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "no": [int(pdf["no"].iloc[0]) // fan], "state": [s.dumps()]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                t = State.totals([State.loads(x) for x in pdf["state"]], common)
                yield pd.DataFrame({"key": pdf["key"]} | {f: t[:, i] for i, f in enumerate((*FIGURES, "prose"))})

    most = parts.agg(F.max("n")).first()[0] or 1
    while most > 1:
        states = states.groupBy("key", F.floor(F.col("no") / fan).alias("_g")).applyInPandas(merge, f"key {kind}, no int, state string")
        most = -(-most // fan)
    return one.unionByName(states.select("key", "state").mapInPandas(finish, f"key {kind}, {_STATS}")).withColumnRenamed("key", key)


def quality(docs: DataFrame, key: str, text: str, common_words: list[str], chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Ratios and rule outcomes of the documents whose text isn't null or blank (others have no row).

    A word is a run of characters other than white space that holds a letter.
    ``prose_share`` is the share of the characters other than white space
    that stand in sentences of prose; below one half a document isn't prose.
    The result doesn't depend on ``chunk`` or ``fan``.
    """
    t = text_totals(docs, key, text, common_words, chunk, fan)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    r = t.select(
        key,
        F.col("nonspace").alias("n_chars"),
        F.col("words").alias("n_words"),
        F.col("lines").alias("n_lines"),
        ratio("word_chars", "words").alias("mean_word_length"),
        ratio("symbols", "nonspace").alias("symbol_ratio"),
        ratio("digits", "nonspace").alias("digit_ratio"),
        ratio("lines_punct", "lines").alias("punctuated_line_share"),
        ratio("bullets", "lines").alias("bullets_per_line"),
        ratio("common", "words").alias("common_word_share"),
        ratio("prose", "nonspace").alias("prose_share"),
    )
    return r.withColumns(
        {
            "word_length_ok": F.col("mean_word_length").between(2.5, 12),
            "symbols_ok": F.col("symbol_ratio") <= 0.1,
            "common_words_ok": F.col("common_word_share") >= 0.05,
            "is_prose": F.col("prose_share") >= 0.5,
        }
    )
