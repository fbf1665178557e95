"""Encoding texts with a public byte-pair tokenizer.

A text is cut into words by the tokenizer's pattern; the bytes of a word are
merged pair by pair, always the pair of lowest rank and of equal ranks the
leftmost. The ranks of the adjacent pairs are the leaves of a segment tree
whose root yields the next merge; a merge changes at most three leaves, each
in logarithmic time, until the root holds no mergeable pair. A word of n
bytes takes O(n log n), however long it is.

Spark spreads the texts; each task encodes Arrow batches and keeps the words
it has merged in a bounded memory of its Python worker.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of the byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers before it starts afresh, and the longest remembered word.
MEMORY, LONGEST = 400_000, 64
_NONE = 1 << 62


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Where a vocabulary file lies: in ``folder``, or beside the installed public files."""
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, name)


#: The largest vocabulary file that is sent to the executors.
MOST_BYTES = 16 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token's bytes, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return parsed_ranks(f.read())


def parsed_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


def shared_vocabulary(df: DataFrame, path: str | None):
    """The vocabulary file, read by the driver and broadcast: executors need no copy of it on their disks."""
    path = path or vocabulary_path()
    size = os.path.getsize(path)
    if size > MOST_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is too large to be broadcast")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


class Encoder:
    """Encodes texts with the ranks of a byte-level vocabulary; special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pair: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.words = regex.compile(pattern).findall
        self.memory: dict[str, list[int]] = {}
        self.units: dict[str, list[int]] = {}

    def _rank(self, a: int, b: int) -> int:
        """The id that a and b merge into, or _NONE."""
        key = (a, b)
        r = self.joined.get(key)
        if r is None:
            r = self.joined[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], _NONE)
            if len(self.joined) > 4 * MEMORY:
                self.joined.clear()
        return r

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word, by a segment tree over the ranks of its adjacent pairs."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        rank = self._rank
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        # a node holds rank * n + position, so that the smaller rank and then the leftmost pair is the minimum
        none = _NONE * n
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i], ids[i + 1])
            if r != _NONE:
                tree[size + i] = r * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def update(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        while tree[1] < none:
            merged, i = divmod(tree[1], n)
            j = after[i]
            ids[i] = merged
            k = after[i] = after[j]
            if j < n - 1:
                update(j, none)
            if k < n:
                before[k] = i
                r = rank(merged, ids[k])
                update(i, r * n + i if r != _NONE else none)
            else:
                update(i, none)
            p = before[i]
            if p >= 0:
                r = rank(ids[p], merged)
                update(p, r * n + p if r != _NONE else none)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _word(self, word: str) -> list[int]:
        ids = self.memory.get(word)
        if ids is None:
            ids = self.merge(word.encode("utf-8", "surrogatepass"))
            if len(word) <= LONGEST:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[word] = ids
        return ids

    def _unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for w in self.words(unit):
            out += self._word(w)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text.

        The text is first cut at blanks that stand before a letter or digit:
        the pattern always starts a word there, so the parts can be encoded
        (and remembered) apart from each other.
        """
        out: list[int] = []
        units = self.units
        pending = ""
        first = True
        for part in text.split(" "):
            if first:
                pending, first = part, False
                continue
            if part and part[0].isalnum():
                if pending:
                    ids = units.get(pending)
                    if ids is None:
                        ids = self._unit(pending)
                        if len(pending) <= LONGEST:
                            if len(units) >= MEMORY:
                                units.clear()
                            units[pending] = ids
                    out += ids
                pending = " " + part
            else:
                pending = f"{pending} {part}"
        return out + self._unit(pending) if pending else out


_encoders: dict[tuple[int, str], Encoder] = {}


def encoder(lines: bytes, pattern: str = PATTERN) -> Encoder:
    """The encoder of a vocabulary (the bytes of its file), made once for a Python worker."""
    key = (hash(lines), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(parsed_ranks(lines), pattern)
    return _encoders[key]


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's text; null and empty texts have the empty list."""
    shared = shared_vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            ids = [enc.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_sizes(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens): the number of tokens of each row's text; 0 for null and empty texts."""
    shared = shared_vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            n = [len(enc.encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    rows = df.select(F.col(key), F.col(text))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
