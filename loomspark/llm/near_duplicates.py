"""Near-duplicate records, exactly, by signature trees.

A record is the set of its shingles. Equal sets are one class; only classes
are compared. Records that are similar enough share one of their rarest
shingles (the prefix filter), so the root of the forest fans out by such a
shingle: a single tree over everything would have to compare almost all of
its nodes. Below it, the records of a shingle form a tree ordered by size,
whose nodes hold the OR of the records' token bitmaps, the range of their
sizes, and how many tokens a bitmap hides at most. Pairs of nodes are
traversed together from the root; a pair goes on only if the largest overlap
that it allows reaches the smallest overlap that the threshold demands. What
is left at the leaves is verified on the whole texts.

Work is spread by shingle; a shingle of very many records is cut into cells,
pairs of blocks, so that no task gets all its records. Which shingles these
are is counted exactly. No pair is lost: the filters are upper bounds, and
nothing is capped or sampled. For candidates a shingle is cut to 32 bits, but
a set keeps its size: shingles that fall together stay apart as elements, so
that a bound counts what a bitmap or a cut hides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.keys import hex_key
from loomspark.operators.bloom import blocks_for, bloom_table, with_maybe
from loomspark.session import checkpointed, small, stored

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Buckets of the counts that order shingles by rarity and tell which of them may be frequent; any order is correct.
BUCKETS = 1 << 17
#: Frequent shingles whose exact counts take part in that order, and rows of their list that are broadcast; a longer list is joined by shuffling.
LISTED = 1_000_000
#: Records of a shingle above which it is cut into cells, and postings that a task should get.
CELL, TASK = 60_000, 400_000
#: Bits of a bitmap; records of more than LARGE shingles have a second one of BIG_BITS, those of more than HUGE one of HUGE_BITS,
#: whose halves, OR-combined, are one of BIG_BITS.
BITS, BIG_BITS, HUGE_BITS, LARGE, HUGE = 256, 1024, 2048, 192, 800
LEAF, FANOUT = 16, 8


@dataclass(frozen=True)
class Kind:
    """How the records of one table are compared: shingles of ``width`` words or characters, those that have enough, the threshold."""

    name: str
    width: int
    characters: bool
    least: int
    threshold: Fraction
    bits: int = BITS


CHUNKS = Kind("chunks", 3, False, 25, Fraction(3, 5))
TITLES = Kind("documents", 3, True, 30, Fraction(13, 20), 128)


class Shingler:
    """Shingle hashes of 64 bits; words are hashed once for a worker."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}

    def of(self, text: str, kind: Kind) -> np.ndarray | None:
        """The distinct shingles of a text in ascending order, or None if it is too short."""
        words = WORD.findall(text.lower())
        if kind.characters:
            joined = " ".join(words)
            if len(joined) < kind.least:
                return None
            h = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        else:
            if len(words) < max(kind.least, kind.width):
                return None
            known = self.words
            if len(known) > 1_000_000:
                known.clear()
            h = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
        n = len(h) - kind.width + 1
        with np.errstate(over="ignore"):
            s = np.zeros(n, np.uint64)
            for i in range(kind.width):
                s = (s ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                s ^= s >> np.uint64(29)
            s *= np.uint64(0xBF58476D1CE4E5B9)
            s ^= s >> np.uint64(32)
        return np.unique(s)


def shingled(records: DataFrame, kinds: tuple[Kind, ...], full: bool) -> DataFrame:
    """(kind, key, cls, toks) of the records (kind, key, text) that are long enough.

    ``cls`` hashes the whole set with 128 bits. ``toks`` are the shingles,
    with 64 bits if ``full``, else cut to 32 bits, which is enough to find
    candidates; shingles that fall together then are listed as often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            kept, cls, sets = [], [], []
            for i, (kind, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                s = shingler.of(text, kinds[kind])
                if s is not None:
                    kept.append(i)
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sets.append(s.view(np.int64) if full else (s >> np.uint64(32)).astype(np.uint32).view(np.int32))
            if not kept:
                continue
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            toks = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets)))
            rows = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array(cls, pa.binary()), toks],
                names=["kind", "key", "cls", "toks"],
            )

    return records.mapInArrow(run, f"kind int, key string, cls binary, toks array<{'bigint' if full else 'int'}>")


def records_of(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk texts and document titles as (kind, key, text); null keys and texts are left out."""
    return (
        chunks.select(F.lit(0).alias("kind"), hex_key("chunk_id").alias("key"), F.col("chunk_text").alias("text"))
        .unionByName(documents.select(F.lit(1).alias("kind"), hex_key("document_id").alias("key"), F.col("title").alias("text")))
        .where(F.col("key").isNotNull() & F.col("text").isNotNull())
    )


def shingle_counts(sets: DataFrame, n_kinds: int) -> np.ndarray:
    """How many records have a shingle of each bucket; the table has n_kinds * BUCKETS entries, whatever the data."""
    bucket = F.col("kind") * BUCKETS + F.col("tok").bitwiseAND(F.lit(BUCKETS - 1))
    counts = sets.select("kind", F.explode("toks").alias("tok")).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(n_kinds * BUCKETS, np.int64)
    out[counts.column("b").to_numpy()] = counts.column("n").to_numpy()
    return out


def frequent_shingles(sets: DataFrame, counts: np.ndarray, cell: int = CELL) -> DataFrame | None:
    """(kind, tok, n): the shingles that more than ``cell`` records have, counted exactly; None if there can't be any.

    Only shingles of a bucket that holds as many are counted one by one.
    """
    heavy = np.flatnonzero(counts > cell)
    if not len(heavy):
        return None
    bucket = F.col("kind") * BUCKETS + F.col("tok").bitwiseAND(F.lit(BUCKETS - 1))
    every = sets.select("kind", F.explode("toks").alias("tok"))
    if len(heavy) < len(counts) // 2:
        buckets = sets.sparkSession.createDataFrame(pa.table({"b": pa.array(heavy)}))  # fewer than the buckets
        every = every.join(F.broadcast(buckets), bucket == F.col("b"))
    found = stored(every.groupBy("kind", "tok").agg(F.count("*").alias("n")).where(F.col("n") > cell), "frequent")
    return None if found.isEmpty() else found


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        return x * np.uint64(0xD6E8FEB86659FD93)


def _bitmaps(row: np.ndarray, tok: np.ndarray, n: int, bits: int, used: np.ndarray | int | None = None) -> np.ndarray:
    """One bitmap of ``bits`` for each of n rows; ``used``: the power of two of bits that a token's row may set."""
    flags = np.zeros((n, bits), bool)
    flags[row, ((_mix(tok) >> np.uint64(40)).astype(np.int64)) & ((bits if used is None else used) - 1)] = True
    return np.packbits(flags, axis=1).view(np.uint64)


#: A class is (c0, c1), its 128 bits; ``about`` holds size and position, 32 bits each.
_POSTING = "kind int, tok bigint, c0 bigint, c1 bigint, about bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, big binary"


def _halves(cls: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(cls.to_pylist()), "<i8").reshape(-1, 2)


def postings(sets: DataFrame, kinds: tuple[Kind, ...], counts: np.ndarray, frequent: DataFrame | None = None) -> DataFrame:
    """The rarest shingles of each class with its signature: as many as the threshold needs, at least one of which a similar class shares.

    Rare are those whose bucket is; frequent shingles, in the order of their exact counts, come last.
    """
    n_kinds = len(kinds)
    if frequent is None:
        known = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    else:
        top = frequent.orderBy(F.col("n").desc(), "kind", "tok").limit(LISTED).toArrow()
        ids = (top.column("kind").to_numpy().astype(np.int64) << 40) | (top.column("tok").to_numpy().astype(np.int64) & 0xFFFFFFFF)
        order = np.argsort(ids)
        known = (ids[order], top.column("n").to_numpy()[order])
    shared = sets.sparkSession.sparkContext.broadcast((counts, *known))
    num, den = (np.array([getattr(k.threshold, x) for k in kinds], np.int64) for x in ("numerator", "denominator"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids, exact = shared.value
        buckets = len(counts) // n_kinds
        seen: set[tuple[int, bytes]] = set()
        for b in batches:
            kind = b.column(0).to_numpy()
            fresh = []
            for i, k in enumerate(zip(kind.tolist(), b.column(1).to_pylist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if len(seen) > 2_000_000:
                seen.clear()
            if not fresh:
                continue
            chosen = pa.array(fresh)
            lists = b.column(2).take(chosen)
            kind, cls = kind[fresh].astype(np.int64), _halves(b.column(1).take(chosen))
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            tok = lists.flatten().to_numpy().view(np.uint32).astype(np.int64)
            row = np.repeat(np.arange(len(fresh)), size)
            # bitmaps
            bits = _bitmaps(row, tok, len(fresh), BITS, np.array([k.bits for k in kinds])[kind[row]])
            large = np.flatnonzero(size > LARGE)
            huge = size[large] > HUGE
            to_large = np.full(len(fresh), -1)
            to_large[large] = np.arange(len(large))
            inside = to_large[row] >= 0
            big = _bitmaps(to_large[row[inside]], tok[inside], len(large), HUGE_BITS)
            # the prefix, the rarest first
            key = (kind[row] << 40) | tok
            often = counts[kind[row] * buckets + (tok & (buckets - 1))]
            listed = np.zeros(len(key), bool)
            if len(ids):
                at = np.minimum(np.searchsorted(ids, key), len(ids) - 1)
                listed = ids[at] == key
                often = np.where(listed, exact[at], often)
            order = np.lexsort((tok, often, listed, row))
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            pos = np.arange(len(tok)) - start[row]
            need = size - -(-size * num[kind] // den[kind]) + 1
            key = key[order]
            # of elements that fall together, next to each other here, the first stands for all
            again = np.concatenate([[False], (row[1:] == row[:-1]) & (key[1:] == key[:-1])])
            keep = (pos < need[row]) & ~again
            row, pos, key = row[keep], pos[keep], key[keep]
            columns = [kind[row].astype(np.int32), key, cls[row, 0], cls[row, 1], (size[row] << 32) | pos]
            words = [bits[row, w].view(np.int64) for w in range(BITS // 64)]
            half = HUGE_BITS // 128
            blobs = pa.array([r.tobytes() if h else (r[:half] | r[half:]).tobytes() for r, h in zip(big, huge, strict=True)], pa.binary())
            which = to_large[row]
            bigs = blobs.take(pa.array(which, mask=which < 0)) if len(large) else pa.nulls(len(row), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *words)] + [bigs], names=[c.split()[0] for c in _POSTING.split(", ")])

    return sets.select("kind", "cls", "toks").mapInArrow(run, _POSTING)


def in_cells(posts: DataFrame, frequent: DataFrame | None, cell: int = CELL) -> DataFrame:
    """Adds ``side`` and cuts the postings of frequent shingles into cells, each of which gets a ``tok`` of its own.

    The classes of a shingle fall into blocks of about ``cell``, and the block
    of a class meets every block once. ``side`` 2: compare all with all; 0
    and 1: only across. Postings of other shingles are as many as before,
    however many records there are.
    """
    if frequent is None:
        return posts.withColumn("side", F.lit(2))
    tok = F.call_function("shiftleft", F.col("kind").cast("bigint"), F.lit(40)).bitwiseOR(F.col("tok").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    cut = small(frequent.select(tok.alias("tok"), F.ceil(F.col("n") / cell).alias("blocks")), LISTED)
    wide = (
        posts.join(cut, "tok", "left")
        .withColumn("mine", F.pmod(F.xxhash64("c0", "c1"), F.coalesce("blocks", F.lit(1))))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1)))
    )
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    return wide.withColumns(
        {
            "side": F.when(lo == hi, 2).otherwise((F.col("mine") == hi).cast("int")),
            "tok": F.when(F.col("blocks") > 1, F.xxhash64("tok", lo, hi)).otherwise(F.col("tok")),
        }
    ).drop("blocks", "mine", "other")


class Forest:
    """The trees of many groups at once: rows sorted by (group, size), leaves of LEAF rows, FANOUT nodes below a node."""

    def __init__(self, group: np.ndarray, size: np.ndarray, pos: np.ndarray, bits: np.ndarray):
        n = len(group)
        hidden = size - np.bitwise_count(bits).sum(1)
        after = size - pos
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        count = np.diff(np.concatenate([starts, [n]]))
        self.levels = []
        below = starts
        fan = LEAF
        lo, hi, most_hidden, most_after, union = size, size, hidden, after, bits
        while True:
            nodes = -(-count // fan)
            offset = np.concatenate([[0], np.cumsum(nodes)])
            g = np.repeat(np.arange(len(nodes)), nodes)
            first = below[g] + fan * (np.arange(offset[-1]) - offset[g])
            last = np.minimum(first + fan, (below + count)[g])
            lo, hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
            most_hidden, most_after = np.maximum.reduceat(most_hidden, first), np.maximum.reduceat(most_after, first)
            union = np.bitwise_or.reduceat(union, first, axis=0)
            self.levels.append((first, last, lo, hi, most_hidden, most_after, union))
            if nodes.max(initial=1) == 1:
                break
            below, count, fan = offset[:-1], nodes, FANOUT

    def leaf_pairs(self, threshold: float, width: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that may hold a pair of similar records, by dual traversal from the roots; in slices."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > width:
                stack.append((level, a[width:], b[width:]))
                a, b = a[:width], b[:width]
            _, _, lo, hi, hidden, after, union = self.levels[level]
            need = threshold / (1 + threshold) * (lo[a] + lo[b]) - 1e-6
            most = np.minimum(np.minimum(hi[a], hi[b]), np.minimum(after[a], after[b]))
            ok = (most >= need) & (hi[a] >= threshold * lo[b] - 1e-6) & (hi[b] >= threshold * lo[a] - 1e-6)
            a, b, need = a[ok], b[ok], need[ok]
            common = np.bitwise_count(union[a] & union[b]).sum(1) + np.minimum(hidden[a], hidden[b])
            a, b = a[common >= need], b[common >= need]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            first, last = self.levels[level][:2]
            na, nb = (last - first)[a], (last - first)[b]
            pair = np.repeat(np.arange(len(a)), na * nb)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            x, y = first[a[pair]] + k // nb[pair], first[b[pair]] + k % nb[pair]
            up = x <= y
            stack.append((level - 1, x[up], y[up]))


def _second(size: np.ndarray, which: np.ndarray, big: pa.Array, order: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of ``which``: where their wider bitmaps are, the bitmaps cut to ``bits``, and the tokens that these hide."""
    rows = np.flatnonzero(which)
    at = np.full(len(size), -1)
    at[rows] = np.arange(len(rows))
    maps = np.zeros((len(rows), bits // 64), np.uint64)
    for i, blob in enumerate(big.take(pa.array(order[rows])).to_pylist()):
        words = np.frombuffer(blob, np.uint64)
        maps[i] = words if len(words) == maps.shape[1] else words[: maps.shape[1]] | words[maps.shape[1] :]
    return at, maps, size[rows] - np.bitwise_count(maps).sum(1)


def candidates(posts: list[np.ndarray], big: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of classes of one kind that no bound rules out: (smaller, larger)."""
    tok, cls, size, pos, side, bits = posts
    order = np.lexsort((cls, size, tok))
    tok, cls = tok[order], cls[order]
    # one row for each class and shingle, shingles of one class only left out
    new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])])
    order, tok, cls = order[new], tok[new], cls[new]
    starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    count = np.diff(np.concatenate([starts, [len(tok)]]))
    many = np.repeat(count > 1, count)
    order, tok, cls = order[many], tok[many], cls[many]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size, pos, side, bits = size[order].astype(np.int64), pos[order].astype(np.int64), side[order], bits[order]
    hidden, after = size - np.bitwise_count(bits).sum(1), size - pos
    second = [_second(size, size > LARGE, big, order, BIG_BITS), _second(size, size > HUGE, big, order, HUGE_BITS)]
    forest = Forest(tok, size, pos, bits)
    first, last = forest.levels[0][:2]
    share = threshold / (1 + threshold)
    lane = np.arange(LEAF)
    found: list[np.ndarray] = []
    for leaf_a, leaf_b in forest.leaf_pairs(threshold):
        for i in range(0, len(leaf_a), 512):
            a, b = leaf_a[i : i + 512], leaf_b[i : i + 512]
            ra, rb = first[a][:, None] + lane, first[b][:, None] + lane
            here_a, here_b = ra < last[a][:, None], rb < last[b][:, None]
            ra, rb = np.where(here_a, ra, 0), np.where(here_b, rb, 0)
            need = share * (size[ra][:, :, None] + size[rb][:, None, :]) - 1e-6
            ok = np.minimum(after[ra][:, :, None], after[rb][:, None, :]) >= need
            ok &= here_a[:, :, None] & here_b[:, None, :]
            ok &= np.where((a == b)[:, None, None], lane[:, None] < lane, True)
            sa, sb = side[ra][:, :, None], side[rb][:, None, :]
            ok &= (sa == 2) | (sa != sb)
            common = np.minimum(hidden[ra][:, :, None], hidden[rb][:, None, :])
            for w in range(bits.shape[1]):
                common = common + np.bitwise_count(bits[ra, w][:, :, None] & bits[rb, w][:, None, :])
            m, x, y = np.nonzero(ok & (common >= need))
            x, y = ra[m, x], rb[m, y]
            for at, maps, hides in second:
                both = (at[x] >= 0) & (at[y] >= 0)
                if both.any():
                    u, v = at[x[both]], at[y[both]]
                    most = np.minimum(hides[u], hides[v]) + np.bitwise_count(maps[u] & maps[v]).sum(1)
                    keep = np.ones(len(x), bool)
                    keep[both] = most >= share * (size[x[both]] + size[y[both]]) - 1e-6
                    x, y = x[keep], y[keep]
            if len(x):
                p, q = cls[x], cls[y]
                found.append(np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)], 1), axis=0))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def candidate_pairs(posts: DataFrame, kinds: tuple[Kind, ...], tasks: int) -> DataFrame:
    """(kind, a, b): distinct pairs of classes that the signature trees leave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's share of the postings: about TASK rows, as the number of tasks follows their number
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        col = {c: t.column(c).combine_chunks() for c in t.column_names}
        tok, kind, side = (col[c].to_numpy() for c in ("tok", "kind", "side"))
        size, pos = col["about"].to_numpy() >> 32, col["about"].to_numpy() & 0xFFFFFFFF
        bits = np.stack([col[f"b{w}"].to_numpy().view(np.uint64) for w in range(BITS // 64)], 1)
        # classes are numbered in the order of their 128 bits, which is the same in every task
        cls = np.stack([col["c0"].to_numpy(), col["c1"].to_numpy()], 1)
        order = np.argsort(cls[:, 0], kind="stable")
        half = cls[order]
        if ((half[1:, 0] == half[:-1, 0]) & (half[1:, 1] != half[:-1, 1])).any():
            order = np.lexsort((cls[:, 1], cls[:, 0]))
        new = np.concatenate([[True], (cls[order][1:] != cls[order][:-1]).any(1)])
        number = np.empty(len(cls), np.int64)
        number[order] = np.cumsum(new) - 1
        name = np.ascontiguousarray(cls[order][new], "<i8").view("V16").ravel()
        for k, of in enumerate(kinds):
            rows = np.flatnonzero(kind == k)
            if len(rows):
                arrays = [tok[rows], number[rows], size[rows], pos[rows], side[rows], bits[rows]]
                a, b = candidates(arrays, col["big"].take(pa.array(rows)), float(of.threshold))
                if len(a):
                    out = [pa.array([x.tobytes() for x in name[i]], pa.binary()) for i in (a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), k, np.int32)), *out], names=["kind", "a", "b"])

    return posts.repartition(tasks, "tok").mapInArrow(run, "kind int, a binary, b binary").distinct()


@dataclass
class NearDuplicates:
    """members: (kind, key, cls), once each; links: (kind, a, b, similarity) between classes that are similar enough, a < b."""

    members: DataFrame
    links: DataFrame


def near_duplicates(records: DataFrame, kinds: tuple[Kind, ...] = (CHUNKS, TITLES), cell: int = CELL, task: int = TASK) -> NearDuplicates:
    """All pairs of classes of (kind, key, text) whose Jaccard similarity reaches the threshold of their kind.

    Words are maximal runs of letters and digits in lower case. Records that
    are too short for their kind have no class; copies share one. Null keys
    and texts must be left out before; no records give no members and links.
    """
    sets = stored(shingled(records, kinds, full=False), "shingles")
    counts = shingle_counts(sets, len(kinds))
    frequent = frequent_shingles(sets, counts, cell)
    tasks = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) * 2 // 5 // task))
    pairs = stored(candidate_pairs(in_cells(postings(sets, kinds, counts, frequent), frequent, cell), kinds, tasks), "candidates")
    members = sets.select("kind", "key", "cls").distinct()
    return NearDuplicates(members, verified(records, members, pairs, kinds))


def verified(records: DataFrame, members: DataFrame, pairs: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """The pairs whose sets, taken from the whole texts again, are similar enough.

    Only the records that a Bloom filter of the pairs' classes lets through are read again in full.
    """
    wanted = pairs.select("kind", F.explode(F.array("a", "b")).alias("cls")).distinct()
    keys = stored(members.join(wanted, ["kind", "cls"]).groupBy("kind", "cls").agg(F.min("key").alias("key")), "wanted")
    full = keys.select(F.concat_ws("/", "kind", "key").alias("id"))
    blocks = blocks_for(full.count())
    some = with_maybe(records.withColumn("id", F.concat_ws("/", "kind", "key")), "id", bloom_table(full, "id", blocks), blocks)
    some = some.where("_maybe").select("id", "kind", "key", "text").join(full, "id", "left_semi")
    sets = shingled(some.select("kind", "key", "text"), kinds, full=True).groupBy("kind", "cls").agg(F.first("toks").alias("toks"))
    t = F.element_at(F.array(*(F.array(F.lit(k.threshold.numerator), F.lit(k.threshold.denominator)) for k in kinds)), F.col("kind") + 1)
    common = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(sets.select("kind", F.col("cls").alias("a"), F.col("toks").alias("ta")), ["kind", "a"])
        .join(sets.select("kind", F.col("cls").alias("b"), F.col("toks").alias("tb")), ["kind", "b"])
        .select("kind", "a", "b", common.alias("common"), (F.size("ta") + F.size("tb") - common).alias("all"), t.alias("t"))
        .where(F.col("common") * F.col("t")[1] >= F.col("all") * F.col("t")[0])
        .select("kind", "a", "b", (F.col("common") / F.col("all")).alias("similarity"))
    )


def named(kinds: tuple[Kind, ...]):
    return F.element_at(F.array(*(F.lit(k.name) for k in kinds)), F.col("kind") + 1)


def key_pairs(found: NearDuplicates, kinds: tuple[Kind, ...] = (CHUNKS, TITLES)) -> DataFrame:
    """(record_table, key_a, key_b): the links between classes and the copies within them, spelled out for the keys; smaller key first.

    The output itself has all pairs of copies; a class of very many is a
    skewed key of a join of (kind, cls), which adaptive execution splits.
    """
    m = found.members
    left = m.select("kind", F.col("cls").alias("a"), F.col("key").alias("ka"))
    right = m.select("kind", F.col("cls").alias("b"), F.col("key").alias("kb"))
    across = found.links.join(left, ["kind", "a"]).join(right, ["kind", "b"]).select("kind", "ka", "kb")
    copied = m.groupBy("kind", "cls").agg(F.count("*").alias("n")).where("n > 1").select("kind", "cls")
    twins = m.join(copied, ["kind", "cls"])
    within = twins.select("kind", "cls", F.col("key").alias("ka")).join(twins.select("kind", "cls", F.col("key").alias("kb")), ["kind", "cls"])
    return (
        across.where("ka <> kb")
        .unionByName(within.where("ka < kb").select("kind", "ka", "kb"))
        .select(named(kinds).alias("record_table"), F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
        .distinct()
    )


def groups(found: NearDuplicates, kinds: tuple[Kind, ...] = (CHUNKS, TITLES)) -> DataFrame:
    """(record_table, record_key, class_id, n_links, group_id): one row for each record and class.

    ``n_links`` counts the classes linked to its own; ``group_id`` is the
    smallest class of its connected component. Labels jump along labels, so
    that the number of rounds grows with the logarithm of a component's
    diameter; each round is checkpointed.
    """
    links = found.links.select("kind", "a", "b")
    both = checkpointed(links.unionByName(links.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = both.groupBy("kind", "a").agg(F.least(F.min("b"), F.first("a")).alias("g"))
    while True:
        label = checkpointed(label)
        other = label.select("kind", F.col("a").alias("b"), F.col("g").alias("og"))
        lower = both.join(other, ["kind", "b"]).groupBy("kind", "a").agg(F.min("og").alias("near"))
        hop = label.select("kind", F.col("a").alias("g"), F.col("g").alias("hop"))
        step = label.join(lower, ["kind", "a"]).join(hop, ["kind", "g"])
        step = checkpointed(step.select("kind", "a", "g", F.least("g", "near", "hop").alias("new")))
        if step.where("new < g").isEmpty():
            break
        label = step.select("kind", "a", F.col("new").alias("g"))
    degree = both.groupBy("kind", F.col("a").alias("cls")).agg(F.count_distinct("b").alias("n_links"))
    labels = label.select("kind", F.col("a").alias("cls"), "g")
    return (
        found.members.join(degree, ["kind", "cls"], "left")
        .join(labels, ["kind", "cls"], "left")
        .select(
            named(kinds).alias("record_table"), F.col("key").alias("record_key"), F.lower(F.hex("cls")).alias("class_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"), F.lower(F.hex(F.coalesce("g", "cls"))).alias("group_id"),
        )
    )
