"""The most similar vectors of every vector, by learned partitions.

1. From a bounded sample of the vectors a graph of nearest neighbours is made
   (in Spark, in blocks) and cut into balanced parts: recursive bisection at
   the median of a smooth vector on the graph, with balanced swaps, then
   refined among all parts at once: nodes go where their neighbours are, while
   the parts keep their sizes.
2. A small network learns the part of a vector and of its neighbours. It
   routes every vector of the collection to its most probable part, where the
   vector is indexed, and to several most probable parts, where it is
   compared exactly with all that is indexed there.
3. How many parts that takes is measured, not assumed: for a bounded sample
   of queries the true neighbours are found by brute force, and the parts are
   increased until the routing finds enough of them.
4. Parts are split into blocks of rows, queries and index alike, so that no
   task holds a whole part; the best of all blocks are merged per query.
5. A vector travels to each of its parts. So that the disk need not hold all
   of these copies, the search goes in waves, each of about as many rows as
   there are vectors: the queries in turns, as the lists of their parts fill
   the disk too, and in a turn one range of parts after another. Only the best
   found so far outlast a wave, and every table of vectors is deleted once
   nothing reads it.

The sample, and with it the network, is bounded by documented parameters; the
number of parts follows the number of vectors; parts that stay too large get
a router of their own, fitted in a task. All rows are indexed and all are
queries. Vectors of one direction are one class: one of them is searched for,
its copies are put back at the end.
"""

from __future__ import annotations

import logging
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.keys import hex_key
from loomspark.session import discard, stored_lean

DIM, K = 64, 5
#: Vectors a part should index, the most parts, and vectors of the sample for each part; so the sample has at most 16,384 vectors.
PART_ROWS, MOST_PARTS, SAMPLE_PER_PART, MOST_SAMPLE = 700, 512, 256, 16_384
#: The same for the parts of a part, where a part still holds more than PART_ROWS: 16 MB of routers at most.
MOST_SUBPARTS, MOST_SUBSAMPLE, SUBHIDDEN = 64, 4096, 64
#: Parts that a query is sent to at least, rows of a block of queries and of a block of the index.
PROBES, QUERY_BLOCK, INDEX_BLOCK = 2, 32_768, 8192
#: Rows that a wave of the search shuffles at least, however few vectors there are.
WAVE_ROWS = 1_000_000
#: Parts for each vector that are listed at once: with more parts a query, the queries take turns.
LISTED = 32
#: Neighbours of a node of the graph, and those among them whose parts are a vector's labels.
GRAPH_K, LABELS = 32, 12
#: Rounds of the refinement among all parts, and of the scaling in each of them that keeps the sizes.
REFINED, SCALED = 12, 6
#: Queries whose neighbours are found by brute force to choose the number of parts, the recall that these need (less two
#: standard errors), that of neighbours above a stated similarity, and the growth of the number from try to try. Few queries
#: have such close neighbours, so the number that finds those of the sample is multiplied by CLOSE_MARGIN.
MEASURED, RECALL, CLOSE_RECALL, GROWTH, CLOSE_MARGIN = 1024, 0.9, 0.995, 1.125, 2
#: Entries of the table of subparts that a router fills at once.
ROUTED_AT_ONCE = 4_000_000

log = logging.getLogger(__name__)


def usable_vectors(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(key, vec): the newest vector of each chunk key as ``dim`` floats in bytes, if it is usable.

    The row with the latest ``updated_at`` counts (null is earliest; of rows
    at the same time the one with the largest embedding). Unusable are null,
    short, long, zero and non-finite vectors; such a chunk has no vector.
    """
    newest = (
        vectors.select(hex_key("chunk_id").alias("key"), F.col("updated_at").alias("at"), F.col("embedding").cast("array<float>").alias("e"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.max(F.struct("at", "e"))["e"].alias("e"))
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = newest.where((F.size("e") == dim) & F.forall("e", finite) & F.exists("e", lambda x: x != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "vec"])

    return good.mapInArrow(pack, "key string, vec binary")


def with_direction(vectors: DataFrame, dim: int) -> DataFrame:
    """Adds ``dir``, a hash of 128 bits of the unit vector to six decimals: copies have one direction, whatever their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = np.round(matrix(b.column(1), dim) * 1e6).astype("<i4")
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in u], pa.binary())], names=["key", "vec", "dir"])

    return vectors.select("key", "vec").mapInArrow(run, "key string, vec binary, dir binary")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a binary column as unit rows; sums are in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sample_graph(sample: np.ndarray, spark, k: int = GRAPH_K, block: int = 1024) -> np.ndarray:
    """The k nearest others of each sample vector; blocks of rows are tasks, the bounded sample is broadcast."""
    n = len(sample)
    k = min(k, n - 1)
    shared = spark.sparkContext.broadcast(sample.astype(np.float32))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                rows = np.arange(i * block, min(n, (i + 1) * block))
                s = x[rows] @ x.T
                s[np.arange(len(rows)), rows] = -9
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(top.tolist(), pa.list_(pa.int32()))], names=["row", "near"])

    blocks = -(-n // block)
    got = spark.range(0, blocks, 1, blocks).mapInArrow(near, "row bigint, near array<int>").orderBy("row").toArrow()
    return np.array(got.column("near").to_pylist(), np.int64)


def balanced_parts(near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """A part for each node of the graph, in 2^j parts of sizes that differ by j at most, cutting few edges."""
    rng = np.random.default_rng(seed)
    n, k = near.shape
    part = np.zeros(n, np.int64)
    # undirected edges, both ways
    a = np.concatenate([np.repeat(np.arange(n), k), near.ravel()])
    b = np.concatenate([near.ravel(), np.repeat(np.arange(n), k)])
    for depth in range(int(np.log2(parts))):
        same = part[a] == part[b]
        ea, eb = a[same], b[same]
        degree = np.bincount(ea, minlength=n) + 1.0
        # a smooth vector on each part's graph, by power iteration; the mean is taken out of each part
        x = rng.standard_normal(n)
        size = np.bincount(part, minlength=1 << depth)
        for _ in range(60):
            x = (x + np.bincount(ea, x[eb], n)) / degree
            x -= (np.bincount(part, x) / size)[part]
            x /= np.sqrt(np.bincount(part, x * x) / size + 1e-12)[part]
        order = np.lexsort((x, part))
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.empty(n, np.int64)
        place[order] = np.arange(n) - start[part[order]]
        side = (place >= size[part] // 2).astype(np.int64)
        # swap equally many nodes that gain by changing sides
        for _ in range(8):
            across = side[ea] != side[eb]
            gain = np.bincount(ea, np.where(across, 1.0, -1.0), n)
            order = np.lexsort((-gain, side, part))
            group = part[order] * 2 + side[order]
            first = np.concatenate([[True], group[1:] != group[:-1]])
            rank = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
            table = {}
            for s in (0, 1):
                rows = order[side[order] == s]
                table[s] = (rows, part[rows], rank[side[order] == s])
            wide = int(rank.max()) + 1
            gains = np.full((2, 1 << depth, wide), -1e9)
            who = np.full((2, 1 << depth, wide), -1)
            for s in (0, 1):
                rows, p, r = table[s]
                gains[s, p, r], who[s, p, r] = gain[rows], rows
            swap = (gains[0] + gains[1] > 2) & (rng.random(gains[0].shape) < 0.5)
            if not swap.any():
                break
            side[who[0][swap]], side[who[1][swap]] = 1, 0
        part = part * 2 + side
    return part


def refined_parts(near: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """Parts of about equal sizes that cut fewer edges than ``part``, or ``part`` itself.

    Every node has a share in each part, which it averages with its
    neighbours' and sharpens; then the shares are scaled so that all parts
    weigh the same and every node 1. Memory: nodes times parts floats.
    """
    n, k = near.shape
    share = np.zeros((n, parts), np.float32)
    share[np.arange(n), part] = 1
    for _ in range(REFINED):
        mixed = share.copy()
        for j in range(k):
            mixed += share[near[:, j]]
        mixed /= mixed.sum(1, keepdims=True)
        mixed *= mixed
        for _ in range(SCALED):
            mixed /= mixed.sum(0) * np.float32(parts / n) + np.float32(1e-9)
            mixed /= mixed.sum(1, keepdims=True) + np.float32(1e-12)
        share = mixed
    new = share.argmax(1)
    kept = lambda q: (q[near] == q[:, None]).mean()
    return new if kept(new) > kept(part) else part


class Router:
    """A network with one hidden layer from a vector to the probability of each part."""

    def __init__(self, x: np.ndarray, targets: np.ndarray, parts: int, hidden: int = 192, epochs: int = 24, seed: int = 0):
        """``targets``: for each row the parts of itself and its neighbours; their shares are the soft labels."""
        rng = np.random.default_rng(seed)
        n, d = x.shape
        x = x.astype(np.float32)
        w = [
            (rng.standard_normal((d, hidden)) * np.sqrt(2 / d) * 4).astype(np.float32), np.zeros(hidden, np.float32),
            (rng.standard_normal((hidden, parts)) / np.sqrt(hidden)).astype(np.float32), np.zeros(parts, np.float32),
        ]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        t = 0
        size = 256
        for epoch in range(epochs):
            rate = 0.004 * (1 - epoch / epochs) + 1e-4
            for rows in np.array_split(rng.permutation(n), max(1, n // size)):
                xb = x[rows]
                h = np.maximum(xb @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                np.subtract.at(p, (np.repeat(np.arange(len(rows)), targets.shape[1]), targets[rows].ravel()), np.float32(1 / targets.shape[1]))
                p /= len(rows)
                dh = (p @ w[2].T) * (h > 0)
                grads = [xb.T @ dh, dh.sum(0), h.T @ p, p.sum(0)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.99 * v[i] + 0.01 * g * g
                    w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-7)
        self.w = [p.astype(np.float32) for p in w]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x.astype(np.float32) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def top(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` most probable parts of each row, the most probable first."""
        return _top(self.log_probabilities(x), probes)


def _top(z: np.ndarray, probes: int) -> np.ndarray:
    """Columns of the largest values of each row, the largest first."""
    probes = min(probes, z.shape[1])
    some = np.argpartition(-z, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(z, some, 1), axis=1, kind="stable"), 1)


class Routing:
    """A router over all parts and, where parts are still too large, routers within them; parts are numbered through."""

    def __init__(self, first: Router | None, within: dict[int, Router] | None = None):
        self.first, self.within = first, within or {}

    def top(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The most probable parts of each row by the product of both probabilities; -1 fills up what is missing."""
        if self.first is None:
            return np.zeros((len(x), 1), np.int64)
        if not self.within:
            return self.first.top(x, probes)
        wide = min(probes, self.first.w[3].size) * MOST_SUBPARTS
        step = max(1, ROUTED_AT_ONCE // wide)
        return np.concatenate([self._within(x[i : i + step], probes) for i in range(0, len(x), step)])

    def _within(self, x: np.ndarray, probes: int) -> np.ndarray:
        p = self.first.log_probabilities(x)
        parts = _top(p, probes)
        score = np.full((len(x), parts.shape[1], MOST_SUBPARTS), -np.inf)
        for part in np.unique(parts):
            row, at = np.nonzero(parts == part)
            sub = self.within.get(int(part))
            inner = sub.log_probabilities(x[row]) if sub else np.zeros((len(row), 1))
            score[row, at, : inner.shape[1]] = p[row, part][:, None] + inner
        flat = score.reshape(len(x), -1)
        best = _top(flat, probes)
        number = np.take_along_axis(parts, best // MOST_SUBPARTS, 1) * MOST_SUBPARTS + best % MOST_SUBPARTS
        return np.where(np.isfinite(np.take_along_axis(flat, best, 1)), number, -1)


def fit_router(vectors: DataFrame, n: int, dim: int, part_rows: int = PART_ROWS, seed: int = 0) -> tuple[Router | None, int]:
    """A router and its number of parts; none if one part is enough."""
    parts = 1
    while parts < MOST_PARTS and parts * part_rows < n:
        parts *= 2
    if parts == 1:
        return None, 1
    want = min(MOST_SAMPLE, parts * SAMPLE_PER_PART)
    rows = vectors.orderBy(F.xxhash64("key", F.lit(seed))).limit(want).select("vec").toArrow()
    x = matrix(rows.column(0), dim)
    return _trained(x, sample_graph(x, vectors.sparkSession), parts, seed), parts


def _trained(x: np.ndarray, near: np.ndarray, parts: int, seed: int, **options) -> Router:
    part = refined_parts(near, balanced_parts(near, parts, seed), parts)
    return Router(x, np.concatenate([part[:, None], part[near[:, :LABELS]]], axis=1), parts, seed=seed, **options)


def fit_routing(vectors: DataFrame, n: int, dim: int, part_rows: int = PART_ROWS, seed: int = 0) -> Routing:
    """Routers for ``n`` vectors (key, vec): one, and one for each part that still holds more than ``part_rows``.

    The routers of parts are fitted in Spark, a part a task, each on a
    bounded sample of its rows.
    """
    router, parts = fit_router(vectors, n, dim, part_rows, seed)
    if parts * part_rows >= n:
        return Routing(router)
    shared = vectors.sparkSession.sparkContext.broadcast(router)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                top = shared.value.top(matrix(b.column(1), dim), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(top.astype(np.int32))], names=["key", "vec", "part"])

    at_home = stored_lean(vectors.mapInArrow(home, "key string, vec binary, part int"), "parts")
    sizes = at_home.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > part_rows)  # at most MOST_PARTS rows
    by_hash = Window.partitionBy("part").orderBy(F.xxhash64("key", F.lit(seed)))
    sample = at_home.withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= MOST_SUBSAMPLE).join(F.broadcast(sizes), "part")

    def fit(t: pa.Table) -> pa.Table:
        subparts = 1
        while subparts < MOST_SUBPARTS and subparts * part_rows < t.column("n")[0].as_py():
            subparts *= 2
        x = matrix(t.column("vec"), dim)
        s = x.astype(np.float32) @ x.astype(np.float32).T
        np.fill_diagonal(s, -9)
        k = min(GRAPH_K, len(x) - 1)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        r = _trained(x, near, subparts, seed, hidden=SUBHIDDEN)
        return pa.table({"part": t.column("part")[:1], "router": pa.array([pickle.dumps(r.w)], pa.binary())})

    routers = stored_lean(sample.groupBy("part").applyInArrow(fit, "part int, router binary"), "routers")
    within = {}
    for row in routers.toLocalIterator():
        r = Router.__new__(Router)
        r.w = pickle.loads(bytes(row["router"]))
        within[row["part"]] = r
    discard(at_home)
    return Routing(router, within)


def true_neighbours(vectors: DataFrame, dim: int, k: int, least: float = -2.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, row of the query, neighbour): MEASURED vectors chosen by hash, and by brute force their k nearest others at ``least`` or more, a row for each."""
    # another seed than the routers' samples have
    chosen = vectors.orderBy(F.xxhash64("key", F.lit(seed + 1)), "key").limit(MEASURED).select("key", "vec").toArrow()
    x = matrix(chosen.column("vec"), dim)
    shared = vectors.sparkSession.sparkContext.broadcast((x.astype(np.float32), {key: i for i, key in enumerate(chosen.column("key").to_pylist())}))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, number = shared.value
        cosine, vec = np.full((len(q), k), -9, np.float32), np.zeros((len(q), k, dim), np.float32)
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f4").reshape(-1, dim)
            keys = b.column(0).to_pylist()
            for i in range(0, len(keys), 4096):
                part = raw[i : i + 4096]
                s = q @ matrix(b.column(1).slice(i, 4096), dim).astype(np.float32).T
                for j, key in enumerate(keys[i : i + 4096]):
                    if key in number:
                        s[number[key], j] = -9
                both = np.concatenate([cosine, s], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                cosine = np.take_along_axis(both, top, 1)
                old = np.take_along_axis(vec, np.minimum(top, k - 1)[:, :, None], 1)
                vec = np.where((top < k)[:, :, None], old, part[np.maximum(top - k, 0)])
        row, at = np.nonzero((cosine > -9) & (cosine >= least))
        if len(row):
            found = [pa.array(row.astype(np.int32)), pa.array(cosine[row, at]), pa.array([v.tobytes() for v in vec[row, at]], pa.binary())]
            yield pa.RecordBatch.from_arrays(found, names=["row", "cosine", "vec"])

    found = vectors.select("key", "vec").mapInArrow(near, "row int, cosine float, vec binary")
    first = Window.partitionBy("row").orderBy(F.col("cosine").desc(), "vec")
    t = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select("row", "vec").toArrow()  # at most MEASURED * k rows
    return x, t.column("row").to_numpy(), matrix(t.column("vec"), dim)


def found_share(routing: Routing, x: np.ndarray, row: np.ndarray, near: np.ndarray, probes: int) -> np.ndarray:
    """For each query that has any, the share of its true neighbours that meet it in a part, from either side."""
    mine, other = routing.top(x, probes)[row], routing.top(near, probes)
    met = (mine == routing.top(near, 1)).any(1) | (other == routing.top(x, 1)[row]).any(1)
    n = np.bincount(row, minlength=len(x))
    return (np.bincount(row, met, len(x)) / np.maximum(n, 1))[n > 0]


def choose_probes(routing: Routing, vectors: DataFrame, dim: int, k: int, least: float = -2.0, seed: int = 0) -> tuple[int, float]:
    """(probes, recall): the parts that a query is sent to, PROBES or as many more as the measured recall needs, up to all of them.

    What is measured are the neighbours that are asked for: where ``least``
    leaves out the others, these are closer and need fewer parts, and more of
    them must be found.
    """
    if routing.first is None:
        return 1, 1.0
    x, row, near = true_neighbours(vectors, dim, k, least, seed)
    enough = RECALL if least <= -1 else CLOSE_RECALL
    margin = 1 if least <= -1 else CLOSE_MARGIN
    every = routing.first.w[3].size * (MOST_SUBPARTS if routing.within else 1)
    probes = min(PROBES, every)
    while True:
        share = found_share(routing, x, row, near, probes) if len(row) else np.ones(1)
        if probes == every or share.mean() - 2 * share.std() / np.sqrt(len(share)) >= enough:
            log.info("%d of at most %d parts a query, recall@%d of %d queries %.3f", probes, every, k, len(share), share.mean())
            return min(every, probes * margin), float(share.mean())
        probes = min(every, int(np.ceil(probes * GROWTH)))


def _best(s: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k largest of each row; all that tie with the last are kept."""
    k = min(k, s.shape[1])
    bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return np.nonzero(s >= bar[:, None] - slack)


def _close(x: np.ndarray, x32: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, column) and (column, row) that hold the k most similar of the first, at ``least`` or more, in single precision.

    Where single precision can't tell many candidates apart, as in a large
    group of near copies, the block is compared in double precision.
    """
    s = x32[rows] @ x32[cols].T
    few = 16 * (k + 1)
    if least > -1:
        near = s >= least - 1e-4
        if np.count_nonzero(near) <= few * len(rows):
            r, c = np.nonzero(near)
            yield rows[r], cols[c]
            yield cols[c], rows[r]
            return
    for me, other, m in ((rows, cols, s), (cols, rows, s.T)):
        # one more than k, as a row may meet itself
        r, c = _best(m, k + 1, 1e-6)
        if len(r) > few * len(me):
            r, c = _best(x[me] @ x[other].T, k + 1, 1e-12)
        yield me[r], other[c]


def _search(table: pa.Table, dim: int, k: int, least: float) -> pa.Table:
    """Within one cell: for every query its k best indexed rows, and for every indexed row its k best queries.

    By cosine, at least ``least``; ties by key. A pair is thus found from
    either side, which halves the loss of the routing at the same cost.
    """
    query = table.column("is_query").to_numpy()
    keys = np.array(table.column("key").to_pylist(), object)
    x = matrix(table.column("vec"), dim)
    out: list[tuple] = []

    def keep(me: np.ndarray, other: np.ndarray) -> None:
        """Adds, of candidate pairs, the k best for each of ``me``."""
        differ = keys[me] != keys[other]
        me, other = me[differ], other[differ]
        exact = np.round(np.einsum("ij,ij->i", x[me], x[other]), 12)
        good = exact >= least
        me, other, exact = me[good], other[good], exact[good]
        if not len(me):
            return
        o = np.lexsort((place[other], -exact, me))
        me, other, exact = me[o], other[o], exact[o]
        first = np.concatenate([[True], me[1:] != me[:-1]])
        top = np.arange(len(me)) - np.maximum.accumulate(np.where(first, np.arange(len(me)), 0)) < k
        out.append((keys[me[top]], keys[other[top]], exact[top]))

    place = np.empty(len(keys), np.int64)
    place[np.argsort(keys)] = np.arange(len(keys))
    rows, cols = np.flatnonzero(query), np.flatnonzero(~query)
    x32 = x.astype(np.float32)
    for i in range(0, len(rows), 1024) if len(cols) else ():
        for me, other in _close(x, x32, rows[i : i + 1024], cols, k, least):
            keep(me, other)
    cat = lambda i, kind: np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind)
    return pa.table(
        {"query": pa.array(cat(0, object), pa.string()), "key": pa.array(cat(1, object), pa.string()), "cosine": pa.array(cat(2, float), pa.float64())}
    )


def similar_vectors(
    vectors: DataFrame, k: int = K, least: float = -2.0, dim: int = DIM, probes: int | None = None, part_rows: int = PART_ROWS, seed: int = 0
) -> DataFrame:
    """(query, key, cosine, rank): the up to ``k`` most similar other keys of every key of ``vectors`` (key, vec).

    Keys must be unique. Equal cosines are ordered by key. ``least`` leaves
    out less similar ones early. No vectors or a single one: no rows. The
    answer is exact if one part is enough, else approximate: a pair is missed
    if each of the two is indexed outside the other's ``probes`` parts. Without
    ``probes`` there are as many as a measured recall of RECALL needs, or of
    CLOSE_RECALL among neighbours at ``least`` or more.
    """
    spark = vectors.sparkSession
    tagged = stored_lean(with_direction(vectors, dim), "tagged")
    reps, copied = _classes(tagged)
    discard(tagged)
    n = reps.count()
    routing = fit_routing(reps, n, dim, part_rows, seed)
    if probes is None:
        probes, _ = choose_probes(routing, reps, dim, k, least, seed)
    shared = spark.sparkContext.broadcast(routing)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = shared.value.top(matrix(b.column(1), dim), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], names=["key", "vec", "part"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                top = shared.value.top(matrix(b.column(1), dim), probes)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(top.tolist(), pa.list_(pa.int32()))], names=["key", "vec", "parts"])

    # in the order of the parts, so that a wave skips most of what it doesn't index
    index = stored_lean(reps.mapInArrow(home, "key string, vec binary, part int").sortWithinPartitions("part"), "index")
    discard(reps)
    # at most MOST_PARTS * MOST_SUBPARTS rows
    held = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    # without a bar every row of a wave may find k others, which are shuffled as well
    most = max(WAVE_ROWS, n if least > -1 else n // 2)
    turns = -(-probes // LISTED)
    best = None
    for turn in range(turns):
        mine = index.where(F.pmod(F.xxhash64("key", F.lit(seed + 2)), F.lit(turns)) == turn).select("key", "vec")
        routed = mine.mapInArrow(route, "key string, vec binary, parts array<int>").withColumn("parts", F.filter("parts", lambda p: p >= 0))
        routed = stored_lean(routed, "routed")
        asked = {r["p"]: r["n"] for r in routed.select(F.explode("parts").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
        for wave in _waves(held, asked, most):
            found = _cells(index, routed, wave).groupBy("part", "ib", "qb").applyInArrow(
                lambda t: _search(t, dim, k, least), "query string, key string, cosine double"
            )
            before, found = best, found if best is None else found.unionByName(_spelled(best))
            best = stored_lean(
                found.groupBy("query").agg(
                    F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cosine")).alias("c"), F.col("key")))), 1, k).alias("best")
                ),
                "best",
            )
            if before is not None:
                discard(before)
        discard(routed)
    discard(index)
    if best is None:
        return spark.createDataFrame([], "query string, key string, cosine double, rank int")
    return _with_copies(copied, _spelled(best), k)


def _spelled(best: DataFrame) -> DataFrame:
    """(query, key, cosine), a row for each of the best that were found."""
    return best.select("query", F.explode("best").alias("b")).select("query", F.col("b.key").alias("key"), (-F.col("b.c")).alias("cosine"))


def _waves(held: dict[int, int], asked: dict[int, int], rows: float) -> list[list[tuple[int, int, int, int, int]]]:
    """Of each wave (part, blocks of its index, blocks of its queries, first cell, last cell); every cell is in one wave.

    Cells of a part are numbered by block of the index, then of queries. A
    wave shuffles at most ``rows``, or one cell. Parts are in the order of
    their numbers.
    """
    waves, room = [], 0.0
    for p in sorted(asked):
        n_index, n_query = -(-held.get(p, 0) // INDEX_BLOCK), -(-asked[p] // QUERY_BLOCK)
        if not n_index:
            continue
        cell, at = held[p] / n_index + asked[p] / n_query, 0
        while at < n_index * n_query:
            if room < cell:
                waves.append([])
                room = rows
            take = min(n_index * n_query - at, max(1, int(room // cell)))
            waves[-1].append((p, n_index, n_query, at, at + take - 1))
            room -= take * cell
            at += take
    return waves


def _cells(home: DataFrame, routed: DataFrame, wave: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(key, vec, part, ib, qb, is_query): the index and the queries of the cells of a wave."""
    to = F.broadcast(home.sparkSession.createDataFrame(wave, "part int, n_index int, n_query int, first int, last int"))
    low, high = wave[0][0], wave[-1][0]
    block = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    numbers = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    here = lambda ib, qb: (ib * F.col("n_query") + qb).between(F.col("first"), F.col("last"))
    index = (
        home.where(F.col("part").between(low, high)).join(to, "part")
        .select("key", "vec", "part", block("n_index").alias("ib"), "n_query", "first", "last")
        .select("key", "vec", "part", "ib", F.explode(F.filter(numbers("n_query"), lambda qb: here(F.col("ib"), qb))).alias("qb"), F.lit(False).alias("is_query"))
    )
    queries = (
        routed.select("key", "vec", F.explode(F.filter("parts", lambda p: p.between(low, high))).alias("part")).join(to, "part")
        .select("key", "vec", "part", block("n_query").alias("qb"), "n_index", "n_query", "first", "last")
        .select("key", "vec", "part", F.explode(F.filter(numbers("n_index"), lambda ib: here(ib, F.col("qb")))).alias("ib"), "qb", F.lit(True).alias("is_query"))
    )
    return index.unionByName(queries)


def _classes(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of vectors with their directions: (key, vec) of the smallest key of each direction, and (key, cls), all keys of directions that have several with the smallest."""
    reps = stored_lean(tagged.groupBy("dir").agg(F.min(F.struct("key", "vec")).alias("r")).select("r.key", "r.vec"), "vectors")
    several = tagged.groupBy("dir").agg(F.min("key").alias("cls"), F.count("*").alias("_n")).where("_n > 1").select("dir", "cls")
    return reps, stored_lean(tagged.select("key", "dir").join(several, "dir").select("key", "cls"), "copied")


def _with_copies(copied: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Turns neighbours between classes into neighbours between keys.

    Of each class at most k + 1 keys, the smallest, can be among anybody's k
    most similar ones; a copy is as similar as a vector can be.
    Copies agree in six decimals of their directions, so their cosine differs
    from 1 by less than 1e-10 and is given as 1.
    """
    salt = F.pmod(F.xxhash64("key"), F.lit(32)).alias("s")
    smallest = Window.partitionBy("cls", "s").orderBy("key")
    few = stored_lean(
        copied.select("cls", "key", salt)
        .withColumn("_r", F.row_number().over(smallest))
        .where(F.col("_r") <= k + 1)
        .groupBy(F.col("cls").alias("c"))
        .agg(F.slice(F.sort_array(F.collect_list("key")), 1, k + 1).alias("keys")),
        "few",
    )
    wide = pairs.join(few, F.col("key") == F.col("c"), "left").select(
        "query", "cosine", F.explode(F.coalesce("keys", F.array("key"))).alias("key"), F.lit(False).alias("own")
    )
    own = few.select(F.col("c").alias("query"), F.lit(1.0).alias("cosine"), F.explode("keys").alias("key"), F.lit(True).alias("own"))
    lists = stored_lean(
        wide.unionByName(own).groupBy("query").agg(
            F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "key"))), 1, k + 1).alias("best"), F.max("own").alias("several")
        ),
        "lists",
    )
    alone = lists.where("not several").select(F.col("query").alias("me"), "best")
    out = alone.unionByName(copied.select(F.col("key").alias("me"), "cls").join(lists.where("several"), F.col("cls") == F.col("query")).select("me", "best"))
    mine = F.slice(F.filter("best", lambda b: b["key"] != F.col("me")), 1, k)
    return out.select("me", F.posexplode(mine).alias("r", "b")).select(
        F.col("me").alias("query"), F.col("b.key").alias("key"), (-F.col("b.c")).alias("cosine"), (F.col("r") + 1).alias("rank")
    )


def similar_pairs(vectors: DataFrame, least: float = 0.85, k: int = K, **options) -> DataFrame:
    """(chunk_id_a, chunk_id_b): keys of which one is among the other's ``k`` most similar, at a cosine of at least ``least``; smaller key first."""
    n = similar_vectors(vectors, k, least, **options)
    return n.select(F.least("query", "key").alias("chunk_id_a"), F.greatest("query", "key").alias("chunk_id_b")).distinct()
