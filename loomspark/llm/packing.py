"""Filling containers of a fixed capacity.

Only the histogram of the lengths, which has at most as many entries as the
capacity, goes to the driver. There a configuration linear program chooses
how often each pattern (a multiset of lengths that fits) is used: fractional
covering by multiplicative weights, where patterns are priced by a knapsack
dynamic program. Patterns that are worth nearly as much as the best one at
the program's final prices are rounded to whole containers while their items
last; what is left is a smaller program, solved and rounded again, a few
times. Only the last remainder is packed the largest fitting length first.
Spark then ranks the items of each length and looks up their container in the
list of patterns.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.session import small, stored

CAPACITY = 2048
#: Rounds of the multiplicative weights, each of which prices one dynamic program; how sharply weights fall with what is covered;
#: the share of a length that a round covers at most, the patterns that it adds at most, and what these may lack of the best one's price.
ROUNDS, SHARPNESS, STEP, WIDTH, NEAR = 24, 0.3, 0.15, 512, 0.01
#: Programs that are solved one after the other at most, and what a pattern that is rounded may lack of the best one's worth, for each of them.
SLACK = (0.002, 0.004, 0.01, 0.03, 0.1)
#: Items of a length that are ranked in one sort.
RANKED = 100_000
#: Rows of a list that is broadcast at most; a longer one is shuffled.
LISTED = 1_000_000

log = logging.getLogger(__name__)

Pattern = tuple[int, dict[int, int]]


def price_patterns(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: (best value, length taken last or 0) for every capacity up to ``capacity``."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        fit = fits[c]
        best[c] = best[c - 1]
        if fit:
            got = best.take(c - lengths[:fit])
            got += value[:fit]
            k = got.argmax()
            if got[k] > best[c]:
                best[c], took[c] = got[k], lengths[k]
    return best, took


def _traced(took: list[int], filled: list[int], room: int) -> dict[int, int]:
    """The lengths of the best pattern for ``room``; ``filled``: the largest capacity up to each at which something is taken last."""
    out: dict[int, int] = {}
    while room := filled[room]:
        x = took[room]
        out[x] = out.get(x, 0) + 1
        room -= x
    return out


class Program:
    """The fractional cover of a histogram: how often each pattern is used, the prices at which it is best, and a bound.

    A length's weight is its size, and falls exponentially with the share of
    its items that is covered. Each round prices all patterns at once; of the lengths whose
    best pattern is worth nearly the optimum, each adds that pattern. Prices
    at which no pattern is worth more than 1 bound the number of containers
    from below by the worth of all items; each round's prices, scaled, are
    such, and so are the lengths themselves over the capacity.
    """

    def __init__(self, counts: dict[int, int], capacity: int, rounds: int = ROUNDS, sharpness: float = SHARPNESS):
        lengths = np.array(sorted(counts), np.int64)
        n = np.array([counts[int(x)] for x in lengths], float)
        where = {int(x): i for i, x in enumerate(lengths)}
        covered = np.zeros(len(lengths))
        used: dict[tuple, float] = {}
        prices, bound = lengths / capacity, float((lengths * n).sum()) / capacity
        eta = np.log(len(lengths) + 1) * sharpness
        for _ in range(rounds):
            y = lengths * np.exp(-eta * (covered - covered.min()))
            best, took = price_patterns(y, lengths, capacity)
            if (worth := float((y * n).sum() / best[capacity])) > bound:
                prices, bound = y / best[capacity], worth
            forced = y + best[capacity - lengths]
            near = np.flatnonzero(forced >= (1 - NEAR) * best[capacity])
            steps, filled = took.tolist(), np.maximum.accumulate(np.where(took > 0, np.arange(capacity + 1), 0)).tolist()
            chosen: set[tuple] = set()
            for i in near[np.argsort(covered[near], kind="stable")][:WIDTH]:
                p = _traced(steps, filled, capacity - int(lengths[i]))
                p[int(lengths[i])] = p.get(int(lengths[i]), 0) + 1
                chosen.add(tuple(sorted(p.items())))
            # together the patterns of a round cover no length by more than a step
            load = np.zeros(len(lengths))
            for key in chosen:
                for length, k in key:
                    load[where[length]] += k
            share = n / np.maximum(load, 1)
            for key in chosen:
                x = min(share[where[length]] for length, _ in key) * STEP
                used[key] = used.get(key, 0.0) + x
                for length, k in key:
                    i = where[length]
                    covered[i] += x * k / n[i]
        # as much volume as there is: where a length is covered more than once, rounding trims it
        volume = sum(x * sum(length * k for length, k in key) for key, x in used.items())
        scale = float((lengths * n).sum()) / volume
        self.cover = {key: x * scale for key, x in used.items()}
        self.prices = dict(zip(lengths.tolist(), prices.tolist(), strict=True))
        self.bound = int(np.ceil(bound * (1 - 1e-9)))

    def worth(self, key: tuple) -> float:
        """What a pattern is worth at the final prices, at which the best one is worth at most 1."""
        return sum(self.prices[length] * k for length, k in key)


def largest_fit(left: dict[int, int], capacity: int) -> list[Pattern]:
    """Packs what is left: the largest length first, then always the largest that still fits; equal containers at once."""
    below = np.arange(capacity + 1)  # the largest length with items that is at most this one (0: none), kept by path compression
    n = np.zeros(capacity + 1, np.int64)
    for x, k in left.items():
        n[x] = k

    def find(c: int) -> int:
        root = c
        while root and n[root] == 0:
            root = below[root - 1] if below[root] == root else below[root]
        while c and c != root:
            c, below[c] = (below[c - 1] if below[c] == c else below[c]), root
        return int(root)

    out: list[Pattern] = []
    while top := find(capacity):
        p: dict[int, int] = {}
        room, x = capacity, top
        while x:
            k = min(room // x, int(n[x]))
            p[x] = k
            room -= k * x
            x = find(min(room, x - 1)) if room else 0
        times = min(int(n[x]) // k for x, k in p.items())
        for x, k in p.items():
            n[x] -= k * times
        out.append((times, p))
    return out


class Plan(list[Pattern]):
    """Patterns with the number of containers of each; together they hold exactly the items of the histogram.

    The first ``n_program`` patterns come from the programs, the others from the last step. ``bound``: no packing has fewer containers.
    """

    n_program = 0
    bound = 0

    @property
    def containers(self) -> int:
        return sum(times for times, _ in self)

    @property
    def program_share(self) -> float:
        """The share of the items that stand in patterns of the programs."""
        held = [times * sum(p.values()) for times, p in self]
        return sum(held[: self.n_program]) / max(1, sum(held))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The containers of a histogram (length: number of items)."""
    left = {x: k for x, k in counts.items() if k > 0}
    out = Plan()
    if not left:
        return out
    if min(left) < 1 or max(left) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    program = None
    for slack in SLACK:
        program = program or Program(left, capacity)
        out.bound = out.bound or program.bound
        if whole := _rounded(left, program, slack):
            out += whole
            left, program = {x: k for x, k in left.items() if k}, None
        if not left:
            break
    out.n_program = len(out)
    out += largest_fit(left, capacity)
    log.info("%d containers, at least %d are needed; %.3f of the items by the program", out.containers, out.bound, out.program_share)
    return out


def _rounded(left: dict[int, int], program: Program, slack: float) -> list[Pattern]:
    """Whole containers of the program's patterns that are worth nearly the best, as often as it uses them and their items last; takes them from ``left``."""
    out: list[Pattern] = []
    good = [(w, x, key) for key, x in program.cover.items() if (w := program.worth(key)) >= 1 - slack]
    for _, x, key in sorted(good, key=lambda g: (-g[1], -g[0], g[2])):
        times = min(max(1, int(x)), *(left[length] // k for length, k in key))
        if times:
            for length, k in key:
                left[length] -= k * times
            out.append((times, dict(key)))
    return out


def slots(patterns: list[Pattern]) -> tuple[list[tuple], list[tuple]]:
    """Where the items of each length go by rank: ((length, width), ...) and ((length, block, first rank, end rank, items a container, first container), ...).

    A length's ranks are cut into blocks of ``width`` ranks, about as many as
    it has slots, and a slot is listed under each block that it meets, so that
    an item finds its slot among the few of its block.
    """
    rank: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    container = 0
    for times, p in patterns:
        for length, k in p.items():
            a = rank.get(length, 0)
            rank[length] = a + times * k
            runs.setdefault(length, []).append((a, rank[length], k, container))
        container += times
    widths = {length: -(-rank[length] // len(r)) for length, r in runs.items()}
    placed = [
        (length, block, a, b, k, start)
        for length, r in runs.items()
        for a, b, k, start in r
        for block in range(a // widths[length], (b - 1) // widths[length] + 1)
    ]
    return sorted(widths.items()), placed


def pieces_to_fit(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, tokens) of (key, n_tokens): an item within the capacity is one piece; a larger one full pieces and a rest."""
    n = F.coalesce("n_tokens", F.lit(0))
    last = F.greatest(F.lit(0), F.floor((n - 1) / capacity)).cast("int")
    return sizes.select("key", n.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "key", "piece", F.least(F.col("_n") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("tokens")
    )


def fill_containers(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, tokens, container): every item of (key, n_tokens) with its container.

    Items above the capacity are split, others never; items of size 0 (null
    and empty texts) take no space and have a null container. Rows with an
    equal key are items of their own. ``sizes`` is written once, as it is
    read for the histogram and again for the assignment. A frequent length is
    ranked in as many sorts as it has RANKED items.
    """
    spark = sizes.sparkSession
    items = stored(pieces_to_fit(sizes, capacity), "packing-items")
    # at most ``capacity`` rows
    counts = {r["tokens"]: r["n"] for r in items.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    widths, placed = slots(plan(counts, capacity))
    by_length = spark.createDataFrame(
        [(length, width, -(-counts[length] // RANKED)) for length, width in widths], "tokens bigint, width bigint, salts bigint"
    )
    # at most ``capacity`` rows, and twice as many as patterns have lengths: both bounded by the program's parameters
    by_length = small(by_length, capacity)
    to = small(spark.createDataFrame(placed, "tokens bigint, block bigint, lo bigint, hi bigint, per bigint, start bigint"), LISTED)
    some = items.where("tokens > 0").join(by_length, "tokens").withColumn("_salt", F.pmod(F.xxhash64("key", "piece"), F.col("salts")))
    base = (
        some.groupBy("tokens", "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_base", F.sum("_n").over(Window.partitionBy("tokens").orderBy("_salt")) - F.col("_n"))
        .drop("_n")
    )
    in_salt = F.row_number().over(Window.partitionBy("tokens", "_salt").orderBy("key", "piece")) - 1
    ranked = some.withColumn("_r", in_salt).join(base, ["tokens", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_r")).withColumn("block", F.floor(F.col("_rank") / F.col("width")))
    full = ranked.select("key", "piece", "tokens", "_rank", "block").join(to, ["tokens", "block"])
    return (
        full.where((F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
        .select("key", "piece", "tokens", (F.col("start") + F.floor((F.col("_rank") - F.col("lo")) / F.col("per"))).cast("bigint").alias("container"))
        .unionByName(items.where("tokens = 0").withColumn("container", F.lit(None).cast("bigint")))
    )
