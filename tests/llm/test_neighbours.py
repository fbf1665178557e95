"""Learned partitions against brute force."""

import datetime as dt
import threading
import time
from pathlib import Path

import numpy as np
import pytest

from loomspark.llm import neighbours as N
from loomspark.session import scratch, stored

SCHEMA = "chunk_id string, updated_at timestamp, embedding array<float>, key string, vec int"


def day(n):
    return dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=n)


def rows_of(x):
    return [(f"{i:08x}", day(0), [float(v) for v in r], "clash", 1) for i, r in enumerate(x)]


def test_usable_vectors(spark):
    ok = [1.0] * 64
    rows = [
        ("{AA}", day(1), ok, "x", 1), ("aa", day(2), [2.0] * 64, "x", 1),  # the newer one counts
        ("bb", day(1), ok, "x", 1), ("bb", day(2), None, "x", 1),  # newest is null: no vector
        ("cc", None, ok, "x", 1), ("dd", day(1), [0.0] * 64, "x", 1), ("ee", day(1), [float("nan")] + ok[1:], "x", 1),
        ("ff", day(1), ok[:50], "x", 1), ("01", day(1), [float("inf")] + ok[1:], "x", 1), (None, day(1), ok, "x", 1), (" ", day(1), ok, "x", 1),
        ("02", day(1), [None] + ok[1:], "x", 1), ("03", day(1), [], "x", 1),
    ]
    got = {r["key"]: np.frombuffer(r["vec"], "<f4")[0] for r in N.usable_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"aa": 2.0, "cc": 1.0}


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, 64))
    x = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, 64)) * rng.uniform(0.05, 0.7, (n, 1))
    return (x * rng.uniform(0.2, 5, (n, 1))).astype(np.float32)


def exact(x, k):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_one_part_is_exact(spark):
    x = clustered(300)
    got = N.similar_vectors(N.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA)), 5).collect()
    _, top = exact(x, 5)
    assert {(r["query"], r["rank"]): r["key"] for r in got} == {(f"{i:08x}", j + 1): f"{top[i, j]:08x}" for i in range(300) for j in range(5)}


def test_recall_of_learned_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "INDEX_BLOCK", 100)
    monkeypatch.setattr(N, "QUERY_BLOCK", 300)
    x = clustered(2400, 1)
    v = N.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA))
    s, top = exact(x, 5)
    got = {(r["query"], r["key"]) for r in N.similar_vectors(v, 5, probes=4, part_rows=150).collect()}
    want = {(f"{i:08x}", f"{j:08x}") for i in range(len(x)) for j in top[i]}
    assert len(got & want) / len(want) >= 0.9
    pairs = {tuple(r) for r in N.similar_pairs(v, probes=4, part_rows=150).collect()}
    true = {tuple(sorted((f"{i:08x}", f"{j:08x}"))) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.85}
    assert len(true) > 100 and len(pairs & true) / len(true) >= 0.97 and len(pairs - true) <= 0.03 * len(true)


def test_parts_within_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_PARTS", 4)
    x = clustered(2400, 3)
    v = N.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA))
    routing = N.fit_routing(v, len(x), 64, 150)
    assert len(routing.within) == 4 and len(np.unique(routing.top(np.asarray(x, float), 1))) > 12
    s, top = exact(x, 5)
    pairs = {tuple(r) for r in N.similar_pairs(v, probes=8, part_rows=150).collect()}
    true = {tuple(sorted((f"{i:08x}", f"{j:08x}"))) for i in range(len(x)) for j in top[i] if s[i, j] >= 0.85}
    assert len(pairs & true) / len(true) >= 0.97


@pytest.mark.parametrize("most_parts", [512, 8])
def test_recall_does_not_depend_on_the_number_of_parts(spark, monkeypatch, most_parts):
    monkeypatch.setattr(N, "MOST_PARTS", most_parts)
    x = np.random.default_rng(7).standard_normal((3000, 64)).astype(np.float32)  # no clusters
    v = N.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA))
    _, top = exact(x, 5)
    got = {(r["query"], r["key"]) for r in N.similar_vectors(v, 5, part_rows=24).collect()}
    want = {(f"{i:08x}", f"{j:08x}") for i in range(len(x)) for j in top[i]}
    assert len(got & want) / len(want) >= 0.9


def test_true_neighbours(spark):
    x = clustered(700, 8)
    v = N.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA)).repartition(3)
    queries, row, near = N.true_neighbours(v, 64, 5)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    me = (queries @ u.T).argmax(1)
    got = sorted(zip(me[row], (near @ u.T).argmax(1)))
    _, top = exact(x, 5)
    assert got == sorted((i, j) for i in range(700) for j in top[i])


def test_copies_and_small_tables(spark):
    x = np.concatenate([np.ones((40, 64), np.float32), np.eye(64, dtype=np.float32)[:3]])
    v = N.usable_vectors(spark.createDataFrame(rows_of(x) + rows_of(x)[:5], SCHEMA))
    got = N.similar_vectors(v, 5).collect()
    mine = sorted((r["rank"], r["key"]) for r in got if r["query"] == f"{20:08x}")
    assert [k for _, k in mine] == [f"{i:08x}" for i in range(5)]
    assert sorted(r["key"] for r in got if r["query"] == f"{2:08x}") == [f"{i:08x}" for i in (0, 1, 3, 4, 5)]
    empty = N.usable_vectors(spark.createDataFrame([], SCHEMA))
    assert N.similar_vectors(empty, 5).count() == 0 and N.similar_pairs(v.limit(1)).count() == 0


def test_a_third_of_near_copies_and_scaled_copies(spark, monkeypatch):
    monkeypatch.setattr(N, "INDEX_BLOCK", 400)
    rng = np.random.default_rng(6)
    x = clustered(1800, 5)
    x[:600] = x[0] + rng.standard_normal((600, 64)).astype(np.float32) * 1e-3
    x[600:900] = x[600] * rng.uniform(0.1, 9, (300, 1))
    v = N.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA))
    s, top = exact(x, 5)
    got = {}
    for r in N.similar_vectors(v, 5, 0.85, probes=8, part_rows=300).collect():
        got.setdefault(int(r["query"], 16), set()).add(int(r["key"], 16))
    near = [len(got[i] & set(top[i])) for i in range(600)]
    assert np.mean(near) > 4.8
    assert all(got[i] <= set(range(600, 900)) and len(got[i]) == 5 for i in range(600, 900))


@pytest.mark.parametrize("parts", [2, 8])
def test_parts_are_balanced(parts):
    x = clustered(1000, 4)
    _, near = exact(x, 8)
    part = N.balanced_parts(near, parts)
    size = np.bincount(part, minlength=parts)
    assert size.max() - size.min() <= np.log2(parts) + 1
    better = N.refined_parts(near, part, parts)
    size = np.bincount(better, minlength=parts)
    assert size.max() <= 1.6 * len(x) / parts and size.min() >= 0.5 * len(x) / parts
    assert (better[near] == better[:, None]).mean() >= (part[near] == part[:, None]).mean()


def test_few_parts_find_close_neighbours(spark):
    """Neighbours above a similarity need fewer parts than all; either recall is measured."""
    x = clustered(4000, 11)
    v = N.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA))
    routing = N.fit_routing(v, len(x), 64, 150)
    parts = routing.first.w[3].size
    every, recall = N.choose_probes(routing, v, 64, 5)
    close, close_recall = N.choose_probes(routing, v, 64, 5, 0.85)
    print(f"{parts} parts: {every} parts a query, recall {recall:.3f}; at 0.85 or more {close}, recall {close_recall:.3f}")
    assert max(close, every) < parts and recall >= N.RECALL and close_recall >= N.CLOSE_RECALL


def test_waves_cover_every_cell_once(monkeypatch):
    monkeypatch.setattr(N, "INDEX_BLOCK", 100)
    monkeypatch.setattr(N, "QUERY_BLOCK", 300)
    held, asked = {0: 950, 2: 90, 3: 120, 7: 100}, {0: 2000, 2: 400, 3: 310, 5: 60, 7: 100}
    for rows in (10, 700, 1500, 1e9):
        waves = N._waves(held, asked, rows)
        cells = [(p, c) for w in waves for p, _, _, first, last in w for c in range(first, last + 1)]
        want = {(p, c) for p in held for c in range(-(-held[p] // 100) * -(-asked[p] // 300))}
        assert len(cells) == len(want) and set(cells) == want
        for w in waves:
            size = sum((last - first + 1) * (held[p] / ni + asked[p] / nq) for p, ni, nq, first, last in w)
            assert size <= rows or sum(last - first + 1 for _, _, _, first, last in w) == 1


def test_waves_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "INDEX_BLOCK", 100)
    monkeypatch.setattr(N, "QUERY_BLOCK", 300)
    x = clustered(1500, 12)
    x[1400:] = x[:100] * 2  # copies
    v = N.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA))
    ask = lambda least: sorted(N.similar_vectors(v, 5, least, probes=3, part_rows=100).collect())
    one = [ask(-2.0), ask(0.85)]
    monkeypatch.setattr(N, "WAVE_ROWS", 100)
    monkeypatch.setattr(N, "LISTED", 2)
    assert [ask(-2.0), ask(0.85)] == one and len(one[0]) == 5 * len(x)


def test_disk_does_not_hold_a_copy_for_every_part(spark, monkeypatch):
    """Shuffle files and tables stay within four times the vectors, with a vector sent to 16 parts."""
    monkeypatch.setattr(N, "WAVE_ROWS", 1000, raising=False)
    x = np.random.default_rng(13).standard_normal((12000, 64)).astype(np.float32)
    v = stored(N.usable_vectors(spark.createDataFrame(rows_of(x), SCHEMA)), "test-vectors")
    kept = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [kept.localDirsString()[i] for i in range(len(kept.localDirsString()))] + [scratch(spark).removeprefix("file:")]

    def used():
        total = 0
        for folder in folders:
            for f in Path(folder).rglob("*"):
                try:
                    total += f.stat().st_size if f.suffix in (".data", ".parquet") else 0
                except OSError:  # just deleted
                    pass
        return total

    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    start, most, over = used(), 0, threading.Event()

    def watch():
        nonlocal most
        while not over.wait(0.02):
            most = max(most, used() - start)

    watcher = threading.Thread(target=watch)
    watcher.start()
    N.similar_pairs(v, probes=16, part_rows=375).count()
    over.set()
    watcher.join()
    print(f"{most / x.nbytes:.2f} times the vectors")
    assert most <= 4 * x.nbytes
