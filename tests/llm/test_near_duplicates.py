"""Signature trees against all pairs."""

import random
from fractions import Fraction
from itertools import combinations

import pytest
import regex

from loomspark.llm import near_duplicates as D

SMALL = (D.Kind("chunks", 3, False, 25, Fraction(3, 5)), D.Kind("documents", 3, True, 30, Fraction(13, 20), 128))


def shingles(text, kind):
    w = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    if kind.characters:
        s = " ".join(w)
        return {s[i : i + 3] for i in range(len(s) - 2)} if len(s) >= kind.least else None
    return set(zip(w, w[1:], w[2:], strict=False)) if len(w) >= kind.least else None


def truth(records):
    out = set()
    for k, kind in enumerate(SMALL):
        sets = [(key, s) for kk, key, text in records if kk == k and text is not None and key is not None and (s := shingles(text, kind)) is not None]
        for (a, x), (b, y) in combinations(sets, 2):
            if a != b and Fraction(len(x & y), len(x | y)) >= kind.threshold:
                out.add((kind.name, *sorted((a, b))))
    return out


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)] + ["naïve", "ёлка", "東京"]
    records = []
    for i in range(n):
        if records and rng.random() < 0.6:
            t = list(rng.choice(records)[2].split(" "))
            for _ in range(rng.randrange(0, max(2, len(t) // 6))):
                p = rng.randrange(len(t))
                t[p : p + rng.randrange(0, 3)] = rng.choices(words, k=rng.randrange(0, 2))
        else:
            size = rng.choice([20, 26, 30, 60, 120, 300, 1200])
            t = rng.choices(words, k=size)
        records.append((0, f"k{i}", " ".join(t)))
    titles = ["Guide to the storage quota of Bravo", "Handbook Storage Quota, edition Bravo Alpha", "Regional cost centre, Madrid and Lisbon"]
    for i in range(n):
        t = list(rng.choice(titles))
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = rng.choice("abcdxyz ")
        records.append((1, f"d{i}", "".join(t)))
    return records


def frame(spark, records):
    return spark.createDataFrame(records, "kind int, key string, text string")


@pytest.mark.parametrize("cell", [7, 60_000])
def test_against_all_pairs(spark, cell):
    rng = random.Random(cell)
    records = corpus(rng, 160)
    records += records[:20] + [(0, f"copy{i}", records[0][2]) for i in range(40)]
    found = D.near_duplicates(frame(spark, records), SMALL, cell=cell, task=5000)
    got = {tuple(r) for r in D.key_pairs(found, SMALL).collect()}
    want = truth(records)
    assert len(want) > 200 and got == want
    groups = D.groups(found, SMALL).collect()
    by = {}
    for r in groups:
        by.setdefault((r["record_table"], r["record_key"]), r["group_id"])
    assert all(by[t, a] == by[t, b] for t, a, b in want)
    parent = {k: k for k in by}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for t, a, b in want:
        parent[root((t, a))] = root((t, b))
    assert len({root(k) for k in by}) == len(set(by.values()))


def test_empty_null_short(spark):
    chunks = spark.createDataFrame([(None, "x " * 40), ("aa", None), ("bb", ""), ("cc", "short"), ("dd", "​ ")], "chunk_id string, chunk_text string")
    docs = spark.createDataFrame([("ee", None), ("ff", "tiny")], "document_id string, title string")
    found = D.near_duplicates(D.records_of(chunks, docs))
    assert found.members.count() == 0 and found.links.count() == 0
    assert D.key_pairs(found).count() == 0 and D.groups(found).count() == 0


def test_repeated_words_and_long_texts(spark):
    # one distinct shingle only; and a text far above the bitmaps' size
    long = " ".join(f"t{i}" for i in range(6000))
    records = [(0, "a", "x " * 30), (0, "b", "X, " * 50), (0, "c", long), (0, "d", long + " more words here"), (0, "e", long[: len(long) // 3])]
    got = {tuple(r) for r in D.key_pairs(D.near_duplicates(frame(spark, records), SMALL), SMALL).collect()}
    assert got == {("chunks", "a", "b"), ("chunks", "c", "d")}


def test_postings_do_not_grow_with_the_corpus(spark, monkeypatch):
    """However many records share the buckets, only a shingle that is frequent itself is cut into cells."""
    monkeypatch.setattr(D, "BUCKETS", 16)
    for n in (60, 240):
        own = [(0, f"k{i}", " ".join(f"w{i}x{j}" for j in range(30))) for i in range(n)]
        sets = D.shingled(frame(spark, own), SMALL, full=False)
        counts = D.shingle_counts(sets, 2)
        assert counts.max() > 20 and D.frequent_shingles(sets, counts, 20) is None
        posts = D.in_cells(D.postings(sets, SMALL, counts), None, 20)
        assert posts.count() == n * (28 - 17 + 1)
    shared = own + [(0, f"s{i}", "the same standard paragraph of all " + " ".join(f"v{i}x{j}" for j in range(24))) for i in range(50)]
    sets = D.shingled(frame(spark, shared), SMALL, full=False)
    counts = D.shingle_counts(sets, 2)
    frequent = D.frequent_shingles(sets, counts, 20)
    assert sorted(r["n"] for r in frequent.collect()) == [50] * 4
    # frequent shingles come last in the order, so none of them is needed
    assert D.in_cells(D.postings(sets, SMALL, counts, frequent), frequent, 20).where("side <> 2").count() == 0


def test_shingles_that_fall_together_lose_no_pair(spark, monkeypatch):
    """With hashes of which only a few bits differ, sizes and bounds still hold."""
    whole = D.Shingler.of

    def cut(self, text, kind):
        s = whole(self, text, kind)
        return None if s is None else D.np.unique((s & D.np.uint64(0xFFFFFFFF)) | ((s >> D.np.uint64(58)) << D.np.uint64(32)))

    records = corpus(random.Random(9), 60)
    monkeypatch.setattr(D.Shingler, "of", cut)
    kinds = {0: SMALL[0], 1: SMALL[1]}
    mine = [(k, key, set(x.tolist())) for k, key, t in records if (x := cut(D.Shingler(), t, kinds[k])) is not None]
    want = {
        (kinds[k].name, *sorted((a, b))) for (k, a, x), (m, b, y) in combinations(mine, 2)
        if k == m and a != b and Fraction(len(x & y), len(x | y)) >= kinds[k].threshold
    }
    pairs, members = candidates_of(spark, records)
    assert len(want) > 20 and all(tuple(sorted((a, b))) in pairs or members[a] == members[b] for _, a, b in want)


def candidates_of(spark, records):
    """Candidate pairs as keys, computed in this process, where the patched hashes hold."""
    np = D.np
    shingler, rows = D.Shingler(), []
    for k, key, t in records:
        s = shingler.of(t, SMALL[k])
        if s is not None:
            rows.append((k, key, D.xxhash.xxh3_128_digest(s.tobytes()), (s >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()))
    sets = spark.createDataFrame(rows, "kind int, key string, cls binary, toks array<int>")
    counts = D.shingle_counts(sets, 2)
    members = {r[1]: r[2] for r in rows}
    keys = {}
    for k, c in members.items():
        keys.setdefault(bytes(c), []).append(k)
    got = D.candidate_pairs(D.in_cells(D.postings(sets, SMALL, counts), None), SMALL, 2).collect()
    return {tuple(sorted((a, b))) for r in got for a in keys[bytes(r["a"])] for b in keys[bytes(r["b"])]}, members
