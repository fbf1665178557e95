"""The splitter: limits, overlaps, boundaries, exact round trips."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import splitting as S


def check(text, limit, overlap):
    ps = S.pieces(text, limit, overlap)
    n = len(text.split())
    if n == 0:
        assert ps == []
        return ps
    # the cores tile the text; with their overlaps taken off, the pieces hold every token once
    assert "".join(text[p["core_start"] : p["core_end"]] for p in ps) == text
    tokens = []
    for k, p in enumerate(ps):
        own = text[p["char_start"] : p["char_end"]].split()
        assert len(own) == p["tokens"] <= limit
        assert p["overlap_tokens"] == (min(overlap, len(tokens)) if k else 0)
        assert own[: p["overlap_tokens"]] == tokens[len(tokens) - p["overlap_tokens"] :]
        tokens += own[p["overlap_tokens"] :]
    assert tokens == text.split()
    return ps


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "c!", "\n", "\n\n", "# h", "- x", "| r |", "```", " ", " ", " ", "\r\n", "d​e", "\x1c"]), max_size=120), st.integers(3, 12))
def test_round_trip(parts, limit):
    check(" ".join(parts), limit, limit // 3)


def test_natural_boundaries():
    text = "# One\n" + "alpha beta. " * 5 + "\n\n" + "gamma delta " * 6 + "\n\n# Two\n" + "x y z.\n" * 4
    assert [p["cut_at"] for p in check(text, 24, 4)] == ["section", "end"]
    ps = check(text, 20, 4)
    assert [p["cut_at"] for p in ps] == ["paragraph", "section", "end"]
    code = "# A\n```\n# not a heading\n" + "c d\n" * 20 + "\n" + "e f\n" * 3
    assert "section" not in {p["cut_at"] for p in check(code, 10, 2)}


def test_no_boundaries_nulls_and_very_long():
    assert S.pieces(None) == [] and S.pieces("") == [] and S.pieces(" \n　") == []
    assert len(check("w " * 100, 900, 80)) == 1
    ps = check("w " * 5000, 900, 80)
    assert [p["tokens"] for p in ps[:-1]] == [900] * (len(ps) - 1)
    check("".join(random.Random(1).choices("ab .\n", k=400_000)), 900, 80)
    cut = S.pieces("x" * 5000, max_chars=1200)
    assert "".join("x" * (p["char_end"] - p["char_start"]) for p in cut) == "x" * 5000 and max(p["char_end"] - p["char_start"] for p in cut) == 1200


def test_operator(spark):
    rows = [("t", "a", "w " * 901), ("t", "a", "w " * 901), ("t", "b", "w " * 900), ("t", None, "v　" * 1000), ("t", "c", None), (None, None, None), ("t", "d", " " * 5000)]
    df = spark.createDataFrame(rows, "record_table string, record_key string, text string")
    got = S.split_oversized(df).collect()
    assert sorted((r["record_key"] or "", r["piece"], r["n_pieces"], r["tokens"]) for r in got) == [("", 0, 2, 900), ("", 1, 2, 180), ("a", 0, 2, 900), ("a", 1, 2, 81)]
    assert S.split_oversized(df.limit(0)).count() == 0
