"""Reassembled conversations against a plain version, with short fragments."""

import random

import pytest

from loomspark.llm import conversations as C

TURNS = "turn_id string, conversation_id string, turn_index int, role string, text string, conv string, h bigint"
ALIASES = [("user", "user"), ("human", "user"), ("bot", "assistant"), ("assistant", "assistant"), ("sys", "system")]


def blank(x):
    return x is None or not x.strip(" \t\n\r\x1c  ​﻿")


def broken(turns):
    """The rule as the problem states it, over (index, role label, text)."""
    role = dict(ALIASES)
    seen = {}
    for i, label, text in turns:
        r = role.get((label or "").strip().lower())
        if i is None or r is None:
            return True
        seen.setdefault(i, set()).add((r, None if blank(text) else text.strip()))
    if any(len(s) > 1 for s in seen.values()) or sorted(seen) != list(range(1, len(seen) + 1)):
        return True
    said = [next(iter(seen[i])) for i in sorted(seen)]
    said = [x for x in said if x[0] != "system"]
    return not said or len(said) % 2 == 1 or any(t is None or r != ("assistant" if k % 2 else "user") for k, (r, t) in enumerate(said))


def made(rng, n):
    turns, same = [], rng.random() < 0.3
    if rng.random() < 0.3:
        turns.append(("sys", "be brief"))
    for k in range(n):
        again = k % 2 if same else k  # a conversation that repeats itself makes matches of hashes ambiguous
        turns.append((rng.choice(["user", " Human"]), f"q{again}"))
        if rng.random() < 0.1:
            turns.append(("sys", "note"))
        turns.append((rng.choice(["bot", "ASSISTANT"]), f"a{again} "))
    rows = [(i + 1, r, t) for i, (r, t) in enumerate(turns)]
    for _ in range(rng.choice([0, 0, 1])):
        k = rng.randrange(len(rows))
        i, r, t = rows[k]
        what = rng.randrange(7)
        if what == 0:
            rows.pop(k)
        elif what == 1:
            rows.append((i, r, "other"))
        elif what == 2:
            rows[k] = (i, "ghost", t)
        elif what == 3:
            rows[k] = (None, r, t)
        elif what == 4:
            rows[k] = (i, r, rng.choice([None, " ​"]))
        elif what == 5:
            rows.append((i, r, f" {t} "))
        else:
            rows[k] = (i, "user", t)
    rows += [rng.choice(rows) for _ in range(2)] if rows else []
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("span", "overlap"), [(2, 2), (3, 1), (4, 2), (256, 2)])
def test_against_plain_version(spark, span, overlap):
    rng = random.Random(5)
    convs = {f"{k:04x}": made(rng, rng.randrange(1, 9)) for k in range(150)}
    rows = [(f"t{n}", c.upper() if n % 2 else "{" + c + "}", i, r, t, "clash", 1) for n, (c, ts) in enumerate(convs.items()) for i, r, t in ts]
    rows += [("x", None, 1, "user", "q", "c", 1), ("x", "ffff", 1, "user", "q", "c", 1), (None, " ", None, None, None, None, None)]
    turns = spark.createDataFrame(rows, TURNS)
    known = spark.createDataFrame([(c,) for c in [*convs, *list(convs)[:9], "eeee", None]], "conversation_id string")
    aliases = spark.createDataFrame(ALIASES, "label string, role_name string")
    want = {c for c, ts in convs.items() if broken(ts)} | {"eeee"}
    assert 20 < len(want) < 130
    assert sorted(r[0] for r in C.broken_conversations(known, turns, aliases, span, overlap).collect()) == sorted(want)
    whole = C.sound_conversations(known, turns, aliases, span, overlap).collect()
    assert {r["conversation_id"] for r in whole} == set(convs) - want
    for c in list(set(convs) - want)[:10]:
        mine = sorted((r["turn_index"], r["role"], r["exchange"]) for r in whole if r["conversation_id"] == c)
        asked = 0
        for i, (index, role, exchange) in enumerate(mine):
            asked += role == "user"
            assert (index, exchange) == (i + 1, asked)


def test_long_conversations_and_empty_tables(spark):
    n = 600
    gone = {"aa": 0, "bb": 1, "cc": 64, "dd": 65, "ee": 66, "ff": n}  # the index that is missing; "ff" then ends with the user
    rows = [("t", c, i + 1, "bot" if i % 2 else "user", f"x{i}", "c", 0) for c, k in gone.items() for i in range(n) if i + 1 != k]
    turns, aliases = spark.createDataFrame(rows, TURNS), spark.createDataFrame(ALIASES, "label string, role_name string")
    known = spark.createDataFrame([(c.upper(),) for c in gone], "conversation_id string")
    assert sorted(r[0] for r in C.broken_conversations(known, turns, aliases, 4).collect()) == sorted(set(gone) - {"aa"})
    assert C.sound_conversations(known, turns, aliases, 64).count() == n
    assert C.broken_conversations(known.limit(0), turns, aliases, 64).count() == 0
    assert C.broken_conversations(known, turns.limit(0), aliases).count() == len(gone)
    assert C.sound_conversations(known, turns.limit(0), aliases).count() == 0


def test_the_graph_decides(spark, monkeypatch):
    """Without its edges no conversation of several fragments is whole; gaps and ambiguity show in the paths."""
    rows = [("t", c, i + 1, "bot" if i % 2 else "user", t, "c", 0) for c, ts in {"aa": "abcdefgh", "bb": "abababab", "cc": "xy"}.items() for i, t in enumerate(ts)]
    turns, aliases = spark.createDataFrame(rows, TURNS), spark.createDataFrame(ALIASES, "label string, role_name string")
    known = spark.createDataFrame([("aa",), ("bb",), ("cc",)], "conversation_id string")
    s = C.slots(C.messages(turns, aliases))
    frags = C.fragments(s)
    assert sorted((r["conv"], r["before"], r["frag"]) for r in C.overlaps(frags).collect()) == [(c, i, i + 1) for c in ("aa", "bb") for i in (0, 1)]
    # of "bb", whose hashes all agree, the indexes tell the ends apart
    assert frags.where("conv = 'bb'").select("prefix").distinct().count() == 2
    gap = C.fragments(s.where("idx <> 4"))
    assert C.overlaps(gap).where("conv = 'aa'").count() == 0 or C.along_paths(gap, C.overlaps(gap), ("n_own",)).where("conv = 'aa'").select("start").distinct().count() > 1
    placed = C.along_paths(frags, C.overlaps(frags), ("n_own",)).where("conv = 'aa'")
    assert sorted((r["frag"], r["start"], r["before_n_own"]) for r in placed.collect()) == [(0, 0, 0), (1, 0, 4), (2, 0, 6)]
    assert C.broken_conversations(known, turns, aliases).count() == 0
    edges = C.overlaps
    monkeypatch.setattr(C, "overlaps", lambda frags: edges(frags).limit(0))
    assert sorted(r[0] for r in C.broken_conversations(known, turns, aliases).collect()) == ["aa", "bb"]
