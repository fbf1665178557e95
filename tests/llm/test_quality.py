"""Merged statistics against those of the whole text, and clear cases of prose and junk."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import quality as Q

COMMON = frozenset("the a of to and is in that it what when should you not before so за и не на что в с".split())
V = Q.Vocabulary(COMMON)
PIECES = st.lists(st.sampled_from(["the ", "Word", ". ", "\n", "\n\n", "\r\n", " ", "-", "1.", "12.5", "!", "…”", " ", "не ", "| ", "#" * 9, "x" * 60, "\x00"]), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 9), st.randoms())
def test_merging_is_associative(parts, size, rng):
    text = "".join(parts)
    cut = [text[i : i + size] for i in range(0, len(text), size)]
    chunks = Q.Chunks(cut, V)
    states = [chunks.state(i) for i in range(len(cut))]
    while len(states) > 1:
        i = rng.randrange(len(states) - 1)
        a = Q.State.loads(states[i].dumps())
        states[i : i + 2] = [a.merged(states[i + 1], COMMON)]
    # a line break of two characters that is cut in two counts twice, as it may not know its other half
    if "\r\n" not in text and text.split():
        whole = Q.Chunks(["", "a b.", text, "x"], V)
        got = Q.State.totals(states, COMMON)[0].tolist()
        assert got == Q.State.totals([whole.state(2)], COMMON)[0].tolist() == whole.totals(Q.np.array([2]))[0].tolist() == plain(text)


def plain(text):
    """The totals, token by token."""
    total, sentence = [0] * (len(Q.FIGURES) + 1), Q.np.zeros(len(Q.FIGURES), int)
    lines = text.replace("\x00", "�").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    words = [(i, w) for i, line in enumerate(lines) for w in line.split()]
    for k, (i, w) in enumerate(words):
        after = words[k + 1][0] - i if k + 1 < len(words) else 2
        figures = Q.Token.of(w).figures(COMMON)
        row = figures[:-2].copy()
        row[-2:] = (after > 0, after > 0 and figures[-1])
        sentence = sentence + row
        if figures[-2] or after > 1:
            prose = int(sentence[0]) if Q.prose_mask(sentence[None])[0] else 0
            total = [a + int(b) for a, b in zip(total, [*sentence, prose], strict=True)]
            sentence = sentence * 0
    return total


PROSE = "What should you do when the system is not in the list? The owner of it should not wait before that, so you and the team can start.\n"
JUNK = [
    "| a | b |\n| --- | --- |\n" + "| 1 | 2024-01-02 |\n" * 20, "- red apple, Bob\n- green pear, Eve\n" * 20, "quarterly owner centre note report engineer. " * 20,
    "Hqzk wvtr lkqukcn xxgrdf leegtfc. " * 20, "#$%^ &*() 12 34 5.6 " * 30, "12 34 56.7\t89%\n" * 30, "for (int i = 0; i < n; i++) { x[i] += f(3); }\n" * 20,
]


@pytest.mark.parametrize("chunk", [13, 100, 8192])
def test_operator(spark, chunk):
    texts = [PROSE * 8, (PROSE * 8).upper(), PROSE.replace(" ", "\n") * 8, *JUNK, None, "", " ​\n", "word", PROSE * 3 + JUNK[0] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df = df.selectExpr("*", "'clash' AS key", "1 AS n", "'s' AS state")
    got = {r["doc_id"]: r for r in Q.quality(df, "doc_id", "text", sorted(COMMON), chunk=chunk, fan=3).collect()}
    assert set(got) == set(range(len(texts))) - {10, 11, 12}
    assert all(got[i]["is_prose"] for i in range(3)) and not any(got[i]["is_prose"] for i in range(3, 10))
    assert got[13]["n_words"] == 1 and not got[13]["is_prose"]
    assert got[0]["n_words"] == len(texts[0].split()) and got[0]["n_chars"] == len("".join(texts[0].split()))
    assert got[0]["punctuated_line_share"] == 1.0


def test_very_long_text_in_many_chunks(spark):
    rng = random.Random(1)
    text = "".join(rng.choices("ab .\n", weights=[9, 9, 4, 1, 1], k=300_000)) + "x" * 50_000
    df = spark.createDataFrame([(1, text)], "k int, t string")
    small = Q.text_totals(df, "k", "t", ["a"], chunk=997, fan=8).first()
    large = Q.text_totals(df, "k", "t", ["a"], chunk=1 << 20).first()
    assert small == large
    assert Q.text_totals(df.limit(0), "k", "t", ["a"]).count() == 0


def test_line_breaks_do_not_change_sides():
    common = frozenset("и в на с до за не должен".split())
    prose = "Каждый дежурный инженер должен подписать внутренний журнал инцидентов после собрания местной группы. "
    listed = "журнал доступа, Доре\nлимит хранилища, Зуко\nдоговор с поставщиком, Бадо\nкалендарь релизов, Вара\n" * 6
    for text, is_prose in ((prose * 5, True), (listed, False)):
        for gap in (" ", "\n"):
            figures = Q.Chunks([gap.join(text.split())], Q.Vocabulary(common)).totals(Q.np.array([0]))[0]
            assert (figures[-1] >= 0.5 * figures[0]) == is_prose, (text, gap)
