"""Checks of answers against what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.config import DEFAULTS, Config
from loomspark.functions.text import sentences, tokens


def grounded(citations: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``grounded``: whether the citation's keys are among the allowed ones; both sides are compared as they are."""
    ok = allowed.select(*keys).distinct().withColumn("_ok", F.lit(True))
    return citations.join(ok, keys, "left").withColumn("grounded", F.coalesce("_ok", F.lit(False))).drop("_ok")


def sentence_support(answers: DataFrame, used: DataFrame, texts: DataFrame, config: Config = DEFAULTS) -> DataFrame:
    """(answer, n_sentences, n_supported) of ``answers`` (answer, text) by the ``texts`` (source, text) that they ``used`` (answer, source).

    A sentence is supported if, for any of its answer's texts, the share of
    its distinct terms that occur there reaches the lexical bound, or the
    square root of that share of all its terms the semantic one. Answers
    without sentences have zero of both. Pairs of ``used`` and sources must
    be unique. Terms are counted once a sentence and once a text and meet in
    a join, so the cost is linear in the texts.
    """
    s = answers.select("answer", F.posexplode_outer(sentences("text")).alias("i", "s")).select("answer", "i", tokens("s").alias("st"))
    said = s.select("answer", "i", F.explode("st").alias("term")).groupBy("answer", "i", "term").agg(F.count("*").alias("n"))
    known = texts.select("source", F.explode(F.array_distinct(tokens("text"))).alias("term"))
    met = said.join(used, "answer").join(known, ["source", "term"]).groupBy("answer", "i", "source").agg(F.count("*").alias("_distinct"), F.sum("n").alias("_all"))
    best = met.groupBy("answer", "i").agg(F.max("_distinct").alias("_distinct"), F.max("_all").alias("_all"))
    lexical = F.coalesce("_distinct", F.lit(0)) / F.greatest(F.lit(1), F.size(F.array_distinct("st")))
    semantic = F.sqrt(F.coalesce("_all", F.lit(0)) / F.greatest(F.lit(1), F.size("st")))
    holds = (lexical >= config.lexical_support) | (F.round(semantic, 9) >= config.sentence_similarity)
    return s.join(best, ["answer", "i"], "left").groupBy("answer").agg(
        F.count("i").alias("n_sentences"), F.count_if(holds & F.col("i").isNotNull()).alias("n_supported")
    )
