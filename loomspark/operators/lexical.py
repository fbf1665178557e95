"""A lexical index as a table of postings, and searches over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import tokens
from loomspark.operators.bloom import blocks_for, bloom_table, with_maybe

#: Weights of the parts of a record: title, labels and path, text (fixed values).
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def postings(df: DataFrame, key: str, parts: dict[str, tuple[str, object]]) -> DataFrame:
    """(key, term, part, n): how often a term stands in each weighted part; parts: label -> (weight class, column of terms)."""
    out = None
    for weight, terms in parts.values():
        p = df.select(key, F.lit(weight).alias("part"), F.explode(terms).alias("term"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy(key, "term", "part").agg(F.count("*").alias("n"))


def weighted_terms(df: DataFrame, key: str, parts: list[tuple[str, object]]) -> DataFrame:
    """(key, pos, term, weight) of the parts (weight class, array of terms) one after the other; positions run through."""
    weighed = lambda terms, w: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    every = F.concat(*(weighed(terms, WEIGHTS[weight]) for weight, terms in parts))
    return df.select(F.col(key).alias("key"), F.posexplode(every).alias("pos", "t")).select("key", "pos", "t.term", "t.weight")


def match_all(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, key): the records of ``index`` (key, terms) that hold all terms of a query of ``queries`` (query, terms).

    A Bloom filter of the queries' terms leaves only their postings. Each
    query looks up its rarest term alone and tests the others within the
    record, so a frequent term costs nothing. Queries without terms match
    nothing.
    """
    wanted = queries.select("query", F.explode("terms").alias("term"))
    blocks = blocks_for(wanted.count())
    every = index.select("key", F.explode("terms").alias("term"))
    posts = with_maybe(every, "term", bloom_table(wanted.select("term"), "term", blocks), blocks).where("_maybe").select("key", "term")
    frequency = posts.groupBy("term").agg(F.count("*").alias("df"))
    rarest = (
        wanted.join(frequency, "term", "left")
        .groupBy("query")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("r"))
        .where("r.df > 0")
        .select("query", F.col("r.term").alias("term"))
    )
    hits = rarest.join(posts, "term").select("query", "key")
    held = posts.groupBy("key").agg(F.collect_set("term").alias("held"))
    return (
        hits.join(queries.select("query", F.col("terms").alias("_q")), "query")
        .join(held, "key")
        .where(F.size(F.array_except("_q", "held")) == 0)
        .select("query", "key")
    )


def cover_rank(matches: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, key, score): matches scored by the density of the covers of all query terms.

    ``terms`` (key, pos, term, weight). A cover is a stretch from a term to
    another that holds all terms of the query and no shorter cover. It counts
    as the number of hits in it over the sum of their inverse weights, divided
    by 1 + the number of other words in it; a record's score is the sum over
    its covers. The hits of one record are folded once in order; the state is
    the latest hit of each term.
    """
    want = queries.select("query", F.posexplode("terms").alias("i", "term"), F.size("terms").alias("n"))
    hits = matches.join(want, "query").join(terms, ["key", "term"])
    listed = hits.groupBy("query", "key", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "i", (1 / F.col("weight")).alias("inv")))).alias("hits"))
    never = F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("at"), F.lit(0.0).alias("before"))
    start = F.struct(
        F.array_repeat(never, F.col("n")).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).alias("score"), F.lit(0).alias("at"), F.lit(0.0).alias("inv")
    )

    def step(acc, x):
        here = F.struct(x["pos"].alias("pos"), (acc["at"] + 1).alias("at"), acc["inv"].alias("before"))
        moved = F.transform(acc["last"], lambda old, i: F.when(i == x["i"], here).otherwise(old))

        def scored(last, first):
            n, inv = acc["at"] + 1 - first["at"] + 1, acc["inv"] + x["inv"] - first["before"]
            cover = F.try_divide(n / inv, 1 + (x["pos"] - first["pos"]) - (n - 1))
            new = first["pos"] > acc["begun"]
            return F.struct(
                last.alias("last"), F.greatest(first["pos"], acc["begun"]).alias("begun"), (acc["score"] + F.when(new, cover).otherwise(0.0)).alias("score"),
                (acc["at"] + 1).alias("at"), (acc["inv"] + x["inv"]).alias("inv"),
            )

        # a one-element array gives its element a name, so that it is computed once
        return F.transform(F.transform(F.array(moved), lambda m: F.struct(m.alias("m"), F.array_min(m).alias("f"))), lambda y: scored(y["m"], y["f"]))[0]

    return listed.select("query", "key", F.aggregate("hits", start, step, lambda a: a["score"]).alias("score"))
