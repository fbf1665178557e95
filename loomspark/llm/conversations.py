"""Rebuilding conversations from message rows by assembling overlapping fragments.

The rows of an export are read as fragments: short runs of messages (SPAN new
ones and the OVERLAP ones that the next fragment repeats), told apart by where
a message's index falls, so that they are found without gathering a
conversation. A message is known by a hash of its role and text, without its
index; a fragment begins with the hash of its first OVERLAP messages and ends
with that of its last ones. Where a suffix equals a prefix there is an edge
of the overlap graph: if it is the only such suffix and the only such prefix
of the conversation at once; if a conversation repeats itself, the indexes
that the messages of the overlap carry tell the ambiguous matches apart. A
fragment with a hole inside has no ends, one that lies wholly within another
is left out, and a match that leads backwards is none.

Edges form paths, which are merged: every fragment learns, by pointers that
double their reach in each round, how many messages and turns stand before it
on its path. So the path gives the order and each message's place. A
conversation is whole if it is a single path and the places agree with the
indexes that the rows carry; whose turn it is follows from the same sums.

No step gathers a conversation: messages are grouped by (conversation,
index), a fragment holds at most SPAN + OVERLAP messages, and the rounds are
joins on (conversation, fragment), as many as the logarithm of the number of
fragments of the longest path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.keys import hex_key
from loomspark.functions.unicode import is_blank, strip
from loomspark.session import small, stored

#: Messages from the start of a fragment to that of the next (an exchange), and messages that two neighbours share; SPAN >= OVERLAP.
SPAN, OVERLAP = 2, 2


def messages(turns: DataFrame, aliases: DataFrame) -> DataFrame:
    """(conv, idx, role, text, blank, h): the rows with a known spelling of everything.

    ``role`` is null if the label is unknown; all blank texts are equal (null).
    Rows without a conversation key are left out. ``aliases`` is the list
    of role labels; it is reduced to one role for a label and broadcast if
    its size allows.
    """
    roles = (
        aliases.select(F.lower(strip("label")).alias("_label"), "role_name")
        .where(F.col("_label").isNotNull())
        .groupBy("_label")
        .agg(F.min("role_name").alias("role"))
    )
    rows = turns.select(
        hex_key("conversation_id").alias("conv"),
        F.col("turn_index").cast("bigint").alias("idx"),
        F.lower(strip("role")).alias("_label"),
        is_blank("text").alias("blank"),
        F.col("text").alias("_text"),
    ).where(F.col("conv").isNotNull())
    text = F.when(~F.col("blank"), strip("_text"))
    return (
        rows.join(small(roles), "_label", "left")
        .select("conv", "idx", "role", text.alias("text"), "blank", F.col("_label"))
        .withColumn("h", F.xxhash64(F.coalesce("role", "_label"), "text"))
        .drop("_label")
    )


def slots(msgs: DataFrame) -> DataFrame:
    """One row for each (conv, idx): its message hash, whether deliveries disagree, role and blankness.

    A null index is a slot of its own, which breaks its conversation.
    """
    return msgs.groupBy("conv", "idx").agg(
        F.min("h").alias("h"),
        (F.min("h") != F.max("h")).alias("conflict"),
        F.min("role").alias("role"),
        F.bool_or(F.col("role").isNull()).alias("no_role"),
        F.bool_or("blank").alias("blank"),
        F.bool_or(F.col("role").isin("user", "assistant") & ~F.col("blank")).alias("says"),
    )


def owner(idx: Column, span: int, overlap: int) -> Column:
    """The fragment that brings the message: of two that hold it, the earlier one."""
    frag = F.floor((idx - 1) / span).cast("bigint")
    return F.when((F.pmod(idx - 1, F.lit(span)) < overlap) & (idx > span), frag - 1).otherwise(frag)


def fragments(s: DataFrame, span: int = SPAN, overlap: int = OVERLAP) -> DataFrame:
    """(conv, frag, prefix, suffix, first_at, last_at, n_own, ...): the overlapping fragments of the slots that have an index.

    ``prefix``/``suffix`` hash the first and last ``overlap`` messages
    without their indexes, ``first_at``/``last_at`` are the indexes of the
    first of these; they are null where a fragment is too short for an end or
    has a hole. ``n_own``, ``n_turns``, ``n_users`` and the rest describe the
    messages that the fragment brings, those beyond what it repeats.
    """
    frag = F.floor((F.col("idx") - 1) / span).cast("bigint")
    own = owner(F.col("idx"), span, overlap)
    spread = (
        s.where(F.col("idx").isNotNull())
        .withColumn("frag", F.explode(F.when(own < frag, F.array(frag - 1, frag)).otherwise(F.array(frag))))
        .withColumn("own", F.col("frag") == own)
    )
    own_turn = F.when(F.col("own") & F.col("role").isin("user", "assistant"), F.struct("idx", (F.col("role") == "user").alias("user")))
    g = spread.groupBy("conv", "frag").agg(
        F.array_sort(F.collect_list(F.struct("idx", "h"))).alias("m"),  # at most span + overlap
        F.count_if("own").alias("n_own"),
        F.min(F.when(F.col("own"), F.col("idx"))).alias("own_at"),
        F.bool_or("conflict").alias("conflict"),
        F.bool_or("no_role").alias("no_role"),
        F.bool_or(F.col("blank") & F.col("role").isin("user", "assistant")).alias("blank"),
        F.bool_or("says").alias("says"),
        F.array_sort(F.collect_list(own_turn)).alias("turns"),
    ).where("n_own > 0")  # else every message of it stands in the fragment before
    n = F.size("m")
    whole = F.element_at("m", -1)["idx"] - F.col("m")[0]["idx"] + 1 == n
    has_end = whole & (n >= overlap)
    digest = lambda part: F.xxhash64(F.transform(part, lambda x: x["h"]))
    tail = F.when(has_end, F.slice("m", n - overlap + 1, overlap))
    front = F.when(has_end & (F.col("frag") > 0), F.slice("m", 1, overlap))
    users = F.transform("turns", lambda t: t["user"])
    alternates = F.forall(
        F.sequence(F.lit(0), F.greatest(F.size("turns") - 1, F.lit(0))),
        lambda i: (i == 0) | (F.get(users, i) != F.get(users, i - 1)),
    )
    return g.select(
        "conv", "frag",
        F.when(front.isNotNull(), digest(front)).alias("prefix"), front[0]["idx"].alias("first_at"),
        F.when(tail.isNotNull(), digest(tail)).alias("suffix"), tail[0]["idx"].alias("last_at"),
        whole.alias("whole"), "n_own", "own_at", "conflict", "no_role", "blank", "says",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.size(F.filter(users, lambda u: u)).cast("bigint").alias("n_users"),
        F.get(users, F.lit(0)).alias("first_user"),
        F.get(users, F.size("turns") - 1).alias("last_user"),
        alternates.alias("alternates"),
    )


def overlaps(frags: DataFrame) -> DataFrame:
    """(conv, before, frag): the edges of the overlap graph, from a fragment to the one whose prefix is its suffix.

    Ends that meet at one hash are counted, never paired: a hash with a single
    suffix and a single prefix is an edge; of an ambiguous one the ends are
    told apart by the index at which their overlap starts. So every fragment
    has at most one edge in and one out.
    """
    end = lambda h, at, out, into: frags.where(F.col(h).isNotNull()).select(
        "conv", F.col(h).alias("h"), F.col(at).alias("at"), out.alias("out"), into.alias("into")
    )
    none = F.lit(None).cast("bigint")
    ends = end("suffix", "last_at", F.col("frag"), none).unionByName(end("prefix", "first_at", none, F.col("frag")))
    meet = [F.count("out").alias("n_out"), F.count("into").alias("n_in"), F.max("out").alias("before"), F.max("into").alias("frag")]
    at_index = ends.groupBy("conv", "h", "at").agg(*meet)
    by_hash = at_index.groupBy("conv", "h").agg(
        F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"), F.max("before").alias("before"), F.max("frag").alias("frag")
    )
    sole = by_hash.where("n_out = 1 AND n_in = 1")
    told_apart = at_index.where("n_out = 1 AND n_in = 1").join(sole.select("conv", "h"), ["conv", "h"], "left_anti")
    edges = sole.select("conv", "before", "frag").unionByName(told_apart.select("conv", "before", "frag"))
    return edges.where("before < frag")


def along_paths(frags: DataFrame, edges: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Adds ``start`` (the first fragment of the path) and ``before_v`` for each of ``values``: its sum over the fragments before this one.

    A fragment points to the one before it; in each round it adds what that
    one has summed up and takes over its pointer, so the reach doubles. Those
    whose path has come to its start leave the rounds. Rounds are written.
    """
    linked = edges.select("conv", "frag", F.col("before").alias("to"))
    at = stored(
        frags.join(linked, ["conv", "frag"], "left").select("conv", "frag", "to", F.coalesce("to", "frag").alias("start"), *values), "path"
    )
    done = [at.where("to IS NULL")]
    going = at.where("to IS NOT NULL")
    while not going.isEmpty():
        # what a fragment points to is either done or still going; both have their sums so far
        target = at.select("conv", F.col("frag").alias("to"), F.col("to").alias("_to"), F.col("start").alias("_start"), *(F.col(v).alias(f"_{v}") for v in values))
        step = going.join(target, ["conv", "to"]).select(
            "conv", "frag", F.col("_to").alias("to"), F.col("_start").alias("start"), *((F.col(v) + F.col(f"_{v}")).alias(v) for v in values)
        )
        going = stored(step, "path")
        at = reduce(DataFrame.unionByName, done).unionByName(going)
        done.append(going.where("to IS NULL"))
        going = going.where("to IS NOT NULL")
    sums = reduce(DataFrame.unionByName, done).select("conv", "frag", "start", *(F.col(v).alias(f"_{v}") for v in values))
    return frags.join(sums, ["conv", "frag"]).select("*", *((F.col(f"_{v}") - F.col(v)).alias(f"before_{v}") for v in values)).drop(*(f"_{v}" for v in values))


def assembled(s: DataFrame, span: int = SPAN, overlap: int = OVERLAP) -> DataFrame:
    """The fragments of the slots with their place on the merged paths."""
    frags = stored(fragments(s, span, overlap), "fragments")
    return stored(along_paths(frags, overlaps(frags), ("n_own", "n_turns", "n_users")), "assembled")


def verdicts(s: DataFrame, placed: DataFrame) -> DataFrame:
    """(conv, sound) for every conversation key that has rows, from its slots and its assembled fragments."""
    in_turn = (F.col("n_turns") == 0) | (F.col("alternates") & (F.col("first_user") == (F.col("before_n_turns") % 2 == 0)))
    paths = placed.groupBy("conv").agg(
        (F.min("start") == F.max("start")).alias("one_path"),
        # the places that the path gives are the indexes that the rows carry
        F.bool_and(F.col("whole") & (F.col("own_at") == F.col("before_n_own") + 1)).alias("in_place"),
        F.bool_or("conflict").alias("conflict"),
        F.bool_or("no_role").alias("no_role"),
        F.bool_or("blank").alias("blank"),
        F.bool_or("says").alias("says"),
        F.bool_and(in_turn).alias("in_turn"),
        F.max_by("last_user", F.when(F.col("n_turns") > 0, F.col("before_n_own"))).alias("ends_user"),
    )
    sound: Column = (
        F.col("one_path")
        & F.col("in_place")
        & ~F.col("conflict")
        & ~F.col("no_role")
        & ~F.col("blank")
        & F.col("says")
        & F.col("in_turn")
        & ~F.col("ends_user")
    )
    loose = s.where(F.col("idx").isNull()).select("conv", F.lit(False).alias("sound"))
    return (
        paths.select("conv", F.coalesce(sound, F.lit(False)).alias("sound"))
        .unionByName(loose)
        .groupBy("conv")
        .agg(F.bool_and("sound").alias("sound"))
    )


def _known(conversations: DataFrame) -> DataFrame:
    return conversations.select(hex_key("conversation_id").alias("conv")).where(F.col("conv").isNotNull()).distinct()


def broken_conversations(conversations: DataFrame, turns: DataFrame, aliases: DataFrame, span: int = SPAN, overlap: int = OVERLAP) -> DataFrame:
    """(conversation_id): the known conversations that must be dropped.

    Dropped are those without rows or without any text of user or assistant,
    with a turn that lacks an index or a known role, with two messages at one
    index, those whose fragments don't merge into a single path that starts
    at index 1 and agrees with the indexes, and those whose turns (system
    turns left out) aren't user, assistant, ..., assistant or hold a blank
    text. Keys are compared by their hexadecimal digits; rows of unknown
    conversations are ignored. Empty tables give no rows.
    """
    s = stored(slots(messages(turns, aliases)), "slots")
    sound = verdicts(s, assembled(s, span, overlap)).where("sound")
    return _known(conversations).join(sound, "conv", "left_anti").select(F.col("conv").alias("conversation_id"))


def sound_conversations(conversations: DataFrame, turns: DataFrame, aliases: DataFrame, span: int = SPAN, overlap: int = OVERLAP) -> DataFrame:
    """(conversation_id, turn_index, exchange, role, text): the turns of the sound conversations, once each, at their place on the path.

    ``exchange`` numbers the pairs of user and assistant from 1; system turns
    have the number of the exchange before them (0 at the start).
    """
    msgs = messages(turns, aliases)
    s = stored(slots(msgs), "slots")
    placed = assembled(s, span, overlap)
    keep = verdicts(s, placed).where("sound").join(_known(conversations), "conv", "left_semi")
    base = placed.join(keep.select("conv"), "conv", "left_semi").select("conv", "frag", "before_n_own", "before_n_users")
    once = (
        msgs.where(F.col("idx").isNotNull())
        .groupBy("conv", "idx")
        .agg(F.min("role").alias("role"), F.min("text").alias("text"))
        .withColumn("frag", owner(F.col("idx"), span, overlap))
    )
    inside = Window.partitionBy("conv", "frag").orderBy("idx")
    return (
        once.join(base, ["conv", "frag"])
        .withColumn("_n", F.row_number().over(inside))
        .withColumn("_in", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(inside))
        .select(
            F.col("conv").alias("conversation_id"),
            (F.col("before_n_own") + F.col("_n")).alias("turn_index"),
            (F.col("before_n_users") + F.col("_in")).alias("exchange"),
            "role",
            "text",
        )
    )
