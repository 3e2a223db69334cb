"""Cumulative-snapshot collapse and chat rendering, in DataFrame functions only.

Loggers often store a conversation again after each turn. A rolling hash of (place, role, text)
identifies every prefix of every conversation; a conversation whose whole hash is a proper prefix of
another one, or equals that of a conversation with a smaller id, is dropped. The rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechreport.llm.common import materialize


def prefixes(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place, n_turns, a, b): two 64-bit hashes of the first ``place`` turns, for each place.

    The hash of a prefix is the exclusive or of its turns' hashes, each salted with its place, so it
    rolls along a window. Only hashes are shuffled, not texts.
    """
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), "_r", "_t")
    role_text = (F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    hashed = df.select(conv, turn, F.xxhash64(*role_text).alias("_r"), F.xxhash64(F.lit(7), F.reverse(role_text[1]), role_text[0]).alias("_t"))
    placed = hashed.withColumn("place", F.row_number().over(order))
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        F.col(conv).alias("conv"), "place",
        F.count(F.lit(1)).over(Window.partitionBy(conv)).alias("n_turns"),
        F.bit_xor(F.xxhash64(F.lit(1), "place", "_r", "_t")).over(rolling).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(2), "_t", "place", "_r")).over(rolling).alias("b"),
    )


def maximal(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_copies) of the conversations that no other one continues or repeats."""
    found = materialize(prefixes(df, conv, turn, role, text))
    whole = found.filter(F.col("place") == F.col("n_turns")).groupBy("place", "a", "b").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies"))
    longer = found.filter(F.col("place") < F.col("n_turns")).groupBy("place", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return whole.join(longer, ["place", "a", "b"], "left_anti").select("conv", F.col("place").cast("long").alias("n_turns"), "n_copies")


def collapse_and_render(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) for each maximal conversation.

    Turns are ordered by number, ties by a hash of role and text. Null roles and texts count as ''.
    Rows without a conversation id belong to none and are left out. Of equal conversations the one
    with the smallest id stays and n_copies tells how many there were. The rendered text holds each
    turn as <|im_start|>role, line feed, text, <|im_end|>, line feed; one conversation is one row, its texts
    whole. Equal rows are turns each. An empty table gives no rows. Other columns are not read.
    """
    own = df.filter(F.col(conv).isNotNull()).select(conv, turn, role, text)
    kept = materialize(maximal(own, conv, turn, role, text))
    turns = own.join(kept, own[conv] == kept["conv"]).select(
        "conv", "n_turns", "n_copies", F.col(turn).alias("t"),
        F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"),
    )
    tie = (F.xxhash64("r", "x"), F.xxhash64(F.lit(7), F.reverse("x"), "r"))
    said = F.struct("t", tie[0].alias("h1"), tie[1].alias("h2"), "r", "x")
    grouped = turns.groupBy("conv", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(said)).alias("turns"))
    lines = F.transform("turns", lambda s: F.concat(F.lit("<|im_start|>"), s["r"], F.lit("\n"), s["x"], F.lit("<|im_end|>\n")))
    return grouped.select(F.col("conv").alias(conv), "n_turns", "n_copies", F.array_join(lines, "").alias("rendered"))
