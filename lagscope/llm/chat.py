"""Chat logs: collapse of cumulative snapshots, then rendering.

A logged conversation that grows is often logged again and again, each time
from its first turn.  Such a snapshot is a prefix of a longer conversation and
adds nothing.  Every turn prefix of every conversation gets a rolling hash (the
exclusive or of position-salted hashes of its turns, two of 64 bits each); a
conversation whose whole hash is a proper prefix hash of another is a snapshot,
and an anti-join keeps the others.  Of equal conversations the one with the
smallest id stays.  The rest is rendered.

Everything is DataFrame functions.  Turns are sorted by range over the whole
table, rows that repeat being told apart by where they are stored, so a
conversation with a third of all turns is many tasks, whatever its turn numbers
are (all null, all equal).  A turn's position is its place in its range plus what
the ranges before hold of its conversation; windows run over segments of
positions, whose totals are carried on by a window over segments, and see hashes
only, no texts.  First turns or whole conversations that many logs share are
aggregated map-side before the anti-join, where every key stands once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, pick, stage

#: Turns of a segment; turns of one rendered text.
SEGMENT, RENDERED_TURNS = 1024, 1024


def sorted_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(key, role, text, at) of every turn, staged: ``key`` is (conv, run), the
    run being the range of the sorted table that holds the turn, ``at`` the
    turn's place there.  Turns of a conversation stand in the order of turn (null
    first), then role, then text."""
    t = pick(turns, conv_col, turn_col, role_col, text_col).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        # equal rows are interchangeable: their place in the input lets ranges part them
        F.monotonically_increasing_id().alias("stored"))
    order = ["conv", "turn", "role", "text", "stored"]
    t = t.repartitionByRange(*order).sortWithinPartitions(*order)
    # (a struct compares its nulls as equal)
    return stage(t.select(F.struct("conv", F.spark_partition_id().alias("run")).alias("key"), "role", "text",
                          F.monotonically_increasing_id().alias("at")), "chat-turns")


def run_starts(rows: DataFrame) -> DataFrame:
    """One row per conversation and range: ``k`` turns there from place
    ``first`` on, ``past`` in earlier ranges, ``n`` in all."""
    whole = Window.partitionBy("key.conv")
    before = whole.orderBy("key.run").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("key").agg(F.count("*").alias("k"), F.min("at").alias("first")).select(
        "key", "k", "first", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("past"), F.sum("k").over(whole).alias("n"))


def _rolling(rows: DataFrame, starts: DataFrame, segment: int) -> DataFrame:
    t = rows.select("key", "at", F.xxhash64("role", "text").alias("ra"), F.xxhash64(F.lit("b"), "text", "role").alias("rb"))
    t = t.join(starts, "key").withColumn("pos", F.col("past") + F.col("at") - F.col("first"))
    t = t.select(F.struct("key.conv", F.floor(F.col("pos") / F.lit(segment)).alias("seg")).alias("key"), "pos", "n",
                 F.xxhash64("pos", "ra").alias("a"), F.xxhash64("pos", "rb").alias("b"))
    upto = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("key.conv").orderBy("key.seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = t.groupBy("key").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    totals = totals.select("key", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(p)
                                    for c, p in (("ta", "pa"), ("tb", "pb"))])
    t = t.withColumn("xa", F.bit_xor("a").over(upto)).withColumn("xb", F.bit_xor("b").over(upto)).join(totals, "key")
    return t.select("key.conv", "pos", F.col("xa").bitwiseXOR(F.col("pa")).alias("h1"),
                    F.col("xb").bitwiseXOR(F.col("pb")).alias("h2"), "n")


def prefix_hashes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(conv, pos, h1, h2, n) of every turn: its position from 0, the rolling
    hashes of the turns up to it, the turns of its conversation.  The order of
    turns is that of ``sorted_turns``."""
    rows = sorted_turns(turns, conv_col, turn_col, role_col, text_col)
    return _rolling(rows, stage(run_starts(rows), "chat-runs"), segment)


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """(conv, n, n_copies) of the conversations that prefix no longer one; of
    equal ones the smallest id, with their number."""
    whole = hashes.where("pos = n - 1").groupBy("h1", "h2", "n").agg(F.min("conv").alias("conv"),
                                                                      F.count("*").alias("n_copies"))
    proper = hashes.where("pos < n - 1").select("h1", "h2", (F.col("pos") + 1).alias("n")).distinct()
    return whole.join(proper, ["h1", "h2", "n"], "left_anti").select("conv", "n", "n_copies")


def chat_texts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text", rendered_turns: int = RENDERED_TURNS) -> DataFrame:
    """One row per maximal conversation and part: id, ``part``, ``n_turns``,
    ``n_copies`` (equal logs it stands for), ``text``.

    A turn renders as <|im_start|>role, newline, text, <|im_end|>, newline.
    Conversations over ``rendered_turns`` turns go on in parts 1, 2, ..., so no
    row gathers an unbounded conversation; the others are one part 0.  Defined
    cases: null role or text renders as empty; a null turn number comes first;
    equal turn numbers are ordered by role and text; rows that repeat are turns
    that repeat; all rows with a null id are one conversation, which an equal
    one with an id stands for; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    rows = sorted_turns(turns, conv_col, turn_col, role_col, text_col)
    starts = stage(run_starts(rows), "chat-runs")
    hashes = stage(_rolling(rows, starts, SEGMENT), "chat-hashes")
    best = maximal_conversations(hashes).select(F.struct("conv").alias("best"), "n_copies")
    kept = starts.join(best, F.struct("key.conv") == F.col("best")).drop("best")
    rows = attach(rows, stage(kept, "chat-maximal"), "key", "k", ["first", "past", "n", "n_copies"], deal_by=["at"])
    rows = rows.select("key.conv", (F.col("past") + F.col("at") - F.col("first")).alias("pos"), "role", "text", "n", "n_copies")
    turn = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    part = F.floor(F.col("pos") / F.lit(rendered_turns))
    out = rows.where("n IS NOT NULL").groupBy("conv", part.alias("part"), F.col("n").alias("n_turns"), "n_copies").agg(
        F.array_sort(F.collect_list(F.struct("pos", turn.alias("x")))).alias("xs"))
    return out.select(F.col("conv").alias(conv_col), "part", "n_turns", "n_copies",
                      F.array_join("xs.x", "").alias("text"))
