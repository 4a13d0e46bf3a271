"""Mixing sources to target weights by balanced sampling (the cube method).

Every source gets a target number of words.  A document is taken floor(p) times
for sure, p being its source's target over its source's size, and once more
with probability p - floor(p).  The extra copies are drawn by the cube method
(Deville and Tillé 2004): three undecided documents at a time move their
probabilities along the null space of the two balance constraints, expected
words and expected documents, until one of them is decided; both totals stay
what they were.  What is left in the end, at most two documents per source, is
the landing: the document constraint is dropped, then the word constraint.  Of
m rows that repeat id, source and text, floor(m (p - floor(p))) get the extra
copy for sure and one flies with the rest.

Distributed plan: one pass counts words; documents are dealt to chunks of
bounded size within their source, so a source with a third of all rows is many
tasks; each chunk streams through the flight phase holding three documents, and
hands on at most two; the remainders of all chunks fly again until one chunk
per source is left.  Only ids, sizes and probabilities move.  All draws come
from hashes and fixed orders, so reruns agree.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, pick, raw_hash, stage

#: Documents of one chunk; what a flight calls decided.
CHUNK, EPS = 2_000, 1e-9


def word_count(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key():
    # a struct compares null sources and ids as equal
    return F.struct("id", "source", "size", "raw")


def sizes_of(docs: DataFrame, text_col: str, id_col: str, source_col: str) -> DataFrame:
    src = pick(docs, id_col, source_col, text_col)
    return src.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                      word_count(text_col).alias("size"), raw_hash(text_col).alias("raw"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """(src, source_size, target, n): weights repeat over the sources in code
    point order (null last); ``share`` of all words is shared out by weight, no
    source above ``most`` times its size.

    Resharing the excess until no target is above its limit ends at
    target = min(limit, level * weight); the level follows from the sources
    ordered by limit / weight, without iterating.  One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    per = per.select("*", weight.alias("w"), rank.alias("rank"))
    per = per.withColumn("limit", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    below = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    per = per.withColumn("level", (F.lit(share) * whole - below) / above).withColumn("at", F.row_number().over(order))
    # the first source that its level does not overfill sets the level
    fits = F.when(F.col("limit") / F.col("w") >= F.col("level"), F.struct("at", "level"))
    level = F.min(fits).over(Window.partitionBy())["level"]
    target = F.coalesce(F.least("limit", level * F.col("w")), F.col("limit"))
    return per.select(F.struct("source").alias("src"), "source_size", target.alias("target"), "n")


def fly(units: Iterator[tuple[int, int, int, float]], rng: random.Random, last: bool) -> Iterator[tuple[int, float]]:
    """The flight phase over (index, documents, words, probability), in order.

    Yields (index, probability) once each: 0 or 1 where decided, and what is
    left of the at most two undecided ones; with ``last`` these land too.
    """
    live: list[list] = []  # [index, documents, words, probability]

    def move(direction: list[float]) -> None:
        """Walk to the next face of the cube, keeping expectations."""
        up = down = float("inf")
        for u, x in zip(direction, live):
            if u > 0:
                up, down = min(up, (1 - x[3]) / u), min(down, x[3] / u)
            elif u < 0:
                up, down = min(up, x[3] / -u), min(down, (1 - x[3]) / -u)
        step = up if rng.random() * (up + down) < down else -down
        for u, x in zip(direction, live):
            x[3] += step * u

    def settle() -> Iterator[tuple[int, float]]:
        for x in [x for x in live if not EPS < x[3] < 1 - EPS]:
            live.remove(x)
            yield x[0], float(round(x[3]))

    for index, documents, words, p in units:
        live.append([index, documents, words, p])
        yield from settle()
        while len(live) == 3:
            (_, d1, w1, _), (_, d2, w2, _), (_, d3, w3, _) = live
            u = [d2 * w3 - d3 * w2, d3 * w1 - d1 * w3, d1 * w2 - d2 * w1]
            if not any(u):  # equal proportions: one constraint holds the other
                u = [d2, -d1, 0]
            largest = max(map(abs, u))
            move([x / largest for x in u])
            yield from settle()
    while last and len(live) == 2:
        (_, d1, w1, _), (_, d2, w2, _) = live
        u = [w2, -w1] if w1 or w2 else [d2, -d1]
        move([x / max(map(abs, u)) for x in u])
        yield from settle()
    for x in live:
        yield x[0], float(rng.random() < x[3]) if last else x[3]


def _flight(kind: str, seed: int, round_no: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by (src, chunk); one chunk, of bounded size, is held
        held: list[pa.RecordBatch] = []

        def land(chunk: pa.Table) -> pa.RecordBatch:
            name = chunk.column("source")[0].as_py()
            rng = random.Random(f"{seed}|{round_no}|{name!r}|{chunk.column('chunk')[0].as_py()}")
            units = zip(range(chunk.num_rows), repeat(1), chunk.column("size").to_pylist(), chunk.column("p").to_pylist())
            p = np.empty(chunk.num_rows)
            for index, value in fly(units, rng, chunk.column("chunks")[0].as_py() == 1):
                p[index] = value
            out = chunk.select(["id", "source", "size", "raw"]).append_column("p", pa.array(p))
            return out.combine_chunks().to_batches()[0]

        def key(batch: pa.RecordBatch, i: int) -> tuple:
            return batch.column("source")[i].as_py(), batch.column("chunk")[i].as_py()

        for b in batches:
            if not b.num_rows:
                continue
            code = b.column("h").to_numpy()  # a hash of (source, chunk), to find the cuts fast
            cuts = (np.flatnonzero(code[1:] != code[:-1]) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, b.num_rows]):
                part = b.slice(start, end - start)
                if held and key(held[-1], 0) != key(part, 0):
                    yield land(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield land(pa.Table.from_batches(held))

    return run, f"id {kind}, source string, size bigint, raw bigint, p double"


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7,
        chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(rows, decisions): rows are (id, source, size, raw, the hash of the
    text) of every document, with their place ``mid``; decisions, staged, have
    for each distinct row ``key`` (a struct of the four), its number of rows
    ``m``, the copies ``sure`` of each, the number ``extra`` of its rows that
    get one more, ``source_size``, ``target``.

    Defined cases: null text has no words; a null source is a source of its
    own, the last; of rows that repeat id, source and text, the number with an
    extra copy is drawn and their place says which; documents without words are drawn like any other; a source
    without words has target 0 and is not taken; an empty table gives no rows.
    """
    rows = stage(sizes_of(docs, text_col, id_col, source_col).withColumn("mid", F.monotonically_increasing_id()), "mix-sizes")
    kind = rows.schema["id"].dataType.simpleString()
    targets = stage(source_targets(rows, weights, share, most), "mix-targets")
    units = rows.groupBy("id", "source", "size", "raw").agg(F.count("*").alias("m")).withColumn("src", F.struct("source"))
    units = attach(units, targets, "src", "n", ["source_size", "target"], deal_by=["id", "size", "raw"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    share_of = F.col("m") * (ratio - F.floor(ratio))  # rows with an extra copy
    units = units.withColumns({"sure": F.floor(ratio), "whole": F.floor(share_of), "p": share_of - F.floor(share_of)})
    units = stage(units.drop("src"), "mix-units")

    undecided = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    settled, open_units = [], units.where(undecided).select("id", "source", "size", "raw", "p")
    settled.append(units.where(~undecided).select("id", "source", "size", "raw", F.round("p").alias("p")))
    round_no = 0
    while True:
        held = open_units.withColumn("src", F.struct("source"))
        many = held.groupBy("src").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / F.lit(chunk)))
        many = stage(many, "mix-chunks")
        if not many.take(1):
            break
        held = attach(held, many, "src", "n", ["chunks"], deal_by=["id", "size", "raw"])
        held = held.withColumn("chunk", F.pmod(F.xxhash64("id", "size", "raw", F.lit(seed + round_no)), F.col("chunks")))
        held = held.withColumn("h", F.xxhash64("source", "chunk")).withColumn("o", F.xxhash64("id", "size", "raw", F.lit(seed)))
        held = (held.repartition("source", "chunk").sortWithinPartitions("h", "source", "chunk", "o", "id", "size", "raw")
                .select("id", "source", "size", "raw", "p", "chunk", "chunks", "h"))
        run, schema = _flight(kind, seed, round_no)
        flown = stage(held.mapInArrow(run, schema), "mix-flight")
        settled.append(flown.where(~undecided).select("id", "source", "size", "raw", "p"))
        open_units, round_no = flown.where(undecided), round_no + 1
    drawn = settled[0]
    for part in settled[1:]:
        drawn = drawn.unionByName(part)
    drawn = drawn.select(_key().alias("key"), F.col("p").cast("long").alias("drawn"))
    decisions = units.withColumn("key", _key()).join(drawn, "key", "left").select(
        "key", "m", "sure", (F.col("whole") + F.coalesce("drawn", F.lit(0))).cast("long").alias("extra"), "source_size", "target")
    return rows, stage(decisions, "mix-decisions")


def with_copies(rows: DataFrame, decisions: DataFrame, extra: list[str]) -> DataFrame:
    """``rows`` (with ``key`` and a place ``mid``) with ``copies`` and the
    columns ``extra`` of their decisions.

    Rows of a key are numbered by place within shards of about ``CHUNK`` rows,
    so a key with a third of all rows is many tasks; the first get the extra
    copies."""
    out = attach(rows, decisions, "key", "m", ["m", "sure", "extra", *extra], deal_by=["mid"])
    if not decisions.where("m > 1").take(1):
        return out.withColumn("copies", F.col("sure") + F.col("extra"))
    out = stage(out, "mix-rows")
    once = out.where("m = 1").withColumn("copies", F.col("sure") + F.col("extra"))
    shard = F.pmod(F.xxhash64("mid"), F.ceil(F.col("m") / F.lit(CHUNK))).alias("shard")
    many = out.where("m > 1").withColumn("place", F.struct("key", shard))
    before = F.sum("rows").over(Window.partitionBy("at.key").orderBy("at.shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = many.groupBy(F.col("place").alias("at")).agg(F.count("*").alias("rows"))
    shards = stage(shards.select("at", F.coalesce(before, F.lit(0)).alias("before")), "mix-shards")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("place").orderBy("mid"))
    many = many.join(shards, F.col("place") == F.col("at")).withColumn("rank", rank)
    many = many.withColumn("copies", F.col("sure") + (F.col("rank") <= F.col("extra")).cast("long"))
    return once.unionByName(many.select(once.columns))


def mixture(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per document: id, ``size``, ``source_size``, ``target`` (its
    source's), ``taken`` (words taken, repeats counted).  Cases as in ``mix``;
    other columns are ignored, whatever their names."""
    rows, decisions = mix(docs, id_col=id_col, **how)
    out = with_copies(rows.withColumn("key", _key()), decisions, ["source_size", "target"])
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
                    **how) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with all
    its columns."""
    _, decisions = mix(docs, text_col, id_col, source_col, **how)
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    at = {c: names[cols.index(c)] for c in (id_col, source_col, text_col)}
    rows = docs.toDF(*names).withColumn("key", F.struct(
        F.col(at[id_col]).alias("id"), F.col(at[source_col]).cast("string").alias("source"),
        word_count(at[text_col]).alias("size"), raw_hash(at[text_col]).alias("raw")))
    out = with_copies(rows.withColumn("mid", F.monotonically_increasing_id()), decisions, [])
    copies = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return out.select(*names, F.explode(copies).alias("copy")).select(*names).toDF(*cols)
