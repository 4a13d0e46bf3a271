"""Exact de-duplication with counting quotient filters.

Pass 1 reads every text once, deletes its ASCII white space and takes a 48-bit
fingerprint and the SHA-256 of the rest.  Each partition then builds counting
quotient filters of its fingerprints; filters of the same slice of the
fingerprint space merge without loss by their sorted remainders, adding
counts.  A fingerprint counted once proves its text unique.  The others go to
the byte check, which groups texts by byte length and the SHA-256 over all
their bytes.

A text that a third of all rows repeat is one slot with a count in each
partition's filter, one row per partition in the grouping, and is attached
back from a broadcast of the few heavy groups (``common.attach``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, attach, keep_rows, pick, raw_hash, small_batches, stage, utf8

#: Bits of a fingerprint: its quotient (a slot number) and remainder together.
FINGERPRINT_BITS = 48


class QuotientFilter:
    """A counting quotient filter over ``FINGERPRINT_BITS``-bit fingerprints.

    A fingerprint's high ``q`` bits are its home slot, its low bits the
    remainder kept there.  The remainders of one home slot form a sorted run;
    runs are pushed right past full slots.  One bit per home slot says whether
    it has a run, one bit per slot whether a run ends there, which is enough
    to read every fingerprint back, so filters of any size merge losslessly.
    """

    def __init__(self, q: int, occupied: np.ndarray, run_end: np.ndarray, remainder: np.ndarray, count: np.ndarray):
        self.q, self.occupied, self.run_end, self.remainder, self.count = q, occupied, run_end, remainder, count

    @classmethod
    def of(cls, fps: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """From distinct sorted fingerprints and their counts."""
        n = len(fps)
        q = max(1, int(np.ceil(np.log2(max(1, n) / 0.75))))
        r = FINGERPRINT_BITS - q
        home = (fps >> np.uint64(r)).astype(np.int64)
        at = np.arange(n)
        slot = at + np.maximum.accumulate(home - at) if n else at
        size = max(1 << q, int(slot[-1]) + 1 if n else 0)
        occupied, run_end = np.zeros(1 << q, bool), np.zeros(size, bool)
        remainder, count = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        occupied[home] = True
        last = np.append(home[1:] != home[:-1], True) if n else np.zeros(0, bool)
        run_end[slot[last]] = True
        remainder[slot] = fps & np.uint64((1 << r) - 1)
        count[slot] = counts
        return cls(q, occupied, run_end, remainder, count)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints, sorted, and their counts."""
        home, ends = np.flatnonzero(self.occupied), np.flatnonzero(self.run_end)
        begins = np.maximum(home, np.append(-1, ends[:-1]) + 1) if len(ends) else ends
        lengths = ends - begins + 1
        total = int(lengths.sum())
        # slots of all runs in order: each run's begin, then one slot at a time
        slot = np.repeat(begins - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(total) if total else ends
        r = FINGERPRINT_BITS - self.q
        fps = (np.repeat(home, lengths).astype(np.uint64) << np.uint64(r)) | self.remainder[slot]
        return fps, self.count[slot]

    def merge(self, *others: QuotientFilter) -> QuotientFilter:
        parts = [f.items() for f in (self, *others)]
        fps, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.zeros(len(fps), np.int64)
        np.add.at(counts, inverse, np.concatenate([p[1] for p in parts]))
        return QuotientFilter.of(fps, counts)

    def dump(self) -> bytes:
        """Bitmaps, then the remainder and count of each slot in use."""
        used = self.count > 0
        head = np.array([self.q, len(self.run_end)], np.int64).tobytes()
        bits = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.run_end, used))
        return head + bits + self.remainder[used].tobytes() + self.count[used].tobytes()

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        q, size = (int(x) for x in np.frombuffer(data, np.int64, 2))
        at = 16

        def bits(n: int) -> np.ndarray:
            nonlocal at
            out = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
            at += (n + 7) // 8
            return out

        occupied, run_end, used = bits(1 << q), bits(size), bits(size)
        k = int(used.sum())
        remainder, count = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        remainder[used] = np.frombuffer(data, np.uint64, k, at)
        count[used] = np.frombuffer(data, np.int64, k, at + 8 * k)
        return cls(q, occupied, run_end, remainder, count)


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, raw, points, bytes, sha, fp) of every row; raw is the hash of the
    text as it stands, points its number of code points, the rest is of the
    text without ASCII white space."""
    src = pick(docs, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    src = src.select(F.col(id_col), raw_hash(text_col),
                     F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)), utf8(text_col))
    shift = 64 - FINGERPRINT_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1024):
            texts = [t.translate(None, ASCII_SPACE) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), b.column(2), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([xxhash.xxh3_64_intdigest(t) >> shift for t in texts], pa.int64()),
            ], ["id", "raw", "points", "bytes", "sha", "fp"])

    return src.mapInArrow(run, f"id {kind}, raw bigint, points int, bytes bigint, sha binary, fp bigint")


def partition_filters(rows: DataFrame, slices: int) -> DataFrame:
    """(slice, filter): for every partition one filter per slice of the
    fingerprint space, each with the fingerprints the partition has there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: tuple[np.ndarray, np.ndarray] | None = None
        for b in batches:  # sorted runs with counts: copies take no room
            fps, counts = np.unique(b.column(0).to_numpy().astype(np.uint64), return_counts=True)
            if whole is not None:
                fps, inverse = np.unique(np.concatenate([whole[0], fps]), return_inverse=True)
                both = np.zeros(len(fps), np.int64)
                np.add.at(both, inverse, np.concatenate([whole[1], counts]))
                counts = both
            whole = fps, counts
        if whole is None or not len(whole[0]):
            return
        fps, counts = whole
        part = (fps % np.uint64(slices)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        ids, first = np.unique(part[order], return_index=True)
        for i, chosen in zip(ids.tolist(), np.split(order, first[1:])):
            data = QuotientFilter.of(fps[chosen], counts[chosen]).dump()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([data], pa.binary())],
                                             ["slice", "filter"])

    return rows.select("fp").mapInArrow(run, "slice bigint, filter binary")


def repeated_fingerprints(filters: DataFrame, fan_in: int = 64) -> DataFrame:
    """(fp, n) of the fingerprints that the merged filters count more than
    once.  A slice's filters are merged as they arrive, at most ``fan_in``
    at a time, so a task holds one merged slice and a few small filters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def merged() -> list[QuotientFilter]:
            return [held[0].merge(*held[1:])] if len(held) > 1 else held

        def result() -> pa.RecordBatch:
            fps, counts = merged()[0].items()
            more = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(fps[more].astype(np.int64)), pa.array(counts[more])],
                                              ["fp", "n"])

        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if part != now and held:
                    yield result()
                    held = []
                now = part
                held.append(QuotientFilter.load(data))
                if len(held) > fan_in:
                    held = merged()
        if held:
            yield result()

    return (filters.repartition("slice").sortWithinPartitions("slice")
            .mapInArrow(run, "fp bigint, n bigint"))


def duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", slices: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``raw``, ``keep_id``, ``group_size``,
    ``kept``, ``text_sha256``.

    Of texts that are equal without ASCII white space, the row with the most
    code points stays, then the one with the smallest id.  Defined cases: null
    text counts as empty (and so equals texts of white space only); a null id
    comes after all others, and ``keep_id`` is null where it stays; of rows
    that repeat the winning id and length exactly one is kept; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the row number only breaks ties between repeated rows; it is fixed by staging
    rows = stage(digests(docs, text_col, id_col).withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    repeated = stage(repeated_fingerprints(partition_filters(rows, slices)), "dedup-repeated")
    each = stage(attach(rows, repeated, "fp", "n", ["n"]), "dedup-routed")
    order = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), "id", "row")
    groups = (each.where("n IS NOT NULL").groupBy("sha", "bytes")
              .agg(F.min(order).alias("k"), F.count("*").alias("group_size"))
              .select("sha", "group_size", F.col("k.id").alias("best_id"), F.col("k.row").alias("best_row")))
    out = attach(each, stage(groups, "dedup-groups"), "sha", "group_size", ["group_size", "best_id", "best_row"])
    single = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col), "raw",
        F.when(single, F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = duplicates(docs, text_col, id_col).where("kept").select(F.col(id_col).alias("id"), "raw").distinct()
    return keep_rows(docs, kept, text_col, id_col)
