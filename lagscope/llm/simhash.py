"""Near-duplicate groups by SimHash.

Every text becomes one 64-bit fingerprint.  The bits are cut into blocks;
fingerprints that differ in at most ``max_bits`` bits agree on at least
``blocks - max_bits`` whole blocks (pigeonhole), so a join on every choice of
that many blocks meets all close pairs.  Pairs that meet are verified by their
Hamming distance, and connected components of the verified links are the
groups.

Distributed plan: one map pass makes fingerprints (texts never shuffle); equal
fingerprints collapse to one row before anything is joined, so a third of all
rows being copies is one row here; the block join moves 16 bytes per
fingerprint and block choice; blocks with very many fingerprints are split
into tiles that are compared in separate tasks; and each tile gives only a
spanning forest of its verified links, never all its pairs.  A forest has the
same connected components, so no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, keep_rows, pick, raw_hash, small_batches, stage, utf8
from .components import components

#: Fingerprints of one block compared in one task; larger blocks are tiled.
TILE = 4096


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of a UTF-8 text (unsigned): a bit is 1 if it is set in over half
    the XXH64 hashes of the ``shingle``-word shingles, repeats included.

    Fewer words than a shingle count as one shingle; no word gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts, ends = [0], [len(joined)]
    if n > 1:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts += (gaps[:n - 1] + 1).tolist()
        ends = gaps[shingle - 1:].tolist() + ends
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends)])
    ones = np.zeros(64, np.int64)
    hashes = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for at in range(0, n, 65536):  # bounds the unpacked bits of a very long text
        ones += np.unpackbits(hashes[at:at + 65536], axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4,
                 seed: int = 42) -> DataFrame:
    """(id, raw, fp): the fingerprint of every row as a signed long, with a hash
    of its text.  Null text counts as empty."""
    src = pick(docs, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))],
                                             ["id", "raw", "fp"])

    return (src.select(F.col(id_col), raw_hash(text_col), utf8(text_col))
            .mapInArrow(run, f"id {kind}, raw bigint, fp bigint"))


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """One 64-bit mask per choice of ``blocks - max_bits`` of the blocks."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("need 0 <= max_bits < blocks <= 64")
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spanning_links(left: np.ndarray, right: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (Hamming distance at most ``max_bits``)
    within ``left``, or between ``left`` and ``right`` where they differ.

    Breadth-first: each vertex that has been reached is compared only with
    those not reached yet, so a dense group costs little more than one pass.
    """
    same = right is left
    sides = [left] if same else [left, right]
    todo = [np.arange(len(s)) for s in sides]
    out: list[tuple[int, int]] = []
    while len(todo[0]):
        front = [(0, int(todo[0][0]))]
        todo[0] = todo[0][1:]
        while front:
            side, i = front.pop()
            other = side if same else 1 - side
            rest = todo[other]
            if not len(rest):
                continue
            near = np.bitwise_count(sides[other][rest] ^ sides[side][i]) <= max_bits
            if near.any():
                for j in rest[near].tolist():
                    out.append((int(sides[side][i]), int(sides[other][j])))
                    front.append((other, j))
                todo[other] = rest[~near]
    return out


def _tile_links(max_bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by (k, i, j), so a tile is one run of rows that
        # may go on in the next batch; a tile has at most about 2 * TILE rows
        held: list[np.ndarray] = []

        def close(rows: np.ndarray) -> list[tuple[int, int]]:
            """Links of whole tiles; rows: columns k, i, j, side, fp."""
            found: list[tuple[int, int]] = []
            cuts = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(axis=1)) + 1
            starts = np.concatenate([[0], cuts])
            ends = np.concatenate([cuts, [len(rows)]])
            sizes = ends - starts
            fps = rows[:, 4].astype(np.int64).view(np.uint64)
            # most tiles hold two fingerprints: those are compared at once
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits]
            found.extend(zip(fps[near].tolist(), fps[near + 1].tolist()))
            for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
                part, side = fps[s:e], rows[s:e, 3]
                if rows[s, 1] == rows[s, 2]:
                    found += spanning_links(part, part, max_bits)
                else:
                    found += spanning_links(part[side == 0], part[side == 1], max_bits)
            return found

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
            held.append(rows)
            last = rows[-1, :3]
            if (rows[0, :3] == last).all():
                continue  # still the same tile
            full = np.concatenate(held)
            end = len(full)
            while end and (full[end - 1, :3] == last).all():
                end -= 1
            held = [full[end:]]
            if end:
                yield batch_of(close(full[:end]))
        if held:
            yield batch_of(close(np.concatenate(held)))

    return run


def near_links(fps: DataFrame, max_bits: int = 4, blocks: int = 7, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``fps`` (column fp)
    that span every group of fingerprints joined by distances of at most
    ``max_bits``."""
    masks = [_signed(m) for m in block_masks(blocks, max_bits)]
    choice = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits"))
                                 for i, m in enumerate(masks)])).alias("x")
    keys = fps.select("fp", choice).select(F.xxhash64("x.c", "x.bits").alias("k"), "fp")
    # a key that two block values share by chance only adds pairs to verify
    big = stage(keys.groupBy("k").count().where(F.col("count") > tile).select("k", F.col("count").alias("n")),
                "simhash-big")
    members = attach(keys, big, "k", "n", ["n"])
    parts = F.coalesce(F.ceil(F.col("n") / F.lit(tile)), F.lit(1)).cast("int")
    members = members.withColumn("p", parts).withColumn("s", F.pmod(F.xxhash64("fp"), F.col("p")).cast("int"))
    # every pair of parts of a large block is a tile; other blocks are one tile
    members = members.select("k", "fp", "s", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("o"))
    tiles = members.select("k", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"),
                           (F.col("s") > F.col("o")).cast("int").alias("side"), "fp")
    dealt = tiles.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return dealt.mapInArrow(_tile_links(max_bits), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 4,
                    max_bits: int = 4, blocks: int = 7, seed: int = 42) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 lower-case hex digits),
    ``component_id`` (the smallest id of its group, its own included).

    Defined cases: null text counts as empty; texts without a word have
    fingerprint 0 and link like any other; a null id never names a group unless
    all its ids are null (then ``component_id`` is null); repeated rows each
    give a row; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    each = stage(fingerprints(docs, text_col, id_col, shingle, seed), "simhash-fp")
    nodes = stage(each.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), max_bits, blocks))
    named = nodes.join(roots, nodes.fp == roots.u, "left").select("fp", "least_id", "n",
                                                                   F.coalesce("root", "fp").alias("root"))
    named = stage(named, "simhash-roots")
    groups = stage(named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("g")),
                   "simhash-groups")
    labels = stage(attach(named, groups, "root", "g", ["component_id"]).select("fp", "n", "component_id"),
                   "simhash-labels")
    out = attach(each, labels, "fp", "n", ["component_id"])
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


def deduplicated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """One document of each near-duplicate group, with all its columns: the
    one with the smallest id (a null id last, then the smallest hash of the
    text, so that rows that repeat an id also leave one)."""
    shingle, seed = how.pop("shingle", 4), how.pop("seed", 42)
    each = stage(fingerprints(docs, text_col, id_col, shingle, seed), "simhash-fp")
    order = F.struct(F.col("id").isNull().alias("z"), "id", "raw")
    nodes = stage(each.groupBy("fp").agg(F.min(order).alias("first")), "simhash-nodes")
    roots = components(near_links(nodes.select("fp"), **how))
    named = nodes.join(roots, nodes.fp == roots.u, "left").select("first", F.coalesce("root", "fp").alias("root"))
    keep = named.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.raw")
    return keep_rows(docs, stage(keep, "simhash-keep"), text_col, id_col)
