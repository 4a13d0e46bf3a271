"""Merkle manifest of a dataset: one root over every row, proofs per row.

The rows of a group (a source) are the leaves of a tree in which three
consecutive nodes become one; the group roots are the leaves of the top tree.
A tree is stored as aligned subtrees of 3^6 leaves, its blocks.  Inside a block
the nodes lie in van Emde Boas order: the upper half of the levels first, then
the lower subtrees from left to right, each laid out the same way.  Nothing
points at anything: ``place`` computes where a node lies, for the construction
and for the siblings alike.  The block roots are the leaves of the next tier of
blocks, until every tree has one block left.

All of it is shuffled by (tree, block).  No task holds more than one block and
its leaves, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, runs, stage

#: Nodes that become one, height of a stored block, bytes of a digest.
ARITY, HEIGHT, WIDTH = 3, 6, 32

#: The columns that a leaf covers.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# -- one block ---------------------------------------------------------------

def size(levels: int) -> int:
    """Nodes of a complete subtree of so many levels."""
    return (ARITY ** levels - 1) // (ARITY - 1)


@lru_cache(maxsize=1 << 14)
def place(depth: int, index: int, levels: int) -> int:
    """Where node ``index`` of the level ``depth`` lies in a block of
    ``levels`` levels: descend into the half of the levels that holds it."""
    base = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            depth -= top
            below, index = divmod(index, ARITY ** depth)
            base += size(top) + below * size(levels - top)
            levels -= top
    return base


def joined(digests: Sequence[bytes]) -> bytes:
    """The parent of consecutive nodes: SHA-256 of their digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height_of(n: int, only: bool, most: int = HEIGHT) -> int:
    """Levels above the leaves of a block of n leaves: as many as it takes to
    be one node if the tree has no other block, ``most`` otherwise."""
    if not only:
        return most
    height = 0
    while ARITY ** height < n:
        height += 1
    return height


def build(leaves: Sequence[bytes], height: int) -> bytes:
    """The nodes of a block, in van Emde Boas order.  Places of nodes that a
    last, partial block lacks stay empty."""
    nodes = bytearray(WIDTH * size(height + 1))
    level = list(leaves)
    for depth in range(height, -1, -1):
        for i, digest in enumerate(level):
            at = WIDTH * place(depth, i, height + 1)
            nodes[at:at + WIDTH] = digest
        if depth:
            level = [joined(level[i:i + ARITY]) for i in range(0, len(level), ARITY)]
    return bytes(nodes)


def siblings(nodes: bytes, n: int, height: int, index: int) -> list[str]:
    """The path of leaf ``index`` through its block, level by level: the hex
    digests before it in its run and those behind it."""
    path = []
    for depth in range(height, 0, -1):
        first = index - index % ARITY
        run = []
        for i in range(first, min(first + ARITY, n)):
            at = WIDTH * place(depth, i, height + 1)
            run.append(nodes[at:at + WIDTH].hex())
        path += ["".join(run[:index - first]), "".join(run[index - first + 1:])]
        index, n = index // ARITY, -(-n // ARITY)
    return path


def fold(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf and its path give."""
    for before, behind in zip(path[::2], path[1::2]):
        leaf = hashlib.sha256((before + leaf + behind).encode()).hexdigest()
    return leaf


# -- trees as tables ---------------------------------------------------------

def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (staged; column tree) with their place ``pos`` within their tree
    and the size ``n`` of the tree: a range sort, counts per range, offsets.
    Rows that agree in ``order`` are told apart by where they are stored, so
    that copies do not pile up in one range."""
    sort = ["tree", *[F.col(c).asc_nulls_first() for c in order], "_row"]
    rows = rows.withColumn("_row", F.col("_metadata.row_index"))
    spread = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_row")
    spread = stage(spread.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    # a monotonic id is the partition's number and the row's within it
    spread = spread.withColumn("_part", F.shiftright("_at", 33))
    counts = spread.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    before = F.sum("_c").over(tree.orderBy("_part")) - F.col("_c")
    counts = counts.select(F.col("tree").alias("_t"), F.col("_part").alias("_p"), "_first", before.alias("_before"),
                           F.sum("_c").over(tree).alias("n"))
    return (spread.join(counts, (F.col("tree") == F.col("_t")) & (F.col("_part") == F.col("_p")))
            .withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_t", "_p", "_at", "_part", "_first", "_before"))


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of one tier from (tree, pos, n, digest): (tree, block, n, only,
    nodes, digest), n the leaves of the block, digest its root."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for (tree, block), of in runs(batches, 2):
                leaves = [bytes(x[4]) for x in of]
                only = of[0][3] <= ARITY ** most
                nodes = build(leaves, height_of(len(leaves), only, most))
                yield tree, block, len(leaves), only, nodes, nodes[:WIDTH]
        yield from _batches(out(), schema, 256)

    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("only", pa.bool_()),
                        ("nodes", pa.binary()), ("digest", pa.binary())])
    cut = rows.select("tree", F.expr(f"pos DIV {ARITY ** most}").alias("block"), "pos", "n", "digest")
    return (cut.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
            .mapInArrow(run, "tree string, block bigint, n bigint, only boolean, nodes binary, digest binary"))


def _batches(rows: Iterator[tuple], schema: pa.Schema, many: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == many:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _walk(rows: DataFrame, blocks: DataFrame, most: int, carried: list[str],
          fields: list[tuple[str, str, pa.DataType]], answer: Callable[..., tuple]) -> DataFrame:
    """``answer(tree, pos, path, header, *carried)`` for every row (tree, pos,
    carried...), where the path runs through its block and on through what the
    block's header names as ``upper``.  Blocks and rows meet in one sorted
    stream: a block, then its leaves."""
    many = ARITY ** most
    extra = [F.col(c) for c in carried]
    head = blocks.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "n", "only", "nodes", "upper", "subroot",
                         "root", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carried])
    body = rows.select("tree", F.expr(f"pos DIV {many}").alias("block"), "pos", F.lit(None).cast("long").alias("n"),
                       F.lit(None).cast("boolean").alias("only"), F.lit(None).cast("binary").alias("nodes"),
                       F.lit(None).cast("array<string>").alias("upper"), F.lit(None).cast("string").alias("subroot"),
                       F.lit(None).cast("string").alias("root"), *extra)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for (tree, _), of in runs(batches, 2):
                _, _, _, n, only, nodes, upper, subroot, root, *_ = of[0]
                height = height_of(n, only, most)
                for x in of[1:]:
                    path = siblings(nodes, n, height, x[2] % many) + upper
                    yield answer(tree, x[2], path, (subroot, root), *x[9:])
        yield from _batches(out(), schema)

    schema = pa.schema([(name, kind) for name, _, kind in fields])
    return (head.unionByName(body).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
            .mapInArrow(run, ", ".join(f"`{name}` {sql}" for name, sql, _ in fields)))


_PATH = [("tree", "string", pa.string()), ("pos", "bigint", pa.int64()), ("path", "array<string>", pa.list_(pa.string()))]


@dataclass
class Trees:
    """Stored trees: ``tiers`` of blocks, lowest first, the ``roots`` (tree,
    digest) and the ``height`` of a block."""
    tiers: list[DataFrame]
    roots: DataFrame
    height: int

    @staticmethod
    def of(rows: DataFrame, height: int = HEIGHT) -> "Trees":
        """From leaves (tree, pos, n, digest)."""
        tiers = []
        while True:
            tier = stage(_blocks(rows, height), "merkle-blocks")
            tiers.append(tier)
            if not tier.where("NOT only").limit(1).count():
                break
            many = tier.where("NOT only")
            sizes = many.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
            rows = many.select("tree", F.col("block").alias("pos"), "digest").join(sizes, "tree")
        roots = tiers[0].where("only").select("tree", "digest")
        for tier in tiers[1:]:
            roots = roots.unionByName(tier.where("only").select("tree", "digest"))
        return Trees(tiers, stage(roots, "merkle-roots"), height)

    def headed(self, ends: DataFrame) -> DataFrame:
        """The lowest blocks with the path from their roots up (``upper``).
        ``ends`` continues the path of every tree: (tree, upper, subroot,
        root)."""
        above = None
        for t, tier in reversed(list(enumerate(self.tiers))):
            top = tier.where("only").join(ends, "tree")
            if above is not None:
                inner = tier.where("NOT only").join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
                top = top.unionByName(inner.withColumnRenamed("path", "upper").join(ends.drop("upper"), "tree"))
            if t == 0:
                return top
            leaves = self.tiers[t - 1].where("NOT only").select("tree", F.col("block").alias("pos"))
            above = stage(_walk(leaves, top, self.height, [], _PATH, lambda tree, pos, path, head: (tree, pos, path)), "merkle-paths")
        raise AssertionError("a tree has a tier")


@dataclass
class Manifest:
    """The manifest of a dataset: ``leaves`` (tree, pos, id, digest, other),
    the ``groups``' trees and the ``top`` tree over their roots, all stored in
    the shared folder; ``root`` covers everything (null for an empty table)."""
    leaves: DataFrame
    groups: Trees
    top: Trees
    order: DataFrame
    root: str | None


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the values, each ``-`` if null, else its UTF-8 byte
    count, ``:`` and itself: no two rows are written alike."""
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"),
                                                               v.cast("string"))) for v in values]
    return F.sha2(F.concat(*parts), 256)


def manifest(rows: DataFrame, digest: Column, other: Column, id_col: str = "doc_id", group_col: str = "source",
             height: int = HEIGHT) -> Manifest:
    """Build and store the trees over ``rows``.

    ``digest`` is the leaf (hex) of a row and ``other`` what is claimed of it
    later (a leaf recomputed from a copy, say), both columns over ``rows``.
    Groups are ordered by their UTF-8 bytes, null first; leaves by id, null
    first, ties by digest, so the root does not depend on the order of rows.
    """
    # null sorts before every string, as the empty name does here
    tree = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    leaves = stage(rows.select(tree.alias("tree"), F.col(id_col).alias("id"), F.unhex(digest).alias("digest"),
                               F.unhex(other).alias("other")), "merkle-leaves")
    leaves = stage(_positions(leaves, ["id", "digest"]), "merkle-leaves")
    groups = Trees.of(leaves, height)
    ordered = stage(groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-roots")
    ordered = stage(_positions(ordered, ["name"]), "merkle-roots")
    top = Trees.of(ordered, height)
    found = top.roots.first()
    return Manifest(leaves, groups, top, ordered, bytes(found["digest"]).hex() if found else None)


def verify(m: Manifest) -> DataFrame:
    """Every leaf against the manifest: ``id``, ``leaf``, ``subroot`` (root of
    its group), ``root``, ``proof`` (its siblings, hex, from the leaf up and
    from left to right), ``folded`` (the root that ``other`` and the siblings
    give)."""
    root = F.lit(m.root).cast("string")
    start = m.top.roots.select("tree", F.array().cast("array<string>").alias("upper"), root.alias("subroot"), root.alias("root"))
    tops = _walk(m.order, m.top.headed(start), m.top.height, ["name", "digest"],
                 [("tree", "string", pa.string()), ("upper", "array<string>", pa.list_(pa.string())),
                  ("subroot", "string", pa.string()), ("root", "string", pa.string())],
                 lambda tree, pos, path, head, name, digest: (name, path, bytes(digest).hex(), head[1]))
    kind = m.leaves.schema["id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    leaves = m.leaves if id_type is not None else m.leaves.withColumn("id", F.col("id").cast("string"))

    def answer(tree, pos, path, head, doc, digest, other):
        return (doc, bytes(digest).hex(), head[0], head[1], hashlib.sha256("".join(path).encode()).hexdigest(),
                fold(bytes(other).hex(), path))

    out = _walk(leaves, m.groups.headed(stage(tops, "merkle-tops")), m.groups.height, ["id", "digest", "other"],
                [("id", kind if id_type is not None else "string", id_type or pa.string()), ("leaf", "string", pa.string()),
                 ("subroot", "string", pa.string()), ("root", "string", pa.string()),
                 ("proof_sha256", "string", pa.string()), ("folded_root", "string", pa.string())], answer)
    return out.withColumn("id", F.col("id").cast(kind))


def tamper_check(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
                 text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """A manifest over ``docs`` and a check of a tampered copy against it: in
    rows where 2 divides the unsigned CRC-32 of the decimal id the copy has
    lost the ``\\n`` characters of its text, nothing else.

    One row per row of ``docs``: id, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (of the untampered rows), ``folded_root`` (from the copy's
    leaf and the stored siblings), ``verified`` (it equals the root).  Defined
    cases: nulls are written as ``-`` in a leaf, a null id is never tampered
    with and comes first in its group, a null source is a group of its own
    before the others; an empty text is ``0:``; repeated rows are leaves of
    their own, rows that repeat an id are ordered by digest; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    rows = pick(docs, *fields)
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    copy = F.when(tampered, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
    values = [F.col(f) for f in fields]
    m = manifest(rows, leaf_digest(values), leaf_digest([copy if f == text_col else F.col(f) for f in fields]), id_col, group_col,
                 height)
    out = verify(m)
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
