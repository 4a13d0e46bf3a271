"""The Merkle manifest against a plain version, and its van Emde Boas blocks."""

import hashlib
import random
import zlib

import pytest

from lagscope.llm import merkle
from .conftest import clashing


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(level):
    """Levels of a tree, the leaves first."""
    levels = [level]
    while len(level) > 1:
        level = [h("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
        levels.append(level)
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append(("".join(level[first:i]), "".join(level[i + 1:first + 3])))
        i //= 3
    return out


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf((r[0], r[1], r[2], r[3], r[4])))):
        trees.setdefault(row[1], []).append(row)
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: climb([leaf(r) for r in trees[s]]) for s in sources}
    top = climb([levels[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(trees[s]):
            way = path(levels[s], i) + path(top, k)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            at = leaf((*r[:4], text))
            for before, behind in way:
                at = h(before + at + behind)
            out.append((r[0], leaf(r), levels[s][-1][0], top[-1][0], h("".join(a + b for a, b in way)), at, at == top[-1][0]))
    return sorted(out, key=str)


def documents(spark, rows, parts=3):
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.repartition(parts) if rows else df


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


def test_places_are_a_permutation_split_at_half_height():
    for levels in range(1, 8):
        order = [merkle.place(d, i, levels) for d in range(levels) for i in range(3 ** d)]
        assert sorted(order) == list(range(merkle.size(levels)))
    # seven levels: the top three fill the first 13 places, then 27 subtrees of 40
    assert {merkle.place(d, i, 7) for d in range(3) for i in range(3 ** d)} == set(range(13))
    for k in range(27):
        below = {merkle.place(3 + d, k * 3 ** d + i, 7) for d in range(4) for i in range(3 ** d)}
        assert below == set(range(13 + 40 * k, 13 + 40 * (k + 1)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 100, 728, 729])
def test_block_alone_gives_the_plain_tree(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = climb(leaves)
    height = merkle.height_of(n, True)
    nodes = merkle.build([bytes.fromhex(x) for x in leaves], height)
    assert nodes[:32].hex() == levels[-1][0]
    for i in range(0, n, 1 if n < 30 else 37):
        want = [x for pair in path(levels, i) for x in pair]
        assert merkle.siblings(nodes, n, height, i) == want
        assert merkle.fold(leaves[i], want) == levels[-1][0]


def test_small_blocks_make_many_tiers(spark):
    """Blocks of nine leaves: several tiers for the hot source, partial last runs."""
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot"] * 12 + ["b", "ä", None]), "en", i % 7, f"a\n{i}\nb" if i % 3 else f"c{i}")
            for i in range(1, 900)]
    assert found(merkle.tamper_check(documents(spark, rows), height=2)) == plain(rows)


def test_nulls_empty_long_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "s", None, None, None), (2, "s", "en", 0, ""), (3, "s", "en", 5, "x\n" * 200_000), (4, None, "", 1, "\n\n"),
            (4, None, "", 1, "\n\n"), (4, "s", "en", 2, "other"), (4, "s", "en", 1, "ä€\n"), (None, "s", "en", 3, "no\nid"),
            (None, "", "en", 3, "empty source"), (7, "", None, None, "q")]
    want = plain(rows)
    assert found(merkle.tamper_check(clashing(documents(spark, rows)))) == want
    # a row whose text has no line break verifies although it is tampered with
    assert {w[-1] for w in want} == {True, False}


def test_copies_of_one_row_and_order_of_rows(spark):
    rows = [(5, "s", "en", 1, "same\n")] * 2000 + [(i, "s", "en", 1, str(i)) for i in range(1000)]
    want = plain(rows)
    assert found(merkle.tamper_check(documents(spark, rows, 5))) == want
    assert found(merkle.tamper_check(documents(spark, rows[::-1], 2))) == want


def test_one_row_and_empty_table(spark):
    rows = [(9, "s", "en", 1, "x")]
    assert found(merkle.tamper_check(documents(spark, rows))) == plain(rows)
    empty = merkle.tamper_check(documents(spark, []))
    assert empty.columns == COLS and empty.collect() == []


def test_manifest_is_stored_and_serves_any_row(spark):
    """The blocks alone (their bytes) lead from a leaf to the root."""
    from pyspark.sql import functions as F
    rows = [(i, "s", "en", 1, str(i)) for i in range(50)]
    docs = documents(spark, rows)
    digest = merkle.leaf_digest([F.col(c) for c in merkle.FIELDS])
    m = merkle.manifest(docs, digest, digest)
    block = m.groups.tiers[0].first()
    at = m.leaves.where("id = 17").first()
    way = merkle.siblings(bytes(block["nodes"]), block["n"], merkle.height_of(block["n"], block["only"]), at["pos"])
    assert merkle.fold(bytes(at["digest"]).hex(), way) == bytes(block["nodes"][:32]).hex()
    assert merkle.verify(m).where("folded_root <> root").count() == 0
