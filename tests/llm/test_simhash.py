import random

import numpy as np
import pytest
import xxhash

from lagscope.llm.components import components
from lagscope.llm.simhash import block_masks, fingerprint, near_duplicates, spanning_links

from .conftest import clashing


def plain_fingerprint(text):
    import re
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = d if r not in least else min(d, least[r])
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def result(df):
    return sorted([tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()], key=str)


def test_fingerprint_is_spark_xxhash64(spark):
    for s in ("a", "héllo wörld x y", "q" * 500):
        got = spark.sql("SELECT xxhash64(:s) AS h", args={"s": s}).first().h
        assert got % (1 << 64) == xxhash.xxh64_intdigest(s.encode(), 42)


@pytest.mark.parametrize("text", ["", "One", "a b c d", "A b\x0bc d\x1ce f\xa0g h a b c d e", "x " * 300])
def test_fingerprint_plain(text):
    assert fingerprint(text.encode()) == plain_fingerprint(text)


def test_every_close_pair_shares_a_block():
    rng = random.Random(3)
    masks = block_masks(7, 4)
    assert len(masks) == 35
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_spanning_links_keep_the_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 40)]]))
    links = spanning_links(fps, fps, 4)
    assert len(links) < len(fps)
    assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
    left, right = fps[::2], fps[1::2]
    across = spanning_links(left, right, 4)
    assert all(bin(a ^ b).count("1") <= 4 for a, b in across) and len(across) < len(fps)


def test_components_chain(spark):
    n = 3000
    edges = spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")
    out = components(edges)
    assert out.count() == n - 1 and out.where("root <> 0").count() == 0


def test_against_brute_force(docs_of, sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    rows += [(None, "one two three four five"), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one two three four five"),
             (9004, "one two three four five"), (9005, "long " * 40000), (9006, "long " * 40001), (None, "alone here it is now")]
    assert result(near_duplicates(clashing(docs_of(rows)))) == brute(rows)


def test_tiles_give_the_same_groups(docs_of):
    from lagscope.llm import simhash
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        w = list(words)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(400)] = "changed"
        rows.append((i, " ".join(w)))
    fps = simhash.fingerprints(docs_of(rows)).select("fp").distinct()
    whole = components(simhash.near_links(fps))
    tiled = components(simhash.near_links(fps, tile=5))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, tiled.collect()))


def test_empty(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
