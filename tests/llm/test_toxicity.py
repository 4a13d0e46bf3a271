"""Nearest labelled examples: the index against brute force, held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lagscope.llm import toxicity as tox
from .conftest import clashing

BAD = ["grobian", "vilain", "schurke", "tontoxyz"]


def unit(rnd, features, most=12):
    ids = sorted(rnd.sample(range(features), rnd.randint(1, most)))
    w = [rnd.choice([1.0, 1.0, 2.5, rnd.random()]) for _ in ids]
    norm = math.sqrt(sum(x * x for x in w))
    return ids, [x / norm for x in w]


@pytest.mark.parametrize("block", [1, 4, 64])
def test_nearest_equals_brute_force(block):
    rnd = random.Random(block)
    for features, many, k in ((5, 40, 3), (60, 500, 15), (60, 7, 15)):
        examples = [(i, rnd.randint(0, 1), *unit(rnd, features, min(features, 12))) for i in range(many)]
        index = tox.Index(examples, features, block)
        dense = np.zeros((many, features))
        place = {e: i for i, e in enumerate(index.ids)}
        for e, _, ids, weights in examples:
            dense[place[e], ids] = weights
        for _ in range(60):
            ids, weights = unit(rnd, features, min(features, 12))
            q = np.zeros(features)
            q[ids] = weights
            cosines = dense @ q
            rows, got = index.nearest(ids, weights, k)
            # equal cosines may differ in their last bits: compare values, then members above the last value
            want = sorted((c for c in cosines if c > 0), reverse=True)[:k]
            assert np.allclose(got, want, atol=1e-12) and len(set(rows.tolist())) == len(rows)
            assert np.allclose(cosines[rows], got, atol=1e-12)


def test_index_skips_blocks():
    """Only the blocks whose bound reaches the k-th cosine are scored."""
    examples = [(i, 0, [i // 64], [1.0]) for i in range(640)]
    index = tox.Index(examples, 10)
    index.weights[64 * 3:] = np.nan  # would show in a result if it were read
    rows, cosines = index.nearest([0, 1], [0.9, math.sqrt(1 - 0.81)], 5)
    assert rows.tolist() == [0, 1, 2, 3, 4] and np.allclose(cosines, 0.9)


def test_curve_is_monotone_and_follows_the_rates():
    points = tox.curve([(2, 100, 1), (10, 50, 5), (40, 10, 4), (45, 10, 2), (80, 40, 39)], 0.2)
    assert points == sorted(points) and points[0] < 0.03 and points[-1] > 0.9
    assert abs(points[42] - (6 + 0.2) / 21) < 0.02   # the two bins that fall are one
    assert tox.curve([(5, 10, 0)], 0.1) == [i / 100 for i in range(101)]


def table(seed=1, many=900):
    rnd = random.Random(seed)
    stems = ["ba", "ko", "lu", "mi", "ren", "tas", "ul", "vo", "we", "zi"]
    rows, labels = [], []
    for d in range(many):
        words = ["".join(rnd.choice(stems) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 60))]
        y = int(rnd.random() < 0.25)
        if y:
            for _ in range(rnd.randint(2, 5)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "en", "s", "%%"]))
        rows.append((d, " ".join(words)))
        if d % 3:
            labels.append((d, y))
    return rows, labels, {d: int(any(b in t for b in BAD)) for d, t in rows}


def labels_of(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_rows_are_told_apart(spark, docs_of):
    rows, labels, truth = table()
    got = tox.toxicity(docs_of(rows), labels_of(spark, labels)).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in rows]
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        # evidence: labelled, learned rows only, nearest first
        assert len(r.evidence) == len(r.cosines) == len(r.evidence_labels) <= 3
        assert list(r.cosines) == sorted(r.cosines, reverse=True)
        for e, y in zip(r.evidence, r.evidence_labels):
            assert dict(labels)[e] == y and zlib.crc32(str(e).encode()) % 3 != 1
    tested = [r for r in got if r.held_out]
    caught = [r.predicted for r in tested if truth[r.doc_id]]
    wrong = [r.predicted for r in tested if not truth[r.doc_id]]
    assert sum(caught) / len(caught) > 0.95 and sum(wrong) / len(wrong) < 0.01


def test_counts_and_vectors_by_definition(spark, docs_of):
    rows, labels, _ = table(2, 300)
    text = dict(rows)
    pairs = spark.createDataFrame([(text[d], y) for d, y in labels], "text string, y int").repartition(3)
    want = [Counter(), Counter()]
    for d, y in labels:
        want[y].update({""}.union(*map(tox.features_of, tox.words_of(text[d]))))
    got = {r.feature: (r.clean, r.toxic) for r in tox.document_counts(pairs).collect()}
    assert got == {f: (want[0][f], want[1][f]) for f in want[0] | want[1]}
    vocabulary = tox.Vocabulary.fit(pairs)
    n = [want[0][""], want[1][""]]

    def g2(f):
        cells, total = [], sum(n)
        for y in (0, 1):
            for seen, all_ in ((want[y][f], want[0][f] + want[1][f]), (n[y] - want[y][f], total - want[0][f] - want[1][f])):
                cells.append(seen * math.log(seen * total / (all_ * n[y])) if seen else 0.0)
        return 2 * sum(cells)

    bar = 2 * math.log(len(got) - 1)
    assert set(vocabulary.features) == {f for f in got if f and sum(got[f]) >= 3 and g2(f) > bar}
    assert any(f.startswith("grob") for f in vocabulary.features)
    ids, weights = tox.Vectors(vocabulary).of("Grobian grobians und BAKO")
    assert abs(sum(w * w for w in weights) - 1) < 1e-12 and ids == sorted(ids)


def test_nulls_copies_long_and_clashing_columns(spark, docs_of):
    rows, labels, _ = table(3, 600)
    bad = " ".join(BAD)
    rows += [(2000, None), (2001, ""), (2002, "1234 %%"), (None, bad), (2003, bad), (2003, bad), (2004, "x" * 300_000),
             (2005, (bad + " ") * 20_000)]
    labels += [(1, None), (None, 1), (2, 1), (2, 0), (3, 7)] + [(2001, 0)]
    docs, marks = clashing(docs_of(rows)), clashing(labels_of(spark, labels))
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in tox.toxicity(docs, marks).collect()), key=str)
    again = sorted(((r.doc_id, r.held_out, r.score, r.predicted)
                    for r in tox.toxicity(docs.repartition(2), marks.repartition(1)).collect()), key=str)
    assert got == again and len(got) == len(rows)
    by = {d: (s, p) for d, _, s, p in got}
    assert by[2000] == by[2001] == by[2002] == by[2004] and by[2000][1] == 0
    assert by[2003][1] == by[2005][1] == by[None][1] == 1
    assert [h for d, h, _, _ in got if d is None] == [False]


def test_without_labels_or_rows(spark, docs_of):
    rows = [(i, "wording " * i) for i in range(6)]
    none = tox.toxicity(docs_of(rows), labels_of(spark, []))
    assert {r.score for r in none.collect()} == {0.5}
    one = tox.toxicity(docs_of(rows), labels_of(spark, [(i, 0) for i in range(6)])).collect()
    assert len(one) == 6 and {r.predicted for r in one} == {0}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert tox.toxicity(empty, labels_of(spark, [(1, 1)])).collect() == []


def test_given_tables(spark):
    """Held-out rows of the given tables: 85 of 144 toxic ones at the threshold
    0.7, none of 1200 others (2600 labelled rows to learn from, many toxic ones
    with invented words that clean texts have too)."""
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    got = tox.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    caught = [p for y, p in got if y]
    wrong = [p for y, p in got if not y]
    assert sum(caught) / len(caught) > 0.55 and sum(wrong) / len(wrong) < 0.01
