"""Spelling variants against a plain version over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from lagscope.llm import spelling
from .conftest import clashing


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def counted(rows):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def plain(words):
    forms, out = {}, []
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] < 5 * n:
            best = None
        forms[w] = best
        out.append([w, best, w, n, len(others), None if best is None else words[best]])
    for row in out:
        while forms[row[2]] is not None:
            row[2] = forms[row[2]]
    return sorted(map(tuple, out), key=str)


COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def found(df):
    assert sorted(df.columns) == sorted(COLS)
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


SPANS = [[(0, 3), (3, None)], [(0, 3), (3, 9), (9, None)], [(0, 1), (1, 3), (3, 4), (4, 6), (6, 9), (9, 10), (10, 21), (21, None)]]


@pytest.mark.parametrize("spans", SPANS)
def test_partitions_meet_each_near_pair_once(spans):
    rnd = random.Random(3)
    for _ in range(60):
        words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 11))) for _ in range(rnd.randint(1, 150))})
        want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if near(a, b)}
        got = []
        for a, b in spans:
            groups = {}
            for w in words:
                if len(w) >= a and b is None:
                    groups.setdefault(w[:a], []).append(("v", w[a:], w, 1))
                elif len(w) >= a:
                    groups.setdefault((w[:a], w[b:]), []).append(("v", w[a:b], w, 1))
                    groups.setdefault((w[:a], w[b + 1:]), []).append(("u", w[a:b + 1], w, 1))
            for rows in groups.values():
                got += [frozenset((x[0], y[0])) for x, y in spelling.near_words(rows, a, b)]
        assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal_and_numbers_its_words():
    rnd = random.Random(1)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(200)})
    acceptors = spelling.Acceptors()
    root = acceptors.of(words)
    assert acceptors.count[root] == len(words)
    for i, w in enumerate(words):
        at, skipped = root, 0
        for c in w:
            at, skip = acceptors.next[at][c]
            skipped += skip
        assert acceptors.final[at] and skipped == i
    # right languages of the prefixes, one state each (and none besides)
    languages = {frozenset(w[len(p):] for w in words if w.startswith(p)) for x in words for p in
                 (x[:k] for k in range(len(x) + 1))}
    assert len(acceptors.final) == len(languages)


def misspelt(rnd, word):
    i = rnd.randrange(len(word))
    return rnd.choice([word[:i] + word[i + 1:], word[:i] + rnd.choice("aeñÿ") + word[i:], word[:i] + "o" + word[i + 1:]])


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    base = ["therapy", "thereof", "reading", "readings", "breading", "aaaaaaa", "aaaaaaaa", "über×÷ßen", "Straßen", "naïveté"]
    rows = []
    for doc in range(400):
        words = [rnd.choice(base) for _ in range(12)]
        words += [misspelt(rnd, rnd.choice(base)) for _ in range(3)]
        rows.append((doc, rnd.choice([" ", ", ", "-", "4"]).join(rnd.choice([w, w.upper(), w.title()]) for w in words)))
    # forms of forms
    return rows + [(1000, 'chainab ' * 6), (1001, 'chainabc ' * 40), (1002, 'chainabcd ' * 250)]


def test_variants_equal_the_plain_version(spark, docs_of, texts):
    words = counted(texts)
    want = plain(words)
    assert any(r[1] for r in want) and any(r[1] and r[1] != r[2] for r in want)  # a form's form
    assert found(spelling.spelling_variants(docs_of(texts))) == want


def test_hot_partitions_are_cut(spark, docs_of, texts):
    """With two words a partition, every start is cut down to single symbols."""
    words = counted(texts)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint")
    assert found(spelling.variant_groups(df, most=2)) == plain(words)


def test_pairs_once(spark):
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 9))) for _ in range(250)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    got = [frozenset((r.word, r.other)) for r in spelling.near_pairs(df, most=20).collect()]
    want = {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_nulls_long_runs_copies_empty_and_clashing_columns(spark, docs_of):
    long = "abcdefgh" * 5_000
    rows = [(1, None), (2, ""), (None, "wording " * 7), (3, f"{long} " * 3), (4, f"{long}x {long} {long}"), (5, f"{long}x " * 4),
            (6, "wordin " * 30), (6, "wordin " * 30), (7, "×÷ÀÀÀÿ " * 5), (8, "Ŵordin wordin1wordin")]
    want = plain(counted(rows))
    assert found(spelling.spelling_variants(clashing(docs_of(rows)))) == want
    assert {r[0] for r in want} >= {long, "wordin"}


def test_empty_table(spark, docs_of):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert found(spelling.spelling_variants(df)) == []
