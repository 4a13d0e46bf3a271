import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lagscope.llm import exact_dedup
from lagscope.llm.exact_dedup import FINGERPRINT_BITS, QuotientFilter, deduplicated, duplicates

from .conftest import clashing


def brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(norm, []).append((-len(t or ""), d is None, d, i))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] if m[2] is not None else 0))
        for m in members:
            out.append((m[2], best[2], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


fps = st.lists(st.integers(0, 2**FINGERPRINT_BITS - 1) | st.integers(0, 40), max_size=200)


@settings(max_examples=80, deadline=None)
@given(fps, fps)
def test_filters_merge_without_loss(a, b):
    def make(x):
        return QuotientFilter.of(*[v.astype(t) for v, t in zip(np.unique(np.array(x, np.uint64), return_counts=True),
                                                               (np.uint64, np.int64))])
    both, counts = QuotientFilter.load(make(a).merge(QuotientFilter.load(make(b).dump())).dump()).items()
    want, n = np.unique(np.array(a + b, np.uint64), return_counts=True)
    assert both.tolist() == want.tolist() and counts.tolist() == n.tolist()


ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \r\n"), (7, "a\u00a0b"), (None, "ab   "),
        (None, "only me"), (8, "x" * 100000), (9, "x " * 100000), (10, "x" * 99999), (11, "é à"), (12, "éà "), (11, "é à")]


def test_against_brute_force(docs_of, sf_docs):
    rows = ROWS + [(r.doc_id + 100, r.text) for r in sf_docs.collect()]
    out = duplicates(clashing(docs_of(rows)))
    got = out.collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_colliding_fingerprints_are_verified(docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FINGERPRINT_BITS", 48)
    rows = [(i, f"text {i % 50}") for i in range(120)]
    df = exact_dedup.digests(docs_of(rows)).selectExpr("id", "raw", "points", "bytes", "sha", "fp % 3 AS fp")
    monkeypatch.setattr(exact_dedup, "digests", lambda *a: df)
    got = duplicates(docs_of(rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)


def test_deduplicated_keeps_whole_rows(docs_of):
    out = deduplicated(clashing(docs_of(ROWS)))
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(out.columns) == 17
    got = sorted([(r[0], r[1]) for r in out.collect()], key=str)
    want = [(3, " a\tb\n"), (6, " \r\n"), (7, "a\u00a0b"), (None, "only me"), (9, "x " * 100000), (10, "x" * 99999), (11, "é à")]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("f", [duplicates, deduplicated])
def test_empty(docs_of, f):
    assert f(docs_of([])).count() == 0
