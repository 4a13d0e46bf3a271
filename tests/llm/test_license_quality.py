import random
import re
from collections import Counter
from math import ceil

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lagscope.llm import license_scan as ls
from lagscope.llm import quality_rules as q

from .conftest import clashing

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_scan(doc, text):
    words = plain_words(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words))
              if words[i:i + len(p.split())] == p.split()]
    labels, score = {x for _, x in places}, 1.0 if places else 0.0
    for t in ls.LICENSES:
        tw = plain_words(t.text)
        step = 4
        while step < len(tw):
            step *= 2
        for start in range(0, max(1, len(words)), step):
            shared = len(set(tw) & set(words[start:start + 2 * step]))
            if shared >= ceil(t.threshold * len(set(tw)) - 1e-9):
                labels.add(t.label)
                score = max(score, shared / len(set(tw)))
    starts = [i for i, _ in places]
    return (doc, len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score)


EDGE = ["", None, "CC BY", "cc\nby cc-by CCBY cc by", "ALL RIGHTS\tRESERVED. all rights reserved", "İ ALL rights Reserved é",
        "Released under the MIT License.", "Released under the License. MIT", "general public general public license license",
        "cc by " * 5000, "x " * 50000 + "Licensed under CC BY-NC 4.0.", ls.LICENSES[1].text[:-14], ls.LICENSES[2].text.upper(),
        "and the of to license under version " * 300, "All rights" + " x" * 7 + " reserved"]


def test_scan_against_brute_force(docs_of, sf_docs):
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(None, "cc by"), (2, EDGE[2])]
    rows += [(r.doc_id + 100, r.text) for r in sf_docs.collect()]
    want = sorted((brute_scan(d, t) for d, t in rows), key=str)
    got = ls.license_scan(clashing(docs_of(rows))).drop("n_blocks").collect()
    assert sorted(map(tuple, got), key=str) == want


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.3, 1.0))
def test_filters_lose_no_block(seed, threshold):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(14)]
    templates = [ls.Template(f"t{i}", " ".join(rng.choices(vocab, k=rng.randint(1, 9))), threshold) for i in range(4)]
    words = rng.choices(vocab + ["other"] * 10, k=rng.randint(0, 90))
    index = ls.Index(templates, Counter(words))
    want = set()
    for e in index.entries:
        for start in range(0, len(words), e.step):
            block = set(words[start:start + 2 * e.step])
            if len(block & set(e.words)) >= ceil(threshold * len(set(e.words)) - 1e-9):
                want.add((e.template.label, start))
    assert {(m[0], m[2]) for m in index.matches(words)} == want


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(inside), failed)


PROSE = "The quick fox, it seems, jumped over {} lazy dogs and {} cats.\n"
TEXTS = ["", None, "a b c a b c", " \t\n\n \n", "é à\x0bx\x1cy z # <b>", "a a a a a", "same\nsame\nsame \n\n\n", "x" * 100000,
         "w " * 60000, "".join(PROSE.format(i, i * 7) for i in range(40))]


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n#\té", max_size=80))
def test_counts_property(text):
    assert q.judge(text.encode(), 50, 50, 0.6)[:6] == brute_counts(text)


def test_cleaning_against_brute_force(docs_of, sf_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[-1]), (2, TEXTS[2])]
    rows += [(r.doc_id + 100, r.text) for r in sf_docs.collect()]
    out = q.line_first_cleaning(clashing(docs_of(rows)))
    got = sorted(((r.doc_id, *r[1:7]) for r in out.collect()), key=str)
    assert got == sorted(((d, *brute_counts(t)) for d, t in rows), key=str)
    for r in out.where("base_failed").collect():
        assert not r.kept


@pytest.mark.parametrize("line, rule", [
    ("A plain sentence, with a comma and an end.", None), ("Er sagte: »Nein.«", None), ("Home | News | Sport | Contact", "navigation"),
    ("We use cookies on this site.", "boilerplate"), ("buy now best price here", "punctuation"),
    ("re*** ed%%% on### it### was.", "punctuation"), ("It ends here (at last)", None), ("wrapped line, that goes on", None)])
def test_line_rules(line, rule):
    assert q.line_fails(line) == rule


def test_verdict():
    prose = "".join(f"Line{i} tells, in word{i} and phrase{i}, of thing{i} here{i}.\n" for i in range(12))
    menu = "".join(f"Home{i} | News{i} | Sport{i} | More{i}\n" for i in range(60))
    n = q.judge(prose.encode(), 50, 50, 0.6)
    assert n[6] and n[7] == 0 and n[-1] == prose
    assert not q.judge((prose + menu).encode(), 50, 50, 0.6)[6]
    short = "".join(f"Home{i} | News{i} | Sport{i} | More{i}\n" for i in range(4))
    part = q.judge((prose + short).encode(), 50, 50, 0.6)
    assert part[6] and part[-1] == prose and part[9] == 4


def test_empty(docs_of):
    assert ls.license_scan(docs_of([])).count() == 0
    assert q.line_first_cleaning(docs_of([])).count() == 0
