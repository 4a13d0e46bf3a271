import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from lagscope.llm import lang_id
from lagscope.llm.lang_id import Models, codes_of

from .conftest import clashing


def plain(text):
    s = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    s = " ".join(s.split(" ")).strip()
    while "  " in s:
        s = s.replace("  ", " ")
    return "   " + s + " " if s else ""


class BruteModel:
    """Interpolated Kneser-Ney by dictionaries, straight from the definition."""

    def __init__(self, texts, size, order=4):
        self.order, self.size = order, size
        self.counts = {order: Counter(p[i:i + order] for p in map(plain, texts) for i in range(len(p) - order + 1) if p)}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for k, c in self.counts.items():
            one, two = (sum(v == x for v in c.values()) for x in (1, 2))
            self.discount[k] = one / (one + 2 * two) if one and two else 0.5
            self.total[k], self.kinds[k] = Counter(), Counter()
            for g, v in c.items():
                self.total[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / self.size
        low = self.p(gram[1:])
        total = self.total[k][gram[:-1]]
        if not total:
            return low
        seen = max(self.counts[k][gram] - self.discount[k], 0) if gram in self.counts[k] else 0
        return seen / total + self.discount[k] * self.kinds[k][gram[:-1]] / total * low

    def ce(self, text):
        s = plain(text)
        n = len(s) - self.order + 1
        return -sum(math.log(self.p(s[i:i + self.order])) for i in range(n)) / n


TRAIN = {"en": ["the cat sat on the mat", "there is the house, and that is all", "on and on the other hand"],
         "de": ["der hund und die katze", "über den fluß gehen die bären", "und das ist alles"]}


def counts():
    rows = Counter((x, p[i:i + 4]) for x, ts in TRAIN.items() for p in map(plain, ts) for i in range(len(p) - 3))
    return pd.DataFrame([(x, g, n) for (x, g), n in sorted(rows.items())], columns=["lang", "gram", "n"])


def test_models_equal_the_definition():
    c = counts()
    models = Models.fit(c)
    size = len({g[-1] for g in c["gram"]}) + 1
    brute = {x: BruteModel(ts, size) for x, ts in TRAIN.items()}
    texts = ["the hand", "Über alles!", "zzz qqq", "x", "katze the fluß 漢字 12 ok"] + TRAIN["en"]
    _, ce = models.cross_entropies(texts)
    for t, row in zip(texts, ce):
        for x, value in zip(models.langs, row):
            assert value == pytest.approx(brute[x].ce(t), rel=1e-4)
    # each model is a distribution over characters and one unknown
    alphabet = sorted({g[-1] for g in c["gram"]}) + ["一"]
    for context in ("the", "und", "   ", "xyz"):
        codes = np.array([list(map(ord, context + a)) for a in alphabet], np.uint32)
        p = np.array([np.exp(models.log_probabilities(row)[0]) for row in codes])
        assert p.sum(0) == pytest.approx(1, abs=1e-4)
    assert all(np.all(g[1:] > g[:-1]) for g in models.grams)


@pytest.mark.parametrize("text", ["", "12 !", "Abc", "a", " a  b..C", "é-à\n\nñ", "İstanbul ǅ", "漢 字", "x" * 30])
def test_codes(text):
    assert "".join(map(chr, codes_of(text))) == plain(text)


def test_long_texts_are_scored_whole(monkeypatch):
    models = Models.fit(counts())
    texts = ["the cat and the hand " * 400, "und das ist " * 300, "", "über den fluß"]
    whole = models.cross_entropies(texts)
    monkeypatch.setattr(lang_id, "POSITIONS", 37)
    parts = models.cross_entropies(texts)
    assert whole[0].tolist() == parts[0].tolist() and np.allclose(whole[1], parts[1], rtol=1e-5)


def test_held_out_accuracy_and_cases(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = lang_id.fit(docs)
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    noise = random.Random(1)
    extra = [(50000, None, None), (50001, "12 !! 34", "en"), (None, "the and of", "en"), (50002, "", "xx"),
             (50003, " ".join("".join(noise.choices("qxzjvkw", k=7)) for _ in range(200)), "en"),
             (50004, "漢字かな交じり文" * 100, "ja")]
    out = lang_id.languages(clashing(docs_of(rows + extra)), models).collect()
    assert len(out) == len(rows) + len(extra)
    by = {r.doc_id: r for r in out}
    held = [(d, x) for d, t, x in rows if x is not None and zlib.crc32(str(d).encode()) % 5 == 0
            and t and any(c.isalpha() for c in t)]
    assert all(by[d].held_out for d, _ in held) and sum(r.held_out for r in out) >= len(held)
    right = sum(by[d].lang_pred == x for d, x in held)
    assert right / len(held) > 0.95, right / len(held)
    assert sum(by[d].rejected for d, t, _ in rows if t and any(c.isalpha() for c in t)) <= len(rows) // 200
    for d in (50000, 50001, 50002):
        assert by[d].lang_pred == "und" and by[d].score == 0 and by[d].rejected
    assert by[50003].rejected and by[50004].rejected and by[None].held_out
    assert all(0 <= r.score <= 1 for r in out)
    kept = lang_id.accepted(clashing(docs_of(rows + extra)), models)
    assert sorted(map(str, [r[0] for r in kept.collect()])) == sorted(str(r.doc_id) for r in out if not r.rejected)


def test_rejects_unlearned_latin_and_gibberish_beside_a_large_alphabet(spark, docs_of):
    noise = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    signs = [chr(0x4E00 + i) for i in range(4000)]
    large = [(100000 + i, "".join(noise.choices(signs, range(4000, 0, -1), k=300)), "zh") for i in range(120)]
    models = lang_id.fit(docs_of([(r.doc_id, r.text, r.lang) for r in docs if r.lang != "es"] + large))
    assert models.langs == ["de", "en", "fr", "zh"] and models.chance > 8

    def rejected(texts):
        return models.predict(texts)[3].mean()

    assert rejected([r.text for r in docs if r.lang == "es" and r.text and len(r.text) >= 200]) > 0.95
    assert rejected(["".join(noise.choices("etaoinshrdlu     ", k=300)) for _ in range(50)]) == 1
    held = [r.text for r in docs if r.lang not in (None, "es") and r.text and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    pieces = [" ".join(t.split()[4:4 + k]) for t in held for k in (2, 5, 10) if len(t.split()) > 20]
    assert rejected(held) < 0.03 and rejected(pieces) < 0.03
    assert rejected([t[:20] for _, t, _ in large]) < 0.03


def test_cut_depends_on_length():
    models = Models.fit(counts())
    text = "the hand and the cat"
    n, ce = models.cross_entropies([text])
    models.cut = np.array([[ce[0].min() - 0.1, 1.0]] * 2)
    assert not models.predict([text])[3][0] and models.predict([" ".join([text] * 400)])[3][0]


def test_every_row_calibrates_and_a_language_of_fold_1_is_learned(docs_of, monkeypatch):
    ids = defaultdict(list)
    for i in range(3000):
        ids[zlib.crc32(str(i).encode()) % 5].append(i)
    seen = []
    cuts = lang_id._cuts
    monkeypatch.setattr(lang_id, "_cuts", lambda rows, models: (seen.append(rows.count()), cuts(rows, models))[1])
    rows = [(i, "the cat and that", "en") for f in (1, 2) for i in ids[f][:300]]
    rows += [(i, "über den fluß", "de") for i in ids[1][300:308]] + [(ids[2][300], "12 !", "de")]
    models = lang_id.fit(docs_of(rows))
    assert seen == [300] and models.langs == ["de", "en"] and np.isfinite(models.cut).all()


def test_learns_only_outside_the_held_out_fold(docs_of):
    ids = defaultdict(list)
    for i in range(400):
        ids[zlib.crc32(str(i).encode()) % 5].append(i)
    rows = [(i, "the cat and that", "en") for f in (1, 2, 3) for i in ids[f][:8]]
    rows += [(i, "never learned", "held") for i in ids[0][:8]] + [(None, "no id", "nul")]
    assert lang_id.fit(docs_of(rows)).langs == ["en"]


def test_nothing_to_learn(docs_of):
    empty = docs_of([])
    models = lang_id.fit(empty)
    assert lang_id.languages(empty, models).count() == 0
    row = lang_id.languages(docs_of([(1, "text", None)]), models).first()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
