"""The whole pipeline against plain versions of its stages."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lagscope.llm import lang_id

from .conftest import clashing
from .test_mixing_chat import brute_targets
from .test_simhash import plain_fingerprint

LIB = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = [docs]
    from lagscope.llm.common import stage
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], "/root/testdata/sf0.001"), "test-pipeline"))
    return out


def test_language_stage(staged):
    before, after = staged[0], staged[1]
    assert after.schema.simpleString() == before.schema.simpleString()
    rows = {r.doc_id: r for r in lang_id.languages(before, lang_id.fit(before)).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, r in rows.items() if not r.rejected}
    assert after.count() >= 0.98 * before.count()


def test_exact_stage(staged):
    best = {}
    for r in staged[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (0, float("inf"))), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in staged[2].collect()) == sorted(d for _, d in best.values())
    assert staged[2].columns == staged[0].columns


def test_near_stage(staged):
    rows = sorted((r.doc_id, plain_fingerprint(r.text)) for r in staged[2].collect())
    label = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for d, f in rows:
            least = min(label[e] for e, g in rows if bin(f ^ g).count("1") <= 4)
            if least < label[d]:
                label[d], changed = least, True
    assert sorted(r.doc_id for r in staged[3].collect()) == sorted({x for x in label.values()})


def test_mixing_stage(staged):
    before, after = staged[3].collect(), staged[4].collect()
    size, largest, taken = Counter(), Counter(), Counter()
    for r in before:
        size[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    for r in after:
        taken[r.source] += words(r.text)
    assert max(Counter(r.doc_id for r in after).values()) <= 2
    for s, t in brute_targets(size).items():
        assert abs(taken[s] - t) <= 2 * largest[s]


def test_encoding_stage_and_run(spark, staged):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in staged[4].collect():
        ids = LIB.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text)))
    assert sorted(map(tuple, staged[5].collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_hard_rows_pass_every_stage(spark, docs_of):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "the end of a null id"), (None, "the end of a null id"), (4, "12 !!"),
            (5, "word " * 50000), (6, "the same"), (6, "the same"), (6, "other text, the same id"), (7, "the\nsame", None, None)]
    rows += [(100 + i, f"the line number {i} of that and this", "en", f"s{i % 3}") for i in range(60)]
    docs = clashing(docs_of(rows))
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, "")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(docs.columns) == 17
        assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
    empty = docs_of([])
    for name, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, "")
        assert empty.count() == 0
