import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lagscope.llm import chat, mixing

from .conftest import clashing


def brute_targets(sizes):
    """Share by weight, cap at twice the size, reshare the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        total = sum(weight[s] for s in free)
        target = {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / total for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    sources = [None, "a", "b", "ä", "z", "hot", "one"]
    rows = []
    for i in range(n):
        s = "hot" if rng.random() < 0.4 else rng.choice(sources[:-1])
        rows.append((i, " ".join(["w"] * min(4000, int(rng.paretovariate(1.1) * 20))), "en", s))
    return rows + [(n, "only words here", "en", "one"), (n + 1, "", "en", "empty"), (n + 2, None, "en", "a"),
                   (5, rows[5][1], "en", rows[5][3]), (None, "some null id", "en", "b"), (None, "some null id", "en", "b")]


def check_mix(rows, got):
    size = defaultdict(int)
    for _, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = brute_targets(size)
    source = {(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))): s for d, t, _, s in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = source[(r.doc_id, r.size)]
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        ratio = want[s] / size[s] if size[s] else 0
        assert r.taken in {int(ratio) * r.size, -(-ratio // 1) * r.size} and r.taken <= 2 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1e-6, (s, taken[s], want[s])


@pytest.mark.parametrize("chunk", [20_000, 40])
def test_mix_meets_targets_and_reruns_agree(docs_of, chunk):
    rows = corpus()
    got = mixing.mixture(clashing(docs_of(rows)), chunk=chunk).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    check_mix(rows, got)
    again = mixing.mixture(docs_of(rows[::-1], parts=2), chunk=chunk).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


def test_mixed_documents_repeat_rows(docs_of):
    rows = corpus(2, 200)
    df = clashing(docs_of(rows))
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.select("doc_id", "source").collect():
        words[r.doc_id] += 1
    taken = {}
    for r in mixing.mixture(docs_of(rows)).collect():
        if r.size:
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken // r.size
    assert {k: v for k, v in words.items() if k not in (200 + 1, 200 + 2)} == {k: v for k, v in taken.items() if v}


def test_a_key_with_a_third_of_the_rows_meets_its_target(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    for rows in ([(1, "seven words are in this one text", "en", "a")] * 1000,
                 [(1, "w " * 40, "en", "a")] * 300 + [(None, f"a{i} " * 30, "en", "a") for i in range(301)]
                 + [(2 + i, "w " * (1 + i % 50), "en", "b" if i % 3 else "a") for i in range(300)]):
        got = mixing.mixture(clashing(docs_of(rows)), chunk=50).collect()
        size, taken = Counter(), Counter()
        for _, t, _, s in rows:
            size[s] += len(t.split())
        want = brute_targets(size)
        assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(t.split())) for d, t, _, _ in rows)
        for r in got:
            s = next(s for s in want if want[s] == pytest.approx(r.target))
            assert r.taken // r.size in {int(want[s] / size[s]), -int(-want[s] // size[s])}
            taken[s] += r.taken
        for s in size:
            assert abs(taken[s] - want[s]) <= 2 * max(len(t.split()) for _, t, _, x in rows if x == s), (s, taken[s], want[s])
        again = mixing.mixture(docs_of(rows[::-1], parts=2), chunk=50).collect()
        assert sorted(got, key=str) == sorted(again, key=str)
        out = mixing.mixed_documents(clashing(docs_of(rows)), chunk=50).collect()
        assert Counter(r.doc_id for r in out) == sum((Counter({r.doc_id: r.taken // r.size}) for r in got), Counter())
        assert {(r.doc_id, r.text, r.source) for r in out} <= {(d, t, s) for d, t, _, s in rows}


def test_flight_keeps_totals_and_probabilities():
    rng = random.Random(4)
    units = [(i, 1, rng.randint(1, 500), 0.3) for i in range(300)]
    hits = Counter()
    for trial in range(300):
        p = dict(mixing.fly(iter(units), random.Random(trial), last=False))
        open_units = [i for i, x in p.items() if 0 < x < 1]
        assert len(open_units) <= 2 and len(p) == 300
        assert sum(p.values()) == pytest.approx(90, abs=1e-6)
        assert sum(p[i] * w for i, _, w, _ in units) == pytest.approx(sum(0.3 * w for _, _, w, _ in units), rel=1e-6)
        landed = dict(mixing.fly(iter(units), random.Random(trial), last=True))
        assert set(landed.values()) <= {0.0, 1.0}
        hits.update(i for i, x in landed.items() if x == 1)
    assert all(0.15 < hits[i] / 300 < 0.45 for i in range(300))


def test_mix_empty(docs_of):
    assert mixing.mixture(docs_of([])).count() == 0
    assert mixing.mixed_documents(docs_of([])).count() == 0


def brute_chat(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: tuple(x[2:] for x in sorted(v)) for c, v in convs.items()}
    same = defaultdict(list)
    for c, v in turns.items():
        same[v].append(c)
    proper = {v[:k] for v in turns.values() for k in range(1, len(v))}
    out = []
    for v, cs in same.items():
        if v not in proper:
            ids = [c for c in cs if c is not None]
            text = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)
            out.append((min(ids) if ids else None, 0, len(v), len(cs), text))
    return sorted(out, key=str)


CHAT = "conv_id bigint, turn bigint, role string, text string"
EDGE = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 5, "user", "hi"), (3, 900, "bot", "yo"),
        (3, 901, "user", "more"), (4, 0, None, None), (5, 0, "", ""), (5, 1, "u", None), (6, 3, "u", "x"), (6, 3, "a", "x"),
        (6, 3, "a", "x"), (7, None, "u", "n"), (7, 1, "u", "m"), (None, 0, "user", "hi"), (None, 1, "bot", "yo"),
        (8, 0, "user", "z" * 200000), (9, -3, "user", "neg"), (9, 2, "user", "pos")]


def test_chat_against_brute_force(spark):
    rng = random.Random(2)
    rows = list(EDGE)
    for c in range(100, 260):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, "user", rng.choice("ab")))
    df = spark.createDataFrame(rows, CHAT).repartition(4)
    assert sorted(map(tuple, chat.chat_texts(clashing(df)).collect()), key=str) == brute_chat(rows)
    h = chat.prefix_hashes(df, segment=2)
    wide = chat.prefix_hashes(df, segment=1000)
    assert sorted(map(str, h.collect())) == sorted(map(str, wide.collect()))


def test_chat_parts_and_native_plan(spark):
    rows = [(1, i, "u", f"t{i}") for i in range(10)]
    out = chat.chat_texts(spark.createDataFrame(rows, CHAT), rendered_turns=4).orderBy("part").collect()
    assert [r.part for r in out] == [0, 1, 2] and "".join(r.text for r in out) == brute_chat(rows)[0][4]
    plan = chat.prefix_hashes(spark.createDataFrame(rows, CHAT))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_hot_conversations_without_turn_numbers_are_many_tasks(spark):
    """A third of all turns have a null number, a third are one row again and
    again: both conversations are split over ranges, and come out whole."""
    n = 4000
    rows = [(1, None, "u", f"t{i % 977}") for i in range(n)] + [(2, 7, "u", "same")] * n
    rows += [(i, 0, "u", f"t{i}") for i in range(10, 10 + n)]
    df = spark.createDataFrame(rows, CHAT).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        starts = chat.run_starts(chat.sorted_turns(df)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_task, runs = Counter(), Counter()
    for r in starts:
        per_task[r.key.run] += r.k
        runs[r.key.conv] += 1
        assert r.n == (n if r.key.conv < 10 else 1)
    assert runs[1] > 1 and runs[2] > 1 and max(per_task.values()) < n
    out = chat.chat_texts(df, rendered_turns=100)
    want = {k: [x for x in brute_chat([r for r in rows if r[0] == k])][0][4] for k in (1, 2)}
    for k in (1, 2):
        parts = out.where(F.col("conv_id") == k).orderBy("part").collect()
        assert [p.part for p in parts] == list(range(n // 100)) and "".join(p.text for p in parts) == want[k]
    assert out.where("conv_id >= 10").count() == n


def test_chat_empty(spark):
    assert chat.chat_texts(spark.createDataFrame([], CHAT)).count() == 0
