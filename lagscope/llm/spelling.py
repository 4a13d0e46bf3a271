"""Spelling variants: words one edit apart, found by composing automata.

The vocabulary is a minimised acyclic acceptor A.  Composed with a transducer T
that makes exactly one edit, and with A again, it accepts the pairs of near
words: a state of A . T . A is a state of either acceptor and whether the edit
is made.  Until the edit both acceptors read the same symbols, so a pair is
known by the state it has reached after a common start, and the pairs are
enumerated per such initial state, each partition with the acceptor of what may
follow there:

* pairs that agree in their first ``START`` symbols meet at the state after
  them; the composed machine runs over all the rest;
* pairs whose edit lies within the first ``START`` symbols agree in what
  follows it; they meet by that rest, and the machine runs over the start.

A partition that holds more than ``MOST`` words (one start may belong to any
part of the vocabulary) is cut again in the same two ways, by a longer common
start and by an edit between the two starts; a span of one symbol can't be cut
and is bounded by the alphabet.  Nothing is capped or dropped, and a pair is
accepted along one path only: an inserted symbol counts at the last place
where it can stand.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, runs, small_batches, stage

# Letters of a run, as UTF-8 (A-Z are lower-cased before), the
# divisor of a run's CRC-32 that makes a variant, the shortest word, the least
# count of a word, and how many times more frequent a form has to be.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){6,}")
EVERY, SHORTEST, LEAST, TIMES = 199, 6, 5, 5

#: Symbols of the common start, words of a partition before it is cut, runs
#: counted in a worker before they are sent on.
START, MOST, HELD = 3, 8192, 200_000


# -- the vocabulary ----------------------------------------------------------

def text_runs(doc: str, text: bytes) -> Counter:
    """Words of at least six symbols in a text and how often they occur, after
    the noise that the CRC-32 of ``<doc>:<run>`` makes."""
    found = Counter(RUN.findall(text.lower()))  # bytes.lower() touches A-Z only
    start, out = zlib.crc32(f"{doc}:".encode()), Counter()
    for run, n in found.items():
        h = zlib.crc32(run, start)
        if h % EVERY == 0:
            word = run.decode()
            at = h % len(word)
            run = (word[:at] + word[at + 1:]).encode()
        out[run] += n
    return out


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(word, n)``: words of at least ``SHORTEST`` symbols that occur at
    least ``LEAST`` times, counted over all rows.  Workers add up what they
    see and pass on at most ``HELD`` words at a time."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            words = [w.decode() for w in held]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())],
                                               ["word", "n"])
            held.clear()
            return batch

        for b in small_batches(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.update(text_runs(doc, text))
                if len(held) >= HELD:
                    yield sent()
        yield sent()

    src = pick(docs, id_col, text_col)
    texts = src.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    return (texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
            .where((F.char_length("word") >= SHORTEST) & (F.col("n") >= LEAST)))


# -- acceptors and their composition -----------------------------------------

class Acceptors:
    """Minimised acyclic acceptors that share their states.

    A state is known by whether it is final and its transitions; the same right
    language is one state, whichever acceptor reaches it.  ``count`` is the
    number of words a state accepts: the words of an acceptor are numbered in
    order, and ``skip`` is how many of them a transition passes over.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []

    def state(self, moves: tuple, final: bool) -> int:
        at = self.known.get((final, moves))
        if at is None:
            at = self.known[(final, moves)] = len(self.final)
            out, total = {}, int(final)
            for symbol, to in moves:
                out[symbol] = (to, total)
                total += self.count[to]
            self.final.append(final)
            self.next.append(out)
            self.count.append(total)
        return at

    def of(self, words: list[str]) -> int:
        """The initial state of the acceptor of ``words`` (sorted, distinct):
        states are closed from the end of a word as soon as the next word
        leaves it."""
        open_: list[tuple[list, bool]] = [([], False)]  # moves so far, final
        before = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                moves, final = open_.pop()
                open_[-1][0].append((before[len(open_) - 1], self.state(tuple(moves), final)))

        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            close(same)
            open_.extend(([], False) for _ in range(same, len(word)))
            open_[-1] = (open_[-1][0], True)
            before = word
        close(0)
        moves, final = open_[0]
        return self.state(tuple(moves), final)

    def both(self, one: int, two: int, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Words that two states accept alike, by their numbers."""
        todo = [(one, two, i, j)]
        while todo:
            one, two, i, j = todo.pop()
            if one == two:
                for k in range(self.count[one]):
                    yield i + k, j + k
                continue
            if self.final[one] and self.final[two]:
                yield i, j
            there = self.next[two]
            for symbol, (to, skip) in self.next[one].items():
                if symbol in there:
                    to2, skip2 = there[symbol]
                    todo.append((to, to2, i + skip, j + skip2))

    def replaced(self, one: int) -> Iterator[tuple[int, int]]:
        """A . T . A with T replacing one symbol, each pair once."""
        todo = [(one, 0)]
        while todo:
            at, i = todo.pop()
            moves = list(self.next[at].values())
            for k, (to, skip) in enumerate(moves):
                todo.append((to, i + skip))
                for to2, skip2 in moves[:k]:
                    yield from self.both(to, to2, i + skip, i + skip2)

    def deleted(self, one: int, two: int, ends: bool) -> Iterator[tuple[int, int]]:
        """A . T . B with T deleting one symbol of the first word, where the
        second goes on with another one.  ``ends``: or where it ends."""
        todo = [(one, two, 0, 0)]
        while todo:
            one, two, i, j = todo.pop()
            there = self.next[two]
            for symbol, (to, skip) in self.next[one].items():
                if ends and self.final[two] and self.final[to]:
                    yield i + skip, j
                behind = self.next[to]
                for symbol2, (to2, skip2) in there.items():
                    if symbol2 == symbol:
                        todo.append((to, to2, i + skip, j + skip2))
                    elif symbol2 in behind:
                        to3, skip3 = behind[symbol2]
                        yield from self.both(to3, to2, i + skip + skip3, j + skip2)


def near_words(rows: list[tuple[str, str, str, int]], start: int, stop: int | None) -> Iterator[tuple[tuple, tuple]]:
    """Pairs of near (word, n) of one partition, each once.

    ``rows`` are (role, middle, word, n): 'v' for words as the result of an
    edit or with a symbol replaced, 'u' for words with a symbol more; their
    middle is what stands between the common start and the common rest.  With
    ``stop`` None there is no rest and every word has both roles.
    """
    if len(rows) < 2:
        return
    acceptors = Acceptors()
    v = sorted((r for r in rows if r[0] == "v"), key=lambda r: r[1])
    a = acceptors.of([r[1] for r in v])
    for i, j in acceptors.replaced(a):
        yield v[i][2:], v[j][2:]
    if stop is None:
        for i, j in acceptors.deleted(a, a, True):
            yield v[i][2:], v[j][2:]
        return
    u = sorted((r for r in rows if r[0] == "u"), key=lambda r: r[1])
    if not u or not v:
        return
    b = acceptors.of([r[1] for r in u])
    # a word that ends before the rest begins may be met by one that goes on;
    # elsewhere an edit behind the middle belongs to another partition
    short = [r for r in v if len(r[1]) < stop - start]
    for i, j in acceptors.deleted(b, a, False):
        yield u[i][2:], v[j][2:]
    if short:
        place = {r[1]: r for r in short}
        for r in u:
            if r[1][:-1] in place and r[1]:
                yield r[2:], place[r[1][:-1]][2:]


# -- partitions --------------------------------------------------------------

_KEY = ["start", "stop", "head", "rest"]


def _members(words: DataFrame, start: int, stop: int | None) -> DataFrame:
    """Rows (start, stop, head, rest, role, middle, word, n) of the partitions
    for edits at symbols ``start`` to ``stop`` (excluded; None: the end).
    Where ``words`` have a role, they keep it."""
    kept = F.col("s.role") == F.col("role") if "role" in words.columns else F.lit(True)
    head = F.substring("word", 1, start)
    if stop is None:
        return words.where(F.char_length("word") >= start).select(
            F.lit(start).alias("start"), F.lit(-1).alias("stop"), head.alias("head"), F.lit("").alias("rest"),
            F.lit("v").alias("role"), F.expr(f"substring(word, {start + 1})").alias("middle"), "word", "n")
    sides = [F.struct(F.lit(role).alias("role"), F.expr(f"substring(word, {start + 1}, {end - start})").alias("middle"),
                      F.expr(f"substring(word, {end + 1})").alias("rest")) for role, end in (("v", stop), ("u", stop + 1))]
    return (words.where(F.char_length("word") >= start)
            .select("*", F.explode(F.array(*sides)).alias("s")).where(kept)
            .select(F.lit(start).alias("start"), F.lit(stop).alias("stop"), head.alias("head"), F.col("s.rest").alias("rest"),
                    F.col("s.role").alias("role"), F.col("s.middle").alias("middle"), "word", "n"))


def partitions(words: DataFrame, most: int = MOST) -> DataFrame:
    """All members of all partitions: none holds more than ``most`` words,
    unless it spans one symbol."""
    spans: list[tuple[int, int | None]] = [(0, START), (START, None)]
    todo, done, step = [(words, span) for span in spans], [], START
    while todo:
        members = None
        for of, span in todo:
            rows = _members(of, *span)
            members = rows if members is None else members.unionByName(rows)
        # the spans of a round are few; their keys are cut where they are hot
        members = stage(members, "spelling-members")
        hot = (members.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("_c"))
               .where((F.col("_c") > most) & ((F.col("stop") < 0) | (F.col("stop") - F.col("start") > 1))).drop("_c"))
        hot = stage(hot, "spelling-hot")
        cut = [(r["start"], r["stop"]) for r in hot.select("start", "stop").distinct().collect()]
        if not cut:
            done.append(members)
            break
        done.append(members.join(hot, _KEY, "left_anti"))
        inside = stage(members.join(hot, _KEY, "left_semi"), "spelling-cut")
        step, todo = 2 * step, []
        for start, stop in sorted(cut):
            of = inside.where((F.col("start") == start) & (F.col("stop") == stop)).select("word", "n", "role")
            if stop < 0:
                of, parts = of.drop("role"), [(start, start + step), (start + step, None)]
            else:
                mid = (start + stop) // 2
                parts = [(start, mid), (mid, stop)]
            todo += [(of, p) for p in parts]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*_KEY, "role", "middle", "word", "n")


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """``(word, n, other, other_n)``: every pair of words (column ``word``, with
    its ``n``) that differ by exactly one inserted, deleted or replaced code
    point, once, in no particular order of the two."""
    return _enumerated(words, most, _pairs, _PAIR)


def _enumerated(words: DataFrame, most: int, take, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``take`` of the near pairs of each partition, as rows."""
    schema = pa.schema([(name, kind) for name, _, kind in fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for (start, stop, _, _), rows in runs(batches, len(_KEY)):
            for row in take(near_words([r[4:] for r in rows], start, None if stop < 0 else stop)):
                held.append(row)
                if len(held) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return (partitions(words, most).repartition(*_KEY).sortWithinPartitions(*_KEY)
            .mapInArrow(run, ", ".join(f"{name} {sql}" for name, sql, _ in fields)))


_PAIR = [("word", "string", pa.string()), ("n", "bigint", pa.int64()), ("other", "string", pa.string()),
         ("other_n", "bigint", pa.int64())]
_BEST = [("word", "string", pa.string()), ("n_near", "bigint", pa.int64()), ("near", "string", pa.string()),
         ("near_n", "bigint", pa.int64())]


def _pairs(found: Iterator[tuple[tuple, tuple]]) -> Iterator[tuple]:
    for one, two in found:
        yield *one, *two


def _best(found: Iterator[tuple[tuple, tuple]]) -> Iterator[tuple]:
    """Per word of a partition the number of its near words and the best:
    largest n, then first in code-point order."""
    best: dict[str, list] = {}
    for one, two in found:
        for (word, _), (near, n) in ((one, two), (two, one)):
            got = best.get(word)
            if got is None:
                best[word] = [1, near, n]
            else:
                got[0] += 1
                if n > got[2] or (n == got[2] and near < got[1]):
                    got[1:] = near, n
    for word, (count, near, n) in best.items():
        yield word, count, near, n


# -- groups ------------------------------------------------------------------

def variant_groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """One row per word of ``words`` (word, n): ``form`` (its near word of
    largest n, ties by code-point order, if that n is at least ``TIMES`` times
    its own; else null), ``root`` (the last word on the way along forms, the
    word itself without one), ``n``, ``n_near``, ``form_n``.

    A form is at least five times as frequent as the word, so the ways along
    forms are short: ``root`` doubles them, a join per doubling, until none
    grows.
    """
    words = stage(words.select("word", "n"), "spelling-words")
    best = _enumerated(words, most, _best, _BEST)
    rank = F.struct((-F.col("near_n")).alias("less"), "near")
    best = best.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(rank).alias("b"))
    formed = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))
    has = F.col("near_n") >= TIMES * F.col("n")
    formed = stage(formed.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"),
                                 F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    # to: the word after 2^k steps along forms
    ways = formed.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        on = ways.select(F.col("word").alias("_w"), F.col("to").alias("_t"))
        longer = ways.join(on, F.col("to") == F.col("_w"), "left")
        longer = stage(longer.select("word", F.coalesce("_t", "to").alias("to"), F.col("_t").isNotNull().alias("grew")),
                       "spelling-ways")
        ways = longer.select("word", "to")
        if not longer.where("grew").limit(1).count():
            break
    return formed.join(ways, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near",
                                                    "form_n")


def spelling_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", most: int = MOST) -> DataFrame:
    """The spelling variants among the words of ``docs``, a row per word (see
    ``variant_groups``).

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, of at
    least six code points and five occurrences, after the noise that the
    CRC-32 of ``<id>:<run>`` makes in one of 199 runs.  Defined cases: null
    texts count as empty, a null id as an empty string before the colon;
    repeated rows count again; ties in n go to the smaller word; texts and runs
    of any length are taken whole; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    return variant_groups(vocabulary(docs, text_col, id_col), most)
