"""Toxicity by the nearest labelled examples.

A text is a TF-IDF vector over the features whose use differs between the
labelled classes; its score comes from the labelled examples with the highest
cosine, found exactly in a block-max inverted index: the postings of a feature
are cut into blocks of examples, each with its largest weight, which bounds
what any example of the block can reach.  Blocks are scored from the highest
bound on, in growing waves, until the k-th best example beats the next bound.  The examples vote
with the square of their cosine, the vote is calibrated on labelled rows that
took no part in the fit, and the nearest examples are given as evidence.

Features are words (runs of letters, lower-cased) and their beginnings of four
to seven letters, so that the forms of one word share evidence.  How many
documents of either class use a feature is counted in Spark over a sample of
labelled rows, at most ``TAUGHT`` of a class; kept are those whose likelihood
ratio G2 exceeds what the largest of so many unrelated features would reach, at
most ``FEATURES``.  The examples come from the same sample, the calibration and
the share of toxic rows from all labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, stage

#: Features of the vocabulary and examples per class in the index: with both,
#: the broadcast index holds at most 2 * EXAMPLES * FEATURES postings of 12
#: bytes (74 MB; some 20 postings an example on the given tables).
FEATURES, EXAMPLES = 2048, 1500

#: Labelled rows per class that the vocabulary and the examples are fitted on:
#: their ids are broadcast (at most 2 * TAUGHT), so no text is shuffled.
TAUGHT = 20_000

#: Neighbours that vote, those named as evidence, examples in a block.
NEIGHBOURS, EVIDENCE, BLOCK = 15, 3, 64

#: Words longer than this count by their beginnings only; features counted in a
#: worker before they are sent on; words in a worker's cache.
LONGEST, HELD, CACHE = 64, 200_000, 200_000

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)

#: Points of the calibration curve.
STEPS = 100


def features_of(word: str) -> list[str]:
    """A word and its beginnings (marked by a hyphen, which no word holds)."""
    own = [word] if len(word) <= LONGEST else []
    return own + [word[:k] + "-" for k in BEGINNINGS if len(word) > k]


def words_of(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


# -- vocabulary --------------------------------------------------------------

def document_counts(texts: DataFrame) -> DataFrame:
    """``(feature, clean, toxic)``: in how many rows of either class of
    ``texts`` (text, y) a feature occurs; the empty feature counts the rows."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def sent() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[
                pa.array([h[f] for f in names], pa.int64()) for h in held]], ["feature", "clean", "toxic"])
            held[0].clear()
            held[1].clear()
            return batch

        for b in small_batches(batches):
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[y].update({""}.union(*map(features_of, words_of(text))))
                if len(held[0]) + len(held[1]) >= HELD:
                    yield sent()
        yield sent()

    return (texts.mapInArrow(count, "feature string, clean bigint, toxic bigint").groupBy("feature")
            .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))


def _likelihood_ratio(toxic: Column, clean: Column, all_toxic: float, all_clean: float) -> Column:
    """G2 of the table class x feature present."""
    rows = all_toxic + all_clean

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    have = toxic + clean
    return 2 * (part(toxic, have * (all_toxic / rows)) + part(clean, have * (all_clean / rows))
                + part(all_toxic - toxic, (rows - have) * (all_toxic / rows))
                + part(all_clean - clean, (rows - have) * (all_clean / rows)))


@dataclass
class Vocabulary:
    """Features with their number and inverse document frequency."""
    features: dict[str, tuple[int, float]]

    @staticmethod
    def fit(texts: DataFrame, size: int = FEATURES) -> "Vocabulary":
        """From labelled ``texts`` (text, y): features told apart by class.  Of
        m unrelated features about one exceeds 2 ln m, so that is the least G2
        kept; what is collected is bounded by ``size``."""
        counts = stage(document_counts(texts), "toxicity-counts")
        rows = counts.where("feature = ''").first()
        clean, toxic = (rows["clean"], rows["toxic"]) if rows else (0, 0)
        many = counts.count() - 1
        if not clean or not toxic or many < 1:
            return Vocabulary({})
        g2 = _likelihood_ratio(F.col("toxic"), F.col("clean"), float(toxic), float(clean))
        kept = (counts.where("feature <> '' AND clean + toxic >= 3").withColumn("g2", g2)
                .where(F.col("g2") > 2 * math.log(many)).orderBy(F.desc("g2"), "feature").limit(size).collect())
        n = clean + toxic
        return Vocabulary({r["feature"]: (i, math.log((1 + n) / (1 + r["clean"] + r["toxic"])) + 1)
                           for i, r in enumerate(kept)})


class Vectors:
    """Texts to unit TF-IDF vectors.  Known words keep their features in a
    bounded cache."""

    def __init__(self, vocabulary: Vocabulary):
        self.known = vocabulary.features
        self.idf = {i: idf for i, idf in vocabulary.features.values()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def of(self, text: str) -> tuple[list[int], list[float]]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        counts: Counter = Counter()
        for word, n in words_of(text).items():
            hit = self.cache.get(word)
            if hit is None:
                hit = tuple(self.known[f][0] for f in features_of(word) if f in self.known)
                if len(word) <= LONGEST:
                    self.cache[word] = hit
            for i in hit:
                counts[i] += n
        ids = sorted(counts)
        weights = [(1 + math.log(counts[i])) * self.idf[i] for i in ids]
        norm = math.sqrt(sum(w * w for w in weights))
        return ids, [w / norm for w in weights]


# -- the index ---------------------------------------------------------------

class Index:
    """Block-max inverted index over examples (id, y, ids, weights).

    Examples are numbered by class and strongest feature, so that the examples
    of a block are alike and its bounds tight.
    """

    def __init__(self, examples: list[tuple], features: int, block: int = BLOCK):
        order = sorted(examples, key=lambda e: (e[1], e[2][int(np.argmax(e[3]))], str(e[0])))
        self.ids = [e[0] for e in order]
        self.labels = np.array([e[1] for e in order], dtype=np.int8)
        self.block = block
        many = -(-len(order) // block)
        postings: list[list[tuple[int, float]]] = [[] for _ in range(features)]
        for row, (_, _, ids, weights) in enumerate(order):
            for i, w in zip(ids, weights):
                postings[i].append((row, w))
        self.rows = np.array([r for p in postings for r, _ in p], dtype=np.int32)
        self.weights = np.array([w for p in postings for _, w in p], dtype=np.float64)
        # where the postings of a feature in a block start, and its peak there
        self.starts = np.zeros((features, many + 1), dtype=np.int32)
        self.peaks = np.zeros((features, many), dtype=np.float64)
        at = 0
        for f, p in enumerate(postings):
            ends = np.searchsorted([r for r, _ in p], np.arange(1, many + 1) * block)
            self.starts[f, 0], self.starts[f, 1:] = at, at + ends
            for r, w in p:
                self.peaks[f, r // block] = max(self.peaks[f, r // block], w)
            at += len(p)

    def nearest(self, ids: list[int], weights: list[float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine (above 0; ties by number) and their
        cosines, in that order: exact, whatever is skipped."""
        ids, q = np.asarray(ids), np.asarray(weights)
        starts, bounds = self.starts[ids], q @ self.peaks[ids]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rows, cosines = np.empty(0, dtype=np.int64), np.empty(0)
        at, wave = 0, 2
        while at < len(order):
            part = order[at:at + wave]
            at, wave = at + wave, 2 * wave
            if len(cosines) == k:
                # sums in another order may differ in their last bits
                part = part[bounds[part] >= cosines[-1] - 1e-9]
                if not len(part):
                    break
            # the postings of all features in these blocks, one after another
            low = starts[:, part].ravel()
            many = starts[:, part + 1].ravel() - low
            flat = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
            total = np.bincount(self.rows[flat], np.repeat(np.repeat(q, len(part)), many) * self.weights[flat], len(self.ids))
            hit = np.flatnonzero(total)
            rows, cosines = np.concatenate([rows, hit]), np.concatenate([cosines, total[hit]])
            top = np.lexsort((rows, -cosines))[:k]
            rows, cosines = rows[top], cosines[top]
        return rows, cosines

    def vote(self, rows: np.ndarray, cosines: np.ndarray, share: float) -> float:
        """Share of toxic votes, each the square of a cosine, beside one vote
        for the share among all labelled rows."""
        power = cosines * cosines
        return (float(power[self.labels[rows] == 1].sum()) + share) / (float(power.sum()) + 1.0)


# -- calibration -------------------------------------------------------------

def curve(bins: list[tuple[int, int, int]], share: float) -> list[float]:
    """The calibrated score at the votes 0, 1/STEPS, ..., 1, from labelled rows
    counted by vote (bin, rows, toxic): pooled until the rates rise with the
    vote, smoothed by one row at the overall rate, joined by straight lines."""
    if not sum(t for _, _, t in bins) or not sum(n - t for _, n, t in bins):
        return [i / STEPS for i in range(STEPS + 1)]
    pools: list[list[float]] = []  # rows, toxic, sum of votes
    for b, n, t in sorted(bins):
        pools.append([n, t, n * (b + 0.5) / STEPS])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    centres = [v / n for n, _, v in pools]
    rates = np.maximum.accumulate([(t + share) / (n + 1) for n, t, _ in pools])
    return [float(x) for x in np.interp([i / STEPS for i in range(STEPS + 1)], centres, rates)]


def calibrated(vote: Column, points: list[float]) -> Column:
    table = F.array(*[F.lit(p) for p in points])
    low = F.least(F.floor(vote * STEPS), F.lit(STEPS - 1)).cast("int")
    a, b = F.element_at(table, low + 1), F.element_at(table, low + 2)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a + (b - a) * (vote * STEPS - low)))


# -- the operator ------------------------------------------------------------

_WORKER: dict = {}


def _vectors(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(id, aside, ids, weights) of texts (id, aside, text)."""
    kind = texts.schema["id"].dataType.simpleString()
    known = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(known.value)
        for b in small_batches(batches):
            both = [vectors.of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i for i, _ in both], pa.list_(pa.int32())),
                                              pa.array([w for _, w in both], pa.list_(pa.float64()))],
                                             ["id", "aside", "ids", "weights"])

    return texts.mapInArrow(run, f"id {kind}, aside boolean, ids array<int>, weights array<double>")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column without nulls, as views of its values."""
    ends = np.asarray(column.offsets)
    return np.split(np.asarray(column.flatten()), ends[1:-1] - ends[0]) if len(column) else []


def _votes(rows: DataFrame, index: Index, share: float, k: int, named: int) -> DataFrame:
    """``rows`` (id, aside, ids, weights) with their vote and evidence."""
    kind = rows.schema["id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())
    sql = kind.simpleString() if arrow != pa.string() else "string"
    shared = rows.sparkSession.sparkContext.broadcast(index)
    head = [f"id {kind.simpleString()}", "aside boolean", "vote double", f"evidence array<{sql}>", "cosines array<double>",
            "evidence_labels array<int>"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in small_batches(batches, 1024):
            votes, named_ids, named_cosines, named_labels = [], [], [], []
            for ids, weights in zip(_lists(b.column(2)), _lists(b.column(3))):
                near, cosines = index.nearest(ids, weights, k) if len(ids) and index.ids else (np.empty(0, dtype=int), np.empty(0))
                votes.append(index.vote(near, cosines, share))
                named_ids.append([index.ids[i] for i in near[:named]])
                named_cosines.append(cosines[:named].tolist())
                named_labels.append(index.labels[near[:named]].tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(votes, pa.float64()), pa.array(named_ids, pa.list_(arrow)),
                 pa.array(named_cosines, pa.list_(pa.float64())), pa.array(named_labels, pa.list_(pa.int32()))],
                ["id", "aside", "vote", "evidence", "cosines", "evidence_labels"])

    return rows.mapInArrow(run, ", ".join(head))


def toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
             threshold: float = 0.7, size: int = FEATURES, examples: int = EXAMPLES, taught: int = TAUGHT,
             k: int = NEIGHBOURS, named: int = EVIDENCE) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1, the
    calibrated chance of label 1), ``predicted`` (1 from ``threshold`` on),
    ``evidence`` (ids of the nearest examples), their ``cosines`` and
    ``evidence_labels``.

    Labels are learned from rows whose CRC-32 of the id as text leaves a
    remainder other than 1 modulo 3 (the others are ``held_out``).  Of these,
    texts whose hash is 0 modulo 4 calibrate, all of them.  Of the others,
    features are counted over the ``taught`` labelled ids of each class with the
    smallest hash, and the examples are the ``examples`` rows per class among
    these with a known feature and the smallest hash of their id, equal vectors
    once.  A score depends on the text alone.

    Defined cases: a null or empty text, or one without a known feature, has no
    neighbours and scores what such texts are worth by the calibration; a null
    id is neither held out nor labelled; an id labelled more than once counts as
    toxic if any label is 1, null labels are ignored; repeated rows each get a
    row; without labels of both classes every row scores the share of toxic
    labels (0.5 if there are none); an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    marks = pick(labels, id_col, label_col).select(F.col(id_col).alias("_l"), F.col(label_col).cast("int").alias("y"))
    marks = (marks.where(F.col("_l").isNotNull() & F.col("y").isin(0, 1)
                         & (F.crc32(F.col("_l").cast("string").cast("binary")) % 3 != 1))
             .groupBy("_l").agg(F.max("y").alias("y")))
    marks = stage(marks, "toxicity-labels")
    known = marks.agg(F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    share = (known["t"] + 0.5) / (known["n"] + 1)
    few = [marks.where(F.col("y") == y).orderBy(F.xxhash64("_l"), "_l").limit(taught) for y in (0, 1)]
    few = F.broadcast(stage(few[0].unionByName(few[1]), "toxicity-taught"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    aside = F.pmod(F.xxhash64(F.lit("aside"), text), F.lit(4)) == 0
    src = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), aside.alias("aside"), text.alias("text"))
    learned = src.where(~held & ~F.col("aside")).join(few, F.col("id") == F.col("_l")).select("text", "y")
    vocabulary = Vocabulary.fit(learned, size)

    vectors = stage(_vectors(src, vocabulary), "toxicity-vectors")
    rows = vectors.where(~held & ~F.col("aside") & (F.size("ids") > 0)).join(few, F.col("id") == F.col("_l"))
    rows = stage(rows.groupBy("y", "ids", "weights").agg(F.min("id").alias("id")), "toxicity-examples")
    sample = []
    for y in (0, 1):
        sample += [(r["id"], y, r["ids"], r["weights"]) for r in rows.where(F.col("y") == y)
                   .orderBy(F.xxhash64("id"), "id").limit(examples).toLocalIterator()]
    votes = stage(_votes(vectors, Index(sample, len(vocabulary.features)), share, k, named), "toxicity-votes")

    tested = votes.where(~held & F.col("aside")).select("id", "vote").join(marks, F.col("id") == F.col("_l"))
    bins = tested.groupBy(F.least(F.floor(F.col("vote") * STEPS), F.lit(STEPS - 1)).cast("int").alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("t")).collect()
    score = calibrated(F.col("vote"), curve([(r["b"], r["n"], r["t"]) for r in bins], share))
    return votes.select(F.col("id").alias(id_col), held.alias("held_out"), score.alias("score"),
                        (score >= threshold).cast("int").alias("predicted"), "evidence", "cosines", "evidence_labels")
