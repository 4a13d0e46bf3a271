"""Language identification by character language models.

Per language an interpolated Kneser-Ney model over characters: the highest
order uses counts, lower orders the number of different characters seen before
an n-gram, every order is discounted and interpolated with the next lower one.
All languages share one sorted array of n-gram hashes per order with a row of
interpolated log-probabilities (a column per language), and one of context
hashes with the log back-off weights.  A text's cross-entropy per character is
a binary search per position; the lowest wins.

A text whose cross-entropy is above its language's cut is rejected.  The cut
depends on the text's length n: usual + slack + Z * spread / sqrt(n), all three
calibrated per language on labelled rows that were not counted and that score
best in their own language.  ``usual`` is their median, ``spread`` the standard
deviation of a single character, and ``slack``, never negative, the 99.9 %
quantile of what is left above usual + Z * spread / sqrt(n) (an exponential
tail where there are too few rows to see that quantile).  So a short clean
text stays and a long foreign or junk text goes, however many languages and
characters there are.

Distributed plan: models are fitted on a bounded sample of labelled rows (n-gram
counts are summed by Spark; the models, bounded by the sample, are broadcast),
then one map pass scores whole texts.  Nothing else moves.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import pick, small_batches, stage

#: Length of the n-grams; labelled rows per language that are counted; most
#: languages; positions scored at a time.
ORDER, COUNTED, MOST_LANGUAGES, POSITIONS = 4, 400, 1000, 1 << 17
#: Standard deviations of a text's mean that its length explains; a language
#: with fewer calibration rows than ENOUGH has at least the slack of all rows.
Z, ENOUGH = 4.0, 1000
_A = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def codes_of(text: str, order: int = ORDER) -> np.ndarray:
    """Lower-case letters as code points, runs of anything else as one space,
    with a space at the end and order - 1 in front; empty without a letter."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[raw]
    if not is_letter.any():
        return raw[:0]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of the characters after a letter
    kept = np.where(is_letter[keep], raw[keep], 32).astype(np.uint32)
    end = [] if kept[-1] == 32 else [32]
    return np.concatenate([np.full(order - 1, 32, np.uint32), kept, np.array(end, np.uint32)])


def hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the k-gram that ends at each position, for k = 1..order; the
    first k - 1 positions have none that is whole."""
    wide = codes.astype(np.uint64)
    out = [wide * np.uint64(_A[0])]
    for k in range(2, order + 1):
        h = out[-1].copy()
        h[k - 1:] += wide[:len(wide) - k + 1] * np.uint64(_A[k - 1])
        out.append(h)
    return out


def _rows(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, found) of each key in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


@dataclass
class Models:
    """The models of all languages; lists go by order, 1 first."""

    langs: list[str]
    order: int
    chance: float = 0.0                                     # log of the number of characters
    grams: list[np.ndarray] = field(default_factory=list)   # sorted hashes
    logp: list[np.ndarray] = field(default_factory=list)    # [gram, language]
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)  # [context, language], logs
    cut: np.ndarray | None = None                           # [language, (usual + slack, spread)]

    @classmethod
    def fit(cls, counts: pd.DataFrame, order: int = ORDER) -> Models:
        """From (lang, gram, n): n-grams of ``order`` characters."""
        langs = sorted(counts["lang"].unique())
        models = cls(langs, order)
        if not langs:
            return models
        chars = np.array([list(map(ord, g)) for g in counts["gram"]], np.uint64).reshape(-1, order)
        size = len(np.unique(chars[:, -1])) + 1  # and one for all others
        models.chance = float(np.log(size))
        lang = counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
        n = counts["n"].to_numpy(np.float64)
        levels = []
        for k in range(order, 0, -1):
            gram = sum(chars[:, order - 1 - j] * np.uint64(_A[j]) for j in range(k))
            # a context is the (k - 1)-gram that ends one position earlier
            context = sum((chars[:, order - 2 - j] * np.uint64(_A[j]) for j in range(k - 1)),
                          np.zeros(len(chars), np.uint64))
            lower = sum((chars[:, order - 1 - j] * np.uint64(_A[j]) for j in range(k - 1)),
                        np.zeros(len(chars), np.uint64))
            levels.append((lang, gram, context, lower, n))
            # what the next lower order counts: different n-grams with that end
            first = pd.DataFrame({"lang": lang, "lower": lower}).reset_index()
            groups = first.groupby(["lang", "lower"])["index"]
            at = groups.first().to_numpy()
            n = groups.size().to_numpy(np.float64)
            chars, lang = chars[at], lang[at]
        below_keys, below = np.zeros(1, np.uint64), np.full((1, len(langs)), 1.0 / size)
        for lang, gram, context, lower, n in reversed(levels):
            keys, row = np.unique(gram, return_inverse=True)
            context_keys, context_row = np.unique(context, return_inverse=True)
            share, weight = np.zeros((len(keys), len(langs))), np.ones((len(context_keys), len(langs)))
            for x in range(len(langs)):
                own = lang == x
                once, twice = (n[own] == 1).sum(), (n[own] == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                total = np.bincount(context_row[own], n[own], len(context_keys))
                kinds = np.bincount(context_row[own], minlength=len(context_keys))
                seen = total > 0
                weight[seen, x] = discount * kinds[seen] / total[seen]
                share[row[own], x] = (n[own] - discount) / total[context_row[own]]
            at = np.zeros(len(keys), np.int64)
            at[row] = np.arange(len(row))  # any n-gram of each key
            lower_row, _ = _rows(below_keys, lower[at])
            below = share + weight[context_row[at]] * below[lower_row]
            below_keys = keys
            models.grams.append(keys)
            models.logp.append(np.log(below).astype(np.float32))
            models.contexts.append(context_keys)
            models.backoff.append(np.log(weight).astype(np.float32))
        return models

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """[position, language] from position order - 1 on."""
        hs = hashes(codes, self.order)
        todo = np.arange(self.order - 1, len(codes))
        out = np.empty((len(todo), len(self.langs)), np.float32)
        carried = np.zeros_like(out)
        for k in range(self.order, 0, -1):
            row, found = _rows(self.grams[k - 1], hs[k - 1][todo])
            hit = todo[found] - (self.order - 1)
            out[hit] = self.logp[k - 1][row[found]] + carried[hit]
            todo = todo[~found]
            if not len(todo):
                return out
            context = hs[k - 2][todo - 1] if k > 1 else np.zeros(len(todo), np.uint64)
            row, found = _rows(self.contexts[k - 1], context)
            carried[todo[found] - (self.order - 1)] += self.backoff[k - 1][row[found]]
        left = todo - (self.order - 1)
        out[left] = carried[left] - self.chance
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, mean negative log-probability by language) of each
        text; texts without a letter have 0 characters."""
        return self.moments(texts, 1)[:2]

    def moments(self, texts: list[str], powers: int = 2) -> tuple[np.ndarray, ...]:
        """(characters, mean of each power of the negative log-probability by
        language) of each text."""
        parts = [codes_of(t, self.order) for t in texts]
        lengths = np.array([max(0, len(p) - self.order + 1) for p in parts])
        sums = np.zeros((powers, len(texts), len(self.langs)))
        if lengths.any():
            codes = np.concatenate(parts)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            inside = np.concatenate([np.arange(len(p)) for p in parts])
            lap = self.order - 1
            for start in range(0, len(codes) - lap, POSITIONS):
                stop = min(len(codes), start + POSITIONS + lap)
                logp = self.log_probabilities(codes[start:stop])
                real = inside[start + lap:stop] >= lap  # not the spaces in front of a text
                for x in range(len(self.langs)):
                    for k in range(powers):
                        sums[k, :, x] += np.bincount(owner[start + lap:stop][real], (-logp[real, x]) ** (k + 1), len(parts))
        return lengths, *(sums / np.maximum(lengths, 1)[:, None])

    def limits(self, best: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Largest cross-entropy accepted of texts in these languages."""
        if self.cut is None:
            return np.full(len(best), np.inf)
        return self.cut[best, 0] + Z * self.cut[best, 1] / np.sqrt(np.maximum(lengths, 1))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text; "und" where
        there is no letter or nothing was learned."""
        lengths, ce = self.cross_entropies(texts) if self.langs else (np.zeros(len(texts), int), None)
        if not self.langs:
            ce = np.zeros((len(texts), 1))
        best = ce.argmin(1)
        low = ce[np.arange(len(texts)), best]
        # the posterior of the winner if all languages are equally likely
        score = np.where(lengths > 0, 1 / np.exp(-(ce - low[:, None]) * lengths[:, None]).sum(1), 0.0)
        known = lengths > 0
        over = low > self.limits(best, lengths)
        return [self.langs[b] if k else "und" for b, k in zip(best, known)], score, np.where(known, low, 0.0), ~known | over


def held_out(id_col: str, folds: int = 5) -> Column:
    """Rows whose label is never learned; a null id is one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))


def _sample(rows: DataFrame, per_language: int, languages: DataFrame, use: Column) -> DataFrame:
    """The ``per_language`` rows to ``use`` of each language with the smallest hash of the
    id.  Thinned by the languages' row counts first, so that the window sorts
    a bounded number of rows however many a language has."""
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n"))
    order = F.xxhash64("id", F.lit(11))
    thin = rows.join(F.broadcast(languages), "lang").where(use).where(F.pmod(order, F.lit(1 << 20)) < share * F.lit(1 << 20))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(12)), "id", "text"))
    return thin.withColumn("rank", rank).where(F.col("rank") <= per_language).select("text", "lang")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", order: int = ORDER,
        counted: int = COUNTED) -> Models:
    """Models learned from labelled rows with a letter outside the held-out
    fold: ``counted`` rows per language for the n-grams, so the models fit in
    memory whatever the corpus, and every row of fold 1 for the cuts.  A
    language with rows in fold 1 only is counted from these and has the cut of
    all rows together; there may be up to ``MOST_LANGUAGES`` languages."""
    src = pick(docs, id_col, text_col, lang_col).toDF("id", "text", "lang")
    src = src.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id") & F.col("text").rlike(r"\p{L}"))
    fold = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5))
    sizes = stage(src.groupBy("lang", (fold == 1).alias("cal")).agg(F.count("*").alias("n")), "langid-sizes")
    if sizes.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in small_batches(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = codes_of(text, order).tobytes().decode("utf-32-le")
                found.update((lang, s[i:i + order]) for i in range(len(s) - order + 1))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                          pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    others = sizes.groupBy("lang").agg(F.sum(F.when(~F.col("cal"), F.col("n"))).alias("other"), F.sum("n").alias("all"))
    others = others.select("lang", F.coalesce("other", "all").alias("n"), F.col("other").isNull().alias("only"))
    only = {r.lang for r in others.where("only").collect()}
    train = _sample(src.withColumn("cal", fold == 1), counted, others, ~F.col("cal") | F.col("only"))
    grams = train.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    models = Models.fit(grams.orderBy("lang", "gram").toPandas(), order)
    if not models.langs:
        return models
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        index = {x: i for i, x in enumerate(m.langs)}
        for b in small_batches(batches):
            known = [(t, x) for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if x in index and x not in only]
            lengths, ce, squares = m.moments([t for t, _ in known])
            own = np.array([index[x] for _, x in known], np.int64)
            use = np.flatnonzero((lengths > 0) & (ce.argmin(1) == own))
            own = own[use]
            yield pa.RecordBatch.from_arrays([pa.array([known[i][1] for i in use], pa.string()), pa.array(lengths[use], pa.int64()),
                                              pa.array(ce[use, own]), pa.array(squares[use, own])], ["lang", "n", "ce", "sq"])

    check = src.where(fold == 1).select("text", "lang")
    models.cut = _cuts(stage(check.mapInArrow(measure, "lang string, n bigint, ce double, sq double"), "langid-scores"), models)
    return models


def _cuts(rows: DataFrame, models: Models) -> np.ndarray | None:
    """``Models.cut`` from (lang, n, ce, sq) of calibration rows; a language
    without one has the cut of all rows together."""
    usual = F.percentile_approx("ce", F.lit(0.5), F.lit(10_000)).alias("usual")
    spread = F.sqrt(F.sum(F.col("n") * (F.col("sq") - F.col("ce") * F.col("ce"))) / F.sum("n")).alias("spread")
    whole = rows.agg(usual, spread).first()
    if whole.usual is None:
        return None  # nothing to calibrate on: nothing is rejected
    own = stage(rows.groupBy("lang").agg(usual, spread), "langid-usual")
    left = rows.join(F.broadcast(own), "lang").withColumn(
        "left", F.col("ce") - F.col("usual") - F.lit(Z) * F.col("spread") / F.sqrt("n"))
    high = F.percentile_approx("left", F.array(F.lit(0.5), F.lit(0.999)), F.lit(10_000)).alias("high")

    def slack_of(r: Row) -> float:
        # of fewer than ENOUGH rows the quantile is their maximum: the rest is
        # an exponential tail through it and the median
        middle, top = r.high
        tail = (top - middle) / math.log(max(r.n, 4) / 2)
        return max(0.0, top + tail * math.log(max(1.0, ENOUGH / r.n)))

    slack = slack_of(left.agg(F.count("*").alias("n"), high).first())
    cuts = {}
    for r in left.groupBy("lang").agg(F.first("usual").alias("usual"), F.first("spread").alias("spread"),
                                      F.count("*").alias("n"), high).collect():
        cuts[r.lang] = (r.usual + (slack_of(r) if r.n >= ENOUGH else max(slack, r.high[1])), r.spread)
    return np.array([cuts.get(x, (whole.usual + slack, whole.spread)) for x in models.langs])


def languages(docs: DataFrame, models: Models, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score`` (0 to
    1), ``cross_entropy`` (nats per character), ``rejected``.

    Defined cases: null text or text without a letter is "und" with score 0 and
    rejected, as is every text where no labelled row was learned; a null id is
    held out; equal cross-entropies go to the first language by code point;
    repeated rows give a row each; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    src = pick(docs, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            lang, score, ce, rejected = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score),
                                              pa.array(ce), pa.array(rejected)],
                                             ["id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    src = src.select(F.col(id_col), held_out(id_col).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return src.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double, cross_entropy double, "
                               "rejected boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns; one map
    pass, no join."""
    cols = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    at = cols.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 64):
            rejected = shared.value.predict([t or "" for t in b.column(at).to_pylist()])[3]
            yield b.filter(pa.array(~rejected))

    return plain.mapInArrow(run, plain.schema).toDF(*cols)
