"""License scans as an exact set-similarity join of text blocks with templates.

A text is cut into overlapping blocks of words; a block matches a template when
it holds at least ``threshold`` of the template's distinct words (containment).
All tokens are put in one global order, rarest in the corpus first.  If a block
B holds alpha = ceil(threshold * |T|) words of template T, then the first word
they share lies among the first |T| - alpha + 1 of T and the first
|B| - alpha + 1 of B (prefix filter), |B| >= alpha (length filter), and what
follows it in both leaves room for the rest (positional filter).  So only blocks
with a rare prefix word are looked at, none that matches is missed, and those
that pass are verified.  Words outside every template cannot count towards an
overlap, so only template words are ordered and counted.

Templates are a parameter of the job, a fixed list of a few hundred words; the
texts are the large side and never shuffle.  The first pass counts the template
words over the whole corpus (one row per word and partition is shuffled), the
second is a map-side join with the index of template prefixes.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str) -> list[str]:
    """Words of a text with A-Z lower-cased: runs of a-z, 0-9 and non-ASCII."""
    return WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float = 1.0
    #: the words must stand consecutively, and every such place is reported
    exact: bool = False


# The base phrases and their labels.
BASE = (
    Template("cc-by", "cc by", exact=True),
    Template("gpl", "general public license", exact=True),
    Template("reserved", "all rights reserved", exact=True),
)

# Lines and notices of well-known licenses.  One-line grants need
# all their words, longer notices four fifths.
LICENSES = (
    Template("apache", "licensed under the apache license version 2 0"),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of "
                       "the license at http www apache org licenses", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
                    "provided that the following conditions are met", 0.8),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", 0.8),
    Template("cc0", "dedicated to the public domain under cc0"),
    Template("gpl", "licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the "
                    "gnu general public license as published by the free software foundation", 0.8),
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                    "associated documentation files", 0.8),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", 0.8),
)


@dataclass(frozen=True)
class _Entry:
    """A template in the global order."""

    template: Template
    words: tuple[str, ...]
    ranks: tuple[int, ...]  # its distinct words, rarest first
    alpha: int              # words a block must share
    step: int               # blocks have 2 * step words and start every step words


class Index:
    """Template prefixes by word, for a global order of the template words."""

    def __init__(self, templates: Iterable[Template], frequency: dict[str, int]):
        split = [(t, tuple(words_of(t.text))) for t in templates]
        if any(not w or not 0 < t.threshold <= 1 for t, w in split):
            raise ValueError("a template needs words and a threshold in (0, 1]")
        vocab = sorted({w for _, ws in split for w in ws}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocab)}
        self.entries, self.prefix = [], defaultdict(list)
        for t, ws in split:
            ranks = tuple(sorted({self.rank[w] for w in ws}))
            need = 1.0 if t.exact else t.threshold
            alpha = max(1, math.ceil(need * len(ranks) - 1e-9))
            # a run of as many words as the template has lies whole in a block
            step = 1 << max(2, (len(ws) - 1).bit_length())
            self.entries.append(_Entry(t, ws, ranks, alpha, step))
            for r in ranks[:len(ranks) - alpha + 1]:
                self.prefix[r].append(len(self.entries) - 1)

    def matches(self, words: list[str]) -> list[tuple[str, bool, int, int, float]]:
        """(label, exact, start, words, containment) of every match: places of
        exact templates, blocks that meet the threshold of the others."""
        get = self.rank.get
        ids = [get(w, -1) for w in words]
        prefix = self.prefix
        candidates = set()
        for at, r in enumerate(ids):
            if r in prefix:
                for e in prefix[r]:
                    block = at // self.entries[e].step
                    candidates.add((e, block))
                    if block:
                        candidates.add((e, block - 1))
        found = set()
        for e, block in sorted(candidates):
            entry = self.entries[e]
            start = block * entry.step
            inside = sorted({r for r in ids[start:start + 2 * entry.step] if r >= 0})
            overlap = self._overlap(inside, entry)
            if not overlap:
                continue
            if entry.template.exact:
                n = len(entry.words)
                for at in range(start, min(start + 2 * entry.step, len(words)) - n + 1):
                    if tuple(words[at:at + n]) == entry.words:
                        found.add((entry.template.label, True, at, n, 1.0))
            else:
                n = min(2 * entry.step, len(words) - start)
                found.add((entry.template.label, False, start, n, overlap / len(entry.ranks)))
        return sorted(found)

    @staticmethod
    def _overlap(block: list[int], entry: _Entry) -> int:
        """Shared words if at least alpha, else 0; filters come first."""
        ranks, alpha = entry.ranks, entry.alpha
        if len(block) < alpha:  # length filter
            return 0
        where = {r: i for i, r in enumerate(ranks[:len(ranks) - alpha + 1])}
        first = next(((where[r], j) for j, r in enumerate(block[:len(block) - alpha + 1]) if r in where), None)
        if first is None:  # prefix filter
            return 0
        if 1 + min(len(ranks) - first[0] - 1, len(block) - first[1] - 1) < alpha:  # positional filter
            return 0
        shared = len(set(ranks).intersection(block))
        return shared if shared >= alpha else 0


def word_frequencies(texts: DataFrame, vocabulary: Iterable[str]) -> dict[str, int]:
    """How often each template word stands in the corpus; as many rows as the
    templates have words reach the driver."""
    wanted = frozenset(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in small_batches(batches):
            for text in b.column(0).to_pylist():
                total.update(filter(wanted.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                         ["word", "n"])

    counts = texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counts.collect()}


MATCHES = "array<struct<label:string,exact:boolean,start:bigint,words:bigint,containment:double>>"


def license_matches(docs: DataFrame, templates: Iterable[Template] = (*BASE, *LICENSES), text_col: str = "text",
                    id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, matches) of every row; see ``Index.matches``.

    Defined cases: null text counts as empty (no words, no matches); null ids
    and repeated rows give a row each; an empty table gives no rows; other
    columns are ignored, whatever their names.  Equal counts in the global
    order are broken by the word, so the order is fixed.
    """
    templates = tuple(templates)
    src = pick(docs, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    src = src.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    frequency = word_frequencies(src.select("t"), {w for t in templates for w in words_of(t.text)})
    index = Index(templates, frequency)
    fields = ("label", "exact", "start", "words", "containment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("start", pa.int64()),
                                      ("words", pa.int64()), ("containment", pa.float64())]))
        for b in small_batches(batches):
            counts, found = [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                found.append([dict(zip(fields, m)) for m in index.matches(words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind_of)],
                                             ["id", "n_words", "matches"])

    return src.mapInArrow(run, f"id {kind}, n_words bigint, matches {MATCHES}")


def license_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_base`` (places of base
    phrases), ``first_word`` and ``last_word`` (their smallest and largest
    start, null without a place), ``base_labels``, ``labels`` (with those of
    the license templates), ``score`` (the largest containment, 0 without a
    match), ``n_blocks`` (matching template blocks)."""
    m = license_matches(docs, text_col=text_col, id_col=id_col)
    base = F.filter("matches", lambda x: x["exact"])
    return m.withColumn("base", base).select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base.label")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct("matches.label")), ",").alias("labels"),
        F.coalesce(F.array_max("matches.containment"), F.lit(0.0)).alias("score"),
        (F.size("matches") - F.size("base")).cast("long").alias("n_blocks"))
