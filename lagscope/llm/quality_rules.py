"""Line-first cleaning.

Every line is judged by itself: a line fails as punctuation (it neither ends in
a terminal mark nor holds any sentence mark, or most of its words carry
symbols), as navigation (a row of short cells between separators) or as
boilerplate (a notice that web pages repeat).  Failing lines go, and a document
that loses more than ``max_loss`` of its words with them is rejected, as is one
that is too short or mostly repeats itself.

One map pass over whole texts; no row depends on another, so nothing is
shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, pick, small_batches, utf8

#: The symbols that count as junk.
SYMBOLS = b"#*$%&|<>"

# Phrases of page furniture, matched without regard to case.
BOILERPLATE = re.compile(
    r"(?i)\b(?:enable javascript|javascript is (?:disabled|required)|use of cookies|we use cookies|accept (?:all )?cookies"
    r"|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|powered by|click here to"
    r"|sign up for our newsletter|subscribe to our|skip to (?:main )?content|back to top|lorem ipsum)\b")

# Marks that end a sentence, also before closing quotes and brackets.
ENDS = (".", "!", "?", "…", ":", ";", "。", "！", "？", "；", "：", '"', "'", ")", "]", "»", "”", "’", "」", "』", "）")
MARKS = re.compile("[.,;:!?…。、，！？；：]")
CELLS = re.compile(r"\s[|»›·•/>]\s")


def line_fails(line: str) -> str | None:
    """The rule that a line with a word fails: punctuation, navigation,
    boilerplate; None for a line that stays."""
    if BOILERPLATE.search(line):
        return "boilerplate"
    cells = CELLS.split(line)
    if len(cells) >= 4 and len(line.split()) <= 4 * len(cells):
        return "navigation"
    words = line.split()
    carrying = sum(any(c in "#*$%&|<>" for c in w) for w in words)
    if 2 * carrying > len(words):
        return "punctuation"
    if not line.rstrip().endswith(ENDS) and not MARKS.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """How many words lie in a window of words that occurs twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    key = ids[:n - window + 1]
    for k in range(1, window):
        # renumbered at each step, so the product stays below n * n
        key = np.unique(key * len(number) + ids[k:n - window + 1 + k], return_inverse=True)[1] \
            if len(number) > 1 else key
    twice = np.bincount(key)[key] > 1
    inside = np.zeros(n, bool)
    for k in range(window):
        inside[k:n - window + 1 + k] |= twice
    return int(inside.sum())


def judge(text: bytes, min_words: int, max_repeat: int, max_loss: float) -> tuple:
    """Counts and verdict of one UTF-8 text, and the text of the lines that stay."""
    words = text.split()
    spaces = len(text) - len(text.translate(None, ASCII_SPACE))
    string = text.decode("utf-8", "replace")
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    repeat = repeated_words(words)
    n = len(words)
    base_failed = n < min_words or 100 * repeat > max_repeat * n
    lost, failed, stay = 0, {"punctuation": 0, "navigation": 0, "boilerplate": 0}, []
    for line, as_text in zip(lines, string.split("\n")):
        rule = line_fails(as_text) if line.strip() else None
        if rule:
            failed[rule] += 1
            lost += len(line.split())
        else:
            stay.append(as_text)
    kept = not base_failed and lost <= max_loss * n
    return (n, len(string) - spaces, len(text) - len(text.translate(None, SYMBOLS)), len(full) - len(set(full)), repeat,
            base_failed, kept, lost, *failed.values(), "\n".join(stay))


COLUMNS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean, n_lost_words bigint, n_punctuation bigint, n_navigation bigint, "
           "n_boilerplate bigint, cleaned string")


def line_first_cleaning(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = 50,
                        max_repeat: int = 50, max_loss: float = 0.6) -> DataFrame:
    """One row per document: id, the counts of ``COLUMNS``, ``kept`` and
    ``cleaned`` (the lines that stay, whatever the verdict).

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``max_repeat`` percent of them in repeated three-word windows.  ``kept``:
    not base_failed and at most ``max_loss`` of the words lost with failing
    lines.  Lines without a word always stay.  Defined cases: null text counts
    as empty (no words, not kept); null ids and repeated rows give a row each;
    an empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    src = pick(docs, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    types = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    names, kinds = zip(*(c.split() for c in COLUMNS.split(", ")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            rows = [judge(t, min_words, max_repeat, max_loss) for t in b.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", *names])

    return src.select(F.col(id_col), utf8(text_col)).mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)
