"""Token counts without encoding every text.

Texts are cut into pre-tokens, and a text has as many tokens as its pre-tokens
together.  Two tiers answer for a pre-token: a compact table of the frequent
ones with their lengths in tokens, broadcast to every worker, and behind it a
cache in each worker that encodes what the table misses, once.  No pre-token
is ever shuffled; one map pass counts the corpus.

The table is only a short cut: it is fitted on a bounded sample and its
entries come from the same library as the misses, so the counts do not depend
on it.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches
from .pretokens import ByteLevel, byte_level

#: Entries of the broadcast table, rows of the sample it is fitted on,
#: entries and longest pre-token of a worker's cache.
TABLE_SIZE, SAMPLE_ROWS, CACHE_SIZE, CACHE_CHARS = 1 << 16, 2000, 200_000, 64


class Lengths(dict):
    """Pre-token -> number of tokens: the broadcast table, and the worker's
    cache of misses on top of it (emptied when full)."""

    def __init__(self, frequent: dict[str, int], tokenizer: ByteLevel):
        super().__init__(frequent)
        self.frequent, self.tokenizer, self.passing = frequent, tokenizer, []

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode what neither tier knows.  Long pre-tokens stay until the next
        call only."""
        for p in self.passing:
            self.pop(p, None)
        if len(self) >= len(self.frequent) + CACHE_SIZE:
            self.clear()
            self.update(self.frequent)
        new = list(set(pieces).difference(self))
        found = self.tokenizer.library.encode_batch_fast(new, add_special_tokens=False)
        self.update(zip(new, (len(e.ids) for e in found)))
        self.passing = [p for p in new if len(p) > CACHE_CHARS]


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", size: int = TABLE_SIZE,
                     sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, int]]:
    """The ``size`` most frequent short pre-tokens of a sample of about
    ``sample_rows`` rows, with their token counts: a table of bounded size."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, found = byte_level(path), Counter()
        for b in small_batches(batches):
            for text in b.column(0).to_pylist():
                found.update(p for p in tokenizer.split(text)[0] if len(p) <= CACHE_CHARS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                         ["piece", "n"])

    texts = pick(docs, text_col).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    share = min(1.0, sample_rows / max(1, docs.count()))
    top = (texts.sample(share, seed=1).mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "piece").limit(size).select("piece").toArrow().column(0).to_pylist())
    library = byte_level(path).library
    return [(p, len(e.ids)) for p, e in zip(top, library.encode_batch(top, add_special_tokens=False))]


def pack(table: list[tuple[str, int]]) -> tuple[bytes, bytes]:
    """Strings joined by NUL (which no kept entry holds) and a byte per length."""
    fit = [(p, n) for p, n in table if "\0" not in p and n < 256]
    return "\0".join(p for p, _ in fit).encode(), bytes(n for _, n in fit)


def unpack(packed: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(packed[0].decode().split("\0"), packed[1]))


_WORKER: dict[tuple[int, str], Lengths] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit`` (more than ``limit`` tokens).

    ``path`` names a byte-level BPE file of the tokenizers library, present on
    every node.  Counts are those of the library without added special tokens;
    special strings inside a text count as the one token they name, the
    library's default.  Defined cases: null text counts as empty (0 tokens);
    null ids and repeated rows give a row each; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    spark = docs.sparkSession
    src = pick(docs, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    packed = spark.sparkContext.broadcast(pack(frequent_lengths(docs, path, text_col)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = byte_level(path)
        key = (packed._jid if hasattr(packed, "_jid") else id(packed), path)
        if key not in _WORKER:
            _WORKER.clear()  # one table per worker at a time
            _WORKER[key] = Lengths(unpack(packed.value), tokenizer)
        lengths = _WORKER[key]
        for b in small_batches(batches):
            split = [tokenizer.split(text) for text in b.column(2).to_pylist()]
            lengths.learn(chain.from_iterable(pieces for pieces, _ in split))
            counts = [sum(map(lengths.__getitem__, pieces)) + len(marks) for pieces, marks in split]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = (src.select(F.col(id_col), F.octet_length(text).cast("long").alias("b"), text.alias("t"))
           .mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))
