"""Byte-level BPE encoding and decoding.

A pre-token is encoded by a segment tree over its adjacent pairs.  A leaf holds
the rank of a pair with its position (none where the pair cannot merge); inner
nodes hold the smaller child, so the root is the leftmost merge of the lowest
rank.  A merge changes at most three leaves, each an update along one path to
the root: a pre-token of n bytes takes O(n log n) steps, also where a text is
one long run.  Pre-tokens recur, so each worker keeps a bounded cache of what
it has encoded; those it has not seen are encoded together, their trees side by
side as rows of arrays.

Encoding and decoding are map passes over Arrow batches; nothing is shuffled
and texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import pick, small_batches
from .pretokens import byte_chars, byte_level, read_spec

#: Entries and longest pre-token (in characters) of a worker's cache; log2 of
#: the most leaves that are encoded as rows.
CACHE_SIZE, CACHE_CHARS, ROWS_BITS = 100_000, 64, 6

_NONE = 1 << 62


class Merges(dict):
    """Pre-token -> token ids: a cache that ``learn`` fills."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = byte_level(path)
        model = read_spec(path)["model"]
        vocab = model["vocab"]
        chars = byte_chars()
        self.byte_ids = [vocab[c] for c in chars]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = [vocab[a + b] for a, b in pairs]
        #: rank of the pair (a, b) at a << 32 | b, also as sorted arrays
        self.ranks = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[p] for p in self.pairs.tolist()], np.int64)
        byte_of = {c: b for b, c in enumerate(chars)}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        tokens |= {i: s.encode() for s, i in self.tokenizer.special.items()}
        self.token_bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.merged_ids = np.array(self.merged)
        self.ids = list(range(len(self.token_bytes)))
        self.passing: list[str] = []
        self.old: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Have the ids of these pre-tokens at hand.  Long ones stay until the
        next call only; a full cache becomes the old one and starts anew with
        what is still asked for."""
        for p in self.passing:
            self.pop(p, None)
        if len(self) >= CACHE_SIZE:
            self.old = dict(self)
            self.clear()
        new = set(pieces).difference(self)
        known = {p: self.old[p] for p in new if p in self.old}
        self.update(known)
        new.difference_update(known)
        self.passing = [p for p in new if len(p) > CACHE_CHARS]
        by_size: dict[int, list[str]] = {}
        for p in new:
            by_size.setdefault(max(0, len(p.encode()) - 2).bit_length(), []).append(p)
        for bits, group in by_size.items():
            data = [p.encode() for p in group]
            if bits <= ROWS_BITS:
                for at in range(0, len(data), 4096):
                    self.update(zip(group[at:at + 4096], self.merge_rows(data[at:at + 4096], 1 << bits)))
            else:
                self.update(zip(group, (tuple(self.merge(d)) for d in data)))

    def merge_rows(self, pieces: list[bytes], leaves: int) -> list[tuple[int, ...]]:
        """Token ids of pre-tokens of up to ``leaves`` + 1 bytes, a tree per row.

        Every step takes the root of each row that still has one, merges there
        and repairs the paths of the three leaves it touches."""
        width = leaves + 1
        size = np.array([len(p) for p in pieces])
        symbol = np.full((len(pieces), width + 1), -1, np.int64)
        inside = np.arange(width) < size[:, None]
        symbol[:, :width][inside] = np.array(self.byte_ids)[np.frombuffer(b"".join(pieces), np.uint8)]
        # a column past the end stands for no neighbour
        after = np.minimum(np.arange(1, width + 2), size[:, None]) + np.zeros((len(pieces), 1), np.int64)
        after[after >= size[:, None]] = width
        before = np.tile(np.arange(-1, width), (len(pieces), 1))
        def keys(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            pair = (left << 32) | right
            row = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            known = (left >= 0) & (right >= 0) & (self.pairs[row] == pair)
            return np.where(known, self.pair_ranks[row] * width + at, _NONE)

        tree = np.full((len(pieces), 2 * leaves), _NONE, np.int64)
        tree[:, leaves:] = keys(symbol[:, :leaves], symbol[:, 1:width], np.arange(leaves))
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + leaves
            tree[rows, node] = value
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        root = 1 if leaves > 1 else leaves  # a single leaf is its own root
        rows = np.arange(len(pieces))
        while len(rows := rows[tree[rows, root] != _NONE]):
            rank, at = np.divmod(tree[rows, root], width)
            gone = after[rows, at]
            symbol[rows, at], symbol[rows, gone] = self.merged_ids[rank], -1
            follow = after[rows, gone]
            after[rows, at] = follow
            some = follow < width
            before[rows[some], follow[some]] = at[some]
            some = gone < leaves
            put(rows[some], gone[some], np.full(int(some.sum()), _NONE))
            some = at < leaves
            put(rows[some], at[some], keys(symbol[rows, at], symbol[rows, follow], at)[some])
            prior = before[rows, at]
            some = prior >= 0
            r, left = rows[some], prior[some]
            put(r, left, keys(symbol[r, left], symbol[r, at[some]], left))
        left = symbol[:, :width] >= 0
        # through one list of all ids, so that cached tuples share their integers
        ids = list(map(self.ids.__getitem__, symbol[:, :width][left].tolist()))
        ends = np.cumsum(left.sum(1)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        byte_ids, ranks, merged = self.byte_ids, self.ranks, self.merged
        n = len(piece)
        symbol = [byte_ids[b] for b in piece]
        if n < 2:
            return symbol
        leaves = 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * leaves)
        for i in range(n - 1):
            rank = ranks.get(symbol[i] << 32 | symbol[i + 1])
            if rank is not None:
                tree[leaves + i] = rank * n + i
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            node = leaves + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least

        def key(left: int, right: int) -> int:
            rank = ranks.get(symbol[left] << 32 | symbol[right])
            return _NONE if rank is None else rank * n + left

        while tree[1] != _NONE:
            rank, at = divmod(tree[1], n)
            gone = after[at]
            symbol[at], symbol[gone] = merged[rank], -1
            follow = after[gone]
            after[at] = follow
            if gone < n - 1:
                put(gone, _NONE)
            if follow < n:
                before[follow] = at
                put(at, key(at, follow))
            else:
                put(at, _NONE)
            if before[at] >= 0:
                put(before[at], key(before[at], at))
        return [s for s in symbol if s >= 0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.tokenizer.split(t) for t in texts]
        self.learn(chain.from_iterable(pieces for pieces, _ in split))
        ids_of, out = self.__getitem__, []
        for pieces, marks in split:
            ids, at = [], 0
            for index, special in marks:
                ids.extend(chain.from_iterable(map(ids_of, pieces[at:index])))
                ids.append(special)
                at = index
            ids.extend(chain.from_iterable(map(ids_of, pieces[at:] if at else pieces)))
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """One per path and Python worker."""
    return Merges(path)


def encoded(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) of every row: the token ids that the tokenizers
    library gives for ``path`` without added special tokens.

    ``path`` names a byte-level BPE file of that library, present on every
    node; special strings inside a text become the token they name.  Defined
    cases: null text counts as empty (no ids); null ids and repeated rows give
    a row each; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    src = pick(docs, id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = merges(path).encode
        for b in small_batches(batches):
            ids = encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return src.select(F.col(id_col), text.alias("t")).mapInArrow(run, f"id {kind}, ids array<int>")


def decoded(tokens: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with a last column ``decoded``: the text of the ids, special
    tokens written out, bytes that are no UTF-8 as U+FFFD (null ids: null)."""
    cols = tokens.columns
    schema = StructType([*tokens.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = merges(path).decode
        at = cols.index(ids_col)
        for b in small_batches(batches):
            lists = b.column(at)
            first = lists.offsets[0].as_py()
            ids = lists.flatten().to_pylist() if lists.null_count else lists.values[first:lists.offsets[-1].as_py()].to_numpy().tolist()
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
            texts = [decode(ids[a:z]) if ok else None
                     for a, z, ok in zip([0, *ends], ends, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*cols, "decoded"])

    return tokens.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256`` (the decoded text in UTF-8) of every document."""
    out = decoded(encoded(docs, path, text_col, id_col), path)
    return out.select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
