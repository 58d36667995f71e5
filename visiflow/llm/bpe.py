"""Byte-level BPE: length-bucketed padded numpy matrices.

Every distinct piece of a batch becomes one row of byte ids in the matrix of
its length bucket.  Each round looks up the ranks of all neighbouring pairs in
an open-addressing hash table, merges the leftmost pair of least rank in every
row, and compacts away the rows that have no pair left.

Defined results: a null or empty text has no ids and decodes to empty bytes; a
piece that is itself a vocabulary entry is that one id; columns of the input
are kept, except that one with the name of the output column is replaced.
Memory per task is bounded by one Arrow batch, its ids and a piece cache of
``CACHE_PIECES`` entries.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from visiflow.llm.common import mix

#: Pieces remembered by a task before the cache is emptied.
CACHE_PIECES = 400_000
#: Rows (pieces) of one matrix, and the piece length beyond which a heap replaces the matrix.
MATRIX_ROWS, LONG_PIECE = 20_000, 2048
NONE = np.int32(2**31 - 1)


class Ranks:
    """A rank file: token bytes -> id, and the hash table (left id, right id) -> merged id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, i in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
        self._build(np.array(keys, np.uint64), np.array(merged, np.int32))

    def _build(self, keys: np.ndarray, merged: np.ndarray) -> None:
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.merged = np.full(size, ~np.uint64(0)), np.full(size, NONE)
        slot = mix(keys) & self.mask
        left = np.arange(len(keys))
        while len(left):  # one winner per free slot a round, the others probe on
            free = self.keys[slot[left]] == ~np.uint64(0)
            self.keys[slot[left[free]]] = keys[left[free]]
            won = self.keys[slot[left]] == keys[left]
            self.merged[slot[left[won]]] = merged[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of every pair, NONE where there is none or a side is padding (negative)."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint32).astype(np.uint64)
        shape, key = key.shape, key.ravel()
        slot = mix(key) & self.mask
        out = np.full(len(key), NONE)
        ask = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        while len(ask):
            there = self.keys[slot[ask]]
            hit = there == key[ask]
            out[ask[hit]] = self.merged[slot[ask[hit]]]
            ask = ask[~hit & (there != ~np.uint64(0))]
            slot[ask] = (slot[ask] + np.uint64(1)) & self.mask
        return out.reshape(shape)


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_matrix(ranks: Ranks, pieces: list[bytes], width: int) -> list[np.ndarray]:
    """Ids of every piece (each of at most ``width`` bytes), all rows merged side by side."""
    lens = np.array([len(p) for p in pieces])
    ids = np.full((len(pieces), width + 1), -1, np.int32)
    inside = np.arange(width + 1) < lens[:, None]
    ids[inside] = ranks.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    merges = ranks.pair(ids[:, :-1], ids[:, 1:])
    rows, done = np.arange(len(pieces)), [None] * len(pieces)
    while len(rows):
        at = merges.argmin(1)
        best = merges[np.arange(len(rows)), at]
        over = best == NONE
        if over.any():  # compaction
            for k in np.flatnonzero(over):
                done[rows[k]] = ids[k, :lens[rows[k]]].copy()
            keep = ~over
            rows, ids, merges, at, best = rows[keep], ids[keep], merges[keep], at[keep], best[keep]
            if not len(rows):
                break
        lens[rows] -= 1
        here = np.arange(len(rows))
        column = np.arange(ids.shape[1] - 1)
        ids[here, at] = best
        ids = np.where(column <= at[:, None], ids[:, :-1], ids[:, 1:])
        column = column[:-1]
        merges = np.where(column <= at[:, None], merges[:, :-1], merges[:, 1:])
        if not merges.shape[1]:
            merges = np.full((len(rows), 1), NONE)
            ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], 1)
            continue
        for shift in (-1, 0):  # the two pairs around the new id
            col = at + shift
            ok = (col >= 0) & (col < merges.shape[1])
            merges[here[ok], col[ok]] = ranks.pair(ids[here[ok], col[ok]], ids[here[ok], col[ok] + 1])
    return done


def merge_long(ranks: Ranks, piece: bytes) -> np.ndarray:
    """The same merges for one long piece: a heap of (rank, position) over a linked list."""
    ids = ranks.byte_ids[np.frombuffer(piece, np.uint8)]
    first = ranks.pair(ids[:-1], ids[1:]).tolist()
    ids, n = ids.tolist(), len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, r in enumerate(first) if r != NONE]
    heapq.heapify(heap)
    pairs, tokens, known = first + [int(NONE)], ranks.tokens, ranks.ids

    def again(i: int) -> None:
        j = after[i]
        pairs[i] = known.get(tokens[ids[i]] + tokens[ids[j]], int(NONE)) if j < n else int(NONE)
        if pairs[i] != NONE:
            heapq.heappush(heap, (pairs[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if ids[i] < 0 or pairs[i] != r:
            continue
        j = after[i]
        ids[i], ids[j], pairs[j] = r, -1, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        again(i)
        if before[i] >= 0:
            again(before[i])
    return np.array([x for x in ids if x >= 0], np.int32)


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> list[np.ndarray]:
    """Ids of distinct pieces: whole entries directly, the others in the matrix of their length bucket."""
    out: list = [None] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        whole = ranks.ids.get(p)
        if whole is not None:
            out[k] = np.array([whole], np.int32)
        elif len(p) > LONG_PIECE:
            out[k] = merge_long(ranks, p)
        else:
            buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(k)
    for width, members in buckets.items():
        step = max(1, MATRIX_ROWS * 8 // width)
        for a in range(0, len(members), step):
            some = members[a:a + step]
            for k, ids in zip(some, merge_matrix(ranks, [pieces[k] for k in some], width)):
                out[k] = ids
    return out


class PieceTable(dict):
    """piece -> number, in order of appearance; ids of piece k are flat[ends[k-1]:ends[k]]."""

    def __init__(self, ranks: Ranks):
        super().__init__()
        self.ranks, self.new = ranks, []
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.new.append(piece)
        return k

    def settle(self) -> None:
        if self.new:
            got = encode_pieces(self.ranks, [p.encode() for p in self.new])
            lens = np.array([len(x) for x in got], np.int64)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lens) - lens])
            self.lens = np.concatenate([self.lens, lens])
            self.flat = np.concatenate([self.flat, *got])
            self.new = []


def encode_texts(texts: list[str | None], table: PieceTable, find) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts end to end, end offset of each text)."""
    codes, ends = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            codes.append(np.fromiter(map(table.__getitem__, find(text)), np.int64))
            ends[i] = len(codes[-1])
    table.settle()
    code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    lens = table.lens[code]
    until = np.concatenate([[0], np.cumsum(lens)])
    ids = table.flat[np.arange(until[-1]) - np.repeat(until[:-1] - table.starts[code], lens)]
    return ids, until[np.cumsum(ends)]


def _parts(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """The batch in runs of rows with about ``limit`` bytes of text."""
    sizes = np.cumsum([len(x) if x is not None else 0 for x in (s.as_buffer() for s in batch.column(column))]) if len(batch) else np.zeros(0)
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + limit, "right")))
        yield batch.slice(a, b - a)
        a = b


def _replaced(schema: T.StructType, name: str, kind: T.DataType) -> tuple[T.StructType, list[str]]:
    kept = [f for f in schema.fields if f.name.lower() != name.lower()]
    return T.StructType([*kept, T.StructField(name, kind, False)]), [f.name for f in kept]


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out`` (array<int>): the ids of every match of ``pattern`` in the whole text, in order.

    No special tokens: their strings are ordinary text.
    """
    schema, names = _replaced(df.schema, out, T.ArrayType(T.IntegerType(), False))

    def run(batches):
        ranks, find = load_ranks(ranks_path), regex.compile(pattern).findall
        table = PieceTable(ranks)
        for whole in batches:
            for batch in _parts(whole, text_col):
                if len(table) > CACHE_PIECES:
                    table = PieceTable(ranks)
                ids, ends = encode_texts(batch.column(text_col).to_pylist(), table, find)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], names=[*names, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes of the ids, end to end; null ids are no ids."""
    schema, names = _replaced(df.schema, out, T.BinaryType())

    def run(batches):
        token = load_ranks(ranks_path).tokens.__getitem__
        for whole in batches:
            for a in range(0, len(whole), 256):  # bounds the bytes held as Python objects
                batch = whole.slice(a, 256)
                texts = [b"".join(map(token, ids or ())) for ids in batch.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.binary())], names=[*names, out])

    return df.mapInArrow(run, schema)
