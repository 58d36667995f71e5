"""Shared helpers: Arrow text buffers, word hashes in numpy, tables in the shared folder.

Word hashing works on the UTF-8 buffer of an Arrow string column.  A word's
hash is a polynomial over its bytes and a k-gram's hash a polynomial over its
word hashes, both modulo 2**64 from prefix sums, so every k-gram of every
length costs O(1).  Values are finished with a bijective mixer.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visiflow.session import shared_path

#: Bytes of text handled at once inside a task (a longer text is handled alone).
CHUNK_BYTES = 2 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back (cuts lineage).

    The write's own shuffle files go when it has ended: nothing reads them
    again, as later stages start from the table.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove a table of ``write_table`` that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(docs: DataFrame) -> Column:
    """64 bits over all columns of a row; a null differs from every value."""
    return F.xxhash64(*(x for c in docs.columns for x in (F.col(c), F.col(c).isNull())))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null is an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    arr = arr.cast(pa.large_string())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return buf, off - off[0] if len(off) else np.zeros(1, np.int64)


def text_chunks(arr, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one longer row."""
    buf, off = text_buffer(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def word_spans(buf: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of the first word of each text (plus the total)."""
    inside = ~gap[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[off[off < len(buf)]] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]] if len(buf) else np.zeros(0, bool)
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, off)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept up to a few million entries)."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0], filled, step = 1, 1, b
            while filled < size:
                p[filled:2 * filled] = p[:filled] * np.uint64(step)
                step = step * step % (1 << 64)
                filled *= 2
            out.append(p)
        got = (out[0], out[1])
        if size <= 1 << 22:
            _POWERS[base] = got
    return got[0][:n], got[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher (in place on a copy)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Two independent families (byte table, byte base, word base).
_FAMILY = [(np.random.default_rng(s).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), b, w)
           for s, b, w in ((11, 0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (12, 0xC2B2AE3D27D4EB4F, 0xAF251AF3B0F025B5))]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    table, base, _ = _FAMILY[family]
    up, down = _powers(base, max(1, len(buf)))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * up[:len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]) if len(starts) else np.zeros(0, np.uint64)


class Grams:
    """Hashes of all k-word windows of one chunk, for any k."""

    def __init__(self, words: np.ndarray, family: int = 0):
        self.n = len(words)
        up, self.down = _powers(_FAMILY[family][2], max(1, self.n))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * up[:self.n], out=self.sums[1:])

    def at(self, pos: np.ndarray, k) -> np.ndarray:
        """Hash of the ``k`` words from each position (the caller keeps them inside one text)."""
        return mix((self.sums[pos + k] - self.sums[pos]) * self.down[pos])

    def all(self, k: int) -> np.ndarray:
        """Hash at every position of the chunk, text borders ignored."""
        m = max(0, self.n - k + 1)
        return mix((self.sums[k:k + m] - self.sums[:m]) * self.down[:m])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
