"""Token ids as flat binary files with 64-bit document offsets, memory-mapped when read.

``write_token_files`` range-partitions the documents by id, encodes each part
with the tokenizers library and writes for it, under a name of its own:

* ``.bin``  the ids of all its documents end to end, little-endian unsigned
  16-bit where the vocabulary fits, else 32-bit, each document closed by ``end_id``;
* ``.doc``  the documents' ids (signed 64-bit; of a null id 0, see the manifest);
* ``.len``  the documents' numbers of tokens (unsigned 64-bit);
* ``.off``  n + 1 offsets (unsigned 64-bit) into the whole sequence of tokens.

The offsets need to know what lies before a part: its base is a prefix sum over
the parts' totals, and ``.off`` is written once the bases are known.  The
manifest (one row per file, in order) names the files that count; what a lost
or repeated attempt of a task left behind is in no manifest.

A text is encoded piece by piece, the pieces being what lies between blanks,
tabs and line ends; each distinct piece goes through the library once while it
is remembered.  That gives the ids of the whole text for tokenizers that drop
white space before their model runs; others are encoded text by text.

Defined results: a null or empty text has only the end id; documents lie in
ascending id order, those without an id first, rows that share an id in the
order of a hash of their text (copies are alike, so their order shows nowhere);
extra columns are ignored; an empty table gives an empty manifest.  A task
holds ``ENCODE_BYTES`` of texts (or one longer text) and ``CACHE_BYTES`` of pieces.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from visiflow.llm.common import drop_table, text_chunks, word_spans, write_table

#: Bytes of remembered pieces and their ids, and tokens that one reading task returns at once.
CACHE_BYTES, PIECE_TOKENS = 256 << 20, 4 << 20
#: Bytes of texts encoded at once, and new pieces that go through the library together.
ENCODE_BYTES, JOINED = 4 << 20, 256
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, 0x09, 0x0A, 0x0D]] = True
MANIFEST = "path string, width int, n_docs long, n_null long, n_tokens long, first_id long, first_hash long, first_row long"


def drops_white_space(path: str) -> bool:
    """Whether the tokenizer cuts texts at white space and keeps none of it (so that pieces can be encoded alone)."""
    rules = json.load(open(path, encoding="utf-8"))
    steps = rules.get("pre_tokenizer") or {}
    first = (steps.get("pretokenizers") or [steps])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    normal = rules.get("normalizer") or {}
    safe = {"NFC", "NFD", "Lowercase", "Replace"}
    parts = normal.get("normalizers", [normal] if normal else [])
    plain = all(p["type"] in safe and (p["type"] != "Replace" or (p["pattern"].get("Regex"), p["content"]) == (r"\s+", " ")) for p in parts)
    # a split that keeps only matches, where white space is named in a negated class and nowhere else
    return (plain and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and r"\s" not in pattern.replace(r"[^\s", "") and r"\S" not in pattern and "." not in pattern and " " not in pattern)


class Encoder:
    """Ids of texts by one tokenizer file, every document closed by ``end_id``."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks share out the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = drops_white_space(path)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, values: list[str]) -> list[bytes]:
        """Ids of pieces: the library gets ``JOINED`` of them with blanks between, and a token belongs to the piece it starts in."""
        out = []
        for i in range(0, len(values), JOINED):
            some = values[i:i + JOINED]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum([len(v) + 1 for v in some])
            cut = np.searchsorted(np.array([a for a, _ in e.offsets], np.int64), ends).tolist()
            ids = np.array(e.ids, self.dtype)
            out += [ids[a:b].tobytes() for a, b in zip([0, *cut], cut)]
        return out

    def pieces(self, values: list[str]) -> list[bytes]:
        """Ids of pieces: from the newer or the older half of the memory, or from the library."""
        known, older = self.known, self.older
        new, kept = [], {}
        for v in values:
            if v not in known:
                if v in older:
                    kept[v] = older[v]
                else:
                    new.append(v)
        kept.update(zip(new, self._joined(new)))
        out = [known[v] if v in known else kept[v] for v in values]
        known.update(kept)
        self.held += sum(len(v) + len(b) + 190 for v, b in kept.items())
        if self.held > CACHE_BYTES // 2:      # what was not used since the last turn goes
            self.older, self.known, self.held = known, {}, 0
        return out

    def chunk(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of one chunk end to end, and the number of ids of each."""
        if not self.by_piece:
            data = buf.tobytes()
            whole = [b + self.end for b in self._library([data[a:b].decode() for a, b in zip(off[:-1], off[1:])])]
            return np.frombuffer(b"".join(whole), self.dtype), np.array([len(b) // self.dtype.itemsize for b in whole], np.int64)
        starts, ends, first = word_spans(buf, off, BREAKS)
        ends_at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=ends_at[1:])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends_at), pa.py_buffer(np.ascontiguousarray(buf[~BREAKS[buf]])))
        coded = words.dictionary_encode()
        known = [*self.pieces(coded.dictionary.to_pylist()), self.end]
        size = np.array([len(b) for b in known], np.int64) // self.dtype.itemsize
        flat, at = np.frombuffer(b"".join(known), self.dtype), np.cumsum(size) - size
        codes = np.insert(coded.indices.to_numpy().astype(np.int64), first[1:], len(known) - 1)  # the end id after each text
        n = size[codes]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(at[codes] - before, n) + np.arange(int(n.sum()))]
        last = np.cumsum(n)[first[1:] + np.arange(len(off) - 1)]
        return ids, np.diff(last, prepend=0)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """The worker process's encoder: its pieces serve all tasks that it runs."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, end_id] = Encoder(path, end_id)
    return _ENCODERS[path, end_id]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Encode and write ``docs`` (doc_id, text) under ``folder``; the manifest with every file's ``base``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("row").asc()]

    def encode(batches):
        coder, fs, root, name = encoder(tokenizer, end_id), *pafs.FileSystem.from_uri(folder), f"part-{uuid.uuid4().hex}"
        files, total, n_docs, n_null, head = None, 0, 0, 0, None
        try:
            for batch in batches:
                if not len(batch):
                    continue
                if files is None:
                    fs.create_dir(root, recursive=True)
                    files = [fs.open_output_stream(f"{root}/{name}.{x}", compression=None) for x in ("bin", "doc", "len")]
                    head = [batch.column(c)[0].as_py() for c in ("doc_id", "hash", "row")]
                ids = batch.column("doc_id")
                for _, buf, off in text_chunks(batch.column("text"), ENCODE_BYTES):
                    tokens, n = coder.chunk(buf, off)
                    files[0].write(tokens.tobytes())
                    files[2].write(n.astype("<u8").tobytes())
                    total += len(tokens)
                files[1].write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
                n_docs, n_null = n_docs + len(batch), n_null + ids.null_count
        finally:
            for f in files or ():
                f.close()
        if files:
            yield pa.RecordBatch.from_pylist([dict(zip((x.split()[0] for x in MANIFEST.split(", ")),
                                                       (f"{folder}/{name}", coder.dtype.itemsize, n_docs, n_null, total, *head)))], _schema())

    parts = write_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, MANIFEST), "token-parts")
    # one row a file: the prefix sum runs over the files, not the documents
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash", "first_row").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))

    def offsets(batches):
        for batch in batches:
            for path, base, n in zip(*(batch.column(c).to_pylist() for c in ("path", "base", "n_docs"))):
                fs, root = pafs.FileSystem.from_uri(path)
                ends = np.zeros(n + 1, "<u8")
                np.cumsum(read_flat(f"{path}.len", "<u8", 0, n), out=ends[1:])
                own = f"{root}.off-{uuid.uuid4().hex}"
                with fs.open_output_stream(own, compression=None) as f:
                    f.write((ends + np.uint64(base)).astype("<u8").tobytes())
                fs.move(own, f"{root}.off")
            yield batch

    spread = based.repartition(max(1, parts.count()))
    manifest = write_table(spread.mapInArrow(offsets, spread.schema), "token-manifest")
    drop_table(parts)
    return manifest


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in MANIFEST.split(", "))])


def read_flat(uri: str, dtype: str, start: int, count: int) -> np.ndarray:
    """``count`` numbers from number ``start`` on: mapped where the file is local, else read by range."""
    fs, path = pafs.FileSystem.from_uri(uri)
    width = np.dtype(dtype).itemsize
    if not count:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", start * width, (count,))
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at(count * width, start * width), dtype)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens before it in all files), n_tokens, tokens (unsigned 32-bit, little-endian), one row per document.

    Files are read in runs of documents of about ``PIECE_TOKENS`` tokens, so that one large file is many tasks' work.
    """
    docs = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.ceil(F.col("n_tokens") / PIECE_TOKENS))).cast("long")
    runs = (manifest.withColumn("docs", docs).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.col("docs"))))
            .select("path", "width", "n_null", "base", "first", F.least("docs", F.col("n_docs") - F.col("first")).alias("docs")))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.large_binary())])

    def read(batches):
        for batch in batches:
            for path, width, n_null, base, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                off = np.asarray(read_flat(f"{path}.off", "<u8", first, n + 1)).astype(np.int64)
                ids = np.asarray(read_flat(f"{path}.doc", "<i8", first, n))
                i = 0
                while i < n:      # batches of a quarter of a run's tokens, or one longer document
                    j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE_TOKENS // 4, "right")) - 1)
                    tokens = np.asarray(read_flat(f"{path}.bin", f"<u{width}", int(off[i]) - base, int(off[j] - off[i]))).astype("<u4")
                    ends = (off[i:j + 1] - off[i]) * 4
                    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(tokens)])
                    empty = np.arange(first + i, first + j) < n_null
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], mask=empty), pa.array(off[i:j]), pa.array(np.diff(off[i:j + 1])), body], schema=schema)
                    i = j

    return runs.repartition(max(1, runs.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, tokens binary")
