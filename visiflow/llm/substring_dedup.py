"""Substring dedup: level-wise doubling over word windows.

Windows of ``window`` consecutive words (a multiple of four) are found by
doubling a quarter: level 1 has windows of window/4 words, level 2 twice that,
level 3 the whole.  Only windows repeated at one level are extended to the
next, and the run ends at the full length or as soon as none survive.

Level 1 looks at one window in about eight: every full window stands for the
quarter window of least hash inside it (its anchor), so that two equal full
windows stand for equal anchors at the same offset and nothing is lost.
Level 2 extends a surviving anchor to twice its length on either side, level 3
takes the full windows whose anchor survived on every side that fits.  Of equal
full windows the first (least doc_id, then least start) stays and every word
that a later one covers goes.  Windows are judged on the input.

Hashes have 64 bits at the first two levels (a chance equality there only costs
work) and 128 at the last.  Hot windows are combined before they move: a
counting task sends each hash once, and a task of the last level sends only the
first of equal windows that it has seen, so one hash has at most as many rows
as there are runs of ``RUN`` windows.

Defined results: a null or empty text has no words; texts of fewer than
``window`` words keep all; rows that share a doc_id and the text are one
document, with other texts they are different ones (the order among them is
that of a hash of the text), and so is every row without a doc_id, which sorts
before all others; words only go where a window covers them;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visiflow.llm.common import (WHITE, Grams, drop_table, signed, text_buffer, text_chunks, word_hashes, word_spans, write_table)

#: Full windows that a task compares before it sends the first of each kind on.
RUN = 1 << 21
_NULL_ID = -(1 << 63)


class Chunk:
    """Words, quarter-window hashes and anchors of a run of texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, window: int):
        starts, ends, self.first = word_spans(buf, off, WHITE)
        self.n = len(starts)
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.buf, self.spans = buf, (starts, ends)
        self.grams = Grams(word_hashes(buf, starts, ends))
        self.end = self.first[1:][self.text]  # of each word's text
        self.window, self.quarter = window, window // 4
        self.full = np.flatnonzero(np.arange(self.n) + window <= self.end)  # starts of full windows
        if len(self.full):
            least, at = self.grams.all(self.quarter), np.arange(self.n - self.quarter + 1)
            reach, have = window - self.quarter + 1, 1
            while have < reach:  # leftmost least over twice as many, then the rest
                step = min(have, reach - have)
                right = least[step:] < least[:-step]
                least, at = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step])
                have += step
            self.anchor_of = at[self.full]  # the anchor of each full window
            self.anchors = np.unique(self.anchor_of)
        else:
            self.anchor_of = self.anchors = np.zeros(0, np.int64)

    def doubled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Level 2 from each anchor, to the left and to the right: hash, and whether it fits into the text."""
        a, q = self.anchors, self.quarter
        left, right = a - q >= self.first[:-1][self.text[a]], a + 2 * q <= self.end[a]
        return (self.grams.at(np.where(left, a - q, a), np.where(left, 2 * q, q)) ^ np.uint64(1), left,
                self.grams.at(a, np.where(right, 2 * q, q)) | np.uint64(1), right)

    def second(self) -> Grams:
        return Grams(word_hashes(self.buf, *self.spans, family=1), family=1)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("id").to_numpy(zero_copy_only=False)


def _anchor_hashes(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for _, buf, off in text_chunks(batch.column("text")):
                c = Chunk(buf, off, window)
                yield pa.RecordBatch.from_arrays([pa.array(signed(c.grams.at(c.anchors, c.quarter)))], names=["h"])

    return docs.select("text").mapInArrow(run, "h long")


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = _ids(batch)
            for row, buf, off in text_chunks(batch.column("text")):
                c = Chunk(buf, off, window)
                text = c.text[c.anchors]
                hl, left, hr, right = c.doubled()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(c.grams.at(c.anchors, c.quarter))), pa.array(ids[row + text]), pa.array((c.anchors - c.first[text]).astype(np.int32)),
                     pa.array(signed(hl), mask=~left), pa.array(signed(hr), mask=~right)], names=["h", "id", "at", "hl", "hr"])

    return docs.mapInArrow(run, "h long, id long, at int, hl long, hr long")


def _first_of_run(h1, h2, ids, start):
    """Of equal windows of one run: (index of the first of each, index of the later ones)."""
    order = np.lexsort((start, ids, h1))
    a, b, i, s = h1[order], h2[order], ids[order], start[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    later = (i != i[head]) | (s != s[head])
    return order[new], order[later]


def _full_windows(docs: DataFrame, window: int) -> DataFrame:
    """Rows of two kinds: first windows of a run (h1, h2, id, start), and starts of later ones (id, later)."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("later", pa.list_(pa.int32()))])

    def settle(held):
        h1, h2, ids, start = (np.concatenate(x) for x in zip(*held))
        first, later = _first_of_run(h1, h2, ids, start)
        for a in range(0, len(first), 1 << 18):
            k = first[a:a + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h1[k])), pa.array(signed(h2[k])), pa.array(ids[k]), pa.array(start[k]),
                                              pa.nulls(len(k), pa.list_(pa.int32()))], schema=schema)
        if len(later):
            later = later[np.lexsort((start[later], ids[later]))]
            own, cut = np.unique(ids[later], return_index=True)
            none = pa.nulls(len(own), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(later)), pa.int32()), pa.array(start[later]))
            yield pa.RecordBatch.from_arrays([none, none, pa.array(own), none.cast(pa.int32()), lists], schema=schema)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, marks = _ids(batch), batch.column("marks")
            for row, buf, off in text_chunks(batch.column("text")):
                c = Chunk(buf, off, window)
                some = marks.slice(row, len(off) - 1)
                flat = some.flatten().to_numpy(zero_copy_only=False)
                place = c.first[:-1][np.repeat(np.arange(len(some)), [len(x) for x in some])] + (flat >> 1)
                side = np.zeros((2, c.n + 1), bool)
                side[flat & 1, place] = True
                ahead = c.anchor_of - c.full
                ok = ((ahead > window // 2) | side[1, c.anchor_of]) & ((ahead < c.quarter) | side[0, c.anchor_of])
                at = c.full[ok]
                text = c.text[at]
                held.append((c.grams.at(at, window), c.second().at(at, window), ids[row + text], (at - c.first[text]).astype(np.int32)))
                size += len(at)
                if size >= RUN:
                    yield from settle(held)
                    held, size = [], 0
        if held:
            yield from settle(held)

    return docs.mapInArrow(run, "h1 long, h2 long, id long, start int, later array<int>")


def later_windows(docs: DataFrame, window: int) -> DataFrame | None:
    """id, starts: windows that also start earlier.  ``docs`` has id (no null) and text; None if no level survives."""
    repeated = write_table(_anchor_hashes(docs, window).groupBy("h").count().filter("count > 1").select("h"), "level1")
    if repeated.isEmpty():
        return None
    anchors = write_table(_anchor_rows(docs, window).join(repeated, "h", "left_semi").drop("h"), "level1-anchors")
    sides = anchors.select("id", F.explode(F.array(F.struct(F.col("hl").alias("h"), (F.col("at") * 2).alias("mark")),
                                                   F.struct(F.col("hr").alias("h"), (F.col("at") * 2 + 1).alias("mark")))).alias("x"))\
        .select("id", "x.h", "x.mark").filter("h is not null")
    doubled = write_table(sides.groupBy("h").count().filter("count > 1").select("h"), "level2")
    marks = write_table(sides.join(doubled, "h", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("mark")).alias("marks")), "level2-marks")
    drop_table(anchors)
    if marks.isEmpty():
        return None
    windows = write_table(_full_windows(docs.join(marks, "id"), window), "level3")
    rank = F.rank().over(Window.partitionBy("h1", "h2").orderBy("id", "start"))
    across = windows.filter("h1 is not null").select("id", "start", rank.alias("r")).filter("r > 1")
    starts = across.groupBy("id").agg(F.collect_list("start").alias("later")).unionByName(windows.filter("h1 is null").select("id", "later"))
    out = write_table(starts.groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("later")))).alias("starts")), "later-windows")
    drop_table(windows)
    return out


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and id: a long per document, in the order of doc_id.

    Where no two rows share a doc_id (a null one included) that is the id; else
    the documents are sorted and numbered, and the rows written with the number.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    if keyed.groupBy("id").count().filter("count > 1").isEmpty():
        return keyed
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)
    rows = write_table(keyed.select("*", F.xxhash64("text").alias("kind"), alone.alias("alone")), "numbered")
    order = rows.select("id", "kind", "alone").distinct().orderBy(F.col("alone") < 0, "id", "kind", "alone")
    numbers = write_table(order.withColumn("number", F.monotonically_increasing_id()), "numbers")
    out = write_table(rows.join(numbers.hint("merge"), ["id", "kind", "alone"]).select("doc_id", F.col("number").alias("id"), "text"), "documents")
    drop_table(rows)
    return out


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (the words that stay, joined by one blank)."""
    if window % 4:
        raise ValueError("window must be a multiple of four")
    keyed = _documents(docs)
    starts = later_windows(keyed.select("id", "text"), window)
    joined = keyed.join(starts, "id", "left") if starts is not None else keyed.withColumn("starts", F.lit(None).cast("array<int>"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 128):
                part = batch.slice(a, 128)
                buf, off = text_buffer(part.column("text"))
                n, removed, kept = [], [], []
                for k, at in enumerate(part.column("starts").to_pylist()):
                    words = buf[off[k]:off[k + 1]].tobytes().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    if at:
                        at = np.array(at)
                        at = at[at + window <= len(words)]
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    stay = np.cumsum(gone)[:-1] == 0
                    n.append(len(words))
                    removed.append(int(len(words) - stay.sum()))
                    kept.append(b" ".join(compress(words, stay.tolist()) if removed[-1] else words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
