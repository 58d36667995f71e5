"""Benchmark decontamination with a distributed positional inverted index.

The index is document-partitioned: every row of the index table is one segment
(a run of whole documents of about ``SEGMENT_BYTES`` of text) that holds, per
term, the sorted list of positions at which the term stands.  A search takes
each test window's terms from the rarest list of the segment to the most
frequent one and intersects the lists, each shifted by the term's place in the
window; what is left are exact phrase matches.  A proximity match is a posting of the window's
anchor around which every other term of the window stands within its length
plus ``slop`` words, in any order; the anchor is the term that is rarest among
all test windows (ties: least word), so it does not depend on the segment.

The test items are the stated query set.  They are taken in blocks of
``block_items`` items (a fixed bound on what tasks receive); every block is
searched in all documents.  Only terms that the block's items use are stored.

Words: A-Z lower-cased, then runs of digits, letters a-z and non-ASCII
characters.  Defined results: a null or empty text has no words and no match;
an item without words has no window; an item whose id is null marks words but
adds no id; rows that repeat a document or an item give repeated or equal
results; extra columns are ignored; without items nothing matches.  A text is
never split, so a task holds at least its longest text.
"""

from __future__ import annotations

from functools import reduce
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiflow.llm.common import text_chunks, write_table

SEGMENT_BYTES = 8 << 20
#: Candidate places examined at once.
CANDIDATES = 1 << 20
#: Byte -> byte: lower case, and a blank for all that stands between words.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))

SEGMENT = "doc_ids binary, null_ids binary, keys binary, n_words binary, terms binary, starts binary, postings binary"
FOUND = "doc_id long, key long, n_words long, matches array<struct<item_id:long,start:int,end:int>>, near_items array<long>"


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(_FOLD).split()


class Items:
    """Windows of one block of items: distinct term sequences, and the items that have each."""

    def __init__(self, rows: list[tuple[int | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in rows:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k:k + window]), set()).add(item)
        self.items = [sorted(x, key=lambda i: (i is None, i)) for x in found.values()]
        self.lens = np.array([len(w) for w in found], np.int64)
        self.windows = np.full((len(found), window), -1, np.int64)
        for k, w in enumerate(found):
            self.windows[k, :len(w)] = w
        uses = np.bincount(self.windows[self.windows >= 0], minlength=len(self.vocabulary))
        place = np.empty(len(self.vocabulary) + 1, np.int64)  # rank by (windows that use the term, word); the last entry is padding
        names = list(self.vocabulary)
        place[sorted(range(len(names)), key=lambda t: (uses[t], names[t]))] = np.arange(len(names))
        place[-1] = len(names)
        self.anchor = place[self.windows].argmin(1) if len(found) else np.zeros(0, np.int64)


def _pack(x, kind) -> bytes:
    return np.asarray(x, kind).tobytes()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], gap: int) -> DataFrame:
    """Segments with the postings of the vocabulary's terms; texts stand ``gap`` positions apart."""

    def run(batches):
        get = vocabulary.get
        for batch in batches:
            ids, keys, text = batch.column("doc_id").cast(pa.int64()), batch.column("key"), batch.column("text")
            for row, buf, off in text_chunks(text, SEGMENT_BYTES):
                data, terms, lens = buf.tobytes(), [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                    words = data[a:b].translate(_FOLD).split()
                    lens.append(len(words))
                    terms.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                lens = np.array(lens, np.int64)
                base = np.cumsum(lens + gap) - lens - gap
                term = np.concatenate(terms)
                at = np.flatnonzero(term >= 0)
                place = at + np.repeat(np.arange(len(lens)) * gap, lens)[at]
                order = np.argsort(term[at], kind="stable")
                distinct, starts = np.unique(term[at][order], return_index=True)
                here = ids.slice(row, len(lens))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], pa.binary()) for x in (
                        _pack(here.fill_null(0), np.int64), _pack(here.is_null(), bool), _pack(keys.slice(row, len(lens)), np.int64), _pack(lens, np.int64),
                        _pack(distinct, np.int32), _pack(starts, np.int32), _pack(place[order], np.int32 if base[-1] + lens[-1] < 2**31 else np.int64))],
                    names=["doc_ids", "null_ids", "keys", "n_words", "terms", "starts", "postings"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, SEGMENT)


def _runs(live: np.ndarray, size: np.ndarray):
    """The windows in runs of about ``CANDIDATES`` candidate places."""
    ends, cut = np.cumsum(size[live]), 0
    while cut < len(live):
        to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + CANDIDATES, "right")))
        yield live[cut:to]
        cut = to


class Segment:
    """One segment's lists as one sorted array of term * span + position."""

    def __init__(self, row: dict, gap: int):
        self.doc_ids = [None if null else i for i, null in zip(np.frombuffer(row["doc_ids"], np.int64).tolist(), np.frombuffer(row["null_ids"], bool))]
        self.keys_of, self.n_words = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["n_words"], np.int64)
        terms, starts = np.frombuffer(row["terms"], np.int32).astype(np.int64), np.frombuffer(row["starts"], np.int32).astype(np.int64)
        total = int(self.n_words.sum()) + gap * len(self.n_words)
        places = np.frombuffer(row["postings"], np.int32 if total - gap < 2**31 else np.int64).astype(np.int64)
        self.base = np.cumsum(self.n_words + gap) - self.n_words - gap
        self.span = total + 4 * gap + 1
        lens = np.diff(np.append(starts, len(places)))
        self.terms, self.lens = terms, lens
        self.keys = np.repeat(terms, lens) * self.span + places + gap
        self.first = starts
        self.gap = gap

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= high)

    def search(self, items: Items, slop: int | None):
        """(window, place) of exact matches and of proximity matches."""
        exact, near = [], []
        count = np.zeros(len(items.vocabulary) + 1, np.int64)  # the last entry stands for padding
        first = np.zeros(len(items.vocabulary) + 1, np.int64)
        count[self.terms], first[self.terms] = self.lens, self.first
        if len(self.keys):
            freq = np.where(items.windows >= 0, count[items.windows], np.iinfo(np.int64).max)
            order = freq.argsort(1, kind="stable")  # rarest first, padding last
            least = np.take_along_axis(freq, order[:, :1], 1)[:, 0]
            live = np.flatnonzero(least > 0)
            rarest = order[:, 0]
            exact += [self._phrase(items, some, order, rarest, count, first) for some in _runs(live, least)]
            if slop is not None:
                held = count[items.windows[np.arange(len(items.lens)), items.anchor]]
                near += [self._near(items, some, order, count, first, slop) for some in _runs(live, held)]
        join = lambda x: tuple(np.concatenate(c) for c in zip(*x)) if x else (np.zeros(0, np.int64),) * 2
        return join(exact), join(near)

    def _postings(self, items, live, column, count, first):
        """Every posting of one term (by its column) of each live window."""
        term = items.windows[live, column[live]]
        n = count[term]
        win = np.repeat(live, n)
        at = np.repeat(first[term], n) + np.arange(len(win)) - np.repeat(np.cumsum(n) - n, n)
        return win, self.keys[at] - np.repeat(term, n) * self.span

    def _phrase(self, items, live, order, rarest, count, first):
        win, place = self._postings(items, live, rarest, count, first)
        start = place - rarest[win]
        for k in range(1, items.windows.shape[1]):
            if not len(win):
                break
            off = order[win, k]
            term = items.windows[win, off]
            keep = (term < 0) | self.has(term * self.span + start + off)
            win, start = win[keep], start[keep]
        return win, start - self.gap

    def _near(self, items, live, order, count, first, slop):
        win, place = self._postings(items, live, items.anchor, count, first)
        for k in range(items.windows.shape[1]):
            if not len(win):
                break
            term, reach = items.windows[win, order[win, k]], items.lens[win] + slop
            keep = (term < 0) | self.within(term * self.span + place - reach, term * self.span + place + reach)
            win, place = win[keep], place[keep]
        return win, place - self.gap


def _found(segment: Segment, items: Items, slop: int | None) -> pa.RecordBatch:
    """One row per document of the segment: merged match intervals per item, and items only near."""
    (win, start), (near_win, near_at) = segment.search(items, slop)
    doc = np.searchsorted(segment.base, start, "right") - 1
    matches: list[dict] = [{} for _ in segment.doc_ids]
    order = np.lexsort((start, doc))
    for d, w, s in zip(doc[order].tolist(), win[order].tolist(), (start - segment.base[doc])[order].tolist()):
        end = s + int(items.lens[w])
        for item in items.items[w]:
            spans = matches[d].setdefault(item, [])
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], end)
            else:
                spans.append([s, end])
    near: list[set] = [set() for _ in segment.doc_ids]
    pairs = np.unique(np.stack([np.searchsorted(segment.base, near_at, "right") - 1, near_win]), axis=1) if len(near_win) else np.zeros((2, 0), np.int64)
    for d, w in pairs.T.tolist():
        near[d].update(i for i in items.items[w] if i not in matches[d] and i is not None)
    return pa.RecordBatch.from_arrays(
        [pa.array(segment.doc_ids, pa.int64()), pa.array(segment.keys_of), pa.array(segment.n_words, pa.int64()),
         pa.array([[{"item_id": i, "start": a, "end": b} for i, spans in m.items() for a, b in spans] for m in matches],
                  pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))),
         pa.array([sorted(x) for x in near], pa.list_(pa.int64()))],
        names=["doc_id", "key", "n_words", "matches", "near_items"])


def search_block(docs: DataFrame, rows: list[tuple[int | None, str | None]], window: int, slop: int | None) -> DataFrame:
    """Index the documents for one block of items, store the index, search it."""
    items = Items(rows, window)
    gap = window + (2 * (window + slop) if slop is not None else 0) + 1
    index = write_table(build_index(docs, items.vocabulary, gap), "postings")

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                yield _found(Segment({n: batch.column(n)[k].as_py() for n in batch.schema.names}, gap), items, slop)

    return index.mapInArrow(run, FOUND)


def _merged(matches: Column) -> Column:
    """Match intervals of several blocks, those of one item that meet as one."""
    last = lambda out: F.element_at(out, -1)
    joined = lambda out, m: F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(
        m.item_id.alias("item_id"), last(out).start.alias("start"), F.greatest(last(out).end, m.end).alias("end"))))
    return F.aggregate(F.sort_array(matches), F.slice(matches, 1, 0), lambda out, m: F.when(
        (F.size(out) > 0) & F.try_element_at(out, F.lit(-1)).item_id.eqNullSafe(m.item_id) & (m.start <= F.try_element_at(out, F.lit(-1)).end),
        joined(out, m)).otherwise(F.concat(out, F.array(m))))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int | None = 5, block_items: int = 20_000,
                       key: str | None = None) -> DataFrame:
    """Per document row: doc_id, n_words, matches (item, first word, end word) and near_items; and the long column ``key``, if one is named.

    Items come to the driver a block at a time.  With several blocks the rows
    are numbered first, and the parts are put together by that number.
    """
    out = ["doc_id", *([key] if key else []), "n_words", "matches", "near_items"]
    docs = docs.select("doc_id", (F.col(key) if key else F.lit(0)).cast("long").alias("key"), "text")
    rows = map(tuple, items.select(F.col("item_id").cast("long"), "text").toLocalIterator())
    block, ahead = list(islice(rows, block_items)), list(islice(rows, 1))
    if not ahead:
        found = search_block(docs, block, window, slop)
        return (found.withColumnRenamed("key", key) if key else found).select(*out)
    numbered = write_table(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    by_row, parts = numbered.select("doc_id", F.col("row").alias("key"), "text"), []
    while block:
        parts.append(search_block(by_row, block, window, slop))
        block, ahead = ahead + list(islice(rows, block_items - len(ahead))), []
    every = (reduce(DataFrame.unionByName, parts).withColumnRenamed("key", "row").groupBy("row")
             .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"),
                  F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"))
             .withColumn("near_items", F.sort_array(F.array_except("near_items", F.transform("matches", lambda m: m.item_id))))
             .withColumn("matches", _merged(F.col("matches"))))
    names = numbered.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("key").alias(key or "key"))
    return names.join(every.hint("merge"), "row").select(*out)


def hit_words(matches: Column) -> Column:
    """Number of words inside any match."""
    return F.aggregate(F.sort_array(F.transform(matches, lambda m: F.struct(m.start.alias("start"), m.end.alias("end")))),
                       F.struct(F.lit(0).alias("n"), F.lit(0).alias("last")),
                       lambda a, m: F.struct((a.n + F.greatest(F.lit(0), m.end - F.greatest(a.last, m.start))).alias("n"),
                                             F.greatest(a.last, m.end).alias("last")),
                       lambda a: a.n)
