"""N-gram Jaccard join by chosen paths.

Texts are sets of shingles of ``k`` words.  Texts with the same words form one
class, and one text stands for its class.  In every run a set follows a path
of sampled tokens: at depth d it goes to the bucket of the shingle that a
random order shared by all sets puts first among its own (two sets share that
token with the probability of their Jaccard similarity).  A bucket of at most
``bucket`` sets is compared by brute force, a larger one is split by the next
token, and at the last depth it is compared in blocks.  The number of runs is
the least with which a pair at the threshold meets in a bucket, even at the
last depth, with probability ``recall``.

Buckets compare short sketches (one byte a token) with a margin below the
threshold and only pass on a spanning forest, never all pairs.  Inside each
connected group found so, all texts are then compared exactly, block by block
(shingle sets, no sketch): that gives the exact links among them, so a pair
that missed every bucket still counts if its group holds both.

Defined results: a text of fewer than k words, but not none, is one shingle; a
null or empty text has no words and no link, also not to its like; rows that
share a doc_id and the words are one document, with other words they are
different ones, and so is every row without a doc_id; class_id is null only
where no document of the group has an id; extra columns are ignored; an empty
table gives no rows.  Inside, every row has a number of its own, written with
its text, and every different text that of its first row.
The exact comparison grows
with the square of the number of different texts in one group, in blocks of
about ``BLOCK`` words and ``TEXTS`` texts of which a task holds two, their
overlaps in strips of ``CELLS`` pairs; nothing else does.  Joins whose sides both grow with the
corpus ask for a sort-merge join, so that none is broadcast at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visiflow.llm.common import WHITE, Grams, drop_table, mix, signed, text_chunks, word_hashes, word_spans, write_table

#: Shingles of one side of an exact comparison.
BLOCK = 1_000_000
#: Texts of one side of an exact comparison.
TEXTS = 2000
#: Pairs of texts whose overlaps are held at once.
CELLS = 1 << 21
#: Margin of the sketch comparison in standard deviations of its estimate.
MARGIN = 3.5


def runs_for(threshold: float, depth: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


class Shingles:
    """Shingle hashes of a run of texts, end to end; ``cut`` has the first of each text that has any (``text``)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, k: int):
        starts, ends, self.first = word_spans(buf, off, WHITE)
        self.n = np.diff(self.first)
        self.words, self.buf, self.spans = word_hashes(buf, starts, ends), buf, (starts, ends)
        self.grams = Grams(self.words)
        count = np.where(self.n >= k, self.n - k + 1, np.minimum(self.n, 1))
        self.text = np.flatnonzero(count)
        count = count[self.text]
        self.cut = np.cumsum(count) - count
        at = np.arange(count.sum()) - np.repeat(self.cut - self.first[self.text], count)
        self.hashes = self.grams.at(at, np.repeat(np.minimum(self.n[self.text], k), count))

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits over all words of each text that has any."""
        second = Grams(word_hashes(self.buf, *self.spans, family=1), family=1)
        at, n = self.first[self.text], self.n[self.text]
        return self.grams.at(at, n), second.at(at, n)


def _orders(runs: int, depth: int) -> np.ndarray:
    rng = np.random.default_rng(23)
    return rng.integers(0, 1 << 63, (2, runs * depth), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(docs: DataFrame, k: int, runs: int, depth: int) -> DataFrame:
    """Per row with words: id, k1 and k2 (its word sequence), n_words, path (the bucket at every depth of every run), sketch."""
    orders = _orders(runs, depth)

    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for row, buf, off in text_chunks(batch.column("text")):
                s = Shingles(buf, off, k)
                if not len(s.text):
                    continue
                k1, k2 = s.sequence()
                tokens = np.stack([np.minimum.reduceat((s.hashes ^ x) * m, s.cut) for x, m in orders.T], 1)
                sketch = mix(tokens).astype(np.uint8)
                n = len(s.text)
                path = np.empty((n, runs, depth), np.uint64)
                at = np.broadcast_to(np.arange(1, runs + 1, dtype=np.uint64), (n, runs))
                for d in range(depth):
                    at = path[:, :, d] = mix(at * np.uint64(0x9E3779B97F4A7C15) + mix(tokens.reshape(n, runs, depth)[:, :, d]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * runs * depth, pa.int32()), pa.array(signed(path.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row + s.text]), pa.array(signed(k1)), pa.array(signed(k2)), pa.array(s.n[s.text]), lists,
                     pa.array([x.tobytes() for x in sketch], pa.binary())], names=["id", "k1", "k2", "n_words", "path", "sketch"])

    return docs.mapInArrow(run, "id long, k1 long, k2 long, n_words long, path array<long>, sketch binary")


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least member of the connected group of each of 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _bucket_edges(buckets: DataFrame, least: float) -> DataFrame:
    """(a, b): spanning forests of the pairs whose sketches agree in at least a share of ``least``."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column("members").to_pylist():
                ids = np.array([m["id"] for m in members])
                order = ids.argsort(kind="stable")
                ids = ids[order]
                sketch = np.frombuffer(b"".join(members[k]["sketch"] for k in order), np.uint8).reshape(len(ids), -1)
                if len(ids) == 2:
                    left, right = (np.array([0]), np.array([1])) if (sketch[0] == sketch[1]).mean() >= least else (np.zeros(0, int),) * 2
                else:
                    same = np.zeros((len(ids), len(ids)), np.uint8)
                    for column in sketch.T:
                        same += column[:, None] == column
                    left, right = np.nonzero(np.triu(same >= least * sketch.shape[1], 1))
                root = forest(len(ids), left, right)
                child = np.flatnonzero((root != np.arange(len(ids))) & (ids != ids[root]))
                a.append(ids[child])
                b.append(ids[root[child]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long").distinct()


def path_edges(texts: DataFrame, runs: int, depth: int, bucket: int, least: float) -> DataFrame:
    """Edges of all buckets of ``texts`` (id, path, sketch); the recursion goes on while a bucket is too large.

    Buckets are found on (id, run, at) alone; sketches and paths are fetched by
    id for the members of buckets of two or more.
    """
    first = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(r.alias("run"), F.element_at("path", r * depth + 1).alias("at")))
    active = texts.select("id", F.explode(first).alias("r")).select("id", "r.run", "r.at")
    parts = []
    for d in range(1, depth + 1):
        sizes = write_table(active.groupBy("at").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), f"buckets{d}")
        shared = write_table(active.join(sizes.hint("merge"), "at"), f"shared{d}")
        drop_table(sizes)
        ready = shared if d == depth else shared.filter(F.col("size") <= bucket)
        ready = ready.join(texts.select("id", "sketch").hint("merge"), "id")
        if d == depth:  # what is still too large meets block by block
            n = F.ceil(F.col("size") / bucket).cast("int")
            own = F.pmod(F.xxhash64("id", "run"), n).cast("int")
            ready = (ready.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
                     .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")))
            grouped = ready.groupBy("at", "low", "high")
        else:
            grouped = ready.groupBy("at")
        members = grouped.agg(F.collect_list(F.struct("id", "sketch")).alias("members")).filter(F.size("members") > 1)
        parts.append(write_table(_bucket_edges(members, least), f"edges{d}"))
        large = shared.filter(F.col("size") > bucket)
        if d == depth or large.isEmpty():
            drop_table(shared)
            break
        at = F.element_at("path", F.col("run") * depth + d + 1).alias("at")
        active = write_table(large.select("id", "run").join(texts.select("id", "path").hint("merge"), "id").select("id", "run", at), f"paths{d + 1}")
        drop_table(shared)
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): every id of an edge (a, b) with the least id of its connected group.

    Large-star and small-star rounds; each round is a written table.
    """
    stars = write_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = write_table(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        drop_table(stars)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        stars = write_table(small.select("e.*").filter("a <> b").distinct(), "small-star")
        drop_table(large)
        n = stars.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("ids")).first()
        if n["n"] == n["ids"] and stars.select(F.col("b").alias("a")).join(stars, "a", "left_semi").isEmpty():
            return stars.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row, buf, off in text_chunks(batch.column("text")):
                s = Shingles(buf, off, k)
                sets = [np.unique(x).tobytes() for x in np.split(s.hashes, s.cut[1:])] if len(s.text) else []
                some = batch.select(["id", "copies", "grp", "blocks"]).take(pa.array(row + s.text))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(sets, pa.binary())], names=[*some.schema.names, "shingles"])

    return texts.select("id", "copies", "grp", "blocks", "text").mapInArrow(run, "id long, copies long, grp long, blocks int, shingles binary")


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes of all intersections in strips of about ``CELLS`` pairs: (first row, rows x sets)."""
    n = len(sets)
    if n == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        yield 0, np.array([[len(sets[0]), common], [common, len(sets[1])]])
        return
    rows = np.repeat(np.arange(n), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], number[column[keep]]
    order = column.argsort(kind="stable")
    rows, column = rows[order], column[order]
    high, step = max(1, CELLS // n), max(64, 2 * CELLS // n)
    for first in range(0, n, high):
        out = np.zeros((min(high, n - first), n), np.int32)
        for a in range(0, int(shared.sum()), step):
            i, j = np.searchsorted(column, [a, a + step])
            part = np.zeros((n, step), np.float32)
            part[rows[i:j], column[i:j] - a] = 1
            out += (part[first:first + high] @ part.T).astype(np.int32)
        yield first, out


def _exact_links(blocks: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links, parent) per block pair: links to the texts on the other side, each with its copies."""

    def run(batches):
        for batch in batches:
            out = {"id": [], "n_links": [], "parent": []}
            for k in range(len(batch)):
                members = sorted(batch.column("members")[k].as_py(), key=lambda m: (m["id"], m["shingles"]))
                members = [m for n, m in enumerate(members) if not n or m["id"] != members[n - 1]["id"]]
                cross = batch.column("low")[k].as_py() != batch.column("high")[k].as_py()
                ids, copies = np.array([m["id"] for m in members]), np.array([m["copies"] for m in members])
                sets = [np.frombuffer(m["shingles"], np.uint64) for m in members]
                own, size = np.array([m["own"] for m in members]), np.array([len(x) for x in sets])
                at = np.arange(len(ids))
                links, root = np.zeros(len(ids), np.int64), at
                for first, common in overlaps(sets):
                    some = at[first:first + len(common)]
                    linked = (common >= threshold * (size[some, None] + size - common) - 1e-6) & (some[:, None] < at)
                    if cross:
                        linked &= own[some, None] != own
                    left, right = np.nonzero(linked)
                    left += first
                    links += (np.bincount(left, copies[right], len(ids)) + np.bincount(right, copies[left], len(ids))).astype(np.int64)
                    root = forest(len(ids), np.concatenate([left, at]), np.concatenate([right, root]))
                some = np.flatnonzero(links)
                out["id"].append(ids[some])
                out["n_links"].append(links[some])
                out["parent"].append(ids[root[some]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out.values()], names=list(out))

    return blocks.mapInArrow(run, "id long, n_links long, parent long")


def jaccard_groups(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999, depth: int = 4, bucket: int = 1000,
                   with_first: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, class_id (least doc_id of the connected group), n_links (other documents at the threshold or above).

    ``with_first`` adds the named columns and ``first``: whether the row is the
    one of its group with the least doc_id (a null one is the last; one row of
    equal ones), null for a text without words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = write_table(docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", *(with_first or ()), "text"), "numbered")
    keyed = numbered.select("id", "text")
    rows = write_table(numbered.drop("text"), "rows")
    runs = runs_for(threshold, depth, recall)
    least = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / (runs * depth))
    signed_texts = write_table(signatures(keyed, k, runs, depth), "signatures")
    # one row a document: rows that share a doc_id and the words are one, a row without an id is one
    own = F.when(F.col("doc_id").isNull(), F.col("id"))
    documents = (signed_texts.select("id", "k1", "k2").join(rows.select("id", "doc_id").hint("merge"), "id")
                 .groupBy("k1", "k2", "doc_id", own.alias("own")).agg(F.min("id").alias("id")))
    copies = write_table(documents.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "copies")
    members = write_table(signed_texts.select("id", "k1", "k2", "n_words").join(copies.hint("merge"), ["k1", "k2"]).select("id", "n_words", "rep", "copies"), "members")
    drop_table(copies)
    # paths and sketches of one text a class
    known = write_table(signed_texts.select("id", "path", "sketch").join(members.filter("id = rep").select("id").hint("merge"), "id", "left_semi"), "texts")
    drop_table(signed_texts)
    groups = components(path_edges(known, runs, depth, bucket, least))
    drop_table(known)
    reps = members.filter("id = rep").select("id", "copies", "n_words")
    sized = groups.join(reps, "id").withColumnRenamed("root", "grp")
    blocks = sized.groupBy("grp").agg(F.greatest(F.ceil(F.sum("n_words") / BLOCK), F.ceil(F.count(F.lit(1)) / TEXTS)).cast("int").alias("blocks"))
    todo = write_table(sized.join(blocks, "grp").select("id", "copies", "grp", "blocks"), "groups")
    own = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    sets = (_shingle_sets(keyed.join(todo.hint("merge"), "id"), k).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    pairs = (sets.groupBy("grp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
             .agg(F.collect_list(F.struct("id", "copies", "own", "shingles")).alias("members")).filter(F.size("members") > 1))
    links = write_table(_exact_links(pairs.select("low", "high", "members"), threshold), "exact-links")
    drop_table(numbered)

    found = links.groupBy("id").agg(F.sum("n_links").alias("near"))
    roots = components(links.select(F.col("id").alias("a"), F.col("parent").alias("b")))
    # written, so that both sides of the next join are plain exchanges and a class of many copies can be split
    of_rep = write_table(found.join(roots, "id", "left").select(F.col("id").alias("rep"), "near", "root"), "links-of-texts")
    linked = members.join(of_rep.hint("merge"), "rep", "left").select(
        "id", F.coalesce("root", "rep").alias("class"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"))
    placed = write_table(rows.join(linked.hint("merge"), "id", "left"), "placed")
    # combined per task before they move: a class of any size is a few rows
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    classes = write_table(placed.filter("class is not null").groupBy("class").agg(F.min(order).alias("head")).select("class", "head"), "classes")
    found = placed.join(classes.hint("merge"), "class", "left")
    extra = [] if with_first is None else [*with_first, (F.col("head.id") == F.col("id")).alias("first")]
    return found.select("doc_id", F.coalesce("head.doc_id", "doc_id").cast(kind).alias("class_id"),
                        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), *extra)
