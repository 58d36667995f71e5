"""Phrase collocations by ERA-style vertical partitioning of the word suffixes.

Texts are sequences of words cut into pieces; every word starts a suffix, cut
off after ``DEPTH`` words.  The suffix tree is never built whole:

1. Words are counted per language: the S-prefixes of one word.
2. Prefixes are sized against the memory budget.  A word of more suffixes
   than the budget, or than one ``share``-th of all (so that no group is a large
   part of the work), is extended to prefixes of two words, counted in one more
   pass; such a pair to three.  What is left is dealt by a hash of its prefix
   into groups of a quarter of the budget on average.
3. A pass over the texts sends every suffix to its prefix's group, equal
   suffixes of one chunk of text combined, sorted, as one block per group.
4. Each group builds its depth-truncated subtree on its own: its suffixes
   sorted are the leaves, a leaf's total is its number of occurrences, and the
   count of an inner node (a phrase) is the sum over the leaves below it.

Counts of candidates are joined with those of their parts, scored in exact
decimals, and phrases that a longer one explains are dropped.

Words travel as 64-bit hashes of (language, word).  The table of all words
shows whether two of them share a hash; then another hash family is taken, so
that the counts are exact.

Defined results: a null text has no words and adds no language; a null lang is
``und``; rows that repeat an id count each; extra columns are ignored; an empty
table gives no rows.  A task holds a chunk of ``TEXT_BYTES`` (or one longer
text), or the different leaves of one group.  The lists of extended prefixes
have at most ``EXTENDED`` entries at every size, since a prefix is only extended
above one ``EXTENDED``-th of all suffixes (``share`` is smaller).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiflow.llm.common import drop_table, mix, signed, text_chunks, word_hashes, word_spans, write_table

DEPTH, BUDGET, SHARE, EXTENDED, TEXT_BYTES = 3, 1 << 20, 200, 1_000_000, 4 << 20
NO_LANG = "und"
#: What ends a piece, and what separates words inside it.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = PIECE_END.copy()
GAP[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
#: A leaf in a block: the hashes of up to three words (0: the piece ends) and its occurrences.
LEAF = np.dtype([("a", "<u8"), ("b", "<u8"), ("c", "<u8"), ("n", "<u4")])


class Pieces:
    """Words of one chunk of texts: bytes, spans, hashes, and where each word's piece ends."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, langs: list[str], family: int):
        self.buf = _FOLD[buf]
        self.starts, self.ends, self.first = word_spans(self.buf, off, GAP)
        self.text = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        salt = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
        salts = np.array([salt[x] for x in langs], np.uint64)
        self.words = mix(word_hashes(self.buf, self.starts, self.ends, family) ^ salts[self.text])
        self.words[self.words == 0] = 1
        piece = np.cumsum(PIECE_END[self.buf])[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.joined = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])      # the next word is in the same piece

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First, second and third word (0: none) of every suffix of two words or more."""
        w, j = self.words, self.joined
        third = np.zeros(len(j), np.uint64)
        third[:-1] = np.where(j[1:], w[2:], 0) if len(j) > 1 else third[:-1]
        at = np.flatnonzero(j)
        return w[at], w[at + 1], third[at]


def _chunks(batches, family: int) -> Iterator[tuple[Pieces, list[str]]]:
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        for row, buf, off in text_chunks(batch.column("text"), TEXT_BYTES):
            langs = [NO_LANG if x is None else x for x in lang[row:row + len(off) - 1]]
            yield Pieces(buf, off, langs, family), langs


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each run of equal keys in sorted order, and the runs' lengths; ``keys`` are 64-bit columns."""
    both = keys[0] if len(keys) == 1 else mix(mix(keys[0].copy()) + keys[1])
    order = np.argsort(both)
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(at, append=len(order))


def count_words(docs: DataFrame, family: int = 0) -> DataFrame:
    """(lang, word, h, n): occurrences of every word of every language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for p, langs in _chunks(batches, family):
            at, n = _distinct(p.words)
            data = p.buf.tobytes()
            words = [data[a:b] for a, b in zip(p.starts[at].tolist(), p.ends[at].tolist())]
            lang = pa.array(langs, pa.string()).take(pa.array(p.text[at]))
            for i in range(0, len(at), 100_000):
                k = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([lang[k], pa.array(words[k], pa.binary()).cast(pa.string()), pa.array(signed(p.words[at[k]])), pa.array(n[k])], schema=schema)

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, word string, h long, n long")
    return rows.groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def _hits(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a.copy()) + b)


def _pair_counts(docs: DataFrame, family: int, first: np.ndarray) -> DataFrame:
    """(h1, h2, a): occurrences of the pairs whose first word is in ``first``: the prefixes of two words."""
    schema = pa.schema([(x, pa.int64()) for x in ("h1", "h2", "a")])

    def run(batches):
        for p, _ in _chunks(batches, family):
            a, b, _ = p.suffixes()
            hit = _hits(first, a)
            a, b = a[hit], b[hit]
            at, n = _distinct(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(signed(a[at])), pa.array(signed(b[at])), pa.array(n)], schema=schema)

    return docs.select("lang", "text").mapInArrow(run, "h1 long, h2 long, a long").groupBy("h1", "h2").agg(F.sum("a").alias("a"))


def _merge(leaves: np.ndarray) -> np.ndarray:
    """Leaves sorted by their words, equal ones as one with the total of their occurrences (``n`` as 64-bit)."""
    leaves = leaves[np.lexsort((leaves["c"], leaves["b"], leaves["a"]))]
    new = np.ones(len(leaves), bool)
    new[1:] = (leaves["a"][1:] != leaves["a"][:-1]) | (leaves["b"][1:] != leaves["b"][:-1]) | (leaves["c"][1:] != leaves["c"][:-1])
    at = np.flatnonzero(new)
    out = np.empty(len(at), [*((x, "<u8") for x in "abc"), ("n", "<i8")])
    for x in "abc":
        out[x] = leaves[x][at]
    out["n"] = np.add.reduceat(leaves["n"].astype(np.int64), at) if len(at) else 0
    return out


def count_phrases(docs: DataFrame, words: DataFrame, min_count: int, family: int = 0, budget: int = BUDGET, share: int = SHARE,
                  extended: int = EXTENDED) -> DataFrame:
    """(h1, h2, h3, a): every phrase of two (h3 null) or three words with at least ``min_count`` occurrences."""
    total = words.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // extended))
    groups = max(1, -(-4 * total // budget))
    most = min(budget, -(-total // share))      # suffixes that one prefix may have
    hashes = lambda rows: np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))
    large = hashes(words.filter(F.col("n") > most).select("h").collect())      # at most total / most
    larger = []
    if len(large):
        larger = _pair_counts(docs, family, large).filter(F.col("a") > most).collect()      # at most total / most
    column = lambda k: np.array([r[k] for r in larger], np.int64).view(np.uint64)
    deep = np.sort(_pair(column(0), column(1)))      # chance equalities only split a prefix that need not be, see ``known``
    known = docs.sparkSession.createDataFrame([(r.h1, r.h2, None, r.a) for r in larger], "h1 long, h2 long, h3 long, a long")
    known_pairs = {(r.h1, r.h2) for r in larger}

    def prefix(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        p = mix(a.copy())
        two = _hits(large, a)
        p[two] = _pair(a[two], b[two])
        three = two & _hits(deep, _pair(a, b))
        p[three] = _pair(p[three], c[three])
        return p

    block = pa.schema([("part", pa.int64()), ("leaves", pa.binary())])

    def send(batches):
        for p, _ in _chunks(batches, family):
            a, b, c = p.suffixes()
            if not len(a):
                continue
            part = prefix(a, b, c) % np.uint64(groups)
            # one sort key: group, then first word, then the whole suffix (interleaved suffixes only combine less)
            key = (part << np.uint64(32)) | ((mix(a.copy()) >> np.uint64(52)) << np.uint64(20)) | (_pair(_pair(a, b), c) >> np.uint64(44))
            order = np.argsort(key)
            a, b, c, part = a[order], b[order], c[order], part[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            at = np.flatnonzero(new)
            leaves = np.empty(len(at), LEAF)
            leaves["a"], leaves["b"], leaves["c"], leaves["n"] = a[at], b[at], c[at], np.diff(at, append=len(a))
            part = part[at]
            edge = np.flatnonzero(part[1:] != part[:-1]) + 1
            cuts = [0, *edge.tolist(), len(part)]
            data = leaves.tobytes()
            size = LEAF.itemsize
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int64)),
                                              pa.array([data[x * size:y * size] for x, y in zip(cuts[:-1], cuts[1:])], pa.binary())], schema=block)

    node = pa.schema([(x, pa.int64()) for x in ("h1", "h2", "h3", "a")])

    def subtree(leaves: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Nodes of one group's subtree at depth two and three with enough occurrences."""
        if not len(leaves):
            return
        full = leaves[(leaves["c"] != 0) & (leaves["n"] >= min_count)]
        yield pa.RecordBatch.from_arrays([*(pa.array(signed(full[x].copy())) for x in "abc"), pa.array(full["n"].copy())], schema=node)
        new = np.ones(len(leaves), bool)
        new[1:] = (leaves["a"][1:] != leaves["a"][:-1]) | (leaves["b"][1:] != leaves["b"][:-1])
        at = np.flatnonzero(new)
        n = np.add.reduceat(leaves["n"], at)
        keep = n >= min_count
        at, n = at[keep], n[keep]
        x, y = signed(leaves["a"][at].copy()), signed(leaves["b"][at].copy())
        inner = np.array([pair not in known_pairs for pair in zip(x.tolist(), y.tolist())], bool) if known_pairs else np.ones(len(at), bool)
        yield pa.RecordBatch.from_arrays([pa.array(x[inner]), pa.array(y[inner]), pa.nulls(int(inner.sum()), pa.int64()), pa.array(n[inner])], schema=node)

    def build(batches):
        current, held, rows, limit = None, [], 0, budget // 2
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("leaves")):
                if part != current:
                    if held:
                        yield from subtree(_merge(np.concatenate(held)))
                    current, held, rows, limit = part, [], 0, budget // 2
                held.append(np.frombuffer(data.as_buffer(), LEAF).astype([*((x, "<u8") for x in "abc"), ("n", "<i8")]))
                rows += len(held[-1])
                if rows > limit:      # a suffix that nearly every chunk sends
                    held = [_merge(np.concatenate(held))]
                    rows = len(held[0])
                    limit = max(limit, 2 * rows)
        if held:
            yield from subtree(_merge(np.concatenate(held)))

    blocks = docs.select("lang", "text").mapInArrow(send, "part long, leaves binary")
    nodes = blocks.repartition("part").sortWithinPartitions("part").mapInArrow(build, "h1 long, h2 long, h3 long, a long")
    return nodes.unionByName(known.filter(F.col("a") >= min_count))


# -- scores ------------------------------------------------------------------------------------------------------------

def _score(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a a / (l r)) in decimals of 38 digits: exact while a stays below 10 ** 15."""
    return F.expr(f"cast((cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * cast(1000000 as decimal(7,0))) div "
                  f"(cast({left} as decimal(15,0)) * cast({right} as decimal(15,0))) as long)")


def collocations(docs: DataFrame, min_count: int = 10, explained_percent: int = 50, top: int = 2000, budget: int = BUDGET,
                 share: int = SHARE, extended: int = EXTENDED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best-scoring phrases of two and three words of every language.

    A phrase is cut after its first k words where floor(10**6 a a / (l r)) is least (ties: smallest k).
    Phrases inside a longer candidate with at least ``explained_percent`` of their occurrences are dropped.
    """
    for family in (0, 1):
        words = write_table(count_words(docs, family), "words")
        if words.groupBy("h").count().filter("count > 1").isEmpty():
            break
        drop_table(words)
    else:
        raise ValueError("two words share a hash in both families")
    phrases = write_table(count_phrases(docs, words, min_count, family, budget, share, extended), "phrases")
    often = words.filter(F.col("n") >= min_count).select("lang", "h", F.col("n").alias("f"))
    two = (phrases.filter("h3 is null").select("h1", "h2", "a")
           .join(often.select(F.col("h").alias("h1"), "lang", F.col("f").alias("l")), "h1")
           .join(often.select(F.col("h").alias("h2"), F.col("f").alias("r")), "h2"))
    two = write_table(two.select("lang", "h1", "h2", "a", "l", "r"), "phrases-two")
    three = phrases.filter("h3 is not null")
    head = two.select("lang", "h1", "h2", F.col("a").alias("l2"), F.col("l").alias("l1"))
    tail = two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    cuts = three.join(head, ["h1", "h2"]).join(tail, ["h2", "h3"]).withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    longer = cuts.select("lang", "h1", "h2", "h3", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), pick("s1", "s2").alias("score"))
    inside = (three.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "a")
              .groupBy("p.h1", "p.h2").agg(F.max("a").alias("whole")))
    kept = (two.join(inside, ["h1", "h2"], "left").filter(F.coalesce(100 * F.col("whole") < explained_percent * F.col("a"), F.lit(True)))
            .select("lang", "h1", "h2", F.lit(None).cast("long").alias("h3"), "a", "l", "r", _score("a", "l", "r").alias("score")))
    # the best by score and a, all ties at the border included, before their words are looked up
    near = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    best = write_table(kept.unionByName(longer).withColumn("place", F.rank().over(near)).filter(F.col("place") <= top).drop("place"), "phrases-best")
    named = lambda k: words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"))
    said = best.join(named(1), "h1").join(named(2), "h2").join(named(3), "h3", "left").withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    place = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = said.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
