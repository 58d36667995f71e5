"""Spelling variant grouping: the vocabulary acceptor composed with a one-edit transducer and itself.

With A the minimised acyclic acceptor of the vocabulary and T the transducer
that copies every symbol but one (which it inserts, deletes or replaces), the
accepted pairs of A o T o A are the pairs of words one edit apart.  A state of
the composition is (state of A, edit spent or not, state of A): before the edit
both sides are in one state, after it the pair of states only moves on symbols
that both can read.  ``near_pairs`` enumerates the accepted pairs breadth-first
in numpy; a path carries its words as ranks (numbers of words that sort before
it), which the counts of words below every transition of A add up to.

The composition is cut by initial states, each a partition of its own.  Of two
words one edit apart, the shorter of m symbols, the first ceil(m / 2) or the
last floor(m / 2) symbols agree.  So a word of n symbols enters, for m = n and
m = n - 1, the partition of its first ceil(m / 2) symbols (the composition
starts in the state after that prefix, no edit spent) and, in the machine of
the reversed words, that of its last floor(m / 2).  A pair is taken from the
prefix's partition if it agrees there, else from the suffix's: once.  A
partition of more than ``GROUP_WORDS`` words is cut again in the same way by
what is left of its words, until all are small (a rest of one or two symbols
is), so that no partition grows with the vocabulary and no pair is lost.

Defined results: a null text has no words; without a doc_id nothing is deleted
from a run; the order of words is that of code points; extra columns are
ignored; an empty table gives no rows.  States are classes of equal right
languages by two 64-bit hashes.  A task holds one block of partitions (at most
twice ``GROUP_WORDS`` words and one Arrow batch) and a frontier of ``FRONTIER`` paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiflow.llm.common import drop_table, mix, write_table

GROUP_WORDS, FRONTIER = 50_000, 1 << 18
LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """Words (word, n) of ``docs``: lower-cased runs of letters, of which one in ``every`` by hash loses a code point."""
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"), F.expr("substring(run, cast(h % length(run) as int) + 2)"))
    words = (docs.select("doc_id", F.explode(runs).alias("run")).withColumn("h", h)
             .select(F.when((F.col("h") % every == 0) & at.isNotNull(), cut).otherwise(F.col("run")).alias("word")))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


# -- partitions of the composition by initial state --------------------------------------------------------------------

def _halves(words: DataFrame) -> DataFrame:
    """Each row of (word, m, front, back, below) as the two partitions that what is left of it may belong to.

    ``front`` and ``back`` symbols at the ends are known to agree; ``below`` is the common prefix that a pair must not reach.
    """
    left = F.col("m") - F.col("front") - F.col("back")
    up, down = F.ceil(left / 2).cast("int"), F.floor(left / 2).cast("int")
    return (words.select("word", "n", "m", F.explode(F.array(
        F.struct((F.col("front") + up).alias("front"), F.col("back").alias("back"), F.col("below").alias("below")),
        F.struct(F.col("front").alias("front"), (F.col("back") + down).alias("back"), (F.col("front") + up).alias("below")))).alias("p"))
        .select("word", "n", "m", "p.*").withColumn("key", _key()))


def _key() -> Column:
    """A partition: length class, what is cut off at either end, and the symbols there."""
    ends = (F.expr("substring(word, 1, front)"), F.expr("right(word, back)"))
    return F.concat_ws("/", F.col("m").cast("string"), F.col("front").cast("string"), F.col("back").cast("string"), F.col("below").cast("string"), *ends)


def partitions(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(key, word, n, m, front, back, below): every partition of two words or more, none above ``group_words``."""
    n = F.length("word")
    rows = _halves(words.select("word", "n", F.explode(F.array(n, n - 1)).alias("m"),
                                F.lit(0).alias("front"), F.lit(0).alias("back"), F.lit(1 << 30).alias("below")))
    done = None
    while True:
        rows = write_table(rows, "spelling-keys")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.col("m") - F.col("front") - F.col("back")).alias("left"))
        large = write_table(sizes.filter((F.col("size") > group_words) & (F.col("left") > 1)).select("key"), "spelling-large")
        small = sizes.filter((F.col("size") > 1) & ((F.col("size") <= group_words) | (F.col("left") <= 1))).select("key")
        part = rows.join(small, "key", "left_semi")
        done = part if done is None else done.unionByName(part)
        if large.isEmpty():
            return done
        rows = _halves(rows.join(large, "key", "left_semi"))


# -- acceptor, transducer, composition ---------------------------------------------------------------------------------

class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words, given as rows of code points padded with -1.

    Transitions are sorted by (state, symbol); ``skip`` is the number of words that leave a state by a smaller symbol
    (or end there), ``final`` marks accepting states.  Following a word's transitions, ``skip`` adds up to its rank.
    """

    def __init__(self, codes: np.ndarray):
        rows, width = codes.shape
        fresh = np.ones((rows, width + 1), bool)     # a row's prefix of t symbols is new (a node of the trie)
        fresh[1:, 0] = False
        np.logical_or.accumulate(codes[1:] != codes[:-1], axis=1, out=fresh[1:, 1:])
        inside = np.concatenate([np.ones((rows, 1), bool), codes >= 0], axis=1)
        node_of, symbols, parents, finals, depth_start = [], [], [], [], [0]
        for t in range(width + 1):                   # number the trie's nodes level by level
            new = fresh[:, t] & inside[:, t]
            at = np.cumsum(new) - 1 + depth_start[-1]
            node_of.append(at)
            depth_start.append(depth_start[-1] + int(new.sum()))
            if t:
                symbols.append(codes[new, t - 1])
                parents.append(node_of[t - 1][new])
            end = np.zeros(depth_start[-1] - depth_start[-2], bool)
            stops = inside[:, t] & (~inside[:, t + 1] if t < width else True)
            end[at[stops] - depth_start[t]] = True
            finals.append(end)
        final = np.concatenate(finals)
        symbol, parent = np.concatenate([[0], *symbols]).astype(np.uint64), np.concatenate([[0], *parents]).astype(np.int64)
        count = final.astype(np.int64)
        hashes = [np.where(final, np.uint64(0x9E3779B97F4A7C15), np.uint64(k)) for k in (0x1234567, 0x7654321)]
        for t in range(width, 0, -1):                # right languages from the leaves up
            a, b = depth_start[t], depth_start[t + 1]
            np.add.at(count, parent[a:b], count[a:b])
            for k, h in enumerate(hashes):
                np.add.at(h, parent[a:b], mix(mix(symbol[a:b] + np.uint64(k * 977 + 1)) + mix(h[a:b].copy())))
        both = np.empty(len(final), [("a", np.uint64), ("b", np.uint64)])
        both["a"], both["b"] = hashes
        _, one, state = np.unique(both, return_index=True, return_inverse=True)
        edges = np.flatnonzero(np.isin(parent, one) & (np.arange(len(parent)) > 0))   # edges out of one node a class
        order = np.lexsort((symbol[edges], state[parent[edges]]))
        edges = edges[order]
        self.source, self.symbol, self.target = state[parent[edges]], symbol[edges].astype(np.int64), state[edges]
        self.final, self.count = final[one], count[one]
        self.first = np.searchsorted(self.source, np.arange(len(one) + 1))
        before = np.cumsum(self.count[self.target]) - self.count[self.target]
        self.skip = before - before[np.minimum(self.first[self.source], max(0, len(edges) - 1))] + self.final[self.source] if len(edges) else before
        self.start = int(state[0])
        self.lookup = self.source * (1 << 22) + self.symbol

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Transition of each state on each symbol, -1 where there is none."""
        want = states * (1 << 22) + symbols
        at = np.minimum(np.searchsorted(self.lookup, want), max(0, len(self.lookup) - 1))
        return np.where(self.lookup[at] == want, at, -1) if len(self.lookup) else np.full(len(want), -1)

    def out(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, transition) of every transition out of each row's state."""
        n = self.first[states + 1] - self.first[states]
        row = np.repeat(np.arange(len(states)), n)
        return row, np.repeat(self.first[states] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def near_pairs(a: Acceptor, starts: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ranks (left, right) of the accepted pairs of A o T o A from the initial states (q, no edit, q), q in ``starts``.

    The edit is made where the words first differ, so that a pair has one path.  Pairs are taken once: a replaced
    symbol grows, and the longer word of an insertion is on the left.
    """
    copying = [(starts, ranks)]                      # no edit spent: one state, rank of the common prefix
    spent: list[tuple[np.ndarray, ...]] = []         # edit spent: left state and rank, right state and rank, symbol that must not come next on the right
    while copying or spent:
        if spent:
            ql, rl, qr, rr, barred = spent.pop()
            if len(ql) > FRONTIER:
                spent += [(ql[i:i + FRONTIER], rl[i:i + FRONTIER], qr[i:i + FRONTIER], rr[i:i + FRONTIER], barred[i:i + FRONTIER])
                          for i in range(0, len(ql), FRONTIER)]
                continue
            done = a.final[ql] & a.final[qr]
            if done.any():
                yield rl[done], rr[done]
            row, e = a.out(qr)
            free = a.symbol[e] != barred[row]
            row, e = row[free], e[free]
            other = a.step(ql[row], a.symbol[e])
            both = other >= 0
            row, e, other = row[both], e[both], other[both]
            if len(row):
                spent.append((a.target[other], rl[row] + a.skip[other], a.target[e], rr[row] + a.skip[e], np.full(len(row), -1)))
            continue
        q, r = copying.pop()
        if len(q) > FRONTIER // 64:
            half = len(q) // 2
            copying += [(q[:half], r[:half]), (q[half:], r[half:])]
            continue
        row, e = a.out(q)
        if not len(row):
            continue
        copying.append((a.target[e], r[row] + a.skip[e]))
        # the left word has one symbol more, which the right one must not go on with
        spent.append((a.target[e], r[row] + a.skip[e], q[row], r[row], a.symbol[e]))
        # the symbol of a transition becomes that of a later transition of the same state
        after = a.first[q[row] + 1] - e - 1
        left = np.repeat(np.arange(len(e)), after)
        right = np.repeat(e + 1 - (np.cumsum(after) - after), after) + np.arange(int(after.sum()))
        spent.append((a.target[e[left]], r[row[left]] + a.skip[e[left]], a.target[right], r[row[left]] + a.skip[right], np.full(len(left), -1)))


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words, padded with -1."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.full((len(words), int(size.max())), -1, np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def _pairs_of_block(part: np.ndarray, words: list[str], m: np.ndarray, front: np.ndarray, back: np.ndarray, below: np.ndarray):
    """Index pairs of near words of a block of whole partitions, numbered by ``part``.

    One acceptor is made of the block: a word is read as its partition's number and then what is left of it, of suffix
    partitions backwards, so that the composition's initial states are those after a partition's number.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    rest = [w[f:len(w) - b][::-1] if b and not f else w[f:len(w) - b] for w, f, b in zip(words, front.tolist(), back.tolist())]
    codes = np.concatenate([part[:, None], _matrix(rest) if any(rest) else np.full((len(words), 1), -1, np.int64)], axis=1)
    order = np.lexsort(codes.T[::-1])
    a = Acceptor(codes[order])
    first = np.flatnonzero(a.source == a.start)
    full, at = _matrix(words), order
    for left, right in near_pairs(a, a.target[first], a.skip[first]):
        x, y = at[left], at[right]
        short = np.minimum(size[x], size[y])
        same = np.logical_and.accumulate(full[x] == full[y], axis=1).sum(axis=1)
        keep = (short == m[x]) & (same < below[x])
        yield x[keep], y[keep]


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, near, near_n): every ordered pair of different words of ``words`` (word, n) that are one edit apart."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    columns = ["key", "word", "n", "m", "front", "back", "below"]

    def block(table: pa.Table):
        table = table.combine_chunks()
        pick = table.column("word").combine_chunks()
        words = table.column("word").to_pylist()
        n, m, front, back, below = (table.column(c).to_numpy().astype(np.int64) for c in columns[2:])
        part = table.column("key").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        for x, y in _pairs_of_block(part, words, m, front, back, below):
            for i in range(0, len(x), 50_000):
                a, b = np.concatenate([x[i:i + 50_000], y[i:i + 50_000]]), np.concatenate([y[i:i + 50_000], x[i:i + 50_000]])
                yield pa.RecordBatch.from_arrays([pick.take(pa.array(a)), pick.take(pa.array(b)), pa.array(n[b])], schema=schema)

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held else ()), batch])
            if held.num_rows > group_words:      # close the block at the last border between partitions
                key = held.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
                edge = np.flatnonzero(key[1:] != key[:-1])
                if len(edge):
                    yield from block(held.slice(0, int(edge[-1]) + 1))
                    held = held.slice(int(edge[-1]) + 1)
        if held:
            yield from block(held)

    parts = partitions(words, group_words).select(*columns)
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, near string, near_n long")


def spelling_forms(words: DataFrame, ratio: int = 2, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every row of ``words`` (word, n).

    A word's form is its near word of largest n (ties: least word) if that n is at least ``ratio`` (above 1) times its
    own; its root is where following forms ends.  Counts grow along forms, so that the steps are at most the logarithm
    of the largest count and halve each round.
    """
    words = write_table(words.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best")
    near = near_words(words, group_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    ok = -F.col("best.minus") >= ratio * F.col("n")
    forms = write_table(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(ok, F.col("best.near")).alias("form"),
        F.when(ok, -F.col("best.minus")).alias("form_n")), "forms")
    drop_table(words)
    steps = write_table(forms.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:      # root := root of the root
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = write_table(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_table(steps)
        steps = after.drop("moved")
        steps.table_path = after.table_path
        if after.filter("moved").isEmpty():
            break
    return forms.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
