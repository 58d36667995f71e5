"""Phrase collocations, spelling variants and token files against brute force, and on awkward rows."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import public_tokenizers as P
from visiflow.llm import collocations as CO
from visiflow.llm import queries as Q
from visiflow.llm import spelling as S
from visiflow.llm import token_files as TF

SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, h long, key string, part long, day long"


def docs_of(spark, rows):
    """Rows (doc_id, text, lang) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, g, "s", "x", 1, 2, "k", 3, 4) for i, t, g in rows], SCHEMA).repartition(3)


def lower(t):
    return t.translate({k: k + 32 for k in range(65, 91)})


def prose(seed, n, vocabulary):
    rng = random.Random(seed)
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(n))


AWKWARD = [(1, None, "en"), (2, "", "en"), (3, " \t\n.,", None), (4, "One one ONE", "en"), (5, "same text here", "de"), (5, "same text here", "de"),
           (5, "another text", None), (None, "no id here", "en"), (None, None, None), (6, "é　ß 😀 x ÀÉ×÷ÿ", "und"), (7, "a " * 3000, "en")]


# -- collocations ------------------------------------------------------------------------------------------------------

def phrases_of(rows, min_count, percent, top):
    f, n = defaultdict(Counter), Counter()
    for _, t, g in rows:
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower(t or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[g or "und"] += len(w)
            for k in (1, 2, 3):
                f[g or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for g, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in cand.items():
            if any(p in (q[:2], q[1:]) and 100 * b >= percent * a for q, b in cand.items() if len(q) == 3 and len(p) == 2):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(g, i + 1, b.decode(), -a, x, y, n[g], -s) for i, (s, a, b, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


WORDS = ["the", "The", "of", "new", "york", "city", "a", "b", "ä", "x1", "|", "été"]


@pytest.mark.parametrize("budget,share,extended,top", [(1 << 20, 1, 1000, 2000), (60, 2, 1000, 2000), (25, 50, 1000, 7), (1, 4, 4, 2000)])
def test_collocations_equal_counting_all_phrases(spark, budget, share, extended, top):
    rows = AWKWARD + [(100 + i, prose(i, 150, WORDS) + " new york city. " * 4, ["en", "de", None][i % 3]) for i in range(9)]
    got = CO.collocations(docs_of(spark, rows), min_count=4, top=top, budget=budget, share=share, extended=extended).collect()
    assert sorted(tuple(r) for r in got) == phrases_of(rows, 4, 50, top)


def test_collocations_of_nothing(spark):
    assert CO.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert CO.collocations(docs_of(spark, [(1, None, "en"), (2, "", None)])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 123_456_789_012, 223_456_789_013, 323_456_789_017
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(CO._score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_a_hash_clash_takes_the_other_family(spark, monkeypatch):
    true = CO.word_hashes
    monkeypatch.setattr(CO, "count_words", lambda docs, family=0, real=CO.count_words: real(docs, family) if family else
                        real(docs, 0).withColumn("h", Q.F.lit(7).cast("long")))
    rows = [(1, "red car " * 12, "en")]
    assert [r.phrase for r in CO.collocations(docs_of(spark, rows)).collect()] == [r[2] for r in phrases_of(rows, 10, 50, 2000)]
    assert CO.word_hashes is true


# -- spelling ----------------------------------------------------------------------------------------------------------

def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def vocabulary_of(rows):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def forms_of(n):
    words = sorted(n)
    near_to = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near_to[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, n[w], len(near_to[w]), form[w], n.get(form[w]), root(w)) for w in words)


def test_composition_accepts_the_near_pairs():
    rng = random.Random(1)
    for _ in range(60):
        words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 50))})
        a = S.Acceptor(S._matrix(words))
        got = sorted(tuple(sorted((words[x], words[y]))) for left, right in S.near_pairs(a, np.array([a.start]), np.array([0])) for x, y in zip(left, right))
        assert got == sorted(tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p))


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("ab", "cd", "x") for b in ("ing", "ed", ""))
    a = S.Acceptor(S._matrix(words))
    assert a.count[a.start] == len(words) and len(a.final) == 8       # start, a, c, the stems' common end, i, in, e, end


def test_spelling_equals_all_pairs_at_every_group_size(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))) for _ in range(250)}
    words |= {"hotab" + "".join(rng.choice("abc") for _ in range(4)) for _ in range(120)} | {"".join(rng.choice("abc") for _ in range(4)) + "hotba" for _ in range(60)}
    n = {w: rng.choice([3, 3, 4, 6, 9, 20, 50]) for w in words}
    table = spark.createDataFrame([(w, c, "x") for w, c in n.items()], "word string, n long, key string").repartition(4)
    want = forms_of(n)
    for group_words in (9, 100, 50_000):
        got = S.spelling_forms(table, group_words=group_words).select("word", "n", "n_near", "form", "form_n", "root").collect()
        assert sorted(tuple(r) for r in got) == want


def test_partitions_of_a_hot_prefix_stay_small(spark):
    rng = random.Random(5)
    words = sorted({"sameprefix" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(900)})
    parts = S.partitions(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), 40)
    assert max(r["count"] for r in parts.groupBy("key").count().collect()) <= 40


def test_spelling_of_documents(spark):
    base = ["spelling", "speling", "variant", "varient", "hello", "helloo", "größe", "grösse", "Ünder", "abc"]
    rows = AWKWARD + [(i, prose(i, 120, base), "en") for i in range(200, 260)] + [(None, "spelling speling " * 4, "en")]
    got = S.spelling_forms(S.vocabulary(docs_of(spark, rows))).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(tuple(r) for r in got) == forms_of(vocabulary_of(rows))
    assert S.spelling_forms(S.vocabulary(spark.createDataFrame([], SCHEMA))).count() == 0


# -- token files -------------------------------------------------------------------------------------------------------

TRICKY = ["", " ", "a ́b <|endoftext|> x<|endoftext|>y ΑΣ ΣΑΣ. İstanbul\x0bq\x0cz\x85r ẞ ﬁ Å é", "don't 12'S 's ''s   ", "\r\nx\ty z"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(Q.TOKENIZER)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_pieces_give_the_ids_of_the_whole_text(library):
    texts = TRICKY + [prose(k, 500, ["Über", "naïve", "x9", "日本", "😀😀", "co-op's"]) for k in range(4)]
    coder, got = TF.Encoder(Q.TOKENIZER, 1), []
    assert coder.by_piece and not TF.drops_white_space(P.path("byte_bpe_50k.json"))
    for _, buf, off in TF.text_chunks(pa.array(texts), 500):
        ids, n = coder.chunk(buf, off)
        ends = np.cumsum(n)
        got += [ids[a:b].tolist() for a, b in zip(ends - n, ends)]
    assert got == [library(t) for t in texts]


def test_a_tokenizer_that_keeps_white_space_gets_whole_texts():
    path = P.path("byte_bpe_50k.json")
    coder, want = TF.Encoder(path, 50256), Tokenizer.from_file(path)
    ids, n = coder.chunk(*next(TF.text_chunks(pa.array(TRICKY)))[1:])
    ends = np.cumsum(n)
    assert [ids[a:b].tolist() for a, b in zip(ends - n, ends)] == [[*want.encode(t, add_special_tokens=False).ids, 50256] for t in TRICKY]


def test_files_hold_every_document_in_order(spark, library, tmp_path, monkeypatch):
    rows = AWKWARD + [(1000 - i, prose(i, 60 + i, ["alpha", "Beta", "γ"]) + TRICKY[i % 5], "en") for i in range(90)]
    manifest = TF.write_token_files(docs_of(spark, rows), Q.TOKENIZER, f"file://{tmp_path}/tokens", 1)
    monkeypatch.setattr(TF, "PIECE_TOKENS", 400)        # many reading tasks a file
    got = sorted(TF.read_token_files(manifest).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(got) == len(rows)
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens * 4 == len(r.tokens)
        start += r.n_tokens
    read = sorted((r.doc_id is None, r.doc_id or 0, np.frombuffer(r.tokens, "<u4").tolist()) for r in got)
    assert read == sorted((i is None, i or 0, library(t)) for i, t, _ in rows)
    for m in manifest.collect():                         # the offsets are those of the whole sequence
        off = TF.read_flat(f"{m.path}.off", "<u8", 0, m.n_docs + 1)
        assert off[0] == m.base and off[-1] == m.base + m.n_tokens and m.width == 2


def test_no_documents_no_files(spark, tmp_path):
    manifest = TF.write_token_files(spark.createDataFrame([], SCHEMA), Q.TOKENIZER, f"file://{tmp_path}/none", 1)
    assert manifest.count() == 0 and TF.read_token_files(manifest).count() == 0


def test_token_query_on_the_small_table(spark, library):
    rows = {r.doc_id: r for r in Q.op13_token_files(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for d in sorted(Q.read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()):
        ids = library(d.text)
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
