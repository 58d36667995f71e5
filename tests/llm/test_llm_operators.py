"""Every LLM data operator against a brute-force version, and on awkward rows."""

import base64
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers as P
from visiflow.llm import (bpe, decontam, jaccard_join, langid, licenses, pii, quality_cotrain, quality_rules, substring_dedup, warc)
from visiflow.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, words string, pii string, h long, token_ids string"
WORD = re.compile("[^\x20\x09-\x0D]+")


def docs_of(spark, texts):
    """Rows (doc_id, text) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en" if i is not None and i % 2 else None, "s", None if t is None else len(t), 7, "x", "y", 1, "z")
                                  for i, t in texts], SCHEMA).repartition(3)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def prose(seed, n, vocabulary=40):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(vocabulary)) for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one two"), (5, "one two"), (6, "é　ß 😀 x"), (7, prose(1, 4000)), (8, prose(1, 4000)),
           (9, "a " * 300), (10, prose(2, 60)), (11, prose(2, 60) + " tail"), (None, "no id here"), (12, "!" * 5000), (13, "Line\nLine\nLine\n")]


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- byte-level BPE ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(Q.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, tik):
    docs = docs_of(spark, AWKWARD + [(20, "Let's  see:\n\n  123456 naïve ﬁn <|endoftext|> "), (21, "a" * 7000)])
    rows = bpe.encode(docs, Q.RANKS, P.PATTERN).select("doc_id", "text", "token_ids", "words").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.token_ids == tik.encode_ordinary(r.text or "") and r.words == "x"
    for r in bpe.decode(bpe.encode(docs, Q.RANKS, P.PATTERN), Q.RANKS).select("text", "decoded").collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty(spark), Q.RANKS, P.PATTERN).count() == 0


def test_bpe_matrix_and_heap_agree(tik):
    ranks, rng = bpe.load_ranks(Q.RANKS), random.Random(4)
    for _ in range(150):
        piece = bytes(rng.choice(b"abth eing\xc3\xa9\xff") for _ in range(rng.randint(2, 70)))
        if piece not in ranks.ids:
            want = tik._encode_single_piece(piece)
            assert bpe.encode_pieces(ranks, [piece])[0].tolist() == want == bpe.merge_long(ranks, piece).tolist()


# -- personal data ----------------------------------------------------------------------------------------------------

def luhn(s):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits))
                    or kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_equals_plain_patterns(spark):
    rng = random.Random(3)
    letters = list("0123456789") * 3 + list(".@-+ ()aZ%_é😀")
    texts = AWKWARD + [(100 + k, "".join(rng.choice(letters) for _ in range(rng.randint(0, 250)))) for k in range(600)]
    texts += [(900, "a.b+c@d-e.f.g+h@i.j @k.l m@n"), (901, "4111 1111 1111 1111, 4111-1111-1111-1112"), (902, "9" * 20000), (903, "0001.002.3.255 1.2.3.256")]
    got = pii.find_pii(docs_of(spark, texts)).select("text", pii.spans_text(F.col("pii")).alias("spans")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [x for x in r.spans.split(",") if x.split(":")[0] in ("email", "ip", "card", "phone")] == base_spans(r.text or "")
    assert pii.find_pii(empty(spark)).count() == 0


def test_pii_checksums_context_and_redaction(spark):
    texts = [(1, "IBAN GB82 WEST 1234 5698 7654 32 ok"), (2, "IBAN GB83 WEST 1234 5698 7654 32"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789"),
             (5, "mail a@b.co now +1 (555) 123-4567."), (6, None)]
    found = pii.find_pii(docs_of(spark, texts))
    spans = {r.doc_id: r.s for r in found.select("doc_id", pii.spans_text(F.col("pii")).alias("s")).collect()}
    assert spans[1] == "iban:5:32" and spans[2] == "" and spans[3] == "ssn:4:15" and spans[4] == ""
    text = {r.doc_id: r.text for r in pii.redact(found).select("doc_id", "text").collect()}
    assert text[5] == "mail [EMAIL] now [PHONE]." and text[4] == "part 123-45-6789" and text[6] is None


# -- quality rules ----------------------------------------------------------------------------------------------------

def rule_counts(t):
    t = t or ""
    words = WORD.findall(t)
    grams = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    seen = defaultdict(int)
    for g in grams:
        seen[g] += 1
    covered = {j for k, g in enumerate(grams) if seen[g] > 1 for j in range(k, k + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_counts_and_divergence(spark):
    clean = [(1000 + 2 * k + 1, prose(k + 50, 80)) for k in range(40)]
    odd = [(2001, " ".join("###$$$%%%" for _ in range(40)) + " " + " ".join(f"Q{k}%%&&" for k in range(40)))]
    rows = {}
    for r in quality_rules.judge(docs_of(spark, AWKWARD + clean + odd)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for i, t in AWKWARD + clean + odd:
        want = [rule_counts(x) for j, x in AWKWARD + clean + odd if j == i]
        got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows[i]]
        assert sorted(got) == sorted(want), i
        for r in rows[i]:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert all(rows[i][0].kept for i, _ in clean) and not rows[2001][0].kept
    assert rows[2001][0].class_distance > 0.25 and rows[10][0].class_distance is None  # even ids have no language
    assert quality_rules.judge(empty(spark)).count() == 0


@pytest.mark.parametrize("shared_id", [None, 7])
def test_quality_rules_judge_every_row_by_its_own_text(spark, shared_id):
    clean = [(2 * k + 101, prose(k + 50, 80, 4)) for k in range(40)]
    junk, fine = " ".join(f"zz{k}qq" for k in range(400)), clean[0][1]
    alone = {r.doc_id: r.word_distance for r in quality_rules.judge(docs_of(spark, clean + [(1, junk), (3, fine), (5, fine)])).collect()}
    assert alone[1] > alone[3] + 0.05
    rows = spark.createDataFrame([(i, t, "en", "s", 0, 7, "x", "y", 1, "z") for i, t in clean + [(shared_id, junk), (shared_id, fine), (shared_id, fine)]], SCHEMA)
    got = [r for r in quality_rules.judge(rows, max_word_distance=(alone[1] + alone[3]) / 2).collect() if r.doc_id == shared_id]
    assert sorted((r.n_words, r.kept) for r in got) == [(80, True), (80, True), (400, False)]
    assert {(r.n_words, round(r.word_distance, 9)) for r in got} == {(80, round(alone[3], 9)), (400, round(alone[1], 9))}


# -- decontamination --------------------------------------------------------------------------------------------------

def bench_words(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def contamination_of(texts, items):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(i)
    out = defaultdict(list)
    for i, t in texts:
        w, hit, found = bench_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k:k + n]))) is not None:
                    found |= {str(j) for j in x if j is not None}
                    hit |= set(range(k, k + n))
        out[i].append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


@pytest.mark.parametrize("segment", [1, 1 << 20])
def test_contamination_equals_brute_force(spark, segment, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", segment)
    long = prose(8, 30)
    items = [(1, long), (2, "One, TWO"), (3, long), (10, prose(1, 12)), (4, None), (5, "--"), (None, prose(2, 15)), (1, long), (6, "a " * 12)]
    texts = AWKWARD + [(30, "start " + long.upper() + " end"), (31, " ".join(long.split()[5:17])), (32, " ".join(long.split()[:9])),
                       (33, " ".join(reversed(long.split())))]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = contamination_of(texts, items)
    got = defaultdict(list)
    for r in Q.contamination(docs_of(spark, texts), bench).collect():
        got[r.doc_id].append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert Q.contamination(empty(spark), bench).count() == 0
    assert all(not r.contaminated for r in Q.contamination(docs_of(spark, texts), bench.limit(0)).collect())


def test_contamination_blocks_and_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta"
    texts = [(1, "x alpha gamma beta y delta epsilon zeta"), (2, item), (3, "alpha " + "pad " * 40 + "beta gamma delta epsilon zeta")]
    bench = spark.createDataFrame([(1, item), (2, "never there"), (3, "pad pad")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_contamination(docs_of(spark, texts), bench, slop=5).collect()}
    assert rows[1].near_items == [1] and rows[1].matches == [] and rows[2].near_items == [] and rows[3].near_items == []
    parts = {r.doc_id: r for r in decontam.find_contamination(docs_of(spark, texts), bench, slop=5, block_items=1).collect()}
    assert {i: (sorted(map(tuple, r.matches)), r.near_items) for i, r in parts.items()} == \
           {i: (sorted(map(tuple, r.matches)), r.near_items) for i, r in rows.items()}


def test_contamination_blocks_of_null_and_repeated_ids(spark):
    item, other = prose(61, 25), prose(62, 12)
    texts = [(None, "x " + item), (None, "clean words"), (None, other), (7, item), (7, "clean words too"), (8, other + " and " + item)]
    bench = spark.createDataFrame([(1, " ".join(item.split()[:14])), (2, other), (1, " ".join(item.split()[8:])), (1, other.split()[3] + " zz " + other.split()[5]),
                                   (1, " ".join(reversed(other.split()))), (None, other)], "item_id long, text string")
    whole, parts = ([(r.doc_id, r.n_words, sorted(map(str, r.matches)), r.near_items) for r in
                     decontam.find_contamination(docs_of(spark, texts), bench, block_items=n).collect()] for n in (100, 1))
    assert len(parts) == len(texts) and sorted(map(str, whole)) == sorted(map(str, parts))
    assert any(near for *_, near in whole)


# -- licenses ---------------------------------------------------------------------------------------------------------

def test_license_scan_equals_all_windows(spark):
    names = list(licenses.TEMPLATES)
    texts = AWKWARD + [(100 + k, prose(k, 37 + 11 * k) + " " + licenses.TEMPLATES[n] + " " + prose(k + 9, 25)) for k, n in enumerate(names)]
    texts += [(300, " ".join(licenses.TEMPLATES["MIT (permission)"].split()[:48])), (301, " ".join(licenses.TEMPLATES["MIT (permission)"].split()[:20]))]
    templates = licenses.TEMPLATES | {"two": "one two", "none": "--"}

    def windows(t):
        w, out = bench_words(t), set()
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        for n, x in templates.items():
            v = bench_words(x)
            s = {tuple(v[k:k + 5]) for k in range(len(v) - 4)}
            if not s:
                out |= {n} if v and any(w[k:k + len(v)] == v for k in range(len(w))) else set()
                continue
            size = max(8, 1 << (len(v) - 1).bit_length())
            out |= {n for a in range(0, len(grams), size) if len(s & set(grams[a:a + 2 * size])) >= 0.8 * len(s)}
        return sorted(out)

    for r in licenses.scan_licenses(docs_of(spark, texts), templates).select("doc_id", "text", "licenses", "words").collect():
        assert [x.license for x in r.licenses] == windows(r.text), r.doc_id
        if r.doc_id and 100 <= r.doc_id < 300:
            assert names[r.doc_id - 100] in [x.license for x in r.licenses]
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_license_bands_reach_the_recall_at_the_containment():
    matcher = licenses.Matcher(licenses.TEMPLATES, 0.8, 0.999)
    for tier, some in matcher.tiers.items():
        for k in some:
            m = len(matcher.sets[k])
            n = -(-4 * m // 5)
            assert (1 - n / (2 * tier + m - n)) ** len(matcher.orders[tier]) <= 0.001


# -- Jaccard join -----------------------------------------------------------------------------------------------------

def groups_of(texts):
    sets = {}
    for i, t in texts:
        w = WORD.findall(t or "")
        if w:
            sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links[a].add(b)
    root = {}
    for i in sorted({i for i, _ in texts}):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = i
                todo += links[x]
    return {i: (root[i], len(links[i])) for i in root}


@pytest.mark.parametrize("bucket,block", [(1000, 1_000_000), (8, 2500)])
def test_jaccard_join_equals_all_pairs(spark, bucket, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(6)
    texts = [(i, t) for i, t in AWKWARD if i is not None]
    for k in range(160):
        w = prose(k % 4 + 70, 120).split()
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = "new" + str(rng.randrange(1000))
        texts.append((100 + k, " ".join(w)))
    texts += [(400 + k, prose(71, 120)) for k in range(20)]
    want = groups_of(texts)
    rows = jaccard_join.jaccard_groups(docs_of(spark, texts + [(None, "null id")]), bucket=bucket).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.class_id, r.n_links) == (want[r.doc_id] if r.doc_id is not None else (None, 0))


def test_jaccard_join_bounds_blocks_by_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TEXTS", 50)
    monkeypatch.setattr(jaccard_join, "CELLS", 700)
    exact, seen = jaccard_join._exact_links, []
    monkeypatch.setattr(jaccard_join, "_exact_links", lambda pairs, *rest: seen.extend(pairs.select(F.size("members")).collect()) or exact(pairs, *rest))
    shared = prose(90, 14)
    texts = [(k, f"{shared} last{k}") for k in range(400)] + [(1000 + k, prose(200 + k, 15)) for k in range(20)]
    rows = jaccard_join.jaccard_groups(docs_of(spark, texts)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (0, 399) if i < 400 else (i, 0) for i, _ in texts}
    assert max(r[0] for r in seen) <= 200
    strips = list(jaccard_join.overlaps([np.arange(k % 5, 10, dtype=np.uint64) for k in range(60)]))
    assert len(strips) > 1 and all(x.size <= 700 for _, x in strips)
    assert np.concatenate([x for _, x in strips]).tolist() == [[10 - max(a % 5, b % 5) for b in range(60)] for a in range(60)]


def test_jaccard_join_of_null_and_repeated_ids(spark):
    a, b, c = prose(301, 60), prose(302, 60), prose(303, 60)
    texts = [(None, a), (5, a), (6, a), (None, b), (None, b), (7, b + " end"), (None, c), (None, c + " end"),
             (8, prose(304, 60)), (8, prose(305, 60)), (9, prose(305, 60) + " end"), (None, None), (None, "")]
    got = defaultdict(list)
    for r in jaccard_join.jaccard_groups(docs_of(spark, texts).withColumn("own", F.col("text")), with_first=("own",)).collect():
        got[r.doc_id, r.own].append((r.class_id, r.n_links, r.first))
    assert got[None, a] == [(5, 2, False)] and got[5, a] == [(5, 2, True)] and got[6, a] == [(5, 2, False)]
    assert got[None, b] == [(7, 2, False)] * 2 and got[7, b + " end"] == [(7, 2, True)]
    assert sorted(got[None, c] + got[None, c + " end"]) == [(None, 1, False), (None, 1, True)]
    assert got[8, prose(304, 60)] == [(8, 0, True)] and got[8, prose(305, 60)] == [(8, 1, True)] and got[9, prose(305, 60) + " end"] == [(8, 1, False)]
    assert got[None, None] == got[None, ""] == [(None, 0, None)]


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_groups(empty(spark)).count() == 0


# -- WARC -------------------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "u", None), (2, "a\r\nb", ""), (3, None, "x\r\n\r\ny"), (4, "q", "x\r\n\r\ny"), (5, "q", "é" * 100000), (6, "q", "é" * 100000),
             (7, "z", "WARC/1.1\r\n\r\n"), (6, "q", "é" * 100000), (8, "k", prose(1, 3000))]
    table = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    folder = f"file://{tmp_path}"
    warc.write_monolithic(warc.with_revisits(table), f"{folder}/whole")
    manifest = warc.normalise(spark, f"{folder}/whole", f"{folder}/members")
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", 0), i)
    want = sorted((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in pages)
    rows = warc.read_archives(manifest).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want
    assert all(bytes(r.payload).decode() == (dict((i, h) for i, _, h in pages)[r.page_id] or "") for r in rows if r.record_type == "response")
    for m in manifest.collect():  # every sidecar entry is a whole gzip member
        data = open(m.archive.removeprefix("file://"), "rb").read()
        index = [x.split("\t") for x in open(m.sidecar.removeprefix("file://")).read().splitlines()]
        assert len(index) == m.records and sum(int(x[1]) for x in index) == len(data)
        for offset, length, name in index:
            member = b"".join(warc.inflate(data[int(offset):int(offset) + int(length)]))
            assert member.startswith(b"WARC/1.1\r\n") and name.encode() in member
    assert warc.with_revisits(table.limit(0)).count() == 0


def test_warc_minimum_and_broken_archive(spark):
    table = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.with_revisits(table, min_payload=5).collect()} == {1: None, 2: None, 3: 4, 4: None}
    with pytest.raises(ValueError):
        list(warc.records_in(iter([b"WARC/1.1\r\nContent-Length: 10\r\n\r\nshort"])))


# -- language ---------------------------------------------------------------------------------------------------------

def test_language_id_learns_and_handles_rows_without_letters(spark):
    rng, rows = random.Random(2), []
    parts = {"en": ["the", "and", "with", "th", "ing"], "fr": ["les", "où", "ça", "eau", "é"], "de": ["sch", "und", "ü", "ß", "ein"]}
    for k in range(360):
        lang = list(parts)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(8, 200))), lang))
    rows += [(1000, None, "en"), (1001, "123 !!!", "en"), (1002, "", None), (None, "the and with", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit_languages(docs.filter("doc_id % 5 <> 0"), per_language=60)
    got = {r.doc_id: r for r in langid.predict_languages(docs, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows[:360] if i % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002)) and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit_languages(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.predict_languages(docs, None).collect()} == {"und"}


def test_language_windows_cover_every_byte():
    import numpy as np
    off = np.array([0, 0, 1, 300, 300 + 253, 300 + 253 + 1000])
    starts, text = langid.windows_of(np.zeros(off[-1], np.uint8), off)
    seen = np.zeros(off[-1], bool)
    for s, t in zip(starts, text):
        assert off[t] <= s < off[t + 1]
        seen[s:min(s + langid.LENGTH, off[t + 1])] = True
    assert seen.all()


# -- quality classifier -----------------------------------------------------------------------------------------------

def test_cotraining_separates_and_keeps_without_labels(spark):
    texts = [(k, prose(k, 60 + k % 50)) if k % 4 else (k, " ".join(w.upper() + "%%%" for w in prose(k, 60).split())) for k in range(400)]
    docs = docs_of(spark, texts + [(1000, None), (1001, ""), (None, "x y")])
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(0, 400, 2)] + [(2, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_cotrain.score_quality(docs, labels, rounds=1, iterations=15).collect()}
    assert len(rows) == 403 and all(0 <= r.score <= 1 for r in rows.values())
    assert sum(rows[k].kept == (k % 4 != 0) for k in range(1, 400)) >= 390
    nothing = quality_cotrain.score_quality(docs, labels.filter("quality = 1"))
    assert all(r.kept and r.score is None for r in nothing.collect())
    assert quality_cotrain.score_quality(empty(spark), labels).count() == 0


# -- substring dedup --------------------------------------------------------------------------------------------------

def kept_of(texts, window=20):
    seen, out = {}, {}
    for i, t in sorted(texts):
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            first = seen.setdefault(tuple(w[s:s + window]), (i, s))
            if first != (i, s):
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("run", [1 << 21, 50])
def test_substring_dedup_equals_brute_force(spark, run, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RUN", run)
    rng = random.Random(5)
    base = [" ".join(rng.choice(["a", "b", "ç", "dd"]) for _ in range(200)) for _ in range(4)]
    texts = [(i, t) for i, t in AWKWARD if i is not None]
    texts += [(100 + i, " ".join(rng.choice(["a", "b", "ç", "dd"]) for _ in range(rng.randint(0, 60))) + " " + base[i % 4][rng.randint(0, 100):rng.randint(100, 390)])
              for i in range(150)] + [(9999, "x y z " * 30)]
    rows = substring_dedup.remove_repeats(docs_of(spark, texts)).collect()
    want = kept_of(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id], r.doc_id


def test_substring_dedup_of_null_and_repeated_ids(spark):
    shared, clean, twin = prose(71, 20, 10**6), prose(72, 40, 10**6), prose(73, 30, 10**6)
    texts = [(1, shared), (None, clean), (None, shared + " tail"), (None, twin), (None, twin), (3, twin + " x"), (4, prose(74, 25, 10**6)),
             (4, prose(75, 22, 10**6)), (5, prose(75, 22, 10**6) + " y"), (4, prose(74, 25, 10**6))]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs_of(spark, texts)).collect())
    assert got == sorted([(1, 20, 20, ""), (0, 40, 0, clean), (0, 21, 0, shared + " tail"), (0, 30, 0, twin), (0, 30, 30, ""), (3, 31, 30, "x"),
                          (4, 25, 0, texts[6][1]), (4, 25, 0, texts[6][1]), (4, 22, 0, texts[7][1]), (5, 23, 22, "y")])


def test_substring_dedup_without_repeats(spark):
    rows = substring_dedup.remove_repeats(docs_of(spark, [(1, prose(1, 50, 10**6)), (None, None)])).collect()
    assert sorted((r.n_words, r.n_removed) for r in rows) == [(0, 0), (50, 0)]
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
