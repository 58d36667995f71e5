"""DuckDB SQL of the operators that SQL can express: the plain rule of each, without its method."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bench_words(table: str, key: str) -> str:
    return (f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
            rf"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}")


def _words(table: str = "documents") -> str:
    return rf"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {table}"


DECONTAMINATION = f"""
WITH d AS ({_bench_words("documents", "doc_id")}),
b AS ({_bench_words("benchmark", "item_id")}),
iw AS (
  SELECT DISTINCT item_id, m AS n, w[i:i + m - 1] AS terms, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM iw),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
),
hits AS (SELECT DISTINCT dg.doc_id, dg.i, dg.n, iw.item_id FROM dg JOIN iw ON dg.g = iw.g AND dg.n = iw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
),
wins AS (SELECT g, any_value(n) AS n, list_distinct(any_value(terms)) AS terms FROM iw GROUP BY g),
wt AS (SELECT g, n, len(terms) AS n_terms, unnest(terms) AS t FROM wins),
occ AS (SELECT g, unnest(terms) AS t FROM (SELECT DISTINCT g, terms FROM iw)),
uses AS (SELECT t, count(*) AS c FROM occ GROUP BY t),
anchor AS (SELECT g, n, n_terms, t FROM wt JOIN uses USING (t) QUALIFY row_number() OVER (PARTITION BY g ORDER BY c, t) = 1),
dt AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS t FROM d),
cand AS (SELECT a.g, a.n, a.n_terms, dt.doc_id, dt.p FROM anchor a JOIN dt USING (t)),
near AS (
  SELECT c.g, c.doc_id, c.p FROM cand c JOIN wt ON wt.g = c.g
  JOIN dt ON dt.doc_id = c.doc_id AND dt.t = wt.t AND dt.p BETWEEN c.p - c.n - 5 AND c.p + c.n + 5
  GROUP BY c.g, c.doc_id, c.p, c.n_terms HAVING count(DISTINCT wt.t) = c.n_terms
),
near_items AS (
  SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT near.doc_id, iw.item_id FROM near JOIN iw USING (g)) x
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = x.doc_id AND h.item_id = x.item_id) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER) >> {s}) & 31) AS INTEGER) + 1, 1)"
    for k in range(8) for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
last AS (SELECT html, max(page_id) AS first_id FROM p GROUP BY html)
SELECT p.page_id, n AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN p.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN last USING (html)
"""

SUBSTRING = f"""
WITH d AS ({_words()}),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
word AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS t FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "white": r"[ \t-\r]", "digit": "[0-9]", "stop": r"[.,;:!?''\"()-]", "symbol": r"[\x21-\x7E]"}


def _class_counts() -> str:
    out, left = [], "text"
    for name, pattern in _CLASSES.items():
        rest = f"regexp_replace({left}, '{pattern}', '', 'g')"
        out.append(f"length({left}) - length({rest}) AS c_{name}")
        left = rest
    return ", ".join([*out, f"length({left}) AS c_other"])


def _half(p: str, q: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) / 2 ELSE 0 END)"


_NAMES = [*_CLASSES, "other"]
_TOTAL, _REF = (" + ".join(f"{a}{c}" for c in _NAMES) for a in ("c_", "r_"))
_CLASS_JS = " + ".join(f"{_half(p, q)} + {_half(q, p)}" for c in _NAMES
                       for p, q in [(f"(r_{c} / greatest({_REF}, 1))", f"(c_{c} / greatest({_TOTAL}, 1))")])

QUALITY_RULES = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
gram AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM gram QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
line AS (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT x) AS n_dup FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
cc AS (SELECT rid, lang, {_class_counts()} FROM d),
refs AS (SELECT lang, {", ".join(f"sum(c_{c}) AS r_{c}" for c in _NAMES)} FROM cc WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20),
totals AS (SELECT lang, sum(len(w)) AS total FROM d WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= 20),
lw AS (SELECT rid, lang, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS word FROM d WHERE lang IS NOT NULL),
top AS (SELECT lang, word, n / total AS p FROM (SELECT lang, word, count(*) AS n FROM lw GROUP BY lang, word) JOIN totals USING (lang)
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(word)) <= 50),
known AS (SELECT lang, sum(p) AS known FROM top GROUP BY lang),
seen AS (SELECT rid, p, n / len(w) AS q FROM (SELECT rid, word, p, count(*) AS n FROM lw JOIN top USING (lang, word) GROUP BY rid, word, p)
         JOIN d USING (rid)),
js AS (SELECT rid, sum({_half("p", "q")} + {_half("q", "p")}) AS js, sum(p) AS p_sum, sum(q) AS q_sum FROM seen GROUP BY rid),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
    coalesce(n_repeat, 0) AS n_repeat_words, CASE WHEN len(w) >= 50 AND r_lower IS NOT NULL THEN sqrt(greatest({_CLASS_JS}, 0)) END AS class_distance,
    CASE WHEN len(w) >= 50 THEN sqrt(greatest(coalesce(js, 0) + (known - coalesce(p_sum, 0)) / 2
      + {_half("greatest(1 - known, 0)", "greatest(1 - coalesce(q_sum, 0), 0)")}
      + {_half("greatest(1 - coalesce(q_sum, 0), 0)", "greatest(1 - known, 0)")}, 0)) END AS word_distance
  FROM d JOIN cc USING (rid) LEFT JOIN refs ON refs.lang = d.lang LEFT JOIN known ON known.lang = d.lang
  LEFT JOIN js USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  round(class_distance, 4) AS class_distance, round(word_distance, 4) AS word_distance,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(class_distance, 0) <= 0.25 AND coalesce(word_distance, 0) <= 0.6 AS kept
FROM m
"""

_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"

PII = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds(no, kind, pat) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'), (4, 'iban', '{_IBAN}'), (5, 'ssn', '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')),
h AS (SELECT doc_id, text, no, kind, regexp_extract_all(text, pat) AS hits, string_split_regex(text, pat) AS gaps FROM d, kinds WHERE regexp_matches(text, pat)),
e AS (
  SELECT doc_id, text, no, kind, hits[i] AS hit, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits,
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM h)
),
v AS (
  SELECT *, s + length(hit) AS e, CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') > '255'))) = 0
    WHEN 'card' THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INTEGER)
             ELSE CAST(substr(reverse(digits), i, 1) AS INTEGER) * 2 - CASE WHEN substr(reverse(digits), i, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    WHEN 'iban' THEN list_reduce(list_transform(range(1, length(replace(hit, ' ', '')) + 1), lambda i: CASE
        WHEN substr(substr(replace(hit, ' ', ''), 5) || substr(hit, 1, 4), i, 1) BETWEEN '0' AND '9'
        THEN ascii(substr(substr(replace(hit, ' ', ''), 5) || substr(hit, 1, 4), i, 1)) - 48
        ELSE ascii(substr(substr(replace(hit, ' ', ''), 5) || substr(hit, 1, 4), i, 1)) - 55 END),
        lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1 AND NOT regexp_matches(
          CASE WHEN s > 0 THEN substr(text, s, 1) ELSE '' END || ' ' || substr(text, s + length(hit) + 1, 1), '[A-Za-z0-9]')
    ELSE regexp_matches(lower(substr(text, greatest(s - 40, 0) + 1, least(s, 40)) || ' ' || substr(text, s + length(hit) + 1, 40)), 'ssn|social security|tax id')
      AND NOT regexp_matches(CASE WHEN s > 0 THEN substr(text, s, 1) ELSE '' END || ' ' || substr(text, s + length(hit) + 1, 1), '[A-Za-z0-9]') END AS ok
  FROM e
),
f AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
    count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY no, s) FILTER (WHERE no < 4) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY no, s) AS spans
  FROM v WHERE ok GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, w[i:i + k - 1] AS t
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, any_value(t) AS t, count(*) AS a FROM g GROUP BY lang, k, phrase),
size AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
parts AS MATERIALIZED (SELECT lang, k, phrase, a, j, array_to_string(t[1:j], ' ') AS lp, array_to_string(t[j + 1:], ' ') AS rp
                       FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
cut AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.j) = 1
),
inside AS (
  SELECT lang, phrase, max(a) AS whole FROM (
    SELECT lang, a, unnest([array_to_string(t[1:2], ' '), array_to_string(t[2:3], ' ')]) AS phrase FROM cand WHERE k = 3) GROUP BY lang, phrase
),
kept AS (SELECT cut.* FROM cut LEFT JOIN inside i ON i.lang = cut.lang AND i.phrase = cut.phrase AND cut.k = 2
         WHERE i.whole IS NULL OR 100 * i.whole < 50 * cut.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN size USING (lang) QUALIFY rank <= 2000
"""

SPELLING = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) s(i)
),
runs AS (SELECT doc_id, run, count(*) AS c
         FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT run, c, hex(encode(doc_id || ':' || run)) AS b FROM runs),
hashed AS (
  SELECT run, c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(b), 2), lambda k: ('0x' || substr(b, k, 2))::BIGINT)),
    lambda s, x: xor(t[(xor(s, x) % 256) + 1], s >> 8)), 4294967295) AS h
  FROM coded, crc_table
),
vocab AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
),
gone AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab),
holes AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS p FROM gone),
less AS (SELECT DISTINCT g.word, g.n, v.word AS near, v.n AS near_n FROM gone g JOIN vocab v ON v.word = substr(g.word, 1, i - 1) || substr(g.word, i + 1)),
near AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM holes x JOIN holes y ON x.p = y.p AND x.word <> y.word
  UNION ALL SELECT word, near, near_n FROM less UNION ALL SELECT near, word, n FROM less
),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM vocab v LEFT JOIN best USING (word)
),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL)
SELECT f.word, n, n_near, form, form_n, root FROM forms f
JOIN (SELECT walk.word, walk.root FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NULL) w ON w.word = f.word
"""
