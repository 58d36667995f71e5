"""Quality rules: repetition and symbol counts, and divergence from language references.

DataFrame functions only.  A document's character-class histogram and its
histogram over the common words of its language are compared with the
references of that language (sums over all its documents) by Jensen-Shannon
distance (base 2, 0 to 1).

Defined results: a null text is empty; an empty text has no words and fails
the base rule; a document with fewer than ``min_words`` words, or whose
language is null or has fewer than ``min_docs`` documents, is not judged by
divergence.  Every row is judged by its own text, whatever other rows share its
doc_id or lack one too (rows are told apart by doc_id and a 64-bit hash of
language and text).  Extra columns are ignored.  An empty table gives no rows.

In-row work grows with the length of one text; the shuffles carry counts per
(language, word) and per (document, common word), combined before they move.
Windows of eight words are compared by 64-bit hash inside one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from visiflow.llm.common import write_table

#: Characters between words, and the symbols that the base rule counts.
WHITE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Character classes in the order in which they are taken out of a text; the rest is the class ``other``.
CLASSES = {"lower": "[a-z]+", "upper": "[A-Z]+", "white": "[ \\t-\\r]+", "digit": "[0-9]+", "stop": "[.,;:!?'\"()-]+", "symbol": "[\\x21-\\x7E]+"}
WINDOW = 8


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+", -1))


def _row() -> Column:
    """Tells rows that share a doc_id apart; equal rows are one, which leaves their shares as they are."""
    return F.xxhash64("lang", F.col("lang").isNull(), "text", F.col("text").isNull()).alias("row")


def text_counts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, row, lang, the base counts and the character-class counts ``c_<class>``."""
    df = docs.select("doc_id", "lang", _row(), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", words_of(F.col("text")))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))      # each word is hashed once
    df = df.withColumn("grams", F.when(F.col("n_words") > WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - WINDOW + 1)),
        lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
                       .otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    n = F.size("sorted")
    twins = F.zip_with(F.slice("sorted", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("sorted", F.lit(2), F.greatest(n - 1, F.lit(0))),
                       lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(F.array().cast("array<int>")))
    covered = F.aggregate(F.sort_array(F.array_distinct(F.flatten(twins))),
                          F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda a, p: F.struct((a.n + F.least(F.lit(WINDOW), p - a.last)).alias("n"), p.alias("last")),
                          lambda a: a.n)
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))
    out = df.select(
        "doc_id", "row", "lang", "text", "n_words",
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"), F.when(n > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    left = "text"
    for name, pattern in CLASSES.items():  # each step only reads what the last one left
        out = out.withColumn(f"_{name}", F.regexp_replace(left, pattern, ""))
        out = out.withColumn(f"c_{name}", (F.length(left) - F.length(f"_{name}")).cast("long")).drop(left)
        left = f"_{name}"
    return out.withColumn("c_other", F.length(left).cast("long")).drop(left)


def _half(p: Column, q: Column) -> Column:
    """p's half of the divergence in one bin (0 where p is 0)."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q)) / 2).otherwise(F.lit(0.0))


def word_references(words: DataFrame, counts: DataFrame, n_common: int, min_docs: int) -> DataFrame:
    """lang, word, p: share of each language's ``n_common`` most frequent words (ties: smaller word)."""
    totals = counts.groupBy("lang").agg(F.sum("n_words").alias("total"), F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= min_docs)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("r", rank).filter(F.col("r") <= n_common)
    return top.join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("p"))


def judge(docs: DataFrame, n_common: int = 50, min_docs: int = 20, min_words: int = 50,
          max_class_distance: float = 0.25, max_word_distance: float = 0.6) -> DataFrame:
    """Base counts, ``class_distance``, ``word_distance`` (null: not judged), ``base_failed`` and ``kept``."""
    counts = write_table(text_counts(docs), "rules")
    words = (docs.filter(F.col("lang").isNotNull())
             .select("doc_id", _row(), "lang", F.explode(words_of(F.lower(F.coalesce("text", F.lit(""))))).alias("word")))
    ref = write_table(word_references(words, counts.filter(F.col("lang").isNotNull()), n_common, min_docs), "common-words")

    seen = words.join(ref, ["lang", "word"]).groupBy("doc_id", "row", "word", "lang", "p").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("id_row")).agg(F.sum("n_words").alias("all_words"))
    same = lambda doc, row: F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("row") == F.col(row))
    known = ref.groupBy("lang").agg(F.sum("p").alias("known"))
    q, rest = F.col("n") / F.col("all_words"), 1 - F.coalesce("q_sum", F.lit(0.0))
    per_doc = (seen.drop("lang").join(sizes, same("id", "id_row")).groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row"))
               .agg(F.sum(_half(F.col("p"), q) + _half(q, F.col("p"))).alias("js"), F.sum("p").alias("p_sum"), F.sum(q).alias("q_sum")))
    other, bare = F.greatest(1 - F.col("known"), F.lit(0.0)), F.greatest(rest, F.lit(0.0))
    word_js = (F.coalesce("js", F.lit(0.0)) + (F.col("known") - F.coalesce("p_sum", F.lit(0.0))) / 2 + _half(other, bare) + _half(bare, other))

    names = [f"c_{c}" for c in [*CLASSES, "other"]]
    chars = (counts.filter(F.col("lang").isNotNull()).groupBy("lang")
             .agg(F.count(F.lit(1)).alias("docs"), *(F.sum(c).alias(f"r_{c}") for c in names)).filter(F.col("docs") >= min_docs))
    total, ref_total = sum((F.col(c) for c in names), F.lit(0)), sum((F.col(f"r_{c}") for c in names), F.lit(0))
    shares = [(F.col(f"r_{c}") / F.greatest(ref_total, F.lit(1)), F.col(c) / F.greatest(total, F.lit(1))) for c in names]
    class_js = sum((_half(p, q) + _half(q, p) for p, q in shares), F.lit(0.0))

    judged = F.col("n_words") >= min_words
    distance = lambda js: F.when(judged, F.sqrt(F.greatest(js, F.lit(0.0))))
    df = counts.join(chars.drop("docs"), "lang", "left").join(known, "lang", "left")
    df = df.join(per_doc, same("of", "of_row"), "left")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                    F.when(F.col(f"r_{names[0]}").isNotNull(), distance(class_js)).alias("class_distance"),
                    distance(word_js).alias("word_distance"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance) | (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)
