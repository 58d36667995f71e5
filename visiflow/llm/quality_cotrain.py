"""Quality classifier by co-training.

Two logistic regressions see a document from two sides: its text (hashed byte
pairs and shares of character classes) and its metadata (source, language,
length).  In every round each side labels the unlabelled documents of which
its calibrated probability is sure, and those join the training rows of the
other side.  At the end both sides are fitted and calibrated again, on labelled
rows kept out of all training, and their calibrated odds are combined (less the
prior's, which both contain) to score every document.

All fitting is Spark ML on all labelled rows; nothing is collected but model
coefficients.  Defined results: a null text is empty and has a zero text view;
null metadata has features of its own; several labels of one document count by
their mean (0.5 or more is 1), null labels not at all; without labelled rows of
both classes in either part nothing is learned, every score is null and every
document is kept; repeated rows give repeated results; an empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visiflow.llm.common import WHITE, text_chunks, word_spans, write_table

PAIRS, SOURCES, LANGS = 128, 64, 16
_CLASS = np.full(256, 6, np.int64)  # other ASCII
for _k, _bytes in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" \t\n\x0b\f\r", b".,;:!?'\"()-", range(0x80, 0x100))):
    _CLASS[list(_bytes)] = _k
N_CLASSES = 7
_PAIR_SLOT = (np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(57)).astype(np.int64)


def text_view(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row a text: square roots of hashed byte-pair shares, class shares, word and line shape."""
    n = len(off) - 1
    text = np.repeat(np.arange(n), np.diff(off))
    size = np.maximum(np.diff(off), 1)[:, None]
    classes = np.bincount(text * N_CLASSES + _CLASS[buf], minlength=n * N_CLASSES).reshape(n, -1) / size
    if len(buf) > 1:
        inside = text[1:] == text[:-1]
        slot = _PAIR_SLOT[buf[:-1].astype(np.int64) << 8 | buf[1:]]
        pairs = np.bincount((text[:-1] * PAIRS + slot)[inside], minlength=n * PAIRS).reshape(n, -1) / size
    else:
        pairs = np.zeros((n, PAIRS))
    starts, ends, first = word_spans(buf, off, WHITE)
    words = np.diff(first)
    letters = np.bincount(np.repeat(np.arange(n), words), ends - starts, n) / np.maximum(words, 1)
    lines = np.bincount(text[buf == 0x0A], minlength=n)
    shape = np.stack([np.log1p(letters), np.log1p(words), lines / np.maximum(words, 1), words > 0], 1)
    return np.concatenate([np.sqrt(pairs), classes, shape], 1).astype(np.float32)


def with_text_view(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, n_chars, the columns ``also`` and the text view ``text_x``."""
    keep = ["doc_id", "lang", "source", "n_chars", *also]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def run(batches):
        for batch in batches:
            for row, buf, off in text_chunks(batch.column("text")):
                x = text_view(buf, off)
                part = batch.slice(row, len(x))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], names=[*keep, "text_x"])

    return docs.select(*keep, "text").mapInArrow(run, schema + ", text_x array<float>")


def metadata_view() -> Column:
    """Hashed source and language (a slot of their own for null), and the length."""
    one_hot = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: (
        i == F.when(F.col(c).isNull(), n).otherwise(F.pmod(F.xxhash64(c), F.lit(n))).cast("int")).cast("float"))
    size = F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))
    rest = F.array(size.cast("float"), (size * size / 10).cast("float"), F.col("n_chars").isNull().cast("float"))
    return F.concat(one_hot("source", SOURCES), one_hot("lang", LANGS), rest)


def features(docs: DataFrame, labels: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``also``, text_x, meta_x, label (null: none) and ``held`` (labelled, for calibration)."""
    known = labels.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    rows = with_text_view(docs, also).withColumn("meta_x", metadata_view()).drop("source", "lang", "n_chars")
    held = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0
    return rows.join(known, "doc_id", "left").withColumn("held", F.col("label").isNotNull() & held)


class View:
    """One side: the model on its features and the calibration of its margin."""

    def __init__(self, column: str, reg: float, iterations: int):
        self.column, self.reg, self.iterations = column, reg, iterations
        self.model: LogisticRegressionModel | None = None
        self.slope, self.shift = 1.0, 0.0

    def fit(self, train: DataFrame, held: DataFrame) -> None:
        """``train`` has label and weight; the calibration is a regression of the held rows' label on the margin."""
        rows = train.select(array_to_vector(self.column).alias("x"), "label", "weight")
        self.model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=self.reg, maxIter=self.iterations).fit(rows)
        margins = self.model.transform(held.select(array_to_vector(self.column).alias("x"), "label"))
        margin = F.array(vector_to_array("rawPrediction")[1])
        scale = LogisticRegression(featuresCol="m", labelCol="label", regParam=1e-4, maxIter=20).fit(margins.select(array_to_vector(margin).alias("m"), "label"))
        self.slope, self.shift = float(scale.coefficients[0]), float(scale.intercept)

    def odds(self, rows: DataFrame, out: str) -> DataFrame:
        """Add the calibrated log odds."""
        scored = self.model.transform(rows.withColumn("_x", array_to_vector(self.column)).withColumnRenamed("_x", "x"))
        value = vector_to_array("rawPrediction")[1] * self.slope + self.shift
        return scored.withColumn(out, value).drop("x", "rawPrediction", "probability", "prediction")


def _probability(odds: str | Column) -> Column:
    return 1 / (1 + F.exp(-(F.col(odds) if isinstance(odds, str) else odds)))


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = 2, sure: float = 0.98, pseudo_weight: float = 0.5,
                  keep_from: float = 0.5, reg: float = 1e-4, iterations: int = 30, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``also``, text_score, meta_score, score (probability of quality 1) and kept (score >= ``keep_from``)."""
    rows = write_table(features(docs, labels, also), "quality-views")
    counts = {(r["held"], r["label"]): r["n"] for r in rows.filter("label is not null").groupBy("held", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = F.lit(None).cast("double")
    if any(not counts.get((held, label)) for held in (False, True) for label in (0.0, 1.0)):
        return rows.select("doc_id", *also, none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("kept"))
    prior = float(np.log(counts[False, 1.0] / counts[False, 0.0]))

    train = rows.filter("label is not null and not held").withColumn("weight", F.lit(1.0))
    held, pool = rows.filter("held"), rows.filter("label is null")
    text, meta = View("text_x", reg, iterations), View("meta_x", reg, iterations)
    for_text = for_meta = train
    edge = float(np.log(sure / (1 - sure)))
    for _ in range(rounds):
        text.fit(for_text, held)
        meta.fit(for_meta, held)
        told = meta.odds(text.odds(pool, "text_odds"), "meta_odds")
        pick = lambda odds: (told.filter(F.abs(odds) >= edge)
                             .withColumn("label", (F.col(odds) > 0).cast("double")).withColumn("weight", F.lit(pseudo_weight)).select(*train.columns))
        for_text, for_meta = train.unionByName(pick("meta_odds")), train.unionByName(pick("text_odds"))
    text.fit(for_text, held)
    meta.fit(for_meta, held)
    scored = meta.odds(text.odds(rows, "text_odds"), "meta_odds")
    score = _probability(F.col("text_odds") + F.col("meta_odds") - prior)
    return scored.select("doc_id", *also, _probability("text_odds").alias("text_score"), _probability("meta_odds").alias("meta_score"),
                         score.alias("score"), (score >= keep_from).alias("kept"))
