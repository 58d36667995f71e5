"""Language identification: a byte convolutional network in numpy.

Filters of several widths slide over the bytes of a fixed-length window, each
filter keeps its largest response, and a softmax layer reads those.  A first
layer over one-hot bytes is a sum of table rows, so inference looks up rows
for pairs of bytes.  A text is cut into windows over its whole length; its
prediction is the mean over windows, weighted by their letters.

Learning uses at most ``per_language`` documents of each language (a fixed
bound on what reaches the driver), chosen by the hash of the id, and
``windows_per_doc`` windows of each.  Defined results: a text that is null or
has no letter is ``und`` with score 0; so is every text if there is nothing to
learn from; rows with a null id or language are never learned from; equal
scores go to the language first in the alphabet; repeated rows give repeated
results; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from visiflow.llm.common import text_chunks

WIDTHS, LENGTH = (2, 3, 4), 256
#: Windows of one inference batch.
BATCH = 256
UNKNOWN = "und"
_LETTERS = np.zeros(256, np.float32)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


class ByteCNN:
    """Tables W[width][offset, byte, filter], filter biases, and the softmax layer."""

    def __init__(self, classes: list[str], filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.params = {f"w{w}": rng.normal(0, 0.3 / math.sqrt(w), (w, 256, filters)).astype(np.float32) for w in WIDTHS}
        n = filters * len(WIDTHS)
        self.params |= {"bias": np.zeros(n, np.float32), "out": rng.normal(0, 0.1, (n, len(classes))).astype(np.float32),
                        "out_bias": np.zeros(len(classes), np.float32)}
        self.filters = filters

    def pooled(self, x: np.ndarray, with_at: bool = False):
        """Largest response of every filter over each window (and where it is)."""
        best, where = [], []
        for w in WIDTHS:
            table, n = self.params[f"w{w}"], x.shape[1] - w + 1
            if with_at:
                got = sum(table[j][x[:, j:j + n]] for j in range(w))
                at = got.argmax(1)
                best.append(np.take_along_axis(got, at[:, None, :], 1)[:, 0])
                where.append(at)
            else:
                best.append(self._fast(w, x, n).max(1))
        return np.concatenate(best, 1), where

    def _fast(self, w: int, x: np.ndarray, n: int) -> np.ndarray:
        if not hasattr(self, "pairs"):
            self.pairs = {(v, j): (self.params[f"w{v}"][j][:, None] + self.params[f"w{v}"][j + 1][None]).reshape(65536, -1)
                          for v in WIDTHS for j in range(0, v - 1, 2)}
        code = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        got = np.take(self.pairs[w, 0], code[:, :n], axis=0)
        for j in range(2, w, 2):
            got += np.take(self.pairs[w, j], code[:, j:j + n], axis=0) if j + 1 < w else np.take(self.params[f"w{w}"][j], x[:, j:j + n], axis=0)
        return got

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(np.maximum(self.pooled(x)[0] + self.params["bias"], 0))

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        z = hidden @ self.params["out"] + self.params["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        best, where = self.pooled(x, True)
        hidden = np.maximum(best + self.params["bias"], 0)
        err = self._softmax(hidden)
        err[np.arange(len(y)), y] -= 1
        err /= len(y)
        back = err @ self.params["out"].T * (hidden > 0)
        grads = {"out": hidden.T @ err, "out_bias": err.sum(0), "bias": back.sum(0)}
        for k, w in enumerate(WIDTHS):
            part, f = back[:, k * self.filters:(k + 1) * self.filters], np.arange(self.filters)
            byte = np.stack([np.take_along_axis(x, where[k] + j, 1) for j in range(w)])
            cell = (np.arange(w)[:, None, None] * 256 + byte) * self.filters + f
            flat = np.bincount(cell.ravel(), np.broadcast_to(part, cell.shape).ravel(), w * 256 * self.filters)
            grads[f"w{w}"] = flat.reshape(w, 256, self.filters).astype(np.float32)
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(p) for k, p in self.params.items()}
        t = 0
        for _ in range(epochs):
            for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                t += 1
                for k, g in self._gradients(x[some], y[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.params[k] = (self.params[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window of every text (neighbours share the widest filter's reach), and its text."""
    step = LENGTH - max(WIDTHS) + 1
    lens = np.diff(off)
    n = np.maximum(-(-(lens - max(WIDTHS) + 1) // step), (lens > 0).astype(np.int64))
    text = np.repeat(np.arange(len(lens)), n)
    return off[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step, text


def window_matrix(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes of the windows, zero beyond the end of the text."""
    at = starts[:, None] + np.arange(LENGTH)
    return np.where(at < ends[:, None], buf[np.minimum(at, len(buf) - 1)], 0).astype(np.uint8)


def training_texts(docs: DataFrame, per_language: int, windows_per_doc: int) -> list[tuple[str, str]]:
    """(language, piece of text) of a bounded sample of rows (lang, text) with ids."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    counts = known.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return []
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    take = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(min(1 << 20, math.ceil(2 * per_language * (1 << 20) / r["count"])))) for r in counts))
    some = known.filter(share < take).filter(F.col("text").rlike("\\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - LENGTH, F.lit(1))) + 1
    pieces = F.array(*(F.substr("text", place(k).cast("int"), F.lit(LENGTH)) for k in range(windows_per_doc)))
    rows = some.select("lang", "doc_id", pieces.alias("pieces")).withColumn("r", rank).filter(F.col("r") <= per_language)
    return sorted((r.lang, x) for r in rows.select("lang", "pieces").collect() for x in r.pieces)


def fit_languages(docs: DataFrame, per_language: int = 1000, windows_per_doc: int = 3, epochs: int = 4) -> ByteCNN | None:
    pieces = training_texts(docs, per_language, windows_per_doc)
    if not pieces:
        return None
    classes = sorted({lang for lang, _ in pieces})
    x = np.zeros((len(pieces), LENGTH), np.uint8)
    for k, (_, text) in enumerate(pieces):
        data = text.encode()[:LENGTH]
        x[k, :len(data)] = np.frombuffer(data, np.uint8)
    y = np.array([classes.index(lang) for lang, _ in pieces])
    return ByteCNN(classes).fit(x, y, epochs)


def predict_languages(docs: DataFrame, model: ByteCNN | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields) + ", lang_pred string, score double"

    def run(batches):
        letter = regex.compile(r"\p{L}").search
        for batch in batches:
            column = batch.column("text")
            langs, scores = [], []
            for row, buf, off in text_chunks(column):
                n = len(off) - 1
                total = np.zeros((n, len(model.classes) if model else 1))
                if model and len(buf):
                    starts, text = windows_of(buf, off)
                    for a in range(0, len(starts), BATCH):
                        some = text[a:a + BATCH]
                        x = window_matrix(buf, starts[a:a + BATCH], off[1:][some])
                        np.add.at(total, some, model.probabilities(x) * (_LETTERS[x].sum(1, keepdims=True) + 1e-6))
                best, share = total.argmax(1), total.max(1) / np.maximum(total.sum(1), 1e-12)
                for k in range(n):
                    known = model and letter(column[row + k].as_py() or "")
                    langs.append(model.classes[best[k]] if known else UNKNOWN)
                    scores.append(float(min(1.0, share[k])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*keep, "lang_pred", "score"])

    return docs.select(*keep, "text").mapInArrow(run, schema)
