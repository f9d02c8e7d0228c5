"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

A task counts the bytes, words and lines of its texts with numpy and gives each
document a vector of transformed statistics.  Training joins the vectors of the
labelled rows with their labels and sums them and their products by class, so the
driver gets a few numbers a class whatever the corpus.  Class covariances are shrunk
towards the diagonal of the pooled one; their Cholesky factors are computed
once and travel to the tasks.  A score is the posterior of label 1 from the
difference of the two Mahalanobis log-densities.

Only the text enters a score.  Defined cases: null text is empty text, whose
statistics are zeros; labels other than 0 and 1 are ignored, and of several labels
of a document the larger counts; with one class only, its label is every
score; with none, 0.5; a very long text counts whole; repeated rows get equal scores, and count
as often as they occur in training; an empty table gives an empty one.  Extra columns of any name pass
through ``accept`` and don't reach ``score``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.llm.arrowtext import SLICE_BYTES, Slice, slices, words

SHRINKAGE = 0.1
#: Least variance of a statistic, against constant ones.
FLOOR = 1e-4
ACCEPT_FROM = 0.7

_BYTES = np.arange(256)
_SYMBOLS = np.isin(_BYTES, [ord(c) for c in "#*$%&<>"])
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0xC0)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: The statistics, each transformed to be nearer a normal one.
NAMES = ("words", "word_bytes", "symbols", "bars", "shouts", "capitals", "digits", "stops", "lines", "distinct", "spread", "entropy", "stutter")


def _histogram(part: Slice) -> np.ndarray:
    n = len(part.offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int64) * 256, np.diff(part.offsets))
    return np.bincount(row + part.data, minlength=n * 256).reshape(n, 256)


def statistics(part: Slice) -> np.ndarray:
    """Transformed statistics of each row of a slice."""
    h = _histogram(part).astype(float)
    w = words(part)
    n = np.diff(w.rows)
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((w.hash, row))
    new = np.ones(len(row), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(n))
    size = (w.end - w.start).astype(float)
    total, squares = (np.bincount(row, x, minlength=len(n)) for x in (size, size**2))
    words_ = np.maximum(n, 1)
    mean = total / words_
    share = h / np.maximum(h.sum(1, keepdims=True), 1)
    entropy = -(share * np.log(share, out=np.zeros_like(share), where=share > 0)).sum(1)
    again = np.zeros(len(row), bool)  # a word that is the one before it
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    letters = np.maximum(h[:, _LETTER].sum(1), 1)
    filled = np.maximum(h[:, ~_SPACE].sum(1), 1)
    out = np.stack(
        [
            np.log1p(n),
            np.sqrt(mean),
            np.log1p(20 * h[:, _SYMBOLS].sum(1) / words_),
            np.log1p(20 * h[:, ord("|")] / words_),
            np.log1p(20 * h[:, ord("!")] / words_),
            np.sqrt(h[:, _UPPER].sum(1) / letters),
            np.sqrt(h[:, _DIGIT].sum(1) / filled),
            np.sqrt((h[:, ord(".")] + h[:, ord(",")]) / words_),
            np.sqrt(h[:, 10] / words_),
            distinct / words_ + 0.15 * np.log1p(n),
            np.sqrt(np.sqrt(np.maximum(squares / words_ - mean**2, 0))),
            entropy,
            np.sqrt(np.bincount(row[again], minlength=len(n)) / words_),
        ],
        axis=1,
    )
    out[np.diff(part.offsets) == 0] = 0
    return out


@dataclass(frozen=True)
class Model:
    """Class means and the inverse Cholesky factors of the shrunken covariances; label 1 is second."""

    prior: tuple[float, float]
    center: np.ndarray
    inverse: np.ndarray  # inverse of the lower Cholesky factor, by class
    log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if min(self.prior) == 0:
            return np.full(len(x), 0.5 if max(self.prior) == 0 else float(self.prior[1] > 0))
        log = []
        for k in (0, 1):
            z = (x - self.center[k]) @ self.inverse[k].T
            log.append(math.log(self.prior[k]) - 0.5 * (z**2).sum(1) - self.log_det[k])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit(count: np.ndarray, total: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Model:
    """From each class's number of rows, sums, and sums of products."""
    d = total.shape[1]
    if count.min() == 0:
        return Model((float(count[0] > 0), float(count[1] > 0)), np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2))
    center = total / count[:, None]
    cov = products / count[:, None, None] - center[:, :, None] * center[:, None, :]
    pooled = (cov * count[:, None, None]).sum(0) / count.sum()
    target = np.diag(np.maximum(np.diag(pooled), FLOOR))
    factors = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * target) for c in cov]
    return Model(
        (count[0] / count.sum(), count[1] / count.sum()),
        center,
        np.stack([np.linalg.inv(f) for f in factors]),
        np.array([np.log(np.diag(f)).sum() for f in factors]),
    )


def _vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), SLICE_BYTES // 2):
                x = statistics(part)
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                ids = batch.column(0).slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit to the rows of ``docs`` that ``labels`` marks 0 or 1."""
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    d = len(NAMES)
    x = [F.get("x", F.lit(i)) for i in range(d)]
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(d)]
    products = [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    got = _vectors(docs, id_col, text_col).join(marked, "id").groupBy("y").agg(F.count("*").alias("n"), *sums, *products).collect()
    count, total, both = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in got:
        count[r.y] = r.n
        total[r.y] = [r[f"s{i}"] for i in range(d)]
        for i in range(d):
            for j in range(i, d):
                both[r.y, i, j] = both[r.y, j, i] = r[f"p{i}_{j}"]
    return fit(count, total, both)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1), SLICE_BYTES // 2):
                ids = batch.column(0).slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(shared.value.score(statistics(part)))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def accept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score ``ACCEPT_FROM`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(0).field(text_col), SLICE_BYTES // 2):
                keep = shared.value.score(statistics(part)) >= ACCEPT_FROM
                yield batch.slice(part.first, part.last - part.first).filter(pa.array(keep))

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.mapInArrow(run, T.StructType().add("row", docs.schema)).select("row.*")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold whose labels aren't learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its fold, score and predicted label."""
    model = train(docs.where(~held_out()), labels)
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT_FROM).cast("int").alias("predicted")
    )
