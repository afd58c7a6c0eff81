"""Quality by regularised quadratic discriminant analysis of document statistics.

Each whole text gives a vector of transformed statistics; neither label, language,
source nor id enters it. For each class the mean and covariance are fitted from
sums over the training rows (a grouped aggregation of d*d + d + 1 numbers, never
rows). The covariance is shrunk towards the pooled one and its mean variance, and
factored once by Cholesky. The score is the logistic of the tempered difference of
the two log densities (Mahalanobis distances and log determinants by the cached
factors) and the log prior odds.

All labelled rows whose crc32(doc_id) mod 5 is not 0 are used; there is no sample.

Statistics are standardised and, in scores only, held to ``REACH`` deviations either way:
the densities are quadratic, so one measure of an odd text would else outweigh all others.

Defined results: null and empty texts have the statistics 0 and get a score;
rows with null ids are scored and count as not held out; labels without quality
or document are not used, repeated ones count each; rows of one text tie in their score;
with fewer than two labelled classes the score is the share of label 1 (0.5 without
labels); a very long text is measured whole, in memory linear in its length; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.process_cache import frugal
from corpusmill.plans.staging import cut, small_batches, table

#: Weight of the pooled covariance, of the mean variance, and the temperature of the score.
POOLED, RIDGE, TEMPERATURE = 0.2, 0.02, 4.0
#: Deviations from the mean beyond which a statistic counts no further.
REACH = 8.0
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "symbols", "exclaims", "capitals", "digits", "stops", "variety", "repeated_lines", "line_length", "top_word", "short_words", "density", "other_ascii")

_SYMBOL, _EXCLAIM, _UPPER, _LOWER, _DIGIT, _STOP, _SPACE = (np.frombuffer(x, np.uint8) for x in (b"#*$%&|<>", b"!?", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b".,;:", b" \t\n\x0b\x0c\r"))
_KNOWN = np.concatenate((_SYMBOL, _EXCLAIM, _UPPER, _LOWER, _DIGIT, _STOP, _SPACE))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(text) - int(size[_SPACE].sum())
    letters = int(size[_UPPER].sum() + size[_LOWER].sum()) + 1
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    return [
        math.log1p(n),
        math.log1p(chars / n),
        math.sqrt(int(size[_SYMBOL].sum()) / n),
        math.sqrt(int(size[_EXCLAIM].sum()) / n),
        math.sqrt(int(size[_UPPER].sum()) / letters),
        math.sqrt(int(size[_DIGIT].sum()) / chars),
        math.sqrt(int(size[_STOP].sum()) / n),
        math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.log1p(n / len(lines)),
        math.sqrt(max(counts.values()) / n),
        short / n,
        math.log(_packed(raw) / len(raw)),
        math.sqrt(int(size[:128].sum() - size[_KNOWN].sum()) / chars),
    ]


def _packed(raw: bytes) -> int:
    """Bytes of the whole text packed at the fastest level, as a measure of repetition."""
    return len(zlib.compress(raw, 1)) + 1


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of statistics) for every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column("text")]).reshape(b.num_rows, len(FEATURES))
            at = pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, x array<double>")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def moments(train: DataFrame) -> dict[int, np.ndarray]:
    """class -> sums of (1, x)(1, x)^T over ``train`` (x, quality), in one fixed-size table."""
    d = len(FEATURES) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
        for b in batches:
            x = np.asarray(b.column("x").flatten()).reshape(b.num_rows, d - 1)
            x = np.concatenate((np.ones((len(x), 1)), x), axis=1)
            y = b.column("quality").to_numpy()
            for c in total:
                total[c] += x[y == c].T @ x[y == c]
        for c, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, c, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(s.ravel())], names=["c", "i", "v"])

    rows = train.select("x", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").mapInArrow(run, "c int, i int, v double")
    out = {0: np.zeros(d * d), 1: np.zeros(d * d)}
    for r in rows.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():  # 2 * d * d rows
        out[r.c][r.i] = r.v
    return {c: v.reshape(d, d) for c, v in out.items()}


class Model:
    """Means, scales and cached Cholesky factors of the two classes."""

    def __init__(self, sums: dict[int, np.ndarray], pooled: float = POOLED, ridge: float = RIDGE, temperature: float = TEMPERATURE) -> None:
        n = {c: s[0, 0] for c, s in sums.items()}
        self.share = float(n[1] / (n[0] + n[1])) if n[0] + n[1] else 0.5
        self.temperature, self.classes = temperature, []
        if min(n.values()) < 2:
            return
        both = sums[0] + sums[1]
        self.middle = both[0, 1:] / both[0, 0]
        self.scale = np.sqrt(np.maximum(np.diag(both)[1:] / both[0, 0] - self.middle**2, 1e-6))
        d = len(self.middle)
        fit = {}
        for c, s in sums.items():
            mean = s[0, 1:] / n[c]
            cov = (s[1:, 1:] / n[c] - np.outer(mean, mean)) / np.outer(self.scale, self.scale)
            fit[c] = ((mean - self.middle) / self.scale, cov)
        common = (n[0] * fit[0][1] + n[1] * fit[1][1]) / (n[0] + n[1])
        for c in (0, 1):
            mean, cov = fit[c]
            cov = (1 - pooled) * cov + pooled * common
            cov = (1 - ridge) * cov + ridge * max(np.trace(cov) / d, 1e-3) * np.eye(d)
            root = np.linalg.cholesky(cov)
            self.classes.append((mean, np.linalg.inv(root), float(2 * np.log(np.diag(root)).sum())))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        z = np.clip((x - self.middle) / self.scale, -REACH, REACH)
        log = [-0.5 * (((z - mean) @ inverse.T) ** 2).sum(axis=1) - 0.5 * logdet for mean, inverse, logdet in self.classes]
        odds = (log[1] - log[0]) / self.temperature + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def fit(x: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from the rows of ``x`` (doc_id, x) with a label that are not held out."""
    train = x.where(~held_out()).join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality is not null"), "doc_id")
    return Model(moments(train), **options)


def scored(x: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    shared = x.sparkSession.sparkContext.broadcast((model.__dict__, len(FEATURES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.__dict__, d = shared.value
        for b in batches:
            s = own.score(np.asarray(b.column("x").flatten()).reshape(b.num_rows, d))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = x.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    x = cut(measured(docs))
    return scored(x, fit(x, labels, **options))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
