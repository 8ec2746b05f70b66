"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a bag of hashed words and punctuation runs. One weight vector is shared by all grades and ordered thresholds
separate them: P(grade <= k) = sigmoid(theta_k - w.x). The fit runs on the driver over a bounded sample of rated rows
(``per_grade`` rows of each grade, a documented parameter); scoring covers whole texts of all rows where they are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_bytes

TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")
BITS = 18
PREFIXES = (4, 5, 6)
#: Features of one rated text that the driver gets at most, those of the highest counts.
PER_TEXT = 1 << 14


@dataclass(frozen=True)
class OrdinalModel:
    """weights over 2**BITS buckets; thetas, ascending, one fewer than grades. No thetas: nothing was rated."""

    weights: np.ndarray
    thetas: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and k."""
        return 1 / (1 + np.exp(np.clip(self.thetas[None, :] - z[:, None], -40, 40)))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values, log counts over the root of how many there are: words, their first 4, 5 and 6 bytes, and bands of repetition and punctuation."""
    tokens = TOKEN.findall(text.lower())
    counts = Counter(tokens)
    kinds = [counts]
    for length in PREFIXES:
        stems: Counter = Counter()
        for word, n in counts.items():
            if len(word) > length:
                stems[word[:length] + b"*"] += n
        kinds.append(stems)
    signs = sum(n for word, n in counts.items() if word[0] < 48 or 57 < word[0] < 97 or 122 < word[0] < 128)
    kinds.append({b"repeats %d" % int(2 * math.log2(len(tokens) / len(counts) if counts else 1)): 1, b"signs %d" % (20 * signs // max(1, len(tokens))): 1})
    n = sum(map(len, kinds))
    bucket = np.fromiter(map(zlib.crc32, chain(*kinds)), np.uint32, n).astype(np.int64) & ((1 << BITS) - 1)
    value = (1 + np.log(np.fromiter(chain(*(k.values() for k in kinds)), np.float64, n))) / np.sqrt(max(n, 50) / 500)
    return bucket.astype(np.int32), value.astype(np.float32)


def loss(z: np.ndarray, theta: np.ndarray, grade: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log likelihood of the grades, and its derivatives by each row's z and by each threshold."""
    n, row = len(z), np.arange(len(z))
    low = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(z[:, None] - theta[None, :], -40, 40))), np.ones((n, 1))], axis=1)
    up, down = low[row, grade + 1], low[row, grade]
    p = np.maximum(up - down, 1e-12)
    du, dd = up * (1 - up), down * (1 - down)
    by_theta = [(weight * dd / p)[grade == k + 1].sum() - (weight * du / p)[grade == k].sum() for k in range(len(theta))]
    return float(-(weight * np.log(p)).sum()), (du - dd) / p * weight, np.array(by_theta)


def fit_ordinal(grade: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], n_grades: int, weight: np.ndarray | None = None, l1: float = 5e-4, steps: int = 200, rate: float = 0.05, least_rows: int = 4) -> OrdinalModel:
    """Proximal Adam on the mean negative log likelihood; the absolute penalty keeps rare words at zero.

    ``weight`` says how many rated rows each row of the sample stands for, so thresholds fit the rows' own mix of grades.
    """
    size = np.array([len(b) for b, _ in rows])
    index = np.concatenate([b for b, _ in rows]) if len(rows) else np.zeros(0, np.int32)
    often = (np.bincount(index, minlength=1 << BITS) >= min(least_rows, max(1, len(rows) // 100)))[index]
    value = (np.concatenate([v for _, v in rows]) if len(rows) else np.zeros(0, np.float32))[often]
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), size)[often]
    used = np.flatnonzero(np.bincount(index[often], minlength=1 << BITS))
    column = np.searchsorted(used, index[often]).astype(np.int32)
    del index, often
    n, d = len(rows), len(used)
    weight = np.ones(n) / n if weight is None else weight / weight.sum()
    share = np.cumsum(np.bincount(grade, weight, n_grades) + 0.5 / n)[:-1] / (1 + 0.5 * n_grades / n)
    theta = np.log(share / (1 - share))
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    tm, tv = np.zeros(n_grades - 1), np.zeros(n_grades - 1)
    for t in range(1, steps + 1):
        _, gz, gt = loss(np.bincount(owner, weights=value * w[column], minlength=n), theta, grade, weight)
        g = np.bincount(column, weights=value * gz[owner], minlength=d)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        tm, tv = 0.9 * tm + 0.1 * gt, 0.999 * tv + 0.001 * gt * gt
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = w - scale * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(scale, 1e3) * l1, 0)
        theta = theta - rate * (tm / (1 - 0.9**t)) / (np.sqrt(tv / (1 - 0.999**t)) + 1e-8)
        theta = np.maximum.accumulate(theta + np.arange(n_grades - 1) * 1e-9)
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, theta)


def grades(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 poor, 1 good but toxic, 2 good and clean; the lowest where a doc_id is rated again."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    grade = F.when(F.col("quality") < 1, 0).when(toxic > 0, 1).otherwise(2)
    rated = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    return rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(grade).alias("grade"))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = []
        for bucket, value in (features(t.as_py()) for t in batch.column("text")):
            if len(bucket) > PER_TEXT:
                best = np.lexsort((bucket, -value))[:PER_TEXT]
                bucket, value = bucket[best], value[best]
            bags.append((bucket, value))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([b.tobytes() for b, _ in bags], pa.binary()), pa.array([x.tobytes() for _, x in bags], pa.binary())], names=["doc_id", "grade", "buckets", "values"])


def train(docs: DataFrame, labels: DataFrame, per_grade: int = 1500, n_grades: int = 3) -> OrdinalModel:
    """Fits on about ``per_grade`` rated rows of each grade, chosen by a hash of doc_id, so reruns agree; at most PER_TEXT features of each.

    Rows of ``labels`` without doc_id or quality rate nothing, and a doc_id that is rated again has its lowest grade. With
    empty tables, or no rated text, the model has no thresholds and keeps everything.
    """
    bound_batches(docs.sparkSession)
    rated = grades(labels)
    count = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().collect()}
    keep = F.lit(False)
    for k, n in count.items():
        keep = keep | ((F.col("grade") == k) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53)) < F.lit(2.0**53 * min(1.0, per_grade / n))))
    sample = rated.filter(keep)  # at most about per_grade rows of each grade, so it can be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(sample), "doc_id")
    bags = texts.select("doc_id", "grade", "text").mapInArrow(_bags, "doc_id long, grade int, buckets binary, values binary")
    # A doc_id that many rows have gives one row here, whatever their texts.
    frame = bags.groupBy("doc_id").agg(F.min(F.struct("grade", "buckets", "values")).alias("one")).select("doc_id", "one.*").toPandas()
    if not len(frame):
        return OrdinalModel(np.zeros(1 << BITS, np.float32), np.zeros(0))
    frame = frame.sort_values("doc_id")
    rows = [(np.frombuffer(b, np.int32), np.frombuffer(v, np.float32)) for b, v in zip(frame["buckets"], frame["values"], strict=True)]
    grade = frame["grade"].to_numpy().astype(np.int64)
    stands_for = np.array([count.get(k, 0) for k in range(n_grades)]) / np.maximum(np.bincount(grade, minlength=n_grades), 1)
    return fit_ordinal(grade, rows, n_grades, stands_for[grade])


def _scores(model: OrdinalModel, texts) -> tuple[np.ndarray, np.ndarray]:
    z = np.array([float(model.weights[b] @ v) for b, v in map(features, texts)])
    tails = model.tails(z)
    return tails.sum(axis=1), tails[:, -1]


def score(docs: DataFrame, model: OrdinalModel, threshold: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: doc_id, expected_grade, p_top (probability of the top grade) and keep.

    keep is p_top >= ``threshold``. Null and empty texts are scored as texts without words. If nothing was rated, the
    grades are null and every row is kept. Repeated rows score alike; an empty table gives an empty result; other columns
    are ignored.
    """
    bound_batches(docs.sparkSession)
    own = docs.sparkSession.sparkContext.broadcast((model.weights, model.thetas))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, model = batch.num_rows, OrdinalModel(*own.value)
            if len(model.thetas):
                expected, top = _scores(model, (t.as_py() for t in batch.column("text")))
                out = [pa.array(expected, pa.float64()), pa.array(top, pa.float64()), pa.array(top >= threshold)]
            else:
                out = [pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array([True] * n, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], names=["doc_id", "expected_grade", "p_top", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, expected_grade double, p_top double, keep boolean")


def filter_rows(docs: DataFrame, test: Callable[[], Callable[[list], np.ndarray]], column: str = "text") -> DataFrame:
    """``docs`` with only the rows whose ``column`` passes; made where they are read, without a shuffle.

    test() is called once in each task and gives a function from a list of texts (bytes) to booleans.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = test()
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(passes(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_good(docs: DataFrame, model: OrdinalModel, threshold: float = 0.6) -> DataFrame:
    """``docs`` without the rows that score() rejects."""
    own = docs.sparkSession.sparkContext.broadcast((model.weights, model.thetas))

    def good():
        model = OrdinalModel(*own.value)
        return lambda texts: _scores(model, texts)[1] >= threshold

    return filter_rows(docs, good) if len(model.thetas) else docs
