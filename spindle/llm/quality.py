"""Quality classifier (operator 6).

Document statistics go through random Fourier features, which approximate a Gaussian kernel; ridge
regression on them is solved from normal equations that tasks sum over their rows, and isotonic
regression on rows kept out of that fit turns its scores into probabilities.

Texts are read once, into a small table of statistics, from which learning and scoring work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = 256
RIDGE = 1e-3
WIDTH = 0.5  # of the kernel, in units of the square root of the number of statistics
THRESHOLD = 0.3
#: Bound of the sample of labelled rows that is learned from, and tasks that sum normal equations.
MAX_FIT = 100_000
FIT_TASKS = 16

_CLASSES = ["a-z", "A-Z", "0-9", " ", "\n", ".", ",", "!", "|", "*", "#$%&", "other ASCII", "not ASCII"]
_CLASS = np.full(256, 11, np.uint8)
_CLASS[128:] = 12
for _i, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!", "|", "*", "#$%&"]):
    for _c in _chars:
        _CLASS[ord(_c)] = _i


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of statistics for each text, all finite, for empty texts too."""
    n = len(texts)
    h, first, data, starts, ends = common.word_hashes(texts)
    a = np.frombuffer(data, np.uint8)
    sizes = np.array([len((t or "").encode("utf-8", "surrogatepass")) + 1 for t in texts])
    where = np.repeat(np.arange(n), sizes)[: len(a)]
    counts = np.bincount(where * 13 + _CLASS[a[: len(where)]], minlength=n * 13).reshape(n, 13)[:, :13].astype(float)
    chars = np.maximum(counts.sum(1), 1)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    per = lambda x: np.bincount(doc, x, n)
    mean = per(length) / some
    spread = np.sqrt(np.maximum(per(length**2) / some - mean**2, 0))
    last = a[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = np.isin(_CLASS[last], [7, 8, 9, 10])
    columns = [np.log1p(chars), np.log1p(words), mean, spread, *(counts / chars[:, None]).T, per(odd) / some, per(length > 20) / some, per(length == 1) / some]
    for lag in (1, 2, 5, 10, 20, 40):
        same = np.zeros(len(h))
        if len(h) > lag:
            same[lag:] = (h[lag:] == h[:-lag]) & (doc[lag:] == doc[:-lag])
        columns.append(per(same) / some)
    for k in (1, 3):
        g = common.rolling(h, k) if k > 1 else h
        d = doc[: len(g)]
        inside = d == doc[k - 1 :] if k > 1 else np.ones(len(g), bool)
        key = common.mix(g[inside] ^ common.mix(d[inside].astype(np.uint64)))
        uniq, at, many = np.unique(key, return_index=True, return_counts=True)
        owner = d[inside][at]
        columns.append(np.bincount(owner, minlength=n) / np.maximum(words - k + 1, 1))
        most = np.zeros(n)
        np.maximum.at(most, owner, many)
        columns.append(most / some)
    return np.nan_to_num(np.column_stack(columns)).astype(np.float32)


def described(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in common.blocks(batch.column(1), 1_000_000):
                x = pa.array(list(statistics(texts)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), x], names=["doc_id", "x"])

    return common.take(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, x array<float>")


def accepted(docs: DataFrame, model: "Model", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose texts score at least the threshold. Texts are not shuffled."""
    at = common.place(docs, "text")
    rows = common.plain(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in common.blocks(batch.column(at).cast(pa.string()), 1_000_000):
                yield batch.slice(start, len(texts)).filter(pa.array(model.score(statistics(texts)) >= threshold))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


class Model:
    """Standardise, random Fourier features, ridge weights, isotonic knots."""

    def __init__(self, mean: np.ndarray, dev: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.dev = mean, dev
        self.w = rng.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.ridge = np.zeros(FEATURES + d + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.dev, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), z * 0.05, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances of label 1; a half where nothing could be learned."""
        if x.shape[1] != len(self.mean):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y in order of s (pool adjacent violators), at the blocks' mean scores."""
    order = np.argsort(s, kind="stable")
    blocks: list[list[float]] = []  # sum of y, sum of s, count
    for a, b in zip(y[order], s[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top)]
    at = np.array([b[1] / b[2] for b in blocks])
    # a block of few rows is drawn towards the middle, so no score is exactly 0 or 1
    value = np.array([(b[0] + 0.5) / (b[2] + 1) for b in blocks])
    return at, np.maximum.accumulate(value)


def _vectors(batch: pa.RecordBatch, k: int) -> np.ndarray:
    x = batch.column(k)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1).astype(float)


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _known(labels: DataFrame, held_out: Column | None) -> DataFrame:
    """doc_id and quality of the labelled documents that may be learned from."""
    known = common.take(labels, doc_id="long", quality="int").where("quality in (0, 1) and doc_id is not null")
    return known.where(~(_held_out() if held_out is None else held_out)).groupBy("doc_id").agg(F.max("quality").alias("quality"))


def _in_sample(known: DataFrame, max_fit: int) -> Column:
    """Whether a doc_id is in the sample of about max_fit of the known ones."""
    share = min(1.0, max_fit / max(1, known.count()))
    return F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)


def learned(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_fit: int = MAX_FIT) -> Model:
    """fit() from documents: statistics are made of those alone that may be in the sample."""
    chosen = common.take(docs, doc_id="long", text="string").where(_in_sample(_known(labels, held_out), max_fit))
    scratch = common.Scratch(docs.sparkSession, "quality")
    model = fit(scratch.save(described(chosen), "statistics"), labels, held_out, max_fit)
    scratch.clear()
    return model


def fit(stats: DataFrame, labels: DataFrame, held_out: Column | None = None, max_fit: int = MAX_FIT) -> Model:
    """Learned from labelled rows that are not held out: four in five for the ridge, the fifth for calibration.

    Of more than max_fit such documents, a sample by a hash of doc_id of about that many is taken. Of a doc_id's several
    texts the one of the least statistics is learned from. Conflicting labels of one doc_id: the
    greater. Without both labels, every score is the mean label.
    """
    known = _known(labels, held_out)
    known = known.where(_in_sample(known, max_fit))
    rows = stats.where("doc_id is not null").groupBy("doc_id").agg(F.min("x").alias("x")).join(known, "doc_id").select("x", F.col("quality").cast("double").alias("y"), (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) == 4).alias("second"), F.pmod(F.xxhash64("doc_id"), F.lit(FIT_TASKS)).alias("task"))
    rows = common.Scratch(stats.sparkSession, "quality").save(rows.repartition(FIT_TASKS, "task"), "fit")
    first = rows.where(~F.col("second"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            if len(batch):
                x = _vectors(batch, 0)
                total = total + np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    m = sum(np.frombuffer(r[0]) for r in first.select("x").mapInArrow(moments, "m binary").collect())
    if isinstance(m, int):
        return Model(np.zeros(1), np.ones(1))
    d = (len(m) - 1) // 2
    mean = m[1 : d + 1] / m[0]
    model = Model(mean, np.sqrt(np.maximum(m[d + 1 :] / m[0] - mean**2, 0)) + 1e-6)
    size = len(model.ridge)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            if len(batch):
                p, y = model.phi(_vectors(batch, 0)), batch.column(1).to_numpy(zero_copy_only=False)
                a, b, n = a + p.T @ p, b + p.T @ y, n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel(), b, [n]]).tobytes()], pa.binary())], names=["s"])

    # one square matrix from each of the FIT_TASKS tasks, whatever the number of rows
    sums = sum(np.frombuffer(r[0]) for r in first.select("x", "y").mapInArrow(normal, "s binary").collect())
    a, b, n = sums[: size * size].reshape(size, size), sums[size * size : -1], sums[-1]
    model.ridge = np.linalg.solve(a + RIDGE * n * np.eye(size), b)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_vectors(batch, 0))), batch.column(1)], names=["s", "y"])

    got = rows.where("second").select("x", "y").mapInArrow(scored, "s double, y double").toPandas()
    if len(got):
        model.knots = isotonic(got["s"].to_numpy(), got["y"].to_numpy())
    else:
        model.knots = (np.array([0.0, 1.0]), np.array([0.01, 0.99]))
    return model


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, threshold: float = THRESHOLD, max_fit: int = MAX_FIT) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every document.

    held_out: a condition on doc_id for rows that nothing is learned from, by default that
    crc32(doc_id as text) mod 5 is 0. Scores come from the text alone. Null and empty texts have
    scores like any other; a null doc_id is scored, never learned from; repeated rows have a row
    each; an empty table gives none. Columns other than doc_id and text are not read.
    """
    stats = common.Scratch(docs.sparkSession, "quality").save(described(docs), "statistics")
    model = fit(stats, labels, held_out, max_fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _vectors(batch, 2)
                score = model.score(x)
                arrays = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", (_held_out() if held_out is None else held_out).alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
