"""Language identification (operator 8).

A text's hashed subwords (byte n-grams inside words, with the words' edges) have embeddings whose
average goes through a linear softmax; both are trained by stochastic gradient descent in numpy
on a bounded sample. The model is linear after the average, so for prediction embeddings and
softmax weights fold into one table of scores by bucket, broadcast once (buckets x languages,
a fixed size), and a text's scores are the mean of its subwords' rows. Scores are calibrated
by a temperature fitted on rows kept out of the training, which also set the rejection level.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 15
SIZES = (2, 3, 4)
DIMENSIONS = 16
EPOCHS = 6
RATE = 1.0
#: Bounds of the training sample: documents for each language, and of all; past the second, each of many languages has fewer, but some.
PER_LANGUAGE = 800
MOST_SAMPLED = 20_000
LEAST_A_LANGUAGE = 20
#: What accepted predictions are to reach on the rows kept out of the training.
ACCEPTED_ACCURACY = 0.99

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[np.arange(ord("a"), ord("z") + 1)] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
_LETTER = re.compile(r"[^\W\d_]")


def subwords(texts: list[str | None], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: buckets of all subwords of the texts in order, and where each text's begin."""
    raw = [b" " + (t or "").lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    a = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    space = a == 0x20
    wide = a.astype(np.uint32)
    for n in SIZES:
        m = len(a) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
            continue
        code = wide[:m].copy()
        ok = ~(space[:m] & space[1 : m + 1]) if n == 2 else ~space[1 : m + 1]
        for j in range(1, n):
            code |= wide[j : m + j] << np.uint32(8 * j)
            if 2 <= j < n - 1:
                ok &= ~space[j : m + j]
        at = np.flatnonzero(ok)
        mixed = code[at] * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)
        yield (mixed >> np.uint32(32 - bits)).astype(np.int64), np.searchsorted(at, bounds)


def bags(texts: list[str | None], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their shares, of each text."""
    per = list(subwords(texts, bits))
    out = []
    for i in range(len(texts)):
        ids, counts = np.unique(np.concatenate([h[b[i] : b[i + 1]] for h, b in per]), return_counts=True)
        out.append((ids.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_languages: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(score table by bucket and language, bias), by plain stochastic gradient descent, one text a step."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    w = np.zeros((DIMENSIONS, n_languages), np.float32)
    b = np.zeros(n_languages, np.float32)
    steps, done = EPOCHS * len(x), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            ids, share = x[i]
            if not len(ids):
                continue
            rows = e[ids]
            h = share @ rows
            p = np.exp((z := h @ w + b) - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= rate * np.outer(h, p)
            b -= rate * p
            e[ids] = rows - (rate * share)[:, None] * back * np.float32(32)
    return e @ w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(temperature of least log loss, least score at which accepted predictions are accurate enough)."""
    if not len(y):
        return 1.0, 0.0
    loss = {t: -np.log(_softmax(z * t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 20, 60)}
    t = float(min(loss, key=loss.get))
    p = _softmax(z * t)
    score, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-score)
    good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= ACCEPTED_ACCURACY
    return t, float(score[order][np.flatnonzero(good).max()]) if good.any() else 1.0


def fit(docs: DataFrame, trained: Column, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray, np.ndarray, float, float]:
    """Languages, score table, bias, temperature and rejection level, learned from rows where `trained` holds.

    Every lang is learned. The sample is by a hash of doc_id and text, about per_language rows of each language, whatever
    the table's size; of more languages than MOST_SAMPLED allows for, fewer rows each. Equal rows are learned from once.
    """
    rows = docs.where(trained & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.0
    per_language = min(per_language, max(LEAST_A_LANGUAGE, MOST_SAMPLED // len(languages)))
    shares = [(r["lang"], int(1_000_000 * min(1.0, per_language / r["count"])) or 1) for r in counts]
    of = F.element_at(F.from_json(F.lit(json.dumps(dict(shares))), "map<string,int>"), F.col("lang"))
    picked = rows.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1_000_000)) < of).select("doc_id", "lang", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in common.blocks(batch.column(2)):
                found = bags(texts)
                arrays = [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "ids", "share"])

    got = picked.mapInArrow(run, "doc_id long, lang string, ids array<int>, share array<float>").toPandas()
    got["first"] = [tuple(i[:8]) for i in got["ids"]]  # rows of one doc_id in an order of their own
    got = got.sort_values(["doc_id", "lang", "first"], kind="stable", na_position="first")
    x = [(np.asarray(i, np.int64), np.asarray(s, np.float32)) for i, s in zip(got["ids"], got["share"])]
    number = {v: k for k, v in enumerate(languages)}
    y = np.array([number[v] for v in got["lang"]], np.int64)
    out = np.arange(len(x)) % 5 == 4  # every fifth is for calibration alone
    table, bias = train([x[i] for i in np.flatnonzero(~out)], y[~out], len(languages))
    z = np.array([s @ table[i] + bias for i, s in (x[j] for j in np.flatnonzero(out))]).reshape(-1, len(languages))
    temperature, level = calibrate(z, y[out])
    return languages, table.astype(np.float32), bias, temperature, level


def identify(docs: DataFrame, held_out: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of every document.

    held_out: rows that nothing is learned from; by default those whose crc32(doc_id as text)
    mod 4 is 2. lang_pred is a learned language, or `und` (score 0) where the text is null or has no
    letter, or where no language could be learned. accepted is false for those and where the
    score is below the calibrated level. A null doc_id is not held out. Whole texts are read;
    lang serves the learning alone. Repeated rows have a row each; an empty table gives none.
    """
    docs = common.take(docs, doc_id="long", text="string", lang="string")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)) if held_out is None else held_out
    languages, table, bias, temperature, level = fit(docs, ~out, per_language)
    shared = docs.sparkSession.sparkContext.broadcast((languages, np.ascontiguousarray(table.T), bias, temperature, level))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, by_language, bias, temperature, level = shared.value
        for batch in batches:
            for at, texts in common.blocks(batch.column(2), 1_000_000):
                n = len(texts)
                sums, total = np.zeros((n, len(languages))), np.zeros(n)
                for h, bounds in subwords(texts):
                    total += np.diff(bounds)
                    if len(h) and len(languages):
                        doc = np.repeat(np.arange(n), np.diff(bounds))
                        for k, row in enumerate(by_language):
                            sums[:, k] += np.bincount(doc, row[h], n)
                letters = [bool(t and _LETTER.search(t)) for t in texts]
                p = _softmax((sums / np.maximum(total, 1)[:, None] + bias) * temperature) if languages else np.zeros((n, 1))
                best = p.argmax(1)
                names = [languages[b] if ok and languages else "und" for b, ok in zip(best, letters)]
                score = np.where([x != "und" for x in names], p.max(1), 0.0)
                arrays = [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array((score >= level) & (score > 0), pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
