"""Exact top-k search by inner product (operator 10).

Norm-sorted inner products: vectors are processed by descending length; a prefix of the
coordinates, rotated by the singular vectors of all vectors, gives partial sums, and the
Cauchy-Schwarz inequality bounds what the remaining coordinates can add. A block of vectors
is left out for a query when even |q| |x| cannot reach the query's k-th score so far, a vector
when its partial sum and bound cannot. What is left is scored exactly, in integers.

Queries come in blocks of bounded size; each block is broadcast to one pass over all vectors,
whose tasks keep k rows a query and never a pair more. Thresholds start from the longest
vectors of the whole table, so tasks prune from their first block on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

K = 10
QUERY_BLOCK = 4096
SEEDS = 1024
SCALE = 1024.0
#: Of the summed squares, as much as the rotated prefix is to hold.
ENERGY = 0.8

_FOUND = "query_id long, vec_id long, score long"


def scaled(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, v (integers, floor(scale * x)) and sq (squared length) of the vectors that take part."""
    rows = common.take(vectors, vec_id="long", embedding="array<double>").withColumnRenamed("embedding", "x").where("x is not null")
    ok = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(ok).select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))
    return rows.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))


def _matrix(column: pd.Series, d: int) -> np.ndarray:
    """Integer rows; shorter vectors are filled with zeros."""
    out = np.zeros((len(column), d), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _gram(rows: DataFrame, d: int) -> np.ndarray:
    """Sum of x x' over all vectors: each task sends d * d sums."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for part in parts:
            x = _matrix(part["v"], d).astype(float)
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(d * d), "s": total.ravel()})

    sums = rows.select("v").mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros(d * d)
    out[sums["i"]] = sums["s"]
    return out.reshape(d, d)


def _best(k: int, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each q, ties to the smaller id, in order."""
    at = np.lexsort((ids, -scores, q))
    q, ids, scores = q[at], ids[at], scores[at]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], scores[keep]


def _thresholds(k: int, n: int, q: np.ndarray, scores: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """The k-th score of each of n queries where k are known (q sorted, best first), at least the floor."""
    out = floor.copy()
    first = np.searchsorted(q, np.arange(n))
    have = np.searchsorted(q, np.arange(n), side="right") - first >= k
    out[have] = np.maximum(out[have], scores[first[have] + k - 1])
    return out


def search(vectors: DataFrame, is_query: Column | None = None, k: int = K, scale: float = SCALE, query_block: int = QUERY_BLOCK, seeds: int = SEEDS) -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank, vec_id, score; ties to the smaller vec_id.

    is_query: a condition on vec_id, by default divisibility by 100. A query's candidates are
    all rows with another vec_id. Vectors that are null, or hold a null or a value that is not
    finite, take no part; nor do rows without vec_id. Vectors of fewer coordinates count as
    filled up with zeros. Repeated rows are candidates each; a repeated query is asked once.
    No vectors, or no queries: no rows. Columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "topk")
    rows = scaled(vectors, scale).where("vec_id is not null")
    is_query = F.col("vec_id") % 100 == 0 if is_query is None else is_query
    facts = rows.agg(F.max(F.size("v")), F.countDistinct(F.when(is_query, F.col("vec_id")))).first()
    d, asked = facts[0] or 0, facts[1]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not asked:
        return empty
    longest = rows.orderBy(F.desc("sq")).limit(seeds).select("vec_id", "v").toPandas()
    values, turn = np.linalg.eigh(_gram(rows, d)) if d else (np.zeros(0), np.zeros((0, 0)))
    turn, values = turn[:, ::-1], np.maximum(values[::-1], 0)
    head = int(np.searchsorted(np.cumsum(values), ENERGY * values.sum())) + 1 if values.sum() > 0 else d
    seed_ids, seed_v = longest["vec_id"].to_numpy(), _matrix(longest["v"], d)
    count = -(-asked // query_block)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)))
    queries = scratch.save(queries, "queries") if count > 1 else queries
    # of several passes, each reads what the first has scaled and sorted
    rows = rows.sortWithinPartitions(F.desc("sq"))
    rows = scratch.save(rows, "sorted") if count > 1 else rows
    found: DataFrame | None = None
    for block in range(count):
        mine = queries.where(F.col("block") == block).select("vec_id", "v").toPandas()
        if not len(mine):
            continue
        one = _pass(rows, mine["vec_id"].to_numpy(), _matrix(mine["v"], d), seed_ids, seed_v, turn, head, k)
        best = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
        best = best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
        best = scratch.save(best, f"block{block}") if count > 1 else best
        found = best if found is None else found.unionAll(best)
    return empty if found is None else found


def _pass(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seed_v: np.ndarray, turn: np.ndarray, head: int, k: int) -> DataFrame:
    """Each task's k best for each query of one block."""
    d, n = q.shape[1], len(q)
    first = q @ seed_v.T
    first[q_ids[:, None] == seed_ids[None, :]] = np.iinfo(np.int64).min
    floor = np.full(n, np.iinfo(np.int64).min)
    if first.shape[1] >= k:
        floor = np.partition(first, -k, axis=1)[:, -k]
    turned = q.astype(float) @ turn
    shared = rows.sparkSession.sparkContext.broadcast((q_ids, q, turned[:, :head], np.sqrt((turned[:, head:] ** 2).sum(1)), np.sqrt((q.astype(float) ** 2).sum(1)), floor, turn))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q, q_head, q_rest, q_len, limit, turn = shared.value
        best = (np.zeros(0, np.int64),) * 3
        for part in parts:
            longest = float(part["sq"].max()) ** 0.5 if len(part) else 0.0
            slack = 1e-9 * (1 + q_len * longest)
            alive = np.flatnonzero(q_len * longest + slack >= limit)
            if not len(alive):
                continue  # what follows in the same file is shorter still
            ids, x = part["vec_id"].to_numpy(), _matrix(part["v"], d)
            turned = x.astype(float) @ turn
            x_rest = np.sqrt((turned[:, head:] ** 2).sum(1))
            for a in range(0, len(alive), 256):
                some = alive[a : a + 256]
                most = q_head[some] @ turned[:, :head].T + q_rest[some][:, None] * x_rest + slack[some][:, None]
                i, j = np.nonzero(most >= limit[some][:, None])
                i = some[i]
                other = q_ids[i] != ids[j]
                i, j = i[other], j[other]
                for s in range(0, len(i), 500_000):
                    ii, jj = i[s : s + 500_000], j[s : s + 500_000]
                    scores = np.einsum("ij,ij->i", q[ii], x[jj])
                    best = _best(k, np.concatenate([best[0], ii]), np.concatenate([best[1], ids[jj]]), np.concatenate([best[2], scores]))
            limit = _thresholds(k, len(q), best[0], best[2], limit)
        if len(best[0]):
            yield pd.DataFrame({"query_id": q_ids[best[0]], "vec_id": best[1], "score": best[2]})

    return rows.mapInPandas(run, _FOUND)
