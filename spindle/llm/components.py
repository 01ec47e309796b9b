"""Connected components of a graph given by its edges, without gathering any of them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

EDGES = 50_000


def components(edges: DataFrame, scratch: common.Scratch, tag: str) -> DataFrame:
    """node, comp (its component's smallest node) of every node that has an edge (a, b).

    Alternates two steps until nothing changes (large-star and small-star): each node's larger
    neighbours, then its smaller ones, are tied to the smallest node known there. The number
    of rounds grows with the logarithm of the graph's size; minima are taken before the
    shuffle, and neighbours of a node that has very many are not dealt by it, so it costs no task more than its share. Each step has
    as many tasks as EDGES edges a task call for.
    """
    now = scratch.save(edges.select("a", "b").where("a <> b").distinct(), f"{tag}-0")
    before, round_, tasks = None, 0, 1
    while True:
        facts = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if facts == before or not facts[0]:
            break
        before = facts
        tasks = common.tasks(scratch.spark, facts[0], EDGES)
        now = now.coalesce(tasks)
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).coalesce(tasks)
        larger = both.where("b > a")
        wide = common.spread(larger, least, ["a"], common.hot_keys(larger, ["a"]) if facts[0] > common.HOT_ROWS else None).select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.where("m < a").select("a", F.col("m").alias("b"))
        large = wide.unionAll(own).where("a <> b").coalesce(tasks).distinct().coalesce(tasks)
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks)
        small = low.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        round_ += 1
        now = scratch.save(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(tasks).distinct().coalesce(tasks), f"{tag}-{round_}")
        scratch.drop(f"{tag}-{round_ - 1}")
    # every node now hangs on its component's smallest
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
