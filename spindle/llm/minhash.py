"""MinHash near-deduplication (operator 2).

ProbMinHash: the shingles of a text, weighted by their counts, are Poisson processes whose rates are
their weights; an arrival goes to a register chosen at random, each register keeps the shingle that
arrived first, and a shingle's process ends as soon as its next arrival is later than every
register's first. Two texts agree in a register with the probability Jaccard similarity of
their weighted shingles (the usual Jaccard where no shingle repeats).

Registers are banded. Documents that share a band value are a bucket, and buckets with the same
smallest document make one group. Verification compares documents of a group by their exact
similarity, but makes no pairs: texts of equal words are one node from the start (their digests are
128 bits of BLAKE2b of the words themselves); a group's smallest document
is held against all its others; components are found; and then, round by round, some
documents outside a group's largest component are held against those in other components, until
every two documents of different components have been compared. So no link is lost. A
comparison keeps the shingles of a bounded number of documents as an inverted index while the others
stream past, in tasks of bounded size, and puts out links alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
#: Documents that a group holds against its others in one round.
CENTRES = 256
#: Documents that stream past in one piece of a group.
PIECE = 512
#: Rows of numbers that one task takes in the steps between comparisons.
ROWS_A_TASK = 50_000

_NODES = "doc long, c1 long, c2 long, bands array<long>"


def shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the distinct shingles of a block's texts, in order of text, then hash.

    A text of fewer than k words, but some, has all of them as its one shingle.
    """
    n = np.diff(first)
    g = common.rolling(h, k)
    at = np.concatenate([np.arange(a, a + c - k + 1) for a, c in zip(first[:-1], n) if c >= k] or [np.zeros(0, np.int64)]).astype(np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    text = np.concatenate([np.searchsorted(first, at, side="right") - 1, short])
    value = np.concatenate([g[at], common.spans(h, first[short], first[short + 1])])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])) if len(text) else np.zeros(0, np.int64)
    return text[new], value[new], np.diff(np.concatenate([new, [len(text)]]))


def probminhash(text: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers: which shingle arrived first. Works round by round on all texts' shingles that are still running."""
    first = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    running, x = np.arange(len(text)), np.zeros(len(text))
    step = 0
    while len(running):
        step += 1
        random = common.mix(value[running] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        uniform = ((random >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
        x[running] -= np.log(uniform) / weight[running]
        register = (common.mix(random ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        slot = text[running] * registers + register
        better = np.flatnonzero(x[running] < first[slot])
        better = better[np.argsort(-x[running[better]], kind="stable")]  # of several for one slot, the earliest is written last
        first[slot[better]] = x[running[better]]
        held[slot[better]] = value[running[better]]
        latest = first.reshape(n, registers).max(axis=1)
        running = running[x[running] < latest[text[running]]]
    return held.reshape(n, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets, each (sorted values, weights)."""
    every = np.union1d(a[0], b[0])
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    ratio = np.divide(y, x, out=np.full(len(x), np.inf), where=x > 0)
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    below = np.cumsum(x[order])
    above = y.sum() - np.cumsum(y[order])
    last = np.searchsorted(r, r, side="right") - 1  # ties count as below
    total = below[last] / np.where(x[order] > 0, x[order], 1) + above[last] / np.where(y[order] > 0, y[order], 1)
    return float((1 / total[both[order]]).sum())


def nodes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """doc, c1, c2 (digest of the word sequence) and bands of every document with a doc_id; null hashes where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in common.blocks(batch.column(1), 1_000_000):
                h, first, data, *_ = common.word_hashes(texts)
                some = np.diff(first) > 0
                c = np.zeros((len(texts), 2), np.int64)
                if some.any():
                    c[some] = common.Sequences(data).digests(first[:-1][some], first[1:][some])
                text, value, count = shingles(h, first, k)
                held = probminhash(text, value, count.astype(float), len(texts), bands * rows)
                keys = np.zeros((len(texts), bands), np.uint64)
                for j in range(rows):
                    keys = common.mix(keys + held.reshape(len(texts), bands, rows)[:, :, j] + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                arrays = [batch.column(0).slice(at, len(texts)), pa.array(c[:, 0], mask=~some), pa.array(c[:, 1], mask=~some), listed]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "c1", "c2", "bands"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, _NODES)


class _Held:
    """Documents held in memory, as an inverted index from shingle to document."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.rows = rows
        values = np.concatenate([r[2] for r in rows])
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.owner = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])[order]
        self.share = np.concatenate([r[3] / r[3].sum() for r in rows])[order]
        self.size = np.array([len(r[2]) for r in rows])
        self.single = np.array([r[3].max() == 1 for r in rows])
        self.comp = np.array([r[1] for r in rows])
        self.met: set[tuple[int, int]] = set()

    def links(self, node: int, comp: int, value: np.ndarray, count: np.ndarray, least: float) -> list[tuple[int, int]]:
        """Links from held documents of other components to this one; of each held document, one to each component."""
        low, high = np.searchsorted(self.values, value), np.searchsorted(self.values, value, side="right")
        n = high - low
        if not n.any():
            return []
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = self.owner[at]
        # similarity is at most the mass that two documents share
        shared = np.bincount(owner, np.minimum(self.share[at], np.repeat(count / count.sum(), n)), len(self.rows))
        near = np.flatnonzero((shared >= least - 1e-9) & (self.comp != comp))
        if not len(near):
            return []
        common_ = np.bincount(owner, minlength=len(self.rows))
        out = []
        for i in near:
            if (i, comp) in self.met:
                continue
            if self.single[i] and count.max() == 1:
                value_ = common_[i] / (self.size[i] + len(value) - common_[i])
            else:
                value_ = similarity(self.rows[i][2:], (value, count))
            if value_ >= least - 1e-9:
                self.met.add((i, comp))
                out.append((self.rows[i][0], node))
        return out


def linked(centres: DataFrame, members: DataFrame, texts: DataFrame, least: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """Links (a, b) between centres and members (g, node, comp) of the same group g and different components.

    A group streams past its centres in pieces of about PIECE members, each with its own copy of the
    centres, of which a round has at most CENTRES.
    """
    spark = texts.sparkSession
    pieces = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    t = texts.select(F.col("doc_id").alias("own"), "text")
    salted = members.join(pieces, "g").select("g", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("salt"), F.lit(1).alias("role"), "node", "comp")
    every = centres.join(pieces, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("salt"), F.lit(0).alias("role"), "node", "comp")
    rows = salted.unionAll(every).join(t, F.col("node") == F.col("own")).select("g", "salt", "role", "node", "comp", "text")
    rows = rows.repartition(common.partitions(spark), "g", "salt").sortWithinPartitions("g", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, held = None, [], None
        for batch in batches:
            g, salt, role, node, comp = (batch.column(i).to_pylist() for i in range(5))
            out: list[tuple[int, int]] = []
            for at, block in common.blocks(batch.column(5), 1_000_000):
                h, first, *_ = common.word_hashes(block)
                text, value, count = shingles(h, first, k)
                bounds = np.searchsorted(text, np.arange(len(block) + 1))
                for i in range(len(block)):
                    j, mine = at + i, slice(bounds[i], bounds[i + 1])
                    if key != (g[j], salt[j]):
                        key, waiting, held = (g[j], salt[j]), [], None
                    if role[j] == 0:
                        waiting.append((node[j], comp[j], value[mine].copy(), count[mine].copy()))
                    elif waiting:
                        held = held or _Held(waiting)
                        out += held.links(node[j], comp[j], value[mine], count[mine], least)
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, k: int = SHINGLE) -> DataFrame:
    """doc_id and class_id of every row; a class is a connected component of documents of similarity `least` or more.

    class_id is the smallest doc_id of the class. Equal word sequences are in one class. A document
    without words (null, empty, white space alone) is a class of its own; a null doc_id has a
    null class; rows that share a doc_id are in one class. An empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    scratch = common.Scratch(docs.sparkSession, "minhash")
    docs = common.take(docs, doc_id="long", text="string")
    if not _repeats(docs.where("doc_id is not null"), "doc_id"):
        return _classes(docs, scratch, least, bands, rows, k)
    # each of a doc_id's different texts is compared under a number of its own, and all are tied at the end
    text = F.coalesce("text", F.lit(""))
    several = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("several")).agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low <> high").select("several")
    told = docs.where("doc_id is not null").select("doc_id", text.alias("text")).distinct().join(several, F.col("doc_id") == F.col("several"), "left")
    seed = 0
    while True:
        own = F.when(F.col("several").isNull(), F.col("doc_id")).otherwise(F.xxhash64(F.lit(seed), "doc_id", "text"))
        keyed = scratch.save(told.select("doc_id", own.alias("own"), "text"), f"keyed{seed}")
        if not _repeats(keyed, "own"):
            break
        seed += 1  # a number that is taken
    found = _classes(keyed.select(F.col("own").alias("doc_id"), "text"), scratch, least, bands, rows, k).select(F.col("doc_id").alias("o"), "class_id")
    held = scratch.save(keyed.select("doc_id", "own").join(found, F.col("own") == F.col("o")).select("doc_id", "class_id"), "held")
    smallest = held.groupBy(F.col("class_id").alias("c")).agg(F.min("doc_id").alias("b"))
    ties = held.join(smallest, F.col("class_id") == F.col("c")).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    parts = components(ties, scratch, "ties").select(F.col("node").alias("n"), "comp")
    out = docs.select("doc_id").join(parts, F.col("doc_id") == F.col("n"), "left")
    return out.select("doc_id", F.coalesce("comp", "doc_id").alias("class_id"))


def _classes(docs: DataFrame, scratch: common.Scratch, least: float, bands: int, rows: int, k: int) -> DataFrame:
    """classes(), of rows of different doc_ids, null ones aside."""
    every = scratch.save(nodes(docs, bands, rows, k), "nodes")
    # one node for all documents of the same words
    copies = every.where("c1 is not null")
    reps = scratch.save(copies.groupBy("c1", "c2").agg(F.min(F.struct("doc", "bands")).alias("f")).select("c1", "c2", F.col("f.doc").alias("node"), "f.bands"), "reps")
    band = scratch.save(reps.select("node", F.explode(F.array_distinct("bands")).alias("band")), "bands")
    busy = scratch.save(band.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "busy")
    hot = busy.where(F.col("rows") > common.HOT_ROWS).where(F.col("rows") > band.count() / common.HOT_KEYS).select("band").collect()
    hot = docs.sparkSession.createDataFrame(hot, "band long") if hot else None
    # a group: all documents that share a bucket with its smallest
    group = common.spread(band, busy.select("band", "centre"), ["band"], hot)
    group = scratch.save(group.select(F.col("centre").alias("g"), "node").distinct(), "groups")
    scratch.drop("bands", "busy")
    # one plan at every size: what is small here is large elsewhere
    involved = group.select(F.col("node").alias("doc_id")).distinct().hint("merge")
    texts = scratch.save(docs.join(involved, "doc_id").select("doc_id", "text"), "texts")
    alone = group.select("g", "node", F.col("node").alias("comp"))
    edges = scratch.save(linked(alone.where("g = node"), alone.where("g <> node"), texts, least, k), "links0")
    parts = components(edges, scratch, "parts0")
    # a group's rows are numbers only; steps on them need tasks by their count
    few = common.tasks(docs.sparkSession, group.count(), ROWS_A_TASK)
    group = group.coalesce(few)
    asked = group.where("g = node")  # what has been held against its whole group
    round_ = 0
    while True:
        round_ += 1
        label = parts.select(F.col("node").alias("n"), "comp")
        members = group.join(label.coalesce(few), F.col("node") == F.col("n"), "left").select("g", "node", F.coalesce("comp", "node").alias("comp")).coalesce(few)
        members = scratch.save(members, f"members{round_}").coalesce(few)
        waiting = members.join(asked.coalesce(few), ["g", "node"], "left_anti").coalesce(few)
        home = waiting.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max_by("comp", F.struct("c", -F.col("comp"))).alias("home"))
        rest = waiting.join(home, "g").where("comp <> home")
        next_ = rest.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("node"))).where(F.col("r") <= CENTRES).select("g", "node", "comp")
        next_ = scratch.save(next_.coalesce(few), f"centres{round_}").coalesce(few)
        if next_.isEmpty():
            break
        # the other groups have nothing left to compare, and components only grow together
        open_ = scratch.save(members.join(next_.select("g").distinct(), "g", "left_semi").coalesce(few), f"open{round_}")
        group = open_.select("g", "node").coalesce(few)
        more = scratch.save(linked(next_, open_, texts, least, k), f"links{round_}")
        scratch.drop(f"members{round_}", f"links{round_ - 1}")
        asked = scratch.save(asked.coalesce(few).unionAll(next_.select("g", "node")), f"asked{round_}")
        if not more.isEmpty():
            tied = parts.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
            parts = components(tied.unionAll(more), scratch, f"parts{round_}")
    label = parts.select(F.col("node").alias("n"), "comp")
    label = reps.select("c1", "c2", "node").join(label, F.col("node") == F.col("n"), "left").select("c1", "c2", F.coalesce("comp", "node").alias("class_id"))
    label = scratch.save(label, "labels")
    found = common.spread(copies.select("c1", "c2", "doc"), label, ["c1", "c2"], common.hot_keys(copies, ["c1", "c2"])).select(F.col("doc").alias("doc_id"), "class_id")
    found = found.unionAll(every.where("c1 is null").select("doc", F.col("doc").alias("class_id")))
    found = scratch.save(found, "classes")
    scratch.clear("classes", "keyed0", "keyed1")
    nowhere = docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return found.unionAll(nowhere)


def _repeats(every: DataFrame, key: str) -> bool:
    """Whether any key stands in several rows."""
    return not every.groupBy(key).count().where("count > 1").isEmpty()


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class, that of the class's smallest doc_id; rows without doc_id all stay.

    Where that doc_id stands in several rows, the row stays whose text, and then whose columns' hash, is smallest. Rows are
    dealt by doc_id once; the search for classes and the selection both work on that table.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "minhash-kept")
    rows, key, text = common.plain(docs), F.col(f"c{common.place(docs, 'doc_id')}").cast("long"), F.col(f"c{common.place(docs, 'text')}").cast("string")
    names = rows.columns
    table = scratch.dealt(rows.where(key.isNotNull()).withColumn("k", key), "rows", "k")
    found = classes(table.select(F.col("k").alias("doc_id"), text.alias("text")), **how)
    chosen = scratch.save(found.where("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "chosen")
    kept = table.join(chosen.hint("merge"), F.col("k") == F.col("doc_id"))
    if not chosen.where("rows > 1").isEmpty():
        first = Window.partitionBy("k").orderBy(text.asc_nulls_first(), F.xxhash64(*names))
        kept = kept.withColumn("n", F.row_number().over(first)).where("n = 1")
    return kept.select(*names).unionAll(rows.where(key.isNull())).toDF(*docs.columns)
