"""Substring deduplication (operator 1).

A log-structured index of window fingerprints: each batch of documents becomes a sorted
immutable run, is merge-joined with the runs of earlier batches, verified, and the runs are
compacted. Runs are dealt and sorted by anchor, so they meet without an exchange.

What a run holds. A window is WINDOW consecutive words; its anchor is the least hash among its
shingles of ANCHOR words. Equal windows have equal anchors, and neighbouring windows mostly share
theirs, so a document falls into segments, maximal stretches of windows with one anchor, about
one for every twenty windows. A run has one row for each different segment: anchor, 128 bits of BLAKE2b of the
segment's words, its number of windows, and the first document that holds it. Nothing is
sampled: a window that also starts in an earlier document is found in one of two ways.

  1. Its whole segment also stands in an earlier document: one equality join on the segment.
  2. Its anchor has several different segments. Then the first document of each is read again
     and the words of its windows are compared, by digests of 128 bits (the verification).

An anchor is a candidate's key alone; words are compared by a cryptographic digest of their
bytes in both ways. Copies are one row of a run, however many there are; way 2 reads only first
documents, so no group is ever gathered and no pairs within a group are made. Rows of a segment or
window that very many documents hold are not dealt by it (common.spread).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 50
ANCHOR = 10
#: Batches that a whole table is taken in, by ranges of doc_id, and runs of one level that are merged into one of the next.
BATCHES = 2
FANOUT = 2
_KEY = ("m", "s1", "s2", "n")
_RUN = "m long, s1 long, s2 long, n int, doc long, t long, start int"
_MANIFEST = "name string, level int, files int, made int, newest long, window int, anchor int"
_SEGMENTS = "m long, s1 long, s2 long, n int, doc long, t long, start int"


def _least(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries, by doubling."""
    span, out = 1, g
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _windows(first: np.ndarray, window: int) -> np.ndarray:
    """Where the windows of each text begin, among the words of a block."""
    n = np.diff(first)
    return np.concatenate([np.arange(a, a + c - window + 1) for a, c in zip(first[:-1], n) if c >= window] or [np.zeros(0, np.int64)])


def _cut(texts: list[str | None], window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Segments of a block: text number, first window (within the text), number of windows, anchor and digest."""
    h, first, data, *_ = common.word_hashes(texts)
    at = _windows(first, window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    m = _least(common.rolling(h, anchor), window - anchor + 1)[at]
    text = np.searchsorted(first, at, side="right") - 1
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (text[1:] != text[:-1])])
    begin = np.flatnonzero(new)
    n = np.diff(np.concatenate([begin, [len(at)]]))
    start, text = at[begin], text[begin]
    end = start + n + window - 1
    return text, start - first[text], n, m[begin], common.Sequences(data).digests(start, end)


def segments(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All segments of the documents that have a doc_id; t tells apart rows that share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in common.blocks(batch.column(2), 2_000_000):
                text, start, n, m, s = _cut(texts, window, anchor)
                if len(text):
                    doc, t = (batch.column(k).slice(at, len(texts)).take(pa.array(text)) for k in (0, 1))
                    arrays = [pa.array(m.view(np.int64)), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(n.astype(np.int32)), doc, t, pa.array(start.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["m", "s1", "s2", "n", "doc", "t", "start"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "t", "text").mapInArrow(run, _SEGMENTS)


def _firsts(rows: DataFrame) -> DataFrame:
    """One row for each different segment, with the first document that holds it (smallest doc_id)."""
    first = F.min(F.struct("doc", "t", "start")).alias("f")
    return rows.groupBy(*_KEY).agg(first).select(*_KEY, "f.*")


class Index:
    """Runs of segments seen so far. Batches come in ascending order of doc_id.

    ingest() takes a batch's segments and returns (covered, doubtful): segments of the batch
    that an earlier document holds as a whole, and the segments, new and old, whose windows
    must be compared (verified()). Runs are never changed, only merged into new ones, as soon as
    the next batch comes.

    An index that lasts: open() reads the runs of earlier sessions from a folder, commit() makes
    the runs of this one part of it. A manifest names the runs that count and is written as a new
    file, so a session that ends before its commit leaves the index as it was; files of runs that
    were merged go after the commit.
    """

    def __init__(self, scratch: common.Scratch, fanout: int = FANOUT, lasting: common.Scratch | None = None):
        self.scratch, self.fanout, self.lasting = scratch, fanout, lasting
        self.runs: list[tuple[int, str, DataFrame]] = []  # level, name, reader
        self.files: dict[str, int] = {}  # into how many files each run is dealt
        self.stale: list[str] = []
        self.made = self.version = 0
        self.newest: int | None = None  # greatest doc_id that it holds

    @classmethod
    def open(cls, scratch: common.Scratch, folder: str, window: int, anchor: int, fanout: int = FANOUT) -> Index:
        """The index in this folder, a new one where there is none."""
        index = cls(scratch, fanout, common.Scratch.at(scratch.spark, folder))
        index.shape = (window, anchor)
        index.version = max((int(n.removeprefix("manifest")) for n in index.lasting.names() if re.fullmatch(r"manifest\d+", n)), default=0)
        if not index.version:
            return index
        rows = index.lasting.spark.read.schema(_MANIFEST).json(index.lasting.path(f"manifest{index.version}")).collect()
        if {(r.window, r.anchor) for r in rows} != {index.shape}:
            raise ValueError(f"the index in {folder} is of other windows")
        index.newest, index.made = rows[0].newest, rows[0].made
        for r in rows:
            index.files[r.name] = r.files
            index.runs.append((r.level, r.name, index.lasting.reopened(r.name, _RUN, r.files, "m")))
        return index

    def commit(self, newest: int) -> None:
        """From now on these runs are the index; newest: the greatest doc_id in them."""
        rows = [(name, level, self.files[name], self.made, newest, *self.shape) for level, name, _ in self.runs]
        before, self.version, self.newest = self.version, self.version + 1, newest
        self.lasting.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(self.lasting.path(f"manifest{self.version}"))
        self.lasting.drop(*self.stale, *([f"manifest{before}"] if before else []))
        self.stale.clear()

    def _run(self, rows: DataFrame, level: int) -> DataFrame:
        name = f"run{self.made}"
        self.made += 1
        out = self.place.dealt(rows, name, "m")
        self.files[name] = common.partitions(self.place.spark)
        self.runs.append((level, name, out))
        return out

    @property
    def place(self) -> common.Scratch:
        return self.lasting or self.scratch

    def read(self, name: str) -> DataFrame:
        """A run's rows as they lie in its files. In a union, readers that promise how rows are dealt are not safe: the planner may rely on it and drop it."""
        return self.place.spark.read.schema(_RUN).parquet(self.place.path(name))

    def ingest(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        self.compact()
        old = [r for *_, r in self.runs]
        known = new = self._run(_firsts(batch), 0)
        tag = f"batch{self.made}"
        if old:
            # each old run meets the new one by anchor; an old row of a segment stands before any new one, as its doc_id is smaller
            past = [r.join(new.select("m").distinct().hint("merge"), "m", "left_semi") for r in old]
            known = self.scratch.dealt(_firsts(_union([*past, self.read(self.runs[-1][1])])), f"{tag}-known", "m")
        several = known.groupBy("m").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("m")
        doubtful = known.join(several.hint("merge"), "m", "left_semi").select("doc", "t", "start", "n")
        f = known.select(*_KEY, F.col("doc").alias("fdoc"), F.col("t").alias("ft"), F.col("start").alias("fstart"))
        # a first document may hold a segment more than once: its other places are as doubtful as the first
        held = common.spread(batch, f, list(_KEY), common.hot_keys(batch, list(_KEY))).where("fdoc < doc or (fdoc = doc and (ft <> t or fstart <> start))")
        held = self.scratch.save(held.select("doc", "t", "start", "n", (F.col("fdoc") < F.col("doc")).alias("sure")), f"{tag}-held")
        doubtful = self.scratch.save(doubtful.unionAll(held.where("not sure").select("doc", "t", "start", "n")), f"{tag}-doubtful")
        if old:
            self.scratch.drop(f"{tag}-known")
        return held.where("sure").select("doc", "t", "start", "n"), doubtful

    def compact(self) -> None:
        """Merge the runs of a level where there are enough of them."""
        level = 0
        while len(some := [r for r in self.runs if r[0] == level]) >= self.fanout:
            self.runs = [r for r in self.runs if r[0] != level]
            self._run(_firsts(_union([self.read(name) for _, name, _ in some])), level + 1)
            names = [name for _, name, _ in some]
            if self.lasting:
                self.stale += names  # the last manifest still names them
            else:
                self.scratch.drop(*names)
            level += 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "t").agg(F.collect_list(F.struct("start", "n")).alias("parts"))


def verified(docs: DataFrame, doubtful: DataFrame, window: int = WINDOW, scratch: common.Scratch | None = None) -> DataFrame:
    """Windows of doubtful segments that an earlier document among them also has: doc, t, start, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(3).is_valid())
            for at, texts in common.blocks(batch.column(2), 2_000_000):
                _, first, data, *_ = common.word_hashes(texts)
                parts = batch.column(3).slice(at, len(texts))
                flat = parts.flatten()
                if not len(flat):
                    continue
                owner = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
                starts, n = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(starts, n) + within
                owner = np.repeat(owner, n)
                spot = first[owner] + place
                doc, t = (batch.column(k).slice(at, len(texts)).take(pa.array(owner)) for k in (0, 1))
                w = common.Sequences(data).digests(spot, spot + window)
                arrays = [pa.array(w[:, 0]), pa.array(w[:, 1]), doc, t, pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["w1", "w2", "doc", "t", "start"])

    scratch = common.Scratch(docs.sparkSession, "windows") if scratch is None else scratch
    listed = _joined(docs, doubtful.distinct(), "inner")
    rows = scratch.save(listed.mapInArrow(run, "w1 long, w2 long, doc long, t long, start int"), "windows")
    least = rows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("w1", "w2", "least")
    found = common.spread(rows, least, ["w1", "w2"], common.hot_keys(rows, ["w1", "w2"]))
    return found.where("least < doc").select("doc", "t", "start", F.lit(1).alias("n"))


def _joined(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """doc_id, t, text of documents that have a doc_id, with the list of (start, n)."""
    lists = _by_document(rows).select(F.col("doc").alias("d"), F.col("t").alias("dt"), "parts").hint("merge")
    return docs.where("doc_id is not null").join(lists, (F.col("doc_id") == F.col("d")) & (F.col("t") == F.col("dt")), how).select("doc_id", "t", "text", "parts")


def _texts(docs: DataFrame) -> DataFrame:
    return common.take(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("t"), "text")


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES, texts: bool = False, index: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document; texts: also kept, the words that stay.

    Words are runs of anything but ASCII white space, as they are. Removed is each word covered by
    a window whose words, in order, also start in a document with a smaller doc_id; kept words are
    joined by one space. A null text has no words; a null doc_id is smaller than none and
    loses nothing; rows that share a doc_id do not count against each other, and equal rows have
    equal results; texts of fewer words than a window lose nothing. An empty table gives no
    rows. Other columns are not read.

    index: a folder with the runs of earlier calls, which docs are held against and become part
    of, and history: the documents of those calls, of which those with doubtful windows are read.
    Each doc_id must be greater than all of the earlier calls; else, as when a batch that is part of the
    index comes again, a ValueError tells so and the index stays as it was. One call at a time may write an index.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "substrings")
    docs = _texts(docs)
    found = scratch.save(segments(docs, window, anchor), "segments")
    cuts = found.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    runs, covered, doubtful = Index(scratch) if index is None else Index.open(scratch, index, window, anchor), [], []
    oldest, newest = docs.agg(F.min("doc_id"), F.max("doc_id")).first() if index is not None else (None, None)
    if runs.newest is not None:
        if history is None:
            raise ValueError("the index holds documents: history must give their texts")
        if oldest is not None and oldest <= runs.newest:
            raise ValueError(f"doc_id {oldest} does not come after {runs.newest}, which the index holds")
    for low, high in zip(bounds, bounds[1:]):
        part = found if low is None else found.where(F.col("doc") > low)
        part = part if high is None else part.where(F.col("doc") <= high)
        sure, open_ = runs.ingest(part)
        covered.append(sure)
        doubtful.append(open_)
    known = docs if history is None else docs.unionAll(_texts(history))
    covered = scratch.save(_union([*covered, verified(known, _union(doubtful), window, scratch)]), "covered")
    if newest is not None:
        runs.commit(newest)
    scratch.clear("covered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in common.blocks(batch.column(2)):
                rows = []
                for text, parts in zip(block, batch.column(3).slice(at, len(block)).to_pylist()):
                    words = (text or "").encode().split()
                    kept = words
                    if parts:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for p in parts:
                            edge[p["start"]] += 1
                            edge[p["start"] + p["n"] + window - 1] -= 1
                        kept = [w for w, c in zip(words, np.cumsum(edge)) if not c]
                    whole = b" ".join(kept)
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode() if texts else None))
                n, removed, digest, kept_text = zip(*rows)
                arrays = [batch.column(0).slice(at, len(block)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    nowhere = docs.where("doc_id is null").select("doc_id", "t", "text", F.lit(None).cast("array<struct<start:int,n:int>>").alias("parts"))
    out = _joined(docs, covered, "left").unionAll(nowhere).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if texts else out.drop("kept")
