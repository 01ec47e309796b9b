"""Pieces that several operators share: scratch tables, joins with hot keys, words and their hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII white space below. bytes.split() splits at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"


#: A key counts as hot that holds more than this share of the rows (and HOT_ROWS); there are at most so many of them, whatever the table.
HOT_KEYS = 1000
HOT_ROWS = 500


class Scratch:
    """Parquet tables in the folder that driver and executors share (spark.checkpoint.dir).

    Tables cut lineage: a lost executor costs a re-read, not a recomputation. The folder is
    the session's own; drop() removes a table as soon as nothing reads it any more. Where no folder
    is set, one is made on this machine, but only in a session that runs on this machine alone.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
            if found.isEmpty():
                if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
                spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spindle-checkpoint-"))
                found = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = found.get()
        self.root = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> Scratch:
        """Tables that last, in a folder of yours; driver and executors must share it."""
        out = cls.__new__(cls)
        out.spark, out.root = spark, folder.rstrip("/")
        return out

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return a reader of it."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def dealt(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        """As save(), dealt by keys into as many files as a shuffle has partitions: joins and groups on these keys need no exchange of it."""
        table, n = f"spindle_{uuid.uuid4().hex}", partitions(self.spark)
        df.repartition(n, *keys).write.format("parquet").mode("overwrite").bucketBy(n, *keys).sortBy(*keys).option("path", self.path(name)).saveAsTable(table)
        return self._unnamed(table)

    def _unnamed(self, table: str) -> DataFrame:
        out = self.spark.table(table)
        out.schema  # resolved; the name is not needed any more, and the files stay, as their place was given
        self.spark.sql(f"drop table {table}")
        return out

    def reopened(self, name: str, schema: str, n: int, *keys: str) -> DataFrame:
        """What dealt() wrote into n files in another session, known to be dealt and sorted as it is."""
        table, by = f"spindle_{uuid.uuid4().hex}", ", ".join(keys)
        where = self.path(name).replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"create table {table} ({schema}) using parquet clustered by ({by}) sorted by ({by}) into {n} buckets location '{where}'")
        return self._unnamed(table)

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def drop(self, *names: str) -> None:
        files, _ = self._files()
        for name in names:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)

    def names(self) -> list[str]:
        """The tables that are there, written to their end."""
        files, root = self._files()
        found = [f.getPath() for f in files.listStatus(root)] if files.exists(root) else []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return [p.getName() for p in found if files.exists(done(p, "_SUCCESS"))]

    def clear(self, *keep: str) -> None:
        """Drop all tables but these."""
        files, root = self._files()
        if files.exists(root):
            self.drop(*[name for f in files.listStatus(root) if (name := f.getPath().getName()) not in keep])


def place(df: DataFrame, name: str) -> int:
    """Which column has this name: exactly, or else but for case."""
    exact = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact:
        raise ValueError(f"there is no column {name}; there are {', '.join(df.columns)}")
    return exact[0]


def plain(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: names that differ in case alone, hold dots or are used twice then cannot be confused."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def take(df: DataFrame, **kinds: str) -> DataFrame:
    """These columns alone, of these types: further ones, whatever their names, can then clash with nothing."""
    at = {name: place(df, name) for name in kinds}
    return plain(df).select(*[F.col(f"c{at[name]}").cast(kind).alias(name) for name, kind in kinds.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """As many tasks as rows call for, at most as many as a shuffle has."""
    return max(1, min(partitions(spark), -(-rows // each)))


def hot_keys(rows: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys that hold more than their share of rows; None where there are none. Their number is bounded by HOT_KEYS."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT_ROWS)
    found = counts.where(F.col("rows") > rows.count() / HOT_KEYS).select(*keys)
    got = found.collect()
    return rows.sparkSession.createDataFrame(got, found.schema) if got else None


def spread(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join of many with one, which has a row for each key.

    Rows of hot keys stay where they are and meet the at most HOT_KEYS rows of one that are
    sent to all; the rest is dealt by key, and no key has more of it than a small share.
    """
    merged = lambda rows: rows.join(one.hint("merge"), keys)
    if hot is None:
        return merged(many)
    few = F.broadcast(one.join(F.broadcast(hot), keys))
    return merged(many.join(F.broadcast(hot), keys, "left_anti")).unionByName(many.join(few, keys))


# --- hashing --------------------------------------------------------------------------------

_WORD_BASE = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public-domain splitmix64 generator: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand; base is odd, so it has an inverse."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_WORDS = Powers(_WORD_BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Hashes(dict):
    """64 bits of BLAKE2b of a word's bytes; bounded, past its bound it starts afresh."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.MOST:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_HASHES = _Hashes()


def _raw(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Of a block of texts: a 64-bit hash for each word, where each text's words begin, the bytes, each word's start and end."""
    raw = _raw(texts)
    data = b" ".join(raw) + b" "
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths + 1)]))
    return _HASHES.of(data.split()), first, data, starts, ends


def digests(parts: Iterable[bytes]) -> np.ndarray:
    """n x 2 numbers: 128 bits of BLAKE2b of each part. Equal digests stand for equal parts: nobody knows how to make two parts that share one."""
    return np.frombuffer(b"".join([blake2b(p, digest_size=16).digest() for p in parts]), "<i8").reshape(-1, 2)


class Sequences:
    """Digests of stretches of the words of a block, each as its words joined by one space."""

    def __init__(self, data: bytes):
        words = data.split()
        self.joined = b" ".join(words)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        self.starts = np.concatenate([[0], self.ends + 1])

    def digests(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return digests(self.joined[a:b] for a, b in zip(self.starts[starts].tolist(), self.ends[ends - 1].tolist()))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries of h, which are hashes themselves, in order; empty when there are fewer than k."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    n = len(h) - k + 1
    return mix((sums[k:] - sums[:n]) * down[:n])


def spans(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the entries from each start to each end (exclusive), of any lengths."""
    up, down = _WORDS.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def blocks(column, most: int = 4_000_000):
    """Slices of an Arrow text column of at most so many bytes (one longer text stands alone), as (first row, texts)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        to = at + 1
        total = sizes[at]
        while to < len(sizes) and total + sizes[to] <= most:
            total += sizes[to]
            to += 1
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def trimmed(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))
