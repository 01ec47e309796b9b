"""Best-fit packing of token sequences (operator 4).

Bounded-space online best-fit: a fixed number of open bins, found through one big integer
whose bit f is set while a bin with f free tokens is open. The best fit for a piece of n
tokens is the lowest set bit at n or above, two machine-word scans. When too many bins are
open, the fullest (lowest set bit of all) closes.

Packing runs inside the scan's own tasks, with no shuffle: a task's memory is its open bins
and one block of pieces, whatever the table's size, and a task that is run again gives the
same rows. A block's pieces arrive longest first, which leaves little to waste; each task
leaves at most its last few sequences part-filled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

CAPACITY = 2048
OPEN_BINS = 4096
BLOCK = 16384
TOKENIZER = "byte_bpe_50k"

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

#: Where only these two characters are white space, a text can be cut before any of their runs and each part be encoded alone.
_PART = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
_OTHER_SPACE = re.compile(r"[^\S \n]")


class Tokens(dict):
    """Token ids of a text as little-endian unsigned 32-bit, through a cache from word (with the white space before it) to ids.

    The cache is bounded; past its bound it starts afresh.
    """

    MOST = 400_000

    def __init__(self, name: str = TOKENIZER):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        super().__init__()
        self.encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            self.added = {t["content"]: int(t["id"]).to_bytes(4, "little") for t in json.load(f)["added_tokens"]}
        self.cuts = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        found = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(part) < 64:
            self[part] = found
        return found

    def ids(self, text: str) -> bytes:
        if len(self) > self.MOST:
            self.clear()
        if _OTHER_SPACE.search(text):
            return b"".join([i.to_bytes(4, "little") for i in self.encode(text)])
        return b"".join(map(self.__getitem__, _PART.findall(text)))

    def whole(self, text: str) -> bytes:
        """ids(), but the tokenizer's added tokens, where they stand in the text, are one id each, as in the tokenizers library."""
        out, at = [], 0
        for m in self.cuts.finditer(text):
            out += [self.ids(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self.ids(text[at:])])


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only a longer one is cut; the first piece takes the odd rest."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


class BestFit:
    """Places pieces one by one; place() gives (bin number, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits = self.open = self.made = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.capacity:
            raise ValueError(f"a piece of {n} tokens does not fit in {self.capacity}")
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        rest = free - n
        if rest:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[rest].append(number)
            self.bits |= 1 << rest
            self.open += 1
        return number, self.capacity - free


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty and is its end token alone; a null doc_id stays null; repeated
    rows are packed each for itself; an empty table gives no rows. Columns other than doc_id
    and text are not read. Sequence numbers are the task's number times 2**40 plus a counter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, bins = Tokens(tokenizer), BestFit(capacity, open_bins)
        base, end = TaskContext.get().partitionId() << 40, end_id.to_bytes(4, "little")
        waiting: list[tuple] = []

        def placed() -> pa.RecordBatch:
            waiting.sort(key=lambda p: -p[3])
            rows = [(*p, base + number, offset) for p in waiting for number, offset in [bins.place(p[3])]]
            waiting.clear()
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            ids = batch.column(0)
            for at, texts in common.blocks(batch.column(1)):
                for doc_id, text in zip(ids.slice(at, len(texts)).to_pylist(), texts):
                    found = tokens.whole(text or "") + end
                    for k, (start, n) in enumerate(cut(len(found) // 4, capacity)):
                        waiting.append((doc_id, k, start, n, zlib.crc32(found[4 * start : 4 * (start + n)])))
                    if len(waiting) >= BLOCK:
                        yield placed()
        if waiting:
            yield placed()

    return common.take(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)
