"""External commands as functions over partitions.

A call's arguments are written, one input row a line (or whatever delimiters its definition
gives), to one process for each block of rows; what it writes is cut into one record for each
input row, each record into rows and each row into columns. Columns that only pass through
stay typed and are never turned into text.

The operator is one mapInArrow node: no shuffle, blocks of bounded size, and a task that is run again
starts its processes afresh.
"""

from __future__ import annotations

import os
import shlex
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NEW_LINE, EMPTY_LINE, NULL, SPACE = "\n", "\n\n", "", " "
NAMED = {"NEW_LINE": NEW_LINE, "EMPTY_LINE": EMPTY_LINE, "NULL": NULL, "SPACE": SPACE}


class UdxError(RuntimeError):
    """A command is missing, failed, or gave another number of records than it was given rows."""


@dataclass(frozen=True)
class Udx:
    """A command line, where its input and output are (None: stdin, stdout), and their delimiters."""

    name: str
    command: str
    input: str | None = None
    output: str | None = None
    input_row: str = NEW_LINE
    input_col: str = NULL
    input_record: str = NULL
    output_row: str = NEW_LINE
    output_col: str = NULL
    output_record: str = NULL
    shell: bool = False
    tolerate: bool = False
    timeout: float | None = None


@dataclass(frozen=True)
class Call:
    """One call in a select list: the chain of commands, innermost first, and the names of argument and output columns."""

    chain: tuple[Udx, ...]
    args: tuple[str, ...]
    outputs: tuple[str, ...] = field(default=())


def execute(udx: Udx, data: str) -> str:
    """Run the command once on a block of input."""
    folder = None
    command, stdin = udx.command, data.encode()
    target = None
    try:
        if udx.input is not None or udx.output is not None:
            folder = tempfile.mkdtemp(prefix="udx-")
        if udx.input is not None:
            source = os.path.join(folder, "in-" + os.path.basename(udx.input))
            with open(source, "wb") as f:
                f.write(stdin)
            command, stdin = command.replace(udx.input, source), None
        if udx.output is not None:
            target = os.path.join(folder, "out-" + os.path.basename(udx.output))
            command = command.replace(udx.output, target)
        try:
            process = subprocess.Popen(command if udx.shell else shlex.split(command.strip()), shell=udx.shell, stdin=subprocess.PIPE if stdin is not None else subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        except OSError as e:
            raise UdxError(f"{udx.name}: {command!r} cannot be started: {e.strerror}") from e
        try:
            out, err = process.communicate(stdin, timeout=udx.timeout)
        except subprocess.TimeoutExpired as e:
            raise UdxError(f"{udx.name}: {command!r} took more than {udx.timeout} s") from e
        finally:
            if process.poll() is None:
                process.kill()
                process.wait()
        if process.returncode and not udx.tolerate:
            raise UdxError(f"{udx.name}: {command!r} ended with status {process.returncode}: {err.decode(errors='replace')[-500:]}")
        if target is not None:
            with open(target, "rb") as f:
                out = f.read()
        return out.decode(errors="replace")
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _between(before: Udx, after: Udx, data: str) -> str:
    """What one command wrote, with the delimiters that the next one reads."""
    row = before.output_record or before.output_row
    if row != after.input_row:
        data = data.replace(row, after.input_row)
    if before.output_col and before.output_col != after.input_col:
        data = data.replace(before.output_col, after.input_col)
    return data


def _parts(data: str, mark: str) -> list[str]:
    """Pieces that a mark ends or parts; the empty piece after the last mark is none."""
    if not data:
        return []
    parts = data.split(mark)
    return parts[:-1] if parts[-1] == "" else parts


def evaluate(call: Call, rows: list[tuple[str, ...]], width: int, aligned: bool = True) -> list[list[tuple[str | None, ...]]]:
    """For each input row, the output rows; not aligned: all output rows, as of one input row."""
    if not rows:
        return []
    first, last = call.chain[0], call.chain[-1]
    for row in rows:
        for value in row:
            if aligned and first.input_row and first.input_row in value:
                raise UdxError(f"{first.name}: a value holds the input row delimiter {first.input_row!r}: {value[:60]!r}; use another delimiter or replace it first")
    data = first.input_row.join(first.input_col.join(r) for r in rows) + first.input_row
    for before, udx in zip((None, *call.chain), call.chain):
        data = execute(udx, _between(before, udx, data) if before else data)

    def columns(row: str) -> tuple[str | None, ...]:
        cells: list[str | None] = list(row.split(last.output_col, width - 1)) if last.output_col and width > 1 else [row]
        return tuple(cells + [None] * (width - len(cells)))

    if last.output_record:
        records = [_parts(r.strip("\n") if last.output_row == NEW_LINE else r, last.output_row) for r in data.split(last.output_record)]
        records = [r for r in records if r]
    else:
        records = [[r] for r in _parts(data, last.output_row)]
    if not aligned:
        return [[columns(r) for record in records for r in record]]
    if len(records) != len(rows):
        raise UdxError(f"{last.name}: {len(rows)} rows went in, {len(records)} records came out")
    return [[columns(r) for r in record] for record in records]


#: Block size of one process for all rows.
ALL = -1


def apply(df: DataFrame, calls: list[Call], keep: list[str], block: int | None = None) -> DataFrame:
    """keep's columns of df and each call's outputs, as strings.

    block: rows for one process; by default, an Arrow batch (spark.sql.execution.arrow.maxRecordsPerBatch). ALL: one
    process takes all rows, in one task that holds them; for commands such as sort or wc, whose answer needs them all.
    Null arguments go in as empty strings. Where nothing passes through and there is one call, output
    rows need not match input rows in number. Several calls with several rows for one input row must
    have as many rows, or one.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType(fields + [T.StructField(o, T.StringType()) for c in calls for o in c.outputs])
    aligned = bool(keep) or len(calls) > 1
    args = list(dict.fromkeys(a for c in calls for a in c.args))
    kept = [f.name for f in fields]
    rows = df.select(*[f"`{c}`" for c in kept], *[df[f"`{a}`"].cast("string").alias(f"udx arg {i}") for i, a in enumerate(args)])
    places = {a: len(kept) + i for i, a in enumerate(args)}
    whole, block = block == ALL, None if block == ALL else block

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        if every:
            yield from pa.Table.from_batches(every).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in together(batches) if whole else batches:
            for start in range(0, batch.num_rows, block or max(1, batch.num_rows)):
                part = batch.slice(start, block) if block else batch
                out = [evaluate(c, list(zip(*[["" if v is None else v for v in part.column(places[a]).to_pylist()] for a in c.args])), len(c.outputs), aligned) for c in calls]
                many = [max((len(o[i]) for o in out), default=1) for i in range(len(out[0]))]
                take = [i for i, m in enumerate(many) for _ in range(m)]
                arrays = [part.column(i).take(pa.array(take, pa.int64())) for i in range(len(kept))]
                for o, c in zip(out, calls):
                    cells = []
                    for i, m in enumerate(many):
                        if len(o[i]) not in (1, m):
                            raise UdxError(f"{c.chain[-1].name}: {len(o[i])} rows where another call gave {m}")
                        cells += o[i] if len(o[i]) == m else o[i] * m
                    arrays += [pa.array([x[k] for x in cells], pa.string()) for k in range(len(c.outputs))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return (rows.repartition(1) if whole else rows).mapInArrow(run, schema)
