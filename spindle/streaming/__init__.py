"""The same operators on streams: external commands and loading need no state, so they run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import udx
from ..sources.catalog import Catalog


def apply_udx(stream: DataFrame, calls: list[udx.Call], keep: list[str], block: int | None = None) -> DataFrame:
    """External commands over a streaming DataFrame; each micro-batch's blocks have processes of their own."""
    return udx.apply(stream, calls, keep, block)


def load(stream: DataFrame, catalog: Catalog, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream's rows to a table, by position, a micro-batch at a time."""

    def append(df: DataFrame, _: int) -> None:
        catalog.append(df, table)
        catalog.spark.catalog.refreshTable(table)  # the batch runs in a session of its own

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
    return (writer.trigger(availableNow=True) if once else writer).start()
