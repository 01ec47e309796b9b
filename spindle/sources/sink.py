"""Results as delimited text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, col_sep: str = "|") -> DataFrame:
    """One string column: the values of a row, joined; nulls are empty."""
    held = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return held.select(F.concat_ws(col_sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in held.columns]).alias("value"))


def write(df: DataFrame, path: str, col_sep: str = "|", row_sep: str = "\n", append: bool = True) -> None:
    """Text files in a folder, written by the tasks that hold the rows."""
    lines(df, col_sep).write.mode("append" if append else "overwrite").option("lineSep", row_sep).text(path)


def stream(df: DataFrame, col_sep: str = "|") -> Iterator[str]:
    """Lines for a client, a partition at a time."""
    return (r[0] for r in lines(df, col_sep).toLocalIterator())
