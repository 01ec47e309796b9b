"""Bulk loading: delimited text, escaped tab-separated text, XML records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delimited(spark: SparkSession, path: str, schema: T.StructType, col_sep: str = "|", row_sep: str = "\n", unescape: bool = False) -> DataFrame:
    """Rows of a text file or folder; separators of any length. Fields that are missing, or do not fit their type, are null.

    An empty line is a row of a table of one column, and none of others.

    Files are split among tasks at row separators; no row passes through the driver.
    """
    lines = spark.read.text(path, lineSep=row_sep)
    parts = F.split("value", re.escape(col_sep), -1)
    out = []
    for i, f in enumerate(schema):
        value = F.get(parts, F.lit(i))
        if unescape:
            value = F.replace(F.replace(value, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
        if not isinstance(f.dataType, (T.StringType, T.BinaryType)):
            value = F.trim(value).try_cast(f.dataType)
        out.append(value.cast(f.dataType).alias(f.name))
    return (lines if len(schema) == 1 else lines.where("value <> ''")).select(*out)


def _paths(schema: T.StructType, before: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    found = []
    for f in schema:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, T.StructType):
            found += _paths(kind, (*before, f.name))
        if not isinstance(kind, T.StructType) or "_VALUE" in kind.names:
            found.append((*before, f.name))
    return found


def _getter(name: str):
    return lambda x: x[name]


def _values(schema: T.StructType, path: tuple[str, ...]) -> Column:
    """All values at a path, as an array of strings."""
    out, kind, many = None, schema, False
    for name in path:
        field = kind[name]
        if out is None:
            out = F.col(f"`{name}`")
        elif many:
            out = F.transform(out, _getter(name))
        else:
            out = out[name]
        kind = field.dataType
        if isinstance(kind, T.ArrayType):
            out = F.flatten(out) if many else out
            many, kind = True, kind.elementType
    if isinstance(kind, T.StructType):
        out = F.transform(out, _getter("_VALUE")) if many else out["_VALUE"]
    return out.cast("array<string>") if many else F.when(out.isNotNull(), F.array(out.cast("string"))).otherwise(F.array().cast("array<string>"))


def xml(spark: SparkSession, path: str, schema: T.StructType, record_tag: str) -> DataFrame:
    """Records of an XML file: a column's name, cut at underscores, is the end of its tags' path.

    A record gives as many rows as its most frequent column has values; a column with fewer values
    repeats its first one after they are used up.
    """
    rows = spark.read.format("xml").option("rowTag", record_tag).option("inferSchema", "false").load(path)
    paths = [(record_tag, *p) for p in _paths(rows.schema)]
    columns = {}
    for f in schema:
        ways = [tuple(f.name.split("_")), (f.name,)]
        at = next((p for w in ways for p in paths if tuple(x.lower() for x in p[-len(w) :]) == tuple(x.lower() for x in w)), None)
        columns[f.name] = F.coalesce(_values(rows.schema, at[1:]), F.array().cast("array<string>")) if at else F.array().cast("array<string>")
    held = rows.select(*[c.alias(n) for n, c in columns.items()])
    most = F.greatest(F.lit(1), *[F.size(f"`{n}`") for n in columns], F.lit(1))
    held = held.withColumn("row of the record", F.explode(F.sequence(F.lit(0), most - 1)))
    i = F.col("row of the record")
    pick = lambda n: F.coalesce(F.get(F.col(f"`{n}`"), i), F.get(F.col(f"`{n}`"), F.lit(0)))
    return held.select(*[pick(f.name).try_cast(f.dataType).alias(f.name) for f in schema])
