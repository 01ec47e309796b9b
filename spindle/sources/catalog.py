"""Tables with the dialect's metadata, over Spark's catalog, and the engine's settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.dialect import CreateIndex, CreateTable, DialectError

_PREFIX = "spindle."


def bucketed(df: DataFrame, name: str, n: int, keys: list[str], mode: str = "error") -> None:
    """Store rows in n buckets, each a single sorted file: they are dealt by the key first, so a task writes one bucket, not a piece of each."""
    df.repartition(n, *[F.col(f"`{k}`") for k in keys]).write.mode(mode).format("parquet").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)


class Catalog:
    """What .tables, .schema, .indices and .show report is kept as table properties and settings."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.temporary: set[str] = set()
        self.settings: dict[str, str] = {"row_sep": "\n", "col_sep": "|", "output": "stdout", "chunk_num": "1", "replica_num": "1"}

    # -- metadata --

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def properties(self, name: str) -> dict[str, str]:
        if not self.exists(name) or self.spark.catalog.getTable(name).tableType in ("TEMPORARY", "VIEW"):
            return {}
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
        return {r["key"].removeprefix(_PREFIX): r["value"] for r in rows if r["key"].startswith(_PREFIX)}

    def _quoted(self, values: dict[str, str]) -> str:
        return ", ".join(f"'{_PREFIX}{k}' = '" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for k, v in values.items())

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def schema(self, name: str | None = None) -> str:
        out = []
        for t in [name] if name else self.tables():
            ddl = self.properties(t).get("ddl")
            if ddl is None:
                ddl = f"CREATE TABLE {t} (" + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.table(t).schema) + ")"
            out.append(ddl + ";")
        return "\n".join(out)

    def indices(self, table: str | None = None) -> str:
        lines = []
        for t in [table] if table else self.tables():
            for key, value in sorted(self.properties(t).items()):
                if key.startswith("index."):
                    for c in json.loads(value)["columns"]:
                        lines.append(f"{c} : {key[6:]}" if table else f"{t} : {c} : {key[6:]}")
        return "\n".join(lines) or "NO index now!"

    def show(self) -> str:
        return "\n".join(f"{k} : {v.encode('unicode_escape').decode() if not v.isprintable() else v}" for k, v in self.settings.items())

    # -- DDL --

    def buckets(self, spec: CreateTable) -> int:
        """Buckets for a partition key: one for each chunk of each node; without either, as many as shuffle partitions."""
        n = max(1, len(spec.nodes)) * max(1, spec.chunk)
        return n if n > 1 else int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _described(self, spec: CreateTable, keys: list[str]) -> dict[str, str]:
        if spec.node_file:
            from ..plans.nodes import expand

            lines = self.spark.read.text(spec.node_file).collect()
            spec.nodes = [n for r in lines if r[0].strip() for n in expand(r[0].strip())]
        return {"ddl": spec.ddl, "nodes": json.dumps(spec.nodes), "partition": json.dumps(spec.partition), "chunk": str(spec.chunk), "replica": str(spec.replica), "key": json.dumps(keys), "buckets": str(self.buckets(spec) if spec.partition else 0)}

    def create(self, spec: CreateTable) -> None:
        if self.exists(spec.name):
            if spec.if_not_exists:
                return
            raise DialectError(f"table {spec.name} exists")
        columns = ", ".join(f"`{c.name}` {c.type}" for c in spec.columns)
        if spec.using == "fts4aux":
            return self._terms(spec)
        if spec.temporary:
            self.temporary.add(spec.name)
        cluster = f" CLUSTERED BY ({', '.join(f'`{c}`' for c in spec.partition)}) INTO {self.buckets(spec)} BUCKETS" if spec.partition else ""
        properties = self._quoted(self._described(spec, [c.name for c in spec.columns if c.key]))
        self.spark.sql(f"CREATE TABLE {spec.name} ({columns}) USING parquet{cluster} TBLPROPERTIES ({properties})")

    def _terms(self, spec: CreateTable) -> None:
        """A full-text table's terms: term, col, documents, occurrences; col `*` is all columns together."""
        source = spec.columns[0].name
        df = self.spark.table(source)
        texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").alias("text")) for c in texts]))
        words = df.select(F.monotonically_increasing_id().alias("row"), pairs.alias("p")).select("row", "p.col", F.explode(F.split(F.lower("p.text"), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''")
        one = words.groupBy("term", "col").agg(F.countDistinct("row").alias("documents"), F.count(F.lit(1)).alias("occurrences"))
        every = words.groupBy("term").agg(F.lit("*").alias("col"), F.countDistinct("row").alias("documents"), F.count(F.lit(1)).alias("occurrences"))
        every.unionByName(one).createOrReplaceTempView(spec.name)

    def create_as(self, spec: CreateTable, df: DataFrame) -> None:
        """Store a result as a table; if the table exists and the statement says IF NOT EXISTS, rows are appended by position."""
        if self.exists(spec.name):
            if not spec.if_not_exists:
                raise DialectError(f"table {spec.name} exists")
            self.append(df, spec.name)
            return
        if spec.temporary:
            self.temporary.add(spec.name)
        if spec.partition:
            bucketed(df, spec.name, self.buckets(spec), spec.partition)
        else:
            df.write.format("parquet").saveAsTable(spec.name)
        self.spark.sql(f"ALTER TABLE {spec.name} SET TBLPROPERTIES ({self._quoted(self._described(spec, []))})")

    def append(self, df: DataFrame, name: str) -> None:
        """Rows into a table, by position; values that do not fit a column's type become null."""
        target = self.spark.table(name).schema
        if len(df.columns) != len(target):
            raise DialectError(f"{name} has {len(target)} columns, the rows have {len(df.columns)}")
        held = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        rows = held.select(*[F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(target)])
        known = self.properties(name)
        if int(known.get("buckets", 0)):
            rows = rows.repartition(int(known["buckets"]), *[F.col(f"`{k}`") for k in json.loads(known["partition"])])
        rows.write.insertInto(name)

    def index(self, spec: CreateIndex) -> None:
        """Metadata alone: files carry column statistics, and sorted or bucketed tables do what an index would."""
        known = {f.name.lower() for f in self.spark.table(spec.table).schema}
        for c in spec.columns:
            if c.lower() not in known:
                raise DialectError(f"{spec.table} has no column {c}")
        if f"index.{spec.name}" in self.properties(spec.table) and not spec.if_not_exists:
            raise DialectError(f"index {spec.name} exists")
        value = json.dumps({"columns": spec.columns, "unique": spec.unique})
        self.spark.sql(f"ALTER TABLE {spec.table} SET TBLPROPERTIES ({self._quoted({f'index.{spec.name}': value})})")

    def close(self) -> None:
        """The session's TEMP tables go; they are tables like others until then, so rows can be put into them."""
        for name in sorted(self.temporary):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.temporary.clear()

    def drop(self, name: str, if_exists: bool) -> None:
        self.temporary.discard(name)
        if self.exists(name) and self.spark.catalog.getTable(name).isTemporary:
            self.spark.catalog.dropTempView(name)
        else:
            self.spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{name}")
