"""The engine: statements and dot commands in, DataFrames and text out."""

from __future__ import annotations

import argparse
import dataclasses
import itertools
import os
import shlex
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .operators import udx
from .plans import dialect
from .plans import tokens as tk
from .plans.dialect import DialectError
from .plans.tokens import Token
from .sources import catalog, loader, sink

_views = itertools.count()


class Engine:
    """SQL of the dialect over one Spark session.

    tolerate: exit statuses of external commands are ignored; else a non-zero one fails the query.
    block: rows for one process of an external command; by default an Arrow batch.
    """

    def __init__(self, spark: SparkSession, tolerate: bool = False, block: int | None = None, timeout: float | None = None):
        self.spark = spark
        self.catalog = catalog.Catalog(spark)
        self.tolerate, self.block, self.timeout = tolerate, block, timeout

    # -- entry points --

    def register(self, folder: str, tables: Iterable[str]) -> "Engine":
        """Parquet tables of a folder as views."""
        for t in tables:
            self.spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
        return self

    def sql(self, statement: str, params: dict | list | None = None) -> DataFrame:
        """A query's result; for other statements, a one-column table that says what was done."""
        out = self.execute(statement, params)
        return out if isinstance(out, DataFrame) else self.spark.createDataFrame([(out,)], "result string")

    def script(self, text: str) -> list[DataFrame | str]:
        return [self.execute(s) for s in tk.statements(text)]

    def execute(self, statement: str, params: dict | list | None = None) -> DataFrame | str:
        statement = statement.strip().rstrip(";").strip()
        if statement.startswith("."):
            return self.command(statement)
        tokens = tk.scan(statement)
        words = [t.upper for t in tk.solid(tokens)[:3]]
        verb = words[0] if words else ""
        if verb in ("SELECT", "WITH", "(", "VALUES"):
            return self._query(tokens, params)
        if verb == "CREATE" and "INDEX" in words:
            self.catalog.index(dialect.create_index(tokens))
        elif verb == "CREATE" and ("TABLE" in words):
            self._create(tokens, params)
        elif verb == "DROP":
            parts = [t.text for t in tk.solid(tokens)]
            self.catalog.drop("".join(parts[4 if parts[2].upper() == "IF" else 2 :]), parts[2].upper() == "IF")
        elif verb == "INSERT":
            self._insert(tokens, params)
        elif verb == "EXPLAIN":
            rest = [i for i, t in enumerate(tokens) if t.kind == "word" and t.upper not in ("EXPLAIN", "QUERY", "QUEYR", "PLAN")]
            return self.plan(tk.text(tokens[rest[0] :]))
        elif verb == "PRAGMA":
            return "1"
        elif verb in ("UPDATE", "DELETE", "REPLACE"):
            raise DialectError(f"{verb} is not supported: tables are immutable files")
        else:
            raise DialectError("please enter right sql: " + statement[:80])
        return "OK"

    # -- queries --

    def _args(self, params: dict | list | None) -> dict | None:
        if isinstance(params, (list, tuple)):
            return {f"p{i + 1}": v for i, v in enumerate(params)}
        return {k.lstrip(":@$"): v for k, v in params.items()} if params else None

    def _run(self, text: str, params: dict | list | None) -> DataFrame:
        args = self._args(params)
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def _view(self, df: DataFrame) -> str:
        name = f"spindle_view_{next(_views)}"
        df.createOrReplaceTempView(name)
        return name

    def _query(self, tokens: list[Token], params: dict | list | None, outer: dict[str, udx.Udx] | None = None) -> DataFrame:
        query, defs, rest = dialect.definitions(tokens)
        options, rest = dialect.tail(rest)
        if not defs:
            options, query = self._trailing(query)
        if rest:
            raise DialectError("not understood: " + " ".join(t.text for t in rest)[:80])
        block = {None: self.block, "all": udx.ALL}[size] if (size := options.get("block")) in (None, "all") else int(size)
        known = (outer or {}) | {k: dataclasses.replace(v, tolerate=self.tolerate, timeout=self.timeout) for k, v in defs.items()}
        query = self._derived(query, params, known)
        if "collective" in options:
            self.spark.sparkContext.setJobGroup(f"collective {options['collective']}", "external commands")
        if not known or not dialect.calls_any(query, set(known)):
            return self._run(dialect.rewrite(query), params)
        return self._udx(dialect.plan_udx(query, known), params, block)

    def _trailing(self, query: list[Token]) -> tuple[dict[str, str], list[Token]]:
        """COLLECTIVE BY and -b may stand at the end of a query without definitions."""
        for i, t in enumerate(query):
            near = tk.solid(query[i : i + 4])
            if t.upper == "COLLECTIVE" and t.kind == "word" or t.text == "-" and len(near) > 1 and near[1].text in ("b", "block"):
                options, rest = dialect.tail(tk.solid(query[i:]))
                if options and not rest:
                    return options, query[:i]
        return {}, query

    def _derived(self, query: list[Token], params, known: dict[str, udx.Udx]) -> list[Token]:
        """Sub-queries that use external commands run first and stand as views."""
        out: list[Token] = []
        i = 0
        while i < len(query):
            t = query[i]
            if t.text == "(":
                end = tk.closing(query, i)
                inner = query[i + 1 : end]
                first = tk.solid(inner)[:1]
                if first and first[0].upper == "SELECT":
                    _, own, _ = dialect.definitions(inner)
                    if own or dialect.calls_any(inner, set(known)):
                        out.append(Token("word", self._view(self._query(inner, params, known))))
                        i = end + 1
                        continue
                out += [t, *self._derived(inner, params, known), query[end]]
                i = end + 1
                continue
            out.append(t)
            i += 1
        return out

    def _udx(self, q: dialect.UdxQuery, params, block: int | None) -> DataFrame:
        base = self._run(q.base, params)
        inputs = {a for c in q.calls for a in c.args}
        keep = [c for c in base.columns if c not in inputs]
        df = udx.apply(base, q.calls, keep, block)
        starred = [c for c in keep if not c.startswith("udx ")]
        names = [x for column, name in q.output for x in ([(c, c) for c in starred] if column == "*" else [(column, name)])]
        if q.distinct:
            df = df.select(*[f"`{c}`" for c, _ in names], *[f"`{h}`" for h in q.hidden]).distinct()
        if q.above:
            plain = df.selectExpr(*[f"`{c}` AS `{n}`" for c, n in names], *[f"`{h}`" for h in q.hidden])
            df = self.spark.sql(f"SELECT * FROM {{df}} {q.above}", df=plain)
            return df.drop(*q.hidden)
        return df.selectExpr(*[f"`{c}` AS `{n}`" for c, n in names])

    # -- other statements --

    def _create(self, tokens: list[Token], params) -> None:
        spec = dialect.create_table(tokens)
        if spec.query is None:
            self.catalog.create(spec)
        else:
            self.catalog.create_as(spec, self._query(spec.query, params))

    def _insert(self, tokens: list[Token], params) -> None:
        if tk.find(tokens, {"DEFAULT"}) >= 0 or tk.find(tokens, {"OR"}) >= 0:
            raise DialectError("INSERT takes VALUES or SELECT: conflict clauses and DEFAULT VALUES are not supported")
        at = tk.find(tokens, {"SELECT"})
        _, defs, _ = dialect.definitions(tokens)
        if at >= 0 and defs:
            tokens = [*tokens[:at], *tk.scan(f"SELECT * FROM {self._view(self._query(tokens[at:], params))}")]
        self._run(dialect.rewrite(tokens), params)

    # -- plans --

    def syntax(self, statement: str) -> str:
        """The parsed plan."""
        return self.spark._jsparkSession.sessionState().sqlParser().parsePlan(dialect.rewrite(tk.scan(statement))).treeString()

    def plan(self, statement: str) -> str:
        """The physical plan, with external commands in their places."""
        df = self._query(tk.scan(statement.strip().rstrip(";")), None)
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # -- dot commands --

    def command(self, line: str) -> str:
        words = shlex.split(line.replace("\\", "\\\\"))
        name, args = words[0].lower(), words[1:]
        if name == ".tables":
            return "\n".join(self.catalog.tables())
        if name == ".schema":
            return self.catalog.schema(args[0] if args else None)
        if name == ".indices":
            return self.catalog.indices(args[0] if args else None)
        if name == ".show":
            return self.catalog.show()
        if name == ".analyze" and args:
            return self.plan(args[0])
        if name in (".output", ".row_separator", ".col_separator"):
            if not args:
                return "please enter right command"
            key = {".output": "output", ".row_separator": "row_sep", ".col_separator": "col_sep"}[name]
            self.catalog.settings[key] = args[0] if key == "output" else dialect.unescape(args[0])
            return "OK"
        if name == ".import":
            return self._import(args)
        return "please enter right command"

    def _import(self, args: list[str]) -> str:
        plain, options, replace = [], {}, False
        i = 0
        while i < len(args):
            if args[i] == "-replace":
                replace = True
            elif args[i] in ("-column_separator", "-row_separator") and i + 1 < len(args):
                options[args[i]] = dialect.unescape(args[i + 1])
                i += 1
            else:
                plain.append(args[i])
            i += 1
        if len(plain) not in (2, 3):
            return "please enter right command"
        path, table, *tag = plain
        if not self.catalog.exists(table):
            raise DialectError(f"there is no table {table}")
        schema = self.spark.table(table).schema
        if tag:
            rows = loader.xml(self.spark, path, schema, tag[0])
        else:
            col = "\t" if replace else options.get("-column_separator", self.catalog.settings["col_sep"])
            rows = loader.delimited(self.spark, path, schema, col, options.get("-row_separator", self.catalog.settings["row_sep"]), unescape=replace)
        self.catalog.append(rows, table)
        return "OK"

    def emit(self, result: DataFrame | str, out=None) -> None:
        """Give a result to where .output points: the client's stream, or a folder of text files."""
        target = self.catalog.settings["output"]
        if isinstance(result, DataFrame) and target != "stdout":
            sink.write(result, target, self.catalog.settings["col_sep"], self.catalog.settings["row_sep"])
            return
        lines = sink.stream(result, self.catalog.settings["col_sep"]) if isinstance(result, DataFrame) else [result]
        for line in lines:
            (out or sys.stdout).write(line + self.catalog.settings["row_sep"])


# --- a small DB-API ---------------------------------------------------------------------------


class Cursor:
    def __init__(self, engine: Engine):
        self.engine, self.result = engine, iter(())
        self.description: list[tuple] | None = None

    def execute(self, statement: str, params: dict | list | None = None) -> "Cursor":
        df = self.engine.sql(statement, params)
        self.description = [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in df.schema]
        self.result = (tuple(r) for r in df.toLocalIterator())
        return self

    def fetchone(self) -> tuple | None:
        return next(self.result, None)

    def fetchmany(self, size: int = 1) -> list[tuple]:
        return list(itertools.islice(self.result, size))

    def fetchall(self) -> list[tuple]:
        return list(self.result)

    def __iter__(self):
        return self.result


class Connection:
    def __init__(self, engine: Engine):
        self.engine = engine

    def cursor(self) -> Cursor:
        return Cursor(self.engine)


def connect(spark: SparkSession, **options) -> Connection:
    return Connection(Engine(spark, **options))


def main(argv: list[str] | None = None) -> int:
    """python -m spindle.session [options] [STATEMENT ...]: statements as arguments, or a script on standard input."""
    parser = argparse.ArgumentParser(prog="spindle", description=main.__doc__)
    parser.add_argument("statements", nargs="*", metavar="STATEMENT")
    parser.add_argument("-b", "--block", help="rows for one process of an external command, or all")
    parser.add_argument("--parse-syntax", action="store_true", help="print how statements are understood, and run nothing")
    parser.add_argument("--parse-plan", action="store_true", help="print plans of queries, and run nothing")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("spindle").config("spark.ui.enabled", os.environ.get("SPINDLE_UI", "false")).getOrCreate()
    engine = Engine(spark, block=udx.ALL if args.block == "all" else int(args.block) if args.block else None)
    for text in args.statements or [sys.stdin.read()]:
        for statement in tk.statements(text):
            if args.parse_syntax or args.parse_plan:
                print(engine.syntax(statement) if args.parse_syntax else engine.plan(statement))
            else:
                engine.emit(engine.execute(statement))
    engine.catalog.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
