"""Statements in, statements or structures out; no session."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from spindle.functions import compat
from spindle.plans import dialect, nodes
from spindle.plans import tokens as tk


def flat(sql):
    return " ".join(dialect.rewrite(tk.scan(sql)).split())


@given(st.text())
def test_scanning_loses_nothing(text):
    assert tk.text(tk.scan(text)) == text


def test_statements_are_split_outside_strings_and_comments():
    script = "select 'a;b' -- not; here\n from t;\n.tables\n.show\nselect 2;"
    assert [" ".join(s.split()) for s in tk.statements(script)] == ["select 'a;b' from t", ".tables", ".show", "select 2"]


def test_operators():
    assert flat("select a from t where a == 1 && b = 2 || c ISNULL") == "select a from t where a = 1 AND b = 2 OR c IS NULL"
    assert flat("select a || b from t where a NOT NULL and b is not null") == "select a || b from t where a IS NOT NULL and b is not null"
    assert flat("select a from t where n not glob 'x*'") == "select a from t where n not RLIKE '(?s)^x.*$'"
    assert flat("select a from t limit 5, 10") == "select a from t LIMIT 10 OFFSET 5"
    assert flat("select a from t where a = ?1 and b = @who") == "select a from t where a = :p1 and b = :who"
    assert flat("select a from t indexed by i where a = 1") == "select a from t where a = 1"


def test_nested_clauses_keep_their_meaning():
    assert flat("select (select x || y from u where p || q) from t") == "select (select x || y from u where p OR q) from t"


def test_functions():
    assert flat("select date('1995-01-31', '+1 month') from t") == "select CAST((CAST('1995-01-31' AS DATE) + INTERVAL '1' MONTH) AS DATE) from t"
    assert "trunc(" in flat("select date(d, 'start of month') from t")
    assert flat("select strftime('%Y', d)") == "select date_format(CAST(d AS TIMESTAMP), 'yyyy')"
    assert flat("select total(a + b)") == "select coalesce(sum(CAST(a + b AS DOUBLE)), CAST(0 AS DOUBLE))"
    with pytest.raises(ValueError):
        flat("select date(d, 'next tuesday')")


@pytest.mark.parametrize("pattern,yes,no", [("a*", ["a", "abc", "a\nb"], ["b", "A"]), ("?b", ["ab"], ["b", "abb"]), ("[^a]x", ["bx"], ["ax"]), ("[0-9]*", ["1x"], ["x1"]), ("a.b", ["a.b"], ["axb"]), ("[", ["["], ["x"])])
def test_glob(pattern, yes, no):
    import re

    regex = re.compile(compat.glob_regex(pattern))
    assert all(regex.match(v) for v in yes) and not any(regex.match(v) for v in no)


def test_match():
    import re

    assert re.search(dialect.match_regex("lin* OR unix"), "about Linux") and not re.search(dialect.match_regex("lin"), "Linux")
    assert re.search(dialect.match_regex('"new york" city'), "City of New  York") and not re.search(dialect.match_regex('"new york"'), "york new")


def test_node_ranges():
    assert nodes.expand("h") == ["h"]
    assert nodes.expand("h[[001-003]]") == ["h001", "h002", "h003"]
    assert nodes.expand("h[[08-10]].x") == ["h08.x", "h09.x", "h10.x"]
    assert nodes.expand("h[[9-11]]") == ["h9", "h10", "h11"]
    assert nodes.expand("h[[1-5;2-3,7]]") == ["h1", "h4", "h5", "h7"]
    assert nodes.expand("h[[1--3]]") == ["h1", "h2"]
    assert nodes.expand("a[[1-2]]b[[1-2]]") == ["a1b1", "a1b2", "a2b1", "a2b2"]
    with pytest.raises(ValueError):
        nodes.expand("h[[x]]")


def test_definitions():
    query, defs, rest = dialect.definitions(tk.scan("select F(a) from t with F=\"awk '{print $1; x}'\" input '/tmp/i' input_col_delimiter SPACE output_record_delimiter EMPTY_LINE G=\"cat\" output_row_delimiter '==' collective by 7 -b 10"))
    assert tk.text(query).strip() == "select F(a) from t"
    assert defs["F"].command == "awk '{print $1; x}'" and defs["F"].input == "/tmp/i" and defs["F"].input_col == " " and defs["F"].output_record == "\n\n"
    assert defs["G"].output_row == "=="
    assert dialect.tail(rest) == ({"collective": "7", "block": "10"}, [])


def test_ctes_are_no_definitions():
    query, defs, _ = dialect.definitions(tk.scan("with x as (select 1 a) select a from x"))
    assert not defs and tk.text(query).startswith("with")


def test_create_table():
    spec = dialect.create_table(tk.scan("create table if not exists t (a int primary key, b varchar(20) not null, c real, d, check (a > 1)) on h[[01-02]] partition by a, b chunk 3 replica 2"))
    assert [(c.name, c.type, c.key, c.required) for c in spec.columns] == [("a", "BIGINT", True, True), ("b", "STRING", False, True), ("c", "DOUBLE", False, False), ("d", "STRING", False, False)]
    assert (spec.name, spec.if_not_exists, spec.nodes, spec.partition, spec.chunk, spec.replica) == ("t", True, ["h01", "h02"], ["a", "b"], 3, 2)


def test_create_as_keeps_its_joins():
    spec = dialect.create_table(tk.scan("create table t as select a from x join y on x.a = y.b on h[[1-2]]"))
    assert tk.text(spec.query).strip() == "select a from x join y on x.a = y.b" and spec.nodes == ["h1", "h2"]
    spec = dialect.create_table(tk.scan("create table t as select a from x join y on x.a = y.b"))
    assert tk.text(spec.query).strip().endswith("x.a = y.b") and not spec.nodes


def test_udx_calls_must_stand_alone():
    defs = dialect.definitions(tk.scan("select 1 with F=\"cat\""))[1]
    with pytest.raises(dialect.DialectError):
        dialect.plan_udx(tk.scan("select F(a) + 1 from t"), defs)
