"""Statements, dot commands, loading, text results."""

import io

import pytest

from spindle.plans.dialect import DialectError
from spindle.session import Engine, connect


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    for t in ("x", "people", "made", "words", "terms", "events_in"):
        e.execute(f"drop table if exists {t}")
    return e


def test_manual_example(engine, tmp_path):
    (tmp_path / "a.dat").write_text("aa|test1\nbb|test2\naa|test3\n")
    engine.execute("create table x (a varchar(10), b varchar(10)) on host[[001-004]] partition by a chunk 2")
    assert engine.execute(f".import {tmp_path}/a.dat x") == "OK"
    assert sorted(map(tuple, engine.sql("select * from x where a='aa'").collect())) == [("aa", "test1"), ("aa", "test3")]
    assert engine.sql("select count(*) from x").first()[0] == 3
    assert sorted(map(tuple, engine.sql("select a, count(*) from x group by a").collect())) == [("aa", 2), ("bb", 1)]


def test_import_options(engine, tmp_path):
    engine.execute("create table people (id int, name text, score real)")
    (tmp_path / "a.txt").write_text("1==ann==1.5##2==bob==oops##3==cid##")
    engine.execute(f'.import {tmp_path}/a.txt people -column_separator "==" -row_separator "##"')
    assert sorted(map(tuple, engine.sql("select * from people").collect())) == [(1, "ann", 1.5), (2, "bob", None), (3, "cid", None)]
    (tmp_path / "b.txt").write_text("9\ta\\nb\t2.0\n")
    engine.execute(f".import {tmp_path}/b.txt people -replace")
    assert engine.sql("select name from people where id = 9").first()[0] == "a\nb"
    with pytest.raises(DialectError):
        engine.execute(f".import {tmp_path}/b.txt nowhere")


def test_import_xml(engine, tmp_path):
    engine.execute("create table people (person_name text, id int, phone_number text)")
    (tmp_path / "a.xml").write_text("<all>\n<person>\n<id>1</id><name>ann</name><phone><number>11</number></phone><phone><number>12</number></phone>\n</person>\n<person>\n<id>2</id><name>bob</name>\n</person>\n</all>\n")
    engine.execute(f".import {tmp_path}/a.xml people person")
    assert sorted(map(tuple, engine.sql("select id, person_name, phone_number from people").collect()), key=str) == [(1, "ann", "11"), (1, "ann", "12"), (2, "bob", None)]


def test_partition_keys_avoid_exchanges(engine, spark):
    engine.execute("create table made as select id as k, id % 7 as v from range(100) partition by k chunk 4")
    plan = engine.plan("select k, sum(v) from made group by k")
    assert "Exchange hashpartitioning" not in plan
    assert engine.sql("select count(*) from made").first()[0] == 100


def test_existing_tables(engine):
    engine.execute("create table made as select 1 as a")
    with pytest.raises(DialectError):
        engine.execute("create table made as select 2 as a")
    engine.execute("create table if not exists made as select 2 as b")
    engine.execute("create table if not exists made (z int)")
    assert sorted(r[0] for r in engine.sql("select a from made").collect()) == [1, 2]
    with pytest.raises(DialectError):
        engine.execute("create table if not exists made as select 1, 2")


def test_insert_and_what_is_not_there(engine):
    engine.execute("create table people (id int, name text)")
    engine.execute("insert into people values (1, 'a'), (2, 'b')")
    engine.execute("insert into people select id + 10, F(name) as n from people with F=\"tr a-z A-Z\"")
    assert sorted(map(tuple, engine.sql("select * from people").collect())) == [(1, "a"), (2, "b"), (11, "A"), (12, "B")]
    for bad in ("update people set id = 1", "delete from people", "insert or replace into people values (1, 'x')", "frobnicate"):
        with pytest.raises(DialectError):
            engine.execute(bad)


def test_ctas_of_a_command(engine, spark):
    spark.createDataFrame([("ab", 2), ("cd", 0)], "pageURL string, pageRank int").createOrReplaceTempView("Rankings")
    engine.execute("create table made as select F(pageURL) as ss from Rankings where pageRank>1 with F=\"grep a\" on huscs[[001-002]]")
    assert [tuple(r) for r in engine.sql("select * from made order by ss").collect()] == [("ab",)]


def test_metadata_commands(engine):
    engine.execute("create table people (id int primary key, name text)")
    assert engine.execute(".indices people") == "NO index now!"
    engine.execute("create unique index by_name on people (name asc)")
    assert engine.execute(".indices people") == "name : by_name" and "people : name : by_name" in engine.execute(".indices")
    assert "people" in engine.execute(".tables").split("\n")
    assert "create table people (id int primary key, name text);" in engine.execute(".schema")
    assert "col_sep : |" in engine.execute(".show") and "row_sep : \\n" in engine.execute(".show")
    assert engine.execute(".col_separator \\t") == "OK" and engine.catalog.settings["col_sep"] == "\t"
    assert engine.execute(".output") == engine.execute(".nonsense") == "please enter right command"
    assert engine.execute("pragma table_info(people)") == "1"
    with pytest.raises(DialectError):
        engine.execute("create index i on people (nope)")
    engine.execute("drop table people")
    assert "people" not in engine.execute(".tables").split("\n")


def test_plans(engine, spark):
    spark.range(3).createOrReplaceTempView("three")
    assert "UnresolvedRelation [three]" in engine.syntax("select count(*) from three")
    assert "MapInArrow" in engine.plan("select id, F(id) as x from three with F=\"cat\"")
    assert "Range" in engine.execute('.analyze "select id from three where id == 1"')
    assert "Range" in engine.execute("explain queyr plan select id from three")


def test_text_results(engine, spark, tmp_path):
    out = io.StringIO()
    engine.emit(engine.sql("select 1 as a, cast(null as string) as b, 'x' as c"), out)
    assert out.getvalue() == "1||x\n"
    engine.execute(f".output {tmp_path}/o")
    engine.emit(engine.sql("select 7 as a, 8 as b"))
    assert [r[0] for r in spark.read.text(f"{tmp_path}/o").collect()] == ["7|8"]


def test_script_and_cursor(engine, spark):
    results = engine.script("-- a comment\ndrop table if exists made; create table made (a int);\ninsert into made values (1);\nselect a from made;")
    assert results[:3] == ["OK", "OK", "OK"] and results[3].first()[0] == 1
    cursor = connect(spark).cursor().execute("select id from range(5) order by id")
    assert cursor.fetchone() == (0,) and cursor.fetchmany(2) == [(1,), (2,)] and cursor.fetchall() == [(3,), (4,)] and cursor.fetchone() is None


def test_full_text(engine, spark):
    engine.execute("create virtual table words using fts4 (title text, body text)")
    engine.execute("insert into words values ('One', 'the cat and the dog'), ('Two', 'a dog')")
    assert engine.sql("select title from words where body match 'cat dog'").first()[0] == "One"
    engine.execute("create virtual table terms using fts4aux (words)")
    assert tuple(engine.sql("select documents, occurrences from terms where term = 'dog' and col = '*'").first()) == (2, 2)
    assert tuple(engine.sql("select documents, occurrences from terms where term = 'the' and col = 'body'").first()) == (1, 2)
    spark.catalog.dropTempView("terms")


def test_bind_parameters(engine):
    assert engine.sql("select :a + 1 as x", {":a": 4}).first()[0] == 5
    assert engine.sql("select ?1 as x, ?2 as y", ["p", 2]).first()[1] == 2


def test_functions_in_sql(engine):
    row = engine.sql("select date('1995-01-31', '+1 month') as d, strftime('%d.%m.%Y', timestamp '2020-02-03 04:05:06') as s, mul(x) as m, total(x) as t from values (2), (-3), (7) as v(x)").first()
    assert (str(row.d), row.s, row.m, row.t) == ("1995-02-28", "03.02.2020", -42.0, 6.0)
    assert engine.sql("select mul(x) as m from values (cast(null as int)) as v(x)").first().m is None
    assert engine.sql("select mul(x) as m from values (2), (0) as v(x)").first().m == 0


def test_streamed_loading(engine, spark, tmp_path):
    from spindle import streaming

    engine.execute("create table events_in (k int, v text)")
    spark.range(4).selectExpr("id k", "'v' v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, v string").parquet(str(tmp_path / "in"))
    streaming.load(stream, engine.catalog, "events_in", str(tmp_path / "c")).awaitTermination(120)
    assert engine.sql("select count(*) from events_in").first()[0] == 4


def test_temporary_tables_take_rows_and_go(spark, tmp_path):
    e = Engine(spark)
    e.execute("create temp table short_lived (v text)")
    e.execute("insert into short_lived values ('a')")
    (tmp_path / "in.txt").write_text("b\n\nc\n")
    e.execute(f".import {tmp_path}/in.txt short_lived")
    assert sorted(r[0] for r in e.sql("select v from short_lived").collect()) == ["", "a", "b", "c"]
    e.catalog.close()
    assert not e.catalog.exists("short_lived")


def test_a_bucket_is_one_file(spark):
    e = Engine(spark)
    spark.range(0, 2000, 1, 6).selectExpr("id as k", "id * 2 as v").createOrReplaceTempView("numbers_in")
    e.execute("drop table if exists dealt_by_key")
    e.execute("create table dealt_by_key as select k, v from numbers_in partition by k chunk 4")
    assert len(spark.table("dealt_by_key").inputFiles()) == 4
    e.execute("create table if not exists dealt_by_key as select k + 5000, v from numbers_in")
    assert len(spark.table("dealt_by_key").inputFiles()) == 8 and spark.table("dealt_by_key").count() == 4000
