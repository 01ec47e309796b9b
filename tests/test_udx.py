"""External commands: delimiters, alignment, failures."""

import pytest

from spindle.operators import udx
from spindle.operators.udx import Call, Udx, UdxError
from spindle.session import Engine

SPLITTER = """awk -F. '{ for (i = 1; i < NF; i++) print i \"==\" $i \".\"; print \"\" }'"""


@pytest.fixture
def engine(spark):
    df = spark.createDataFrame([(32819, "It is sunny today. I have a good mood."), (82718, "I am studying in the lab. I want to go outside and play pingpong.")], "document_id int, text string")
    df.coalesce(1).createOrReplaceTempView("document")
    return Engine(spark)


def test_a_whole_block_for_each_row(engine):
    sql = "select document_id, F(text) as s from document with F=\"" + SPLITTER.replace('"', '""') + "\" output_row_delimiter EMPTY_LINE"
    rows = {r[0]: r[1] for r in engine.sql(sql).collect()}
    assert rows[32819] == "1==It is sunny today.\n2== I have a good mood."


def test_several_rows_and_columns(engine):
    sql = "select document_id, F(text) as (n, sentence) from document with F=\"" + SPLITTER.replace('"', '""') + "\" output_col_delimiter '==' output_record_delimiter EMPTY_LINE"
    rows = sorted(map(tuple, engine.sql(sql).collect()))
    assert rows == [(32819, "1", "It is sunny today."), (32819, "2", " I have a good mood."), (82718, "1", "I am studying in the lab."), (82718, "2", " I want to go outside and play pingpong.")]


def test_chain_translates_delimiters():
    first = Udx("A", "cat", output_row=";", output_col=",")
    second = Udx("B", "cat", input_row="\n", input_col=" ")
    assert udx._between(first, second, "a,b;c,d;") == "a b\nc d\n"


def test_two_commands_in_one_select(engine):
    rows = engine.sql("select F(document_id) as a, document_id, G(document_id, document_id) as b from document with F=\"rev\" G=\"cat\" input_col_delimiter ':'").collect()
    assert sorted(map(tuple, rows)) == [("81728", 82718, "82718:82718"), ("91823", 32819, "32819:32819")]


def test_blocks(engine, spark):
    spark.range(10).coalesce(1).createOrReplaceTempView("ten")
    rows = engine.sql("select id, F(id) as n from ten with F=\"awk 'END {} {print NR}'\" -b 4").collect()
    assert [r[1] for r in sorted(rows)] == ["1", "2", "3", "4", "1", "2", "3", "4", "1", "2"]
    rows = engine.sql("select id, F(id) as n from ten with F=\"awk '{print NR}'\" -b all").collect()
    assert [r[1] for r in sorted(rows)] == [str(i) for i in range(1, 11)]


def test_empty_input_and_nulls(engine, spark):
    assert engine.sql("select document_id, F(text) as x from document where document_id < 0 with F=\"cat\"").collect() == []
    spark.sql("select cast(null as string) v, 1 k").createOrReplaceTempView("one_null")
    assert [tuple(r) for r in engine.sql("select k, F(v) as x from one_null with F=\"cat\"").collect()] == [(1, "")]


@pytest.mark.parametrize("command,what", [("no-such-command-here", "cannot be started"), ("false", "status 1"), ("head -n 1", "2 rows went in, 1 records came out")])
def test_failures_name_the_command(engine, command, what):
    with pytest.raises(Exception, match=what):
        engine.sql(f"select document_id, F(text) as x from document with F=\"{command}\"").collect()


def test_values_that_hold_the_row_delimiter():
    with pytest.raises(UdxError, match="input row delimiter"):
        udx.evaluate(Call((Udx("F", "cat"),), ("a",), ("x",)), [("a\nb",)], 1)
    kept = udx.evaluate(Call((Udx("F", "cat", input_row="\x1e", output_row="\x1e"),), ("a",), ("x",)), [("a\nb",), ("c",)], 1)
    assert kept == [[("a\nb",)], [("c",)]]


def test_tolerated_status(spark, engine):
    tolerant = Engine(spark, tolerate=True)
    assert tolerant.sql("select F(text) as x from document where document_id = 32819 with F=\"grep nothing-like-it\"").collect() == []


def test_order_limit_distinct_above(engine):
    rows = engine.sql("select F(document_id) as x from document order by x desc limit 1 with F=\"rev\"").collect()
    assert [tuple(r) for r in rows] == [("91823",)]
    rows = engine.sql("select distinct F(1) as x from document with F=\"cat\"").collect()
    assert [tuple(r) for r in rows] == [("1",)]


def test_no_name_no_call(engine):
    with pytest.raises(Exception):
        engine.sql("select document_id, Nope(text) from document").collect()


def test_streams(spark, tmp_path):
    from spindle import streaming

    spark.range(5).selectExpr("id", "cast(id as string) v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
    out = streaming.apply_udx(stream, [Call((Udx("F", "sed s/^/x/"),), ("v",), ("y",))], ["id"])
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(i, f"x{i}") for i in range(5)]


def test_all_rows_in_one_process(engine, spark):
    spark.range(0, 5000, 1, 7).selectExpr("cast(4999 - id as string) as v").createOrReplaceTempView("many_rows")
    assert [r[0] for r in engine.sql("select F(v) as n from many_rows with F=\"awk 'END {print NR}'\" -b all").collect()] == ["5000"]
    assert [int(r[0]) for r in engine.sql('select F(v) as n from many_rows with F="sort -n" -b all').collect()] == list(range(5000))
    assert engine.sql('select F(v) as n from many_rows where v < 0 with F="cat" -b all').count() == 0
