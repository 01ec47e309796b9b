"""The relational operators as queries over the driver's tables, each with the SQL that gives the same rows.

DataFrame code where an operator is one DataFrame call; the engine's SQL where the point is the
dialect. Floating sums are rounded to two digits, and every LIMIT has a total order.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat
from ..session import Engine, connect
from ..sources.catalog import bucketed

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

c = F.col


class Tables:
    """Tables of one folder as attributes; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def engine(self, *names: str) -> Engine:
        return Engine(self.spark).register(self.folder, names)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str, build: Callable[[Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
    ORACLE_SQL[name] = sql


def dialect(name: str, sql: str, text: str, *tables: str) -> None:
    """A query given in the engine's dialect."""
    query(name, sql, lambda t: t.engine(*tables).sql(text))


def revenue():
    return c("l_extendedprice") * (1 - c("l_discount"))


# --- scans, projections -----------------------------------------------------------------------

query("scan_project", "select l_orderkey, l_partkey, l_quantity from lineitem", lambda t: t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"))
query("star", "select * from part", lambda t: t.part.select("*"))
query("qualified_star", "select n.* from nation n join region r on n.n_regionkey = r.r_regionkey where r.r_name = 'ASIA'", lambda t: t.nation.alias("n").join(t.region.alias("r"), c("n.n_regionkey") == c("r.r_regionkey")).where(c("r.r_name") == "ASIA").select("n.*"))
query("alias_expr", "select l_orderkey, l_linenumber, l_quantity * 2 + 1 as q, (l_extendedprice - l_tax) / 2 as p from lineitem", lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (c("l_quantity") * 2 + 1).alias("q"), ((c("l_extendedprice") - c("l_tax")) / 2).alias("p")))
dialect("select_constant", "select 1 as a, 'x' as b, 2 + 3 as c", "select 1 as a, 'x' as b, 2 + 3 as c")

# --- filters ----------------------------------------------------------------------------------

query("filter_cmp", "select o_orderkey, o_totalprice from orders where o_totalprice >= 200000 and o_orderstatus <> 'F'", lambda t: t.orders.where((c("o_totalprice") >= 200000) & (c("o_orderstatus") != "F")).select("o_orderkey", "o_totalprice"))
query("filter_and_or_not", "select p_partkey from part where (p_size < 5 or p_type = 'PROMO') and not p_brand = 'Brand#12'", lambda t: t.part.where(((c("p_size") < 5) | (c("p_type") == "PROMO")) & ~(c("p_brand") == "Brand#12")).select("p_partkey"))
query("filter_between", "select l_orderkey, l_linenumber from lineitem where l_discount between 0.02 and 0.04 and l_quantity between 10 and 20", lambda t: t.lineitem.where(c("l_discount").between(0.02, 0.04) & c("l_quantity").between(10, 20)).select("l_orderkey", "l_linenumber"))
query("filter_like", "select p_partkey, p_name from part where p_name like '%ring%'", lambda t: t.part.where(c("p_name").like("%ring%")).select("p_partkey", "p_name"))
query("filter_not_like", "select p_partkey, p_type from part where p_type not like 'M%'", lambda t: t.part.where(~c("p_type").like("M%")).select("p_partkey", "p_type"))
dialect("filter_like_escape", "select doc_id from documents where text like '%!%%' escape '!'", "select doc_id from documents where text like '%!%%' escape '!'", "documents")
query("filter_in", "select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH')", lambda t: t.orders.where(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey"))
query("filter_not_in", "select c_custkey from customer where c_mktsegment not in ('BUILDING', 'AUTOMOBILE')", lambda t: t.customer.where(~c("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).select("c_custkey"))
dialect("filter_regexp", "select p_partkey from part where regexp_matches(p_brand, '#[1-3][0-5]$')", "select p_partkey from part where p_brand regexp '#[1-3][0-5]$'", "part")
dialect("filter_glob", "select p_partkey, p_brand from part where p_brand glob 'Brand#[12]?'", "select p_partkey, p_brand from part where p_brand glob 'Brand#[12]?'", "part")
dialect("filter_not_glob", "select p_partkey from part where not (p_type glob 'S*')", "select p_partkey from part where p_type not glob 'S*'", "part")
dialect("filter_null", "select c_custkey from customer left join orders on c_custkey = o_custkey and o_orderdate >= timestamp '2001-06-01' where o_orderkey is null", "select c_custkey from customer left join orders on c_custkey = o_custkey and o_orderdate >= timestamp '2001-06-01' where o_orderkey isnull", "customer", "orders")
dialect("filter_not_null", "select count(*) as n from customer where c_name is not null and c_acctbal is not null", "select count(*) as n from customer where c_name notnull and c_acctbal not null", "customer")
query("col_col_filter", "select l_orderkey, l_linenumber from lineitem where l_suppkey = l_linenumber", lambda t: t.lineitem.where(c("l_suppkey") == c("l_linenumber")).select("l_orderkey", "l_linenumber"))
query("pred_arith", "select l_orderkey, l_linenumber from lineitem where l_quantity * l_discount > 4 and l_partkey + 1 > l_orderkey", lambda t: t.lineitem.where((c("l_quantity") * c("l_discount") > 4) & (c("l_partkey") + 1 > c("l_orderkey"))).select("l_orderkey", "l_linenumber"))
dialect("filter_dialect_operators", "select n_nationkey from nation where (n_nationkey % 2 = 0 and n_regionkey <> 1) or n_nationkey = 3", "select n_nationkey from nation where (n_nationkey % 2 == 0 && n_regionkey != 1) || n_nationkey == 3", "nation")
dialect("filter_bits", "select n_nationkey, n_nationkey << 2 as l, n_nationkey >> 1 as r from nation where n_nationkey % 3 = 1", "select n_nationkey, n_nationkey << 2 as l, n_nationkey >> 1 as r from nation where n_nationkey % 3 = 1", "nation")
query("filter_bind", "select o_orderkey from orders where o_totalprice > 300000 and o_orderstatus = 'O'", lambda t: t.engine("orders").sql("select o_orderkey from orders where o_totalprice > ?1 and o_orderstatus = ?2", [300000, "O"]))
dialect("filter_match", "select item_id from benchmark where regexp_matches(lower(text), '\\bthe\\b') and regexp_matches(lower(text), '\\bof\\b')", "select item_id from benchmark where text match 'the of'", "benchmark")
dialect("filter_collate", "select r_regionkey from region where lower(r_name) = 'asia'", "select r_regionkey from region where r_name collate UTF8_LCASE = 'asia'", "region")

# --- sub-queries ------------------------------------------------------------------------------

query("in_subquery", "select s_suppkey, s_name from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)", lambda t: t.supplier.join(t.nation.where("n_regionkey = 2"), c("s_nationkey") == c("n_nationkey"), "left_semi").select("s_suppkey", "s_name"))
query("exists", "select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 50)", lambda t: t.orders.join(t.lineitem.where("l_quantity = 50"), c("l_orderkey") == c("o_orderkey"), "left_semi").select("o_orderkey"))
query("not_exists", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderdate >= timestamp '2001-01-01')", lambda t: t.customer.join(t.orders.where("o_orderdate >= timestamp '2001-01-01'"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey"))
dialect("scalar_subquery", "select o_orderkey, o_totalprice from orders where o_totalprice = (select max(o_totalprice) from orders)", "select o_orderkey, o_totalprice from orders where o_totalprice = (select max(o_totalprice) from orders)", "orders")
dialect("correlated_subquery", "select o_orderkey, o_custkey from orders a where o_totalprice = (select max(o_totalprice) from orders b where b.o_custkey = a.o_custkey)", "select o_orderkey, o_custkey from orders a where o_totalprice = (select max(o_totalprice) from orders b where b.o_custkey = a.o_custkey)", "orders")
dialect("derived_table", "select seg, n from (select c_mktsegment as seg, count(*) as n from customer group by c_mktsegment) x where n > 10", "select seg, n from (select c_mktsegment as seg, count(*) as n from customer group by c_mktsegment) x where n > 10", "customer")
dialect("nested_derived", "select max(n) as m from (select k, count(*) as n from (select o_custkey % 10 as k from orders where o_totalprice > 1000) a group by k) b", "select max(n) as m from (select k, count(*) as n from (select o_custkey % 10 as k from orders where o_totalprice > 1000) a group by k) b", "orders")

# --- joins ------------------------------------------------------------------------------------

query("join_hash", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey", lambda t: t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name"))
dialect("join_comma", "select n_name, r_name from nation, region where n_regionkey = r_regionkey", "select n_name, r_name from nation, region where n_regionkey = r_regionkey", "nation", "region")
dialect("join_explicit", "select s_name, n_name from supplier s join nation n on s.s_nationkey = n.n_nationkey", "select s_name, n_name from supplier s join nation n on s.s_nationkey = n.n_nationkey", "supplier", "nation")
query("join_multi", "select r_name, count(*) as n from region, nation, customer, orders where r_regionkey = n_regionkey and n_nationkey = c_nationkey and c_custkey = o_custkey group by r_name", lambda t: t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n")))
query("join_using", "select doc_id, source, quality from documents join labels using (doc_id)", lambda t: t.documents.join(t.labels, ["doc_id"]).select("doc_id", "source", "quality"))
dialect("join_natural", "select doc_id, lang, toxic from documents natural join labels", "select doc_id, lang, toxic from documents natural join labels", "documents", "labels")
query("join_left", "select d.doc_id, quality from documents d left join labels l on d.doc_id = l.doc_id", lambda t: t.documents.join(t.labels, ["doc_id"], "left").select("doc_id", "quality"))
query("join_right", "select d.doc_id as a, l.doc_id as b from (select doc_id from documents where lang = 'de') d right join labels l on d.doc_id = l.doc_id", lambda t: t.documents.where("lang = 'de'").select(c("doc_id").alias("a")).join(t.labels.select(c("doc_id").alias("b")), c("a") == c("b"), "right"))
query("join_full", "select a.n_nationkey as a, b.n_nationkey as b from (select * from nation where n_nationkey < 15) a full join (select * from nation where n_nationkey > 8) b on a.n_nationkey = b.n_nationkey", lambda t: t.nation.where("n_nationkey < 15").select(c("n_nationkey").alias("a")).join(t.nation.where("n_nationkey > 8").select(c("n_nationkey").alias("b")), c("a") == c("b"), "full"))
query("join_cross", "select r_name, s_name from region cross join supplier", lambda t: t.region.crossJoin(t.supplier).select("r_name", "s_name"))
dialect("join_without_on", "select a.r_name as x, b.r_name as y from region a cross join region b", "select a.r_name as x, b.r_name as y from region a join region b", "region")
query("join_self", "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", lambda t: t.nation.alias("a").join(t.nation.alias("b"), (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("x"), c("b.n_name").alias("y")))
query("join_semi", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)", lambda t: t.customer.join(t.orders.where("o_totalprice > 400000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey"))
query("join_anti", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)", lambda t: t.part.join(t.lineitem.where("l_quantity > 45"), c("p_partkey") == c("l_partkey"), "left_anti").select("p_partkey"))
query("join_residual", "select l_orderkey, l_linenumber from lineitem join orders on l_orderkey = o_orderkey and l_extendedprice > o_totalprice / 2 and l_shipdate > o_orderdate + interval 100 day", lambda t: t.lineitem.join(t.orders, (c("l_orderkey") == c("o_orderkey")) & (c("l_extendedprice") > c("o_totalprice") / 2) & (c("l_shipdate") > c("o_orderdate") + F.expr("interval 100 days"))).select("l_orderkey", "l_linenumber"))
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("ne", "<>")):
    _sql = f"select a.n_nationkey as a, b.n_nationkey as b from nation a, nation b where a.n_regionkey {_op} b.n_regionkey"
    dialect(f"join_theta_{_name}", _sql, _sql, "nation")


def _bucketed(t: Tables) -> DataFrame:
    """Both sides bucketed on the join key: the join and the aggregate on it need no exchange."""
    spark = t.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, key, keep in (("orders", "o_orderkey", ["o_orderkey", "o_orderpriority"]), ("lineitem", "l_orderkey", ["l_orderkey", "l_quantity"])):
        bucketed(getattr(t, name).select(*keep), f"spindle_bucketed_{name}", n, [key], "overwrite")
    joined = spark.table("spindle_bucketed_orders").join(spark.table("spindle_bucketed_lineitem"), c("o_orderkey") == c("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.sum("l_quantity").alias("q"))


query("join_bucketed", "select o_orderkey, o_orderpriority, sum(l_quantity) as q from orders join lineitem on o_orderkey = l_orderkey group by 1, 2", _bucketed)

# --- aggregation ------------------------------------------------------------------------------

query("agg_global", "select count(*) as n, round(sum(l_extendedprice), 2) as s, round(avg(l_quantity), 6) as a, max(l_tax) as hi, min(l_discount) as lo from lineitem", lambda t: t.lineitem.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"), F.round(F.avg("l_quantity"), 6).alias("a"), F.max("l_tax").alias("hi"), F.min("l_discount").alias("lo")))
query("agg_group", "select l_returnflag, sum(l_quantity) as q, count(*) as n from lineitem group by l_returnflag", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n")))
query("agg_multi_key", "select l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) as a, max(l_shipdate) as d from lineitem group by 1, 2", lambda t: t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("a"), F.max("l_shipdate").alias("d")))
query("agg_expr", "select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as r from lineitem group by l_suppkey", lambda t: t.lineitem.groupBy("l_suppkey").agg(F.round(F.sum(revenue()), 2).alias("r")))
query("agg_of_agg_expr", "select l_linenumber, round(2 * avg(l_quantity + l_tax) + avg(l_discount), 6) as v, round(100.0 * sum(l_tax) / sum(l_quantity), 6) as w from lineitem group by l_linenumber", lambda t: t.lineitem.groupBy("l_linenumber").agg(F.round(2 * F.avg(c("l_quantity") + c("l_tax")) + F.avg("l_discount"), 6).alias("v"), F.round(100.0 * F.sum("l_tax") / F.sum("l_quantity"), 6).alias("w")))
dialect("agg_total", "select n_regionkey, coalesce(sum(cast(n_nationkey as double)), 0.0) as t from nation group by n_regionkey", "select n_regionkey, total(n_nationkey) as t from nation group by n_regionkey", "nation")
dialect("agg_total_empty", "select cast(0 as double) as t, cast(null as bigint) as s from region limit 1", "select total(n_nationkey) as t, cast(sum(n_nationkey) as bigint) as s from nation where n_nationkey < 0", "nation")
query("agg_mul", "select n_regionkey, product(n_nationkey + 1) as m from nation group by n_regionkey", lambda t: t.nation.groupBy("n_regionkey").agg(compat.mul(c("n_nationkey") + 1).alias("m")))
dialect("agg_mul_sql", "select n_regionkey, round(product((n_nationkey - 9) / 4), 6) as m from nation group by n_regionkey", "select n_regionkey, round(mul((n_nationkey - 9) / 4), 6) as m from nation group by n_regionkey", "nation")
query("agg_min_max_string", "select p_type, min(p_name) as lo, max(p_brand) as hi from part group by p_type", lambda t: t.part.groupBy("p_type").agg(F.min("p_name").alias("lo"), F.max("p_brand").alias("hi")))
query("agg_count_col", "select count(quality) as labelled, count(*) as n from documents left join labels using (doc_id)", lambda t: t.documents.join(t.labels, ["doc_id"], "left").agg(F.count("quality").alias("labelled"), F.count("*").alias("n")))
query("agg_count_distinct", "select l_returnflag, count(distinct l_suppkey) as s, count(distinct l_partkey) as p from lineitem group by l_returnflag", lambda t: t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("s"), F.countDistinct("l_partkey").alias("p")))
query("agg_having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12", lambda t: t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12"))
dialect("group_no_agg", "select distinct o_orderstatus, o_orderpriority from orders", "select o_orderstatus, o_orderpriority from orders group by o_orderstatus, o_orderpriority", "orders")
query("distinct_rows", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem", lambda t: t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct())
dialect("select_all", "select l_linestatus from lineitem where l_quantity = 7", "select all l_linestatus from lineitem where l_quantity = 7", "lineitem")

# --- order, limit -----------------------------------------------------------------------------

query("order_mixed", "select c_mktsegment, c_acctbal, c_custkey from customer order by c_mktsegment desc, c_acctbal asc, c_custkey limit 50", lambda t: t.customer.select("c_mktsegment", "c_acctbal", "c_custkey").orderBy(c("c_mktsegment").desc(), c("c_acctbal").asc(), "c_custkey").limit(50))
dialect("order_alias", "select l_suppkey, sum(l_quantity) as q from lineitem group by l_suppkey order by q desc, l_suppkey limit 10", "select l_suppkey, sum(l_quantity) as q from lineitem group by l_suppkey order by q desc, l_suppkey limit 10", "lineitem")
dialect("order_hidden", "select c_name from customer order by c_acctbal desc, c_custkey limit 20", "select c_name from customer order by c_acctbal desc, c_custkey limit 20", "customer")
query("topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25", lambda t: t.orders.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(25))
query("limit_total_order", "select p_partkey from part order by p_partkey limit 17", lambda t: t.part.select("p_partkey").orderBy("p_partkey").limit(17))
dialect("offset", "select p_partkey from part order by p_partkey limit 10 offset 30", "select p_partkey from part order by p_partkey limit 10 offset 30", "part")
dialect("offset_comma", "select p_partkey from part order by p_partkey limit 10 offset 30", "select p_partkey from part order by p_partkey limit 30, 10", "part")
dialect("distinct_ordered", "select distinct o_orderpriority from orders order by o_orderpriority limit 3", "select distinct o_orderpriority from orders order by o_orderpriority limit 3", "orders")

# --- set operations, conditionals, functions --------------------------------------------------

query("union", "select n_regionkey as k from nation union select s_nationkey from supplier", lambda t: t.nation.select(c("n_regionkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct())
query("union_all", "select n_regionkey as k from nation union all select s_nationkey from supplier", lambda t: t.nation.select(c("n_regionkey").alias("k")).unionAll(t.supplier.select("s_nationkey")))
query("intersect", "select c_nationkey as k from customer intersect select s_nationkey from supplier where s_acctbal > 5000", lambda t: t.customer.select(c("c_nationkey").alias("k")).intersect(t.supplier.where("s_acctbal > 5000").select("s_nationkey")))
query("except", "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000", lambda t: t.nation.select(c("n_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 5000").select("s_nationkey")))
query("case_when", "select p_partkey, case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size from part", lambda t: t.part.select("p_partkey", F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "medium").otherwise("large").alias("size")))
dialect("case_simple", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as s from orders", "select o_orderkey, case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as s from orders", "orders")
query("cast", "select p_partkey, cast(p_size as double) as d, cast(p_partkey as varchar) as s, cast(p_size as bigint) as b from part", lambda t: t.part.select("p_partkey", c("p_size").cast("double").alias("d"), c("p_partkey").cast("string").alias("s"), c("p_size").cast("long").alias("b")))
dialect("date_literal", "select count(*) as n from orders where o_orderdate >= timestamp '1995-10-11'", "select count(*) as n from orders where o_orderdate >= date('1995-10-11')", "orders")
dialect("date_add_modifier", "select count(*) as n from orders where o_orderdate >= timestamp '1995-10-11' and o_orderdate < timestamp '1996-11-13'", "select count(*) as n from orders where o_orderdate >= date('1995-10-11') and o_orderdate < date('1995-10-11', '+1 year', '+1 month', '+2 day')", "orders")
dialect("strftime_year", "select strftime(o_orderdate, '%Y-%m') as ym, count(*) as n from orders group by 1", "select strftime('%Y-%m', o_orderdate) as ym, count(*) as n from orders group by 1", "orders")
dialect("substr", "select substr(c_mktsegment, 1, 2) as code, count(*) as n from customer group by 1", "select substr(c_mktsegment, 1, 2) as code, count(*) as n from customer group by 1", "customer")

# --- external commands ------------------------------------------------------------------------

dialect("udx_cat", "select c_custkey, c_name as x from customer", "select c_custkey, F(c_name) as x from customer with F=\"cat\"", "customer")
dialect("udx_upper", "select l_orderkey, l_linenumber, lower(l_returnflag) as x from lineitem", "select l_orderkey, l_linenumber, F(l_returnflag) as x from lineitem with F=\"tr A-Z a-z\" collective by 1", "lineitem")
dialect("udx_multi_arg", "select o_orderkey, cast(o_orderkey * 2 as varchar) || '-' || o_orderpriority as x from orders", "select o_orderkey, G(o_orderkey, o_orderpriority) as x from orders with G=\"awk -F@ '{printf \"\"%d-%s\\n\"\", $1 * 2, $2}'\" input_col_delimiter '@'", "orders")
dialect("udx_multi_col", "select p_partkey, split_part(p_brand, '#', 1) as x, split_part(p_brand, '#', 2) as y from part", "select p_partkey, F(p_brand) as (x, y) from part with F=\"cat\" output_col_delimiter '#'", "part")
dialect("udx_explode", "select item_id, unnest(string_split(text, ' ')) as word from (select item_id, regexp_replace(trim(text), '\\s+', ' ', 'g') as text from benchmark)", "select item_id, F(regexp_replace(trim(text), '\\\\s+', ' ')) as word from benchmark with F=\"awk '{n=split($0,w,\"\" \"\"); for(i=1;i<=n;i++) print w[i]; print \"\"\"\"}'\" output_record_delimiter EMPTY_LINE -b 16", "benchmark")
dialect("udx_chain", "select o_orderkey, reverse(lower(o_orderpriority)) as x from orders", "select o_orderkey, A(B(o_orderpriority)) as x from orders with B=\"tr A-Z a-z\" A=\"rev\"", "orders")
dialect("udx_file_io", "select p_partkey, p_name as x from part", "select p_partkey, F(p_name) as x from part with F=\"cp /tmp/udx_in /tmp/udx_out\" input '/tmp/udx_in' output '/tmp/udx_out'", "part")
dialect("udx_all", "select count(*)::varchar as n from orders", "select F(o_orderkey) as n from orders with F=\"awk 'END {print NR}'\" -b all", "orders")
dialect("udx_two", "select p_partkey, lower(p_type) as a, length(p_name) as b from part", "select p_partkey, F(p_type) as a, cast(b as bigint) as b from (select p_partkey, p_type, G(p_name) as b from part with G=\"awk '{print length($0)}'\") x with F=\"tr A-Z a-z\"", "part")
dialect("udx_group", "select x, count(*) as n from (select lower(p_type) as x from part) t group by x", "select x, count(*) as n from (select F(p_type) as x from part with F=\"tr A-Z a-z\") t group by x", "part")
dialect("udx_join", "select o_orderkey, lower(c_mktsegment) as x from orders join customer on o_custkey = c_custkey where o_totalprice > 1000", "select o_orderkey, F(c_mktsegment) as x from orders, customer where o_custkey = c_custkey and o_totalprice > 1000 with F=\"tr A-Z a-z\"", "orders", "customer")
dialect("udx_over_aggregate", "select o_orderpriority, cast(count(*) * 10 as varchar) as x from orders group by o_orderpriority", "select o_orderpriority, F(count(*)) as x from orders group by o_orderpriority with F=\"awk '{print $1 * 10}'\"", "orders")
dialect("udx_arg_and_column", "select p_type, lower(p_type) as x from part", "select p_type, F(p_type) as x from part with F=\"tr A-Z a-z\"", "part")
dialect("udx_limit", "select c_custkey, lower(c_name) as x from customer order by c_custkey limit 5", "select c_custkey, F(c_name) as x from customer order by c_custkey limit 5 with F=\"tr A-Z a-z\"", "customer")
dialect("udx_unaligned", "select n_name as x from nation where n_name like '%1%'", "select F(n_name) as x from nation with F=\"grep 1\"", "nation")

# --- statements that write --------------------------------------------------------------------


def _ctas(t: Tables) -> DataFrame:
    """CREATE TABLE IF NOT EXISTS ... AS twice: the second appends."""
    e = t.engine("nation")
    e.execute("drop table if exists spindle_ctas")
    e.execute("create table if not exists spindle_ctas as select n_nationkey as k, n_name from nation where n_regionkey = 1 on host[[001-004]] partition by k chunk 2")
    e.execute("create table if not exists spindle_ctas as select n_nationkey, n_name from nation where n_regionkey = 2")
    return e.sql("select k, n_name from spindle_ctas")


def _insert(t: Tables) -> DataFrame:
    e = t.engine("region")
    e.execute("drop table if exists spindle_insert")
    e.execute("create table spindle_insert (k int primary key, name varchar(20))")
    e.execute("insert into spindle_insert select r_regionkey, r_name from region")
    e.execute("insert into spindle_insert values (100, 'NOWHERE')")
    return e.sql("select k, name from spindle_insert")


def _folder(t: Tables, name: str) -> str:
    return t.spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/" + name


def _import(t: Tables) -> DataFrame:
    """Written with a separator of two characters, loaded into a table partitioned by hash."""
    from ..sources import sink

    e = t.engine()
    e.execute("drop table if exists spindle_import")
    e.execute("create table spindle_import (k int, name text, customer int) partition by k chunk 4")
    path = _folder(t, "spindle_import_text")
    sink.write(t.orders.select("o_orderkey", "o_orderpriority", "o_custkey"), path, "@@", append=False)
    e.execute(f".import {path} spindle_import -column_separator @@")
    return e.sql("select k, name, customer from spindle_import")


def _import_replace(t: Tables) -> DataFrame:
    """Fields with line breaks and tabs, written as two characters each and read back by -replace."""
    e = t.engine()
    e.execute("drop table if exists spindle_import_replace")
    e.execute("create table spindle_import_replace (k int, text text)")
    path = _folder(t, "spindle_import_replace_text")
    line = F.concat_ws("\t", "p_partkey", F.concat("p_name", F.lit("\\n"), "p_type", F.lit("\\t"), "p_brand"))
    t.part.select(line).write.mode("overwrite").text(path)
    e.execute(f".import {path} spindle_import_replace -replace")
    return e.sql("select k, text from spindle_import_replace")


def _import_xml(t: Tables) -> DataFrame:
    """Records of XML files; a column's name is the end of its tags' path."""
    e = t.engine()
    e.execute("drop table if exists spindle_import_xml")
    e.execute("create table spindle_import_xml (key int, name text, seg text)")
    path = _folder(t, "spindle_import_xml_text")
    t.customer.select(c("c_custkey").alias("key"), c("c_name").alias("name"), c("c_mktsegment").alias("seg")).write.mode("overwrite").format("xml").option("rowTag", "customer").option("rootTag", "customers").save(path)
    e.execute(f".import {path} spindle_import_xml customer")
    return e.sql("select key, name, seg from spindle_import_xml")


def _temporary(t: Tables) -> DataFrame:
    """A TEMP table takes rows like any other."""
    e = t.engine("part")
    e.execute("drop table if exists spindle_temp")
    e.execute("create temp table spindle_temp (k int, name text)")
    e.execute("insert into spindle_temp select p_partkey, p_name from part")
    e.execute("insert into spindle_temp values (-1, 'none')")
    return e.sql("select k, name from spindle_temp")


def _indices(t: Tables) -> DataFrame:
    """An index is metadata that .indices lists."""
    e = t.engine("region")
    e.execute("drop table if exists spindle_indexed")
    e.execute("create table spindle_indexed as select r_regionkey as k, r_name as name from region")
    e.execute("create index spindle_index on spindle_indexed (name)")
    return e.sql(".indices spindle_indexed")


def _nodes(t: Tables) -> DataFrame:
    """Host ranges, written out."""
    from ..plans import nodes

    return t.spark.createDataFrame([(n,) for n in nodes.expand("host[[001-003]]")], "node string")


def _to_file(t: Tables) -> DataFrame:
    """A result goes to where .output points, with the separator that was set; read back as lines."""
    e = t.engine("orders")
    path = _folder(t, f"spindle_result_text_{uuid.uuid4().hex}")
    e.execute(f".output {path}")
    e.execute(".col_separator @@")
    e.emit(e.sql("select o_orderkey, o_orderpriority from orders"))
    return t.spark.read.text(path).select(c("value").alias("line"))


def _to_client(t: Tables) -> DataFrame:
    """What a client's stream receives."""
    e, out = t.engine("nation"), io.StringIO()
    e.emit(e.sql("select n_nationkey, n_name from nation order by n_nationkey"), out)
    return t.spark.createDataFrame([(line,) for line in out.getvalue().splitlines()], "line string")


def _db_api(t: Tables) -> DataFrame:
    """Rows by a cursor, with a bound parameter."""
    t.engine("nation")
    cursor = connect(t.spark).cursor().execute("select n_nationkey, n_name from nation where n_regionkey = ?1 order by n_nationkey", [2])
    return t.spark.createDataFrame(cursor.fetchmany(2) + cursor.fetchall(), "k long, name string")


def _settings(t: Tables) -> DataFrame:
    e = t.engine()
    e.execute(".col_separator \\t")
    return e.sql(".show").select(F.explode(F.split("result", "\n")).alias("setting"))


def _schema(t: Tables) -> DataFrame:
    """A table's statement, as it was given; .tables names the table."""
    e = t.engine()
    e.execute("drop table if exists spindle_described")
    e.execute("create table spindle_described (id int primary key, name text)")
    listed = e.sql(".tables").select(F.explode(F.split("result", "\n")).alias("line")).where("line = 'spindle_described'")
    return listed.unionAll(e.sql(".schema spindle_described").select("result"))


def _terms(t: Tables) -> DataFrame:
    """The terms of a full-text table: in how many rows, and how often, each stands."""
    e = t.engine("documents")
    for name in ("spindle_terms", "spindle_words"):
        e.execute(f"drop table if exists {name}")
    e.execute("create virtual table spindle_words using fts4 (body text)")
    e.execute("insert into spindle_words select text from documents")
    e.execute("create virtual table spindle_terms using fts4aux (spindle_words)")
    return e.sql("select term, col, documents as in_rows, occurrences from spindle_terms")


def _multi_step(t: Tables) -> DataFrame:
    """Intermediate tables in place of sub-queries, as in the five-step form of TPC-H 20."""
    e = t.engine("lineitem", "part", "supplier", "nation", "region")
    for k in range(1, 5):
        e.execute(f"drop table if exists spindle_step{k}")
    e.execute("create table spindle_step1 as select distinct p_partkey from part where p_name like 'small%'")
    e.execute("create table spindle_step2 as select l_partkey, l_suppkey, 0.5 * sum(l_quantity) as sum_quantity from lineitem where l_shipdate >= date('1996-01-01') and l_shipdate < date('1996-01-01', '+1 year') group by l_partkey, l_suppkey partition by l_partkey, l_suppkey chunk 8")
    e.execute("create table spindle_step3 as select ps_suppkey, ps_availqty, sum_quantity from (select l_partkey as ps_partkey, l_suppkey as ps_suppkey, sum(l_quantity) as ps_availqty from lineitem group by l_partkey, l_suppkey) ps, spindle_step1, spindle_step2 where p_partkey = ps_partkey and l_partkey = ps_partkey and l_suppkey = ps_suppkey")
    e.execute("create table spindle_step4 as select ps_suppkey from spindle_step3 where ps_availqty > sum_quantity group by ps_suppkey")
    return e.sql("select s_name from supplier, nation, region, spindle_step4 where s_suppkey = ps_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA'")


query("ctas_append", "select n_nationkey as k, n_name from nation where n_regionkey in (1, 2)", _ctas)
query("insert_select", "select cast(r_regionkey as bigint) as k, r_name as name from region union all select 100, 'NOWHERE'", _insert)
query("import_text", "select cast(o_orderkey as bigint) as k, o_orderpriority as name, cast(o_custkey as bigint) as customer from orders", _import)
query("import_replace", "select cast(p_partkey as bigint) as k, p_name || chr(10) || p_type || chr(9) || p_brand as text from part", _import_replace)
query("import_xml", "select cast(c_custkey as bigint) as key, c_name as name, c_mktsegment as seg from customer", _import_xml)
query("temp_table", "select cast(p_partkey as bigint) as k, p_name as name from part union all select -1, 'none'", _temporary)
query("create_index", "select 'name : spindle_index' as result", _indices)
query("node_ranges", "select * from (values ('host001'), ('host002'), ('host003')) v(node)", _nodes)
query("result_to_file", "select o_orderkey || '@@' || o_orderpriority as line from orders", _to_file)
query("result_to_client", "select n_nationkey || '|' || n_name as line from nation", _to_client)
query("db_api", "select cast(n_nationkey as bigint) as k, n_name as name from nation where n_regionkey = 2", _db_api)
query("show_settings", "select unnest(['row_sep : \\n', 'col_sep : \\t', 'output : stdout', 'chunk_num : 1', 'replica_num : 1']) as setting", _settings)
query("schema_tables", "select unnest(['spindle_described', 'create table spindle_described (id int primary key, name text);']) as line", _schema)
query("full_text_terms", "with w as (select row_number() over () n, text from documents), t as (select n, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) term from w), a as (select term, count(distinct n) in_rows, count(*) occurrences from t where term <> '' group by term) select term, unnest(['*', 'body']) as col, in_rows, occurrences from a", _terms)
