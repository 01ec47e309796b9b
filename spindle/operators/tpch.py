"""The 22 TPC-H shapes over the driver's tables, in the engine's SQL.

The tables lack PartSupp, comments, ship modes and commit dates; the shapes keep their operators
(correlated minima, EXISTS, self joins, CASE, anti joins, ...) on the columns there are.
"""

from __future__ import annotations

from .relational import ORACLE_SQL, QUERIES, Tables, _multi_step, query

_PS = "(select l_partkey ps_partkey, l_suppkey ps_suppkey, sum(l_quantity) ps_availqty, min(l_extendedprice) ps_supplycost from lineitem group by l_partkey, l_suppkey)"

SHAPES: dict[str, str] = {
    "q01": "select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice), 2) sum_base_price, round(sum(l_extendedprice*(1-l_discount)), 2) sum_disc_price, round(sum(l_extendedprice*(1-l_discount)*(1+l_tax)), 2) sum_charge, round(avg(l_quantity), 4) avg_qty, round(avg(l_extendedprice), 4) avg_price, round(avg(l_discount), 6) avg_disc, count(*) count_order from lineitem where l_shipdate <= timestamp '1998-12-01' group by l_returnflag, l_linestatus",
    "q02": f"with ps as {_PS}, j as (select s_acctbal,s_name,n_name,p_partkey,ps_supplycost from part join ps on p_partkey=ps_partkey join supplier on s_suppkey=ps_suppkey join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey where r_name='ASIA' and p_size<=25 and p_type like '%LARGE%') select s_acctbal,s_name,n_name,p_partkey from j where ps_supplycost=(select min(ps_supplycost) from j k where k.p_partkey=j.p_partkey)",
    "q03": "select l_orderkey, round(sum(l_extendedprice*(1-l_discount)), 2) revenue, o_orderdate from customer, orders, lineitem where c_mktsegment = 'AUTOMOBILE' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < timestamp '1998-10-11' and l_shipdate > timestamp '1998-10-11' group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10",
    "q04": "select o_orderpriority, count(*) order_count from orders where o_orderdate>=timestamp '1996-07-01' and o_orderdate<timestamp '1996-10-01' and exists (select 1 from lineitem where l_orderkey=o_orderkey and l_shipdate>o_orderdate + interval 60 day) group by o_orderpriority",
    "q05": "select n_name, round(sum(l_extendedprice*(1-l_discount)), 2) revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'EUROPE' and o_orderdate >= timestamp '1995-10-11' and o_orderdate < timestamp '1996-10-11' group by n_name",
    "q06": "select round(sum(l_extendedprice*l_discount), 2) revenue from lineitem where l_shipdate >= timestamp '1995-10-11' and l_shipdate < timestamp '1996-10-11' and l_discount between 0.09 and 0.11 and l_quantity < 50",
    "q07": "select n1.n_name a,n2.n_name b,year(l_shipdate) y, round(sum(l_extendedprice*(1-l_discount)),2) r from supplier,lineitem,orders,customer,nation n1,nation n2 where s_suppkey=l_suppkey and o_orderkey=l_orderkey and c_custkey=o_custkey and s_nationkey=n1.n_nationkey and c_nationkey=n2.n_nationkey and ((n1.n_name='NATION_1' and n2.n_name='NATION_3') or (n1.n_name='NATION_3' and n2.n_name='NATION_1')) group by 1,2,3",
    "q08": "select year(o_orderdate) y, round(sum(case when n2.n_name='NATION_1' then l_extendedprice*(1-l_discount) else 0 end)/sum(l_extendedprice*(1-l_discount)),6) s from part,supplier,lineitem,orders,customer,nation n1,nation n2,region where p_partkey=l_partkey and s_suppkey=l_suppkey and l_orderkey=o_orderkey and o_custkey=c_custkey and c_nationkey=n1.n_nationkey and n1.n_regionkey=r_regionkey and r_name='AMERICA' and s_nationkey=n2.n_nationkey and p_type='ECONOMY' group by 1",
    "q09": "select n_name, year(o_orderdate) y, round(sum(l_extendedprice*(1-l_discount)),2) p from part,supplier,lineitem,orders,nation where s_suppkey=l_suppkey and p_partkey=l_partkey and o_orderkey=l_orderkey and s_nationkey=n_nationkey and p_name like '%ring%' group by 1,2",
    "q10": "select c_custkey, c_name, round(sum(l_extendedprice*(1-l_discount)), 2) revenue, c_acctbal, n_name from customer, orders, lineitem, nation where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= timestamp '1995-10-01' and o_orderdate < timestamp '1996-04-01' and l_returnflag = 'R' and c_nationkey = n_nationkey group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20",
    "q11": f"with ps as {_PS}, v as (select ps_partkey, sum(ps_supplycost*ps_availqty) v from ps join supplier on ps_suppkey=s_suppkey join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey where r_name='ASIA' group by ps_partkey) select ps_partkey, round(v,2) v from v where v>(select sum(v)*0.001 from v)",
    "q12": "select o_orderpriority, cast(sum(case when o_orderpriority in ('1-URGENT','2-HIGH') then 1 else 0 end) as bigint) h, count(*) c from orders join lineitem on o_orderkey=l_orderkey where l_shipdate<o_orderdate+interval 30 day group by 1",
    "q13": "select c_count, count(*) custdist from (select c_custkey, count(o_orderkey) c_count from customer left join orders on c_custkey=o_custkey and o_orderpriority<>'1-URGENT' group by 1) x group by 1",
    "q14": "select round(100.0*sum(case when p_type like 'PROMO%' then l_extendedprice*(1-l_discount) else 0 end)/sum(l_extendedprice*(1-l_discount)),4) r from lineitem join part on l_partkey=p_partkey where l_shipdate>=timestamp '1995-10-11' and l_shipdate<timestamp '1995-11-11'",
    "q15": "with revenue as (select l_suppkey supplier_no, round(sum(l_extendedprice*(1-l_discount)), 2) total_revenue from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1996-04-01' group by l_suppkey) select s_suppkey, s_name, total_revenue from supplier join revenue on s_suppkey = supplier_no where total_revenue = (select max(total_revenue) from revenue)",
    "q16": f"with ps as {_PS} select p_brand,p_type,p_size,count(distinct ps_suppkey) c from ps join part on p_partkey=ps_partkey where p_brand<>'Brand#12' and p_type not like 'MEDIUM%' and p_size in (49,14,23,45,19,3,36,9) and ps_suppkey not in (select s_suppkey from supplier where s_acctbal<0) group by 1,2,3",
    "q17": "select round(sum(l_extendedprice)/7.0,2) a from lineitem join part on p_partkey=l_partkey where p_brand='Brand#12' and l_quantity<(select 0.2*avg(l2.l_quantity) from lineitem l2 where l2.l_partkey=p_partkey)",
    "q18": "select c_name,c_custkey,o_orderkey,o_totalprice,sum(l_quantity) q from customer,orders,lineitem where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity)>200) and c_custkey=o_custkey and o_orderkey=l_orderkey group by 1,2,3,4",
    "q19": "select round(sum(l_extendedprice*(1-l_discount)),2) r, count(*) c from lineitem, part where (p_partkey=l_partkey and p_brand='Brand#12' and l_quantity between 1 and 11 and p_size between 1 and 15) or (p_partkey=l_partkey and p_brand='Brand#13' and l_quantity between 10 and 20 and p_size between 1 and 30)",
    "q20": f"with ps as {_PS} select s_name from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey where r_name='ASIA' and s_suppkey in (select ps_suppkey from ps where ps_partkey in (select p_partkey from part where p_name like 'small%') and ps_availqty>(select 0.5*sum(l_quantity) from lineitem where l_partkey=ps_partkey and l_suppkey=ps_suppkey and l_shipdate>=timestamp '1996-01-01' and l_shipdate<timestamp '1997-01-01'))",
    "q21": "select s_name,count(*) c from supplier,lineitem l1,orders,nation where s_suppkey=l1.l_suppkey and o_orderkey=l1.l_orderkey and o_orderstatus='F' and l1.l_shipdate>o_orderdate+interval 60 day and exists (select 1 from lineitem l2 where l2.l_orderkey=l1.l_orderkey and l2.l_suppkey<>l1.l_suppkey) and not exists (select 1 from lineitem l3 join orders o3 on l3.l_orderkey=o3.o_orderkey where l3.l_orderkey=l1.l_orderkey and l3.l_suppkey<>l1.l_suppkey and l3.l_shipdate>o3.o_orderdate+interval 60 day) and s_nationkey=n_nationkey group by 1",
    "q22": "select substr(c_mktsegment,1,2) code,count(*) n, round(sum(c_acctbal),2) t from customer where c_acctbal>(select avg(c_acctbal) from customer where c_acctbal>0) and not exists (select 1 from orders where o_custkey=c_custkey and o_orderdate>=timestamp '2001-01-01') group by 1",
}

#: Literals of the dialect's own date function, where a shape uses them in the reference form.
_DIALECT = {
    "q05": {"timestamp '1995-10-11'": "date('1995-10-11')", "timestamp '1996-10-11'": "date('1995-10-11', '+1 year')"},
    "q06": {"timestamp '1995-10-11'": "date('1995-10-11')", "timestamp '1996-10-11'": "date('1995-10-11', '+1 year')"},
    "q10": {"timestamp '1995-10-01'": "date('1995-10-01')", "timestamp '1996-04-01'": "date('1995-10-01', '+6 month')"},
}


def text(name: str) -> str:
    sql = SHAPES[name]
    for a, b in _DIALECT.get(name, {}).items():
        sql = sql.replace(a, b)
    return sql


for _name in SHAPES:
    query(f"tpch_{_name}", SHAPES[_name], lambda t, n=_name: t.engine("region", "nation", "customer", "supplier", "part", "orders", "lineitem").sql(text(n)))
query("tpch_q20_steps", SHAPES["q20"], _multi_step)

__all__ = ["ORACLE_SQL", "QUERIES", "SHAPES", "Tables", "text"]
