"""The benchmark's queries on the columns that the tables have. Money is summed as DECIMAL, so results don't depend on order."""

from __future__ import annotations

from ..registry import sql


def total(expr: str, scale: int = 4) -> str:
    return f"cast(sum(cast({expr} as decimal(18,{scale}))) as double)"


REVENUE = total("l_extendedprice * (1 - l_discount)")

sql("tpch_q1", f"""
select l_returnflag, l_linestatus, {total('l_quantity', 2)} as sum_qty, {total('l_extendedprice', 2)} as sum_base_price, {REVENUE} as sum_disc_price,
       {total('l_extendedprice * (1 - l_discount) * (1 + l_tax)', 6)} as sum_charge, round(avg(l_quantity), 4) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= timestamp '2001-09-02 00:00:00' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""", covers="scan.parquet filter hash_aggregate sort project agg.sum agg.avg agg.count")

sql("tpch_q3", f"""
select l_orderkey, {REVENUE} as revenue, o_orderdate from customer, orders, lineitem
where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < timestamp '1998-03-15 00:00:00' and l_shipdate > timestamp '1998-03-15 00:00:00'
group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""", covers="join.inner top_k")

sql("tpch_q4", """
select o_orderpriority, count(*) as order_count from orders
where o_orderdate >= timestamp '1997-07-01 00:00:00' and o_orderdate < timestamp '1997-10-01 00:00:00'
  and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate > o_orderdate) group by o_orderpriority order by o_orderpriority""", covers="join.exists join.left_semi subquery.correlated")

sql("tpch_q5", f"""
select n_name, {REVENUE} as revenue from customer, orders, lineitem, supplier, nation, region
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey
  and r_name = 'ASIA' and o_orderdate >= timestamp '1996-01-01 00:00:00' and o_orderdate < timestamp '1999-01-01 00:00:00' group by n_name order by revenue desc, n_name""", covers="join.inner join.broadcast_hash")

sql("tpch_q6", f"""
select {total('l_extendedprice * l_discount')} as revenue from lineitem
where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1997-01-01 00:00:00' and l_discount between 0.0499 and 0.0701 and l_quantity < 24""", covers="filter aggregate.global predicate.between")

sql("tpch_q7", f"""
select supp_nation, cust_nation, l_year, {total('volume')} as revenue from (
  select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as int) as l_year, l_extendedprice * (1 - l_discount) as volume
  from supplier, lineitem, orders, customer, nation n1, nation n2
  where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey
    and ((n1.n_name = 'NATION_1' and n2.n_name = 'NATION_2') or (n1.n_name = 'NATION_2' and n2.n_name = 'NATION_1'))) shipping
group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year""", covers="join.self subquery.from")

sql("tpch_q8", """
select o_year, cast(sum(case when nation = 'NATION_3' then volume else 0 end) as double) / cast(sum(volume) as double) as mkt_share from (
  select cast(extract(year from o_orderdate) as int) as o_year, cast(l_extendedprice * (1 - l_discount) as decimal(18,4)) as volume, n2.n_name as nation
  from part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey
    and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey and p_type = 'ECONOMY') all_nations group by o_year order by o_year""", covers="conditional.case")

sql("tpch_q10", f"""
select c_custkey, c_name, {REVENUE} as revenue, c_acctbal, n_name from customer, orders, lineitem, nation
where c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate >= timestamp '1997-10-01 00:00:00' and o_orderdate < timestamp '1998-01-01 00:00:00' and l_returnflag = 'R' and c_nationkey = n_nationkey
group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""", covers="top_k")

sql("tpch_q12", """
select l_linestatus, cast(sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end) as bigint) as high_line_count,
       cast(sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end) as bigint) as low_line_count
from orders, lineitem where o_orderkey = l_orderkey and l_returnflag in ('R', 'A') and l_shipdate >= timestamp '1997-01-01 00:00:00' and l_shipdate < timestamp '1998-01-01 00:00:00'
group by l_linestatus order by l_linestatus""", covers="predicate.in")

sql("tpch_q13", """
select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left outer join orders on c_custkey = o_custkey and o_orderpriority <> '5-LOW' group by c_custkey) c_orders
group by c_count order by custdist desc, c_count desc""", covers="join.left_outer")

sql("tpch_q14", f"""
select 100.00 * {total("case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end")} / {REVENUE} as promo_revenue
from lineitem, part where l_partkey = p_partkey and l_shipdate >= timestamp '1997-09-01 00:00:00' and l_shipdate < timestamp '1997-10-01 00:00:00'""", covers="predicate.like")

sql("tpch_q15", f"""
with revenue as (select l_suppkey as supplier_no, {REVENUE} as total_revenue from lineitem where l_shipdate >= timestamp '1996-01-01 00:00:00' and l_shipdate < timestamp '1996-04-01 00:00:00' group by l_suppkey)
select s_suppkey, s_name, total_revenue from supplier, revenue where s_suppkey = supplier_no and total_revenue = (select max(total_revenue) from revenue) order by s_suppkey""", covers="cte subquery.scalar")

sql("tpch_q17", f"""
select {total('l_extendedprice', 2)} / 7.0 as avg_yearly from lineitem, part
where p_partkey = l_partkey and p_brand = 'Brand#23' and l_quantity < (select 0.6 * avg(l_quantity) from lineitem where l_partkey = p_partkey)""", covers="subquery.correlated_scalar")

sql("tpch_q18", f"""
select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {total('l_quantity', 2)} as sum_qty from customer, orders, lineitem
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 220) and c_custkey = o_custkey and o_orderkey = l_orderkey
group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderkey limit 100""", covers="subquery.in having")

sql("tpch_q19", f"""
select coalesce({REVENUE}, 0.0) as revenue from lineitem, part where p_partkey = l_partkey and (
  (p_brand = 'Brand#12' and l_quantity between 1 and 21 and p_size between 1 and 25) or (p_brand = 'Brand#23' and l_quantity between 10 and 30 and p_size between 1 and 30)
  or (p_brand = 'Brand#4' and l_quantity between 20 and 40 and p_size between 1 and 45))""", covers="predicate.or")

sql("tpch_q21", """
select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation
where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and l1.l_returnflag = 'R'
  and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey)
  and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R')
  and s_nationkey = n_nationkey and n_regionkey = 2 group by s_name order by numwait desc, s_name limit 100""", covers="join.left_anti join.not_exists")

sql("tpch_q22", """
select cntrycode, count(*) as numcust, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as totacctbal from (
  select substring(c_name, 17, 2) as cntrycode, c_acctbal, c_custkey from customer
  where substring(c_name, 17, 2) in ('13', '31', '23', '29', '30', '18', '17') and c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.00)) custsale
where not exists (select 1 from orders where o_custkey = c_custkey) group by cntrycode order by cntrycode""", covers="fn.substring")
