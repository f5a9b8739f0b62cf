"""Projection, filters, sorting, limits, sampling, subqueries, pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import frame, sql
from ..tables import load

sql("project_expressions", "select o_orderkey, o_totalprice * 2 as twice, o_orderkey + 1 as next_key, upper(o_orderstatus) as status, o_orderpriority as priority from orders", covers="project")
sql("filter_compound", "select c_custkey, c_acctbal from customer where (c_acctbal > 5000 or c_mktsegment = 'BUILDING') and not c_nationkey = 3 and c_name is not null", covers="filter predicate.and predicate.or predicate.not predicate.isnotnull")
sql("filter_in_set", "select o_orderkey from orders where o_custkey % 40 in (1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37) and o_orderpriority not in ('1-URGENT')", covers="expr.InSet predicate.in")
sql("sort_nulls_multi", "select c_custkey, nullif(c_nationkey, 3) as nk, cast(row_number() over (order by nullif(c_nationkey, 3) desc nulls first, c_acctbal asc, c_custkey) as int) as place from customer order by nk desc nulls first, c_acctbal asc, c_custkey", covers="sort sort.nulls")
sql("limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25 offset 50", covers="limit.global limit.offset limit.local")
sql("top_k", "select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 50", covers="top_k limit.collect")
sql("distinct_rows", "select distinct o_orderstatus, o_orderpriority from orders", covers="distinct")
sql("having_filter", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12", covers="having")
sql("cte_chain", "with a as (select o_custkey, count(*) as n from orders group by o_custkey), b as (select n, count(*) as customers from a group by n) select n, customers from b where customers > 1", covers="cte")
sql("subquery_scalar", "select c_custkey, c_acctbal - (select avg(c_acctbal) from customer) > 0 as above from customer", covers="subquery.scalar")
sql("subquery_lateral", "select n_name, t.c_custkey, t.c_acctbal from nation, lateral (select c_custkey, c_acctbal from customer where c_nationkey = n_nationkey order by c_acctbal desc, c_custkey limit 2) t", covers="lateral")
sql("subquery_in_not_in", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P') and c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)", covers="subquery.in join.not_in")
sql("values_rows", "select a, b from (values (1, 'x'), (2, 'y'), (cast(null as int), 'z')) as t(a, b)", covers="local_table_scan")
sql("qualify_top", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) t where rn = 1", covers="qualify window_group_limit")
sql(
    "pivot_status",
    "select * from (select o_orderpriority, o_orderstatus, 1 as one from orders) pivot (sum(one) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))",
    "select o_orderpriority, cast(sum(case when o_orderstatus = 'F' then 1 end) as bigint) as f, cast(sum(case when o_orderstatus = 'O' then 1 end) as bigint) as o, cast(sum(case when o_orderstatus = 'P' then 1 end) as bigint) as p from orders group by o_orderpriority",
    covers="pivot",
)
sql(
    "unpivot_columns",
    "select s_suppkey, metric, value from (select s_suppkey, s_acctbal as bal, cast(s_nationkey as double) as nat from supplier) unpivot (value for metric in (bal, nat))",
    "select s_suppkey, 'bal' as metric, s_acctbal as value from supplier union all select s_suppkey, 'nat', cast(s_nationkey as double) from supplier",
    covers="unpivot",
)


@frame("range_source", "select cast(range as bigint) as id, cast(range % 7 as bigint) as m from range(0, 1000, 3)", "range")
def range_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 1000, 3).select("id", (F.col("id") % 7).alias("m"))


@frame("sample_bernoulli", "select true as within, true as repeatable", "sample")
def sample_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the rows, drawn twice with one seed: within four deviations of its expected size, and the same rows."""
    rows = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    one, two = (rows.sample(False, 0.1, seed=5).agg(F.count("*").alias("n"), F.sum(F.hash("*")).alias("h")) for _ in range(2))
    total = rows.agg(F.count("*").alias("all"))
    both = one.join(two.select(F.col("n").alias("m"), F.col("h").alias("g"))).join(total)
    return both.select((F.abs(F.col("n") - 0.1 * F.col("all")) < 4 * F.sqrt(0.09 * F.col("all"))).alias("within"), ((F.col("n") == F.col("m")) & (F.col("h") == F.col("g"))).alias("repeatable"))


@frame("sample_split", "select o_orderkey, 1 as n from orders", "sample.split")
def sample_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of randomSplit, put together again: each row is in one of them."""
    a, b = load(spark, sf_dir, "orders").select("o_orderkey").randomSplit([0.7, 0.3], seed=5)
    return a.unionAll(b).groupBy("o_orderkey").agg(F.count("*").cast("int").alias("n"))


@frame("sample_stratified", "select o_orderstatus, true as within from (select distinct o_orderstatus from orders where o_orderstatus <> 'P')", "sample.by")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sampleBy with a fraction for each status; P has none."""
    orders = load(spark, sf_dir, "orders")
    share = {"F": 0.5, "O": 0.2, "P": 0.0}
    got = orders.sampleBy("o_orderstatus", share, seed=3).groupBy("o_orderstatus").count()
    size = orders.groupBy("o_orderstatus").agg(F.count("*").alias("all"))
    p = F.when(F.col("o_orderstatus") == "F", 0.5).otherwise(0.2)
    return got.join(size, "o_orderstatus").select("o_orderstatus", (F.abs(F.col("count") - p * F.col("all")) < 4 * F.sqrt(0.25 * F.col("all"))).alias("within"))


@frame("coalesce_repartition", "select count(*) as n, true as few, true as many from orders", "coalesce exchange.hash exchange.range exchange.round_robin")
def coalesce_repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    few = orders.repartition(8).coalesce(2).select(F.spark_partition_id().alias("p")).agg((F.max("p") < 2).alias("few"))
    many = orders.repartitionByRange(4, "o_orderkey").select(F.spark_partition_id().alias("p")).agg((F.count_distinct("p") == 4).alias("many"))
    return orders.repartition(4, "o_custkey").agg(F.count("*").alias("n")).join(few).join(many)


@frame("cache_table", "select o_orderstatus, count(*) as n from orders group by o_orderstatus", "in_memory_table_scan")
def cache_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = load(spark, sf_dir, "orders").select("o_orderstatus").persist()
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@frame("transpose_small", "select 'ASIA' as key, cast((select r_regionkey from region where r_name = 'ASIA') as int) as region", "transpose")
def transpose_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = load(spark, sf_dir, "region").select("r_name", "r_regionkey").transpose()
    return wide.select(F.lit("ASIA").alias("key"), F.col("ASIA").cast("int").alias("region"))


@frame("sample_replacement", "select true as within, true as repeatable, true as repeated", "sample.replacement")
def sample_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the rows, drawn with replacement: within four deviations of its expected size, the same with one seed, and some rows twice."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey")
    drawn = rows.sample(True, 0.5, seed=5)
    one = drawn.agg(F.count("*").alias("n"), F.sum(F.hash("*")).alias("h"), F.count_distinct("o_orderkey").alias("d"))
    two = rows.sample(True, 0.5, seed=5).agg(F.count("*").alias("m"), F.sum(F.hash("*")).alias("g"))
    both = one.join(two).join(rows.agg(F.count("*").alias("all")))
    within = F.abs(F.col("n") - 0.5 * F.col("all")) < 4 * F.sqrt(0.5 * F.col("all"))
    return both.select(within.alias("within"), ((F.col("n") == F.col("m")) & (F.col("h") == F.col("g"))).alias("repeatable"), (F.col("d") < F.col("n")).alias("repeated"))


@frame("sample_bounds", "select o_orderkey, 1 as n from orders", "sample.bounds")
def sample_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts between bounds of one random draw: each row is in one of them."""
    parts = load(spark, sf_dir, "orders").select("o_orderkey").randomSplit([0.1, 0.2, 0.3, 0.4], seed=9)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    return every.groupBy("o_orderkey").agg(F.count("*").cast("int").alias("n"))


@frame("observe_metrics", "select count(*) as rows, max(o_totalprice) as top, count(distinct o_orderstatus) as statuses from orders", "metrics.observe")
def observe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the greatest price, observed while another result is computed; both come from one read."""
    from pyspark.sql import Observation

    seen = Observation("orders")
    orders = load(spark, sf_dir, "orders").observe(seen, F.count(F.lit(1)).alias("rows"), F.max("o_totalprice").alias("top"))
    n = orders.agg(F.count_distinct("o_orderstatus")).first()[0]
    return spark.createDataFrame([(seen.get["rows"], seen.get["top"], n)], "rows long, top double, statuses long")
