"""Union, intersect, except, with and without duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import frame, sql
from ..tables import load

A, B = "select c_nationkey as k from customer", "select s_nationkey as k from supplier"
sql("set_union_all", f"select k, count(*) as n from ({A} union all {B}) t group by k", covers="union")
sql("set_union", f"{A} union {B}", covers="union.distinct")
sql("set_intersect", f"{A} intersect {B}", covers="intersect")
sql("set_intersect_all", f"select k, count(*) as n from ({A} intersect all {B}) t group by k", covers="intersect.all")
sql("set_except", f"select n_nationkey as k from nation except {B}", covers="except")
sql("set_except_all", f"select k, count(*) as n from ({A} except all {B}) t group by k", covers="except.all")


@frame("set_union_by_name", "select n_nationkey as k, n_name as name, cast(null as int) as region from nation union all select r_regionkey, r_name, r_regionkey from region", "union.by_name")
def set_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    two = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))
    return one.unionByName(two, allowMissingColumns=True)


@frame("drop_duplicates_subset", "select o_custkey, count(*) as n from (select distinct o_custkey, o_orderstatus from orders) t group by o_custkey", "distinct.subset")
def drop_duplicates_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").dropDuplicates(["o_custkey", "o_orderstatus"]).groupBy("o_custkey").agg(F.count("*").alias("n"))
