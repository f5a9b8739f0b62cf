"""User-defined functions: Arrow-batched scalar, aggregate, grouped, cogrouped and table functions, and SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import frame
from ..tables import load


@frame("udf_pandas_scalar", "select o_orderkey, o_totalprice * 2 + 1 as v from orders", "udf.pandas udf.arrow_eval")
def udf_pandas_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def line(x: pd.Series) -> pd.Series:
        return x * 2 + 1

    return load(spark, sf_dir, "orders").select("o_orderkey", line("o_totalprice").alias("v"))


@frame("udf_arrow_scalar", "select p_partkey, cast(length(p_name) as bigint) as n from part", "udf.arrow")
def udf_arrow_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("long")
    def size(x):
        import pyarrow.compute as pc

        return pc.cast(pc.utf8_length(x), "int64")

    return load(spark, sf_dir, "part").select("p_partkey", size("p_name").alias("n"))


@frame("udf_python", "select n_nationkey, n_name || '!' as v from nation", "udf.pickled")
def udf_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    shout = F.udf(lambda s: f"{s}!", "string", useArrow=False)
    return load(spark, sf_dir, "nation").select("n_nationkey", shout("n_name").alias("v"))


@frame("udf_grouped_agg", "select o_orderstatus, round(max(o_totalprice) - min(o_totalprice), 2) as spread from orders group by o_orderstatus", "udf.udaf")
def udf_grouped_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(spread("o_totalprice"), 2).alias("spread"))


@frame("udf_grouped_map", "select c_custkey, round(c_acctbal - avg(c_acctbal) over (partition by c_nationkey), 4) as off from customer", "udf.apply_in_pandas")
def udf_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def centred(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_custkey": pdf["c_custkey"], "off": (pdf["c_acctbal"] - pdf["c_acctbal"].mean()).round(4)})

    return load(spark, sf_dir, "customer").groupBy("c_nationkey").applyInPandas(centred, "c_custkey long, off double")


@frame("udf_cogrouped", "select n_regionkey as k, count(*) as nations, any_value(r_name) as name from nation join region on n_regionkey = r_regionkey group by n_regionkey", "udf.cogroup")
def udf_cogrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [a["n_regionkey"].iloc[0]], "nations": [len(a)], "name": [b["r_name"].iloc[0]]})

    a, b = load(spark, sf_dir, "nation").groupBy("n_regionkey"), load(spark, sf_dir, "region").groupBy("r_regionkey")
    return a.cogroup(b).applyInPandas(both, "k int, nations long, name string")


@frame("udf_map_in_arrow", "select s_suppkey, s_acctbal from supplier where s_acctbal > 0", "udf.map_in_arrow")
def udf_map_in_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    def positive(batches):
        import pyarrow.compute as pc

        for b in batches:
            yield b.filter(pc.greater(b.column("s_acctbal"), 0))

    rows = load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return rows.mapInArrow(positive, rows.schema)


@frame("udf_map_in_pandas", "select s_suppkey, s_acctbal + 1 as bal from supplier", "udf.map_in_pandas")
def udf_map_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def more(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"s_suppkey": f["s_suppkey"], "bal": f["s_acctbal"] + 1})

    return load(spark, sf_dir, "supplier").mapInPandas(more, "s_suppkey long, bal double")


@frame("udf_table_function", "select n_nationkey, cast(unnest(range(0, n_regionkey)) as int) as i from nation", "udf.udtf")
def udf_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="i: int")
    class UpTo:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("up_to", UpTo)
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("select n_nationkey, i from nation, lateral up_to(n_regionkey)")


@frame("udf_sql_function", "select n_nationkey, n_nationkey * n_nationkey + 1 as v from nation", "udf.sql")
def udf_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("create or replace temporary function square_plus(x int) returns int return x * x + 1")
    load(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("select n_nationkey, square_plus(n_nationkey) as v from nation")
