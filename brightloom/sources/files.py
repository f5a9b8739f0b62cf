"""Files in every built-in format: written, read back, pruned and evolved. Round trips go to the session's shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import add, frame
from ..tables import load


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a local one only in local mode, where it may be unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="brightloom-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def round_trip(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """df written in a format and read with its schema."""
    path = scratch(df.sparkSession)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path)


def _trip(kind: str, **options: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_trip(load(spark, sf_dir, "customer"), kind, **options)

    return build


#: Rows of one XML file. A task reads such files whole, as they can't be split; those of a few columns have about 25 MB then.
XML_ROWS = 100_000

for _kind, _options in {"parquet": {"compression": "zstd"}, "orc": {}, "json": {}, "csv": {"header": "true", "quote": '"', "escape": "\\"}, "xml": {"rowTag": "row", "maxRecordsPerFile": str(XML_ROWS)}}.items():
    add(f"io_{_kind}", _trip(_kind, **_options), "select * from customer", f"scan.{_kind} write.{_kind}")


@frame("io_csv_options", "select n_nationkey, n_name from nation", "scan.csv.options")
def io_csv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another delimiter, comments and nulls, without a header."""
    path = scratch(spark)
    rows = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows.write.csv(path, sep="|", nullValue="-")
    return spark.read.csv(path, sep="|", nullValue="-", comment="#", schema=rows.schema)


@frame("io_text", "select n_name as value from nation", "scan.text write.text")
def io_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    load(spark, sf_dir, "nation").select(F.col("n_name").alias("value")).write.text(path)
    return spark.read.text(path)


@frame("io_binary_file", "select true as readable", "scan.binary_file scan.metadata")
def io_binary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(f"{sf_dir}/region.parquet")
    return files.agg((F.min(F.length("content") - F.col("length")) == 0).alias("readable"))


@frame("io_partitioned", "select c_custkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'", "write.partitioned scan.partition_pruning")
def io_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    return spark.read.parquet(path).where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment")


@frame("io_bucketed", "select o_custkey, count(*) as n, max(c_acctbal) as bal from orders join customer on o_custkey = c_custkey group by o_custkey", "write.bucketed join.colocated")
def io_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed by the join key: neither join nor aggregate shuffles."""
    names = {k: f"bucketed_{k}_{uuid.uuid4().hex}" for k in ("orders", "customer")}
    load(spark, sf_dir, "orders").write.bucketBy(8, "o_custkey").sortBy("o_custkey").saveAsTable(names["orders"])
    load(spark, sf_dir, "customer").write.bucketBy(8, "c_custkey").sortBy("c_custkey").saveAsTable(names["customer"])
    o, c = spark.table(names["orders"]), spark.table(names["customer"])
    return o.join(c.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("bal"))


@frame("io_schema_evolution", "select n_nationkey as k, n_name as name, null::varchar as note from nation union all select r_regionkey, null, r_name from region", "scan.schema_evolution")
def io_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).write.parquet(path)
    load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("note")).write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", "true").parquet(path).select("k", "name", "note")


@frame("io_nested", "select n_nationkey, n_name, n_regionkey from nation", "scan.nested_pruning types.nested")
def io_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs, arrays and maps through Parquet; only the fields asked for are read."""
    path = scratch(spark)
    n = load(spark, sf_dir, "nation")
    n.select("n_nationkey", F.struct("n_name", F.array("n_regionkey").alias("regions")).alias("s"), F.create_map(F.lit("k"), "n_name").alias("m")).write.parquet(path)
    return spark.read.parquet(path).select("n_nationkey", F.col("s.n_name").alias("n_name"), F.col("s.regions")[0].alias("n_regionkey"))


@frame("io_overwrite_append", "select count(*) * 2 as n from region", "write.modes")
def io_overwrite_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    r = load(spark, sf_dir, "region")
    load(spark, sf_dir, "nation").write.parquet(path)
    r.write.mode("overwrite").parquet(path)
    r.write.mode("append").parquet(path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@frame("io_insert_table", "select r_regionkey, r_name from region where r_regionkey < 3", "write.insert ddl")
def io_insert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"inserted_{uuid.uuid4().hex}"
    load(spark, sf_dir, "region").createOrReplaceTempView("region")
    spark.sql(f"create table {name} (r_regionkey int, r_name string) using parquet")
    spark.sql(f"insert into {name} select r_regionkey, r_name from region where r_regionkey < 3")
    return spark.table(name)


@frame("io_file_metadata", "select true as named, count(*) as n from region", "scan.metadata_columns")
def io_file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "region").select("r_regionkey", "_metadata.file_name")
    return rows.agg(F.bool_and(F.col("file_name").endswith(".parquet")).alias("named"), F.count("*").alias("n"))


@frame("io_partition_empty", "select n_nationkey, case when n_regionkey > 1 then n_name end as part from nation", "expr.Empty2Null write.partitioned")
def io_partition_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty strings and nulls in the column that partitions a table: both come back as null."""
    path = scratch(spark)
    name = F.when(F.col("n_regionkey") > 1, F.col("n_name")).when(F.col("n_regionkey") == 1, F.lit(""))
    load(spark, sf_dir, "nation").select("n_nationkey", name.alias("part")).write.partitionBy("part").parquet(path)
    return spark.read.schema("n_nationkey int, part string").parquet(path)
