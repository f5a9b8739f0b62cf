"""The star schema's tables as DataFrames and temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Registers the tables that a statement names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            load(spark, sf_dir, name).createOrReplaceTempView(name)
