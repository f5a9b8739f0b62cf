"""Queries by name, what part of the inventory each covers, and the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .tables import views

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    oracle: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def add(name: str, build: Build, oracle: str | None, covers: str) -> None:
    if name in REGISTRY:
        raise ValueError(f"two queries are named {name}")
    REGISTRY[name] = Query(name, build, oracle, tuple(covers.split()))


def sql(name: str, text: str, oracle: str | None = None, covers: str = "") -> None:
    """A query written in SQL; oracle: the comparison's wording where it differs."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    add(name, build, oracle or text, covers)


def frame(name: str, oracle: str | None, covers: str) -> Callable[[Build], Build]:
    """A query written with the DataFrame API."""

    def keep(build: Build) -> Build:
        add(name, build, oracle, covers)
        return build

    return keep
