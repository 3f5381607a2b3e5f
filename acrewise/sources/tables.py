"""Scan the driver tables (S1). Catalyst prunes columns and pushes filters
into the parquet scan, so a reader only names the table."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession

from acrewise.session import plain_unions

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(table_path(sf_dir, name))


class Tables:
    """Lazy accessor: ``Tables(spark, dir).lineitem`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        plain_unions(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self._dfs: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            if name not in self._dfs:
                self._dfs[name] = read_table(self.spark, self.sf_dir, name)
            return self._dfs[name]
        raise AttributeError(name)


def view(fn):
    """Build a derived view once per ``Tables`` object: DataFrames are
    immutable, so every reference within a query can share one plan object
    (less driver-side plan construction)."""
    @functools.wraps(fn)
    def wrapper(t: Tables, *args, **kwargs):
        cache = t.__dict__.setdefault("_views", {})
        key = (fn.__module__, fn.__name__, args, tuple(sorted(kwargs.items())))
        if key not in cache:
            cache[key] = fn(t, *args, **kwargs)
        return cache[key]
    return wrapper
