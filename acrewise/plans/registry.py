"""Registry of named queries: report id -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acrewise import params as P
from acrewise.plans import compare, demographics, employment, operator_checks, parcels, supply
from acrewise.session import ensure_checkpoint_dir
from acrewise.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]


def _wrap(fn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(Tables(spark, sf_dir), P.DEFAULT)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def _families():
    return [m.REPORTS for m in (employment, supply, parcels, compare, demographics, operator_checks)]


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for fam in _families():
        for name, fn in fam.items():
            out[name] = _wrap(fn)
    return out
