"""Reshaping: pivots, unpivot, total rows, label order."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_fixed(df: DataFrame, rows: Sequence[str], key: str, values: Sequence, value: str,
                agg: str = "max") -> DataFrame:
    """``PIVOT (agg(value) FOR key IN (values))`` grouped by ``rows``."""
    fn = {"max": F.max, "sum": F.sum, "first": F.first}[agg]
    return df.groupBy(*rows).pivot(key, list(values)).agg(fn(value))


def unpivot_long(df: DataFrame, ids: Sequence[str], measures: Sequence[str],
                 name: str = "var_name", value: str = "value") -> DataFrame:
    """pivot_longer over the measure columns."""
    return df.unpivot(list(ids), list(measures), name, value)


def pivot_wider(df: DataFrame, ids: Sequence[str], names_from: Sequence[str], value: str,
                name_values: Sequence[str] | None = None, sep: str = "_") -> DataFrame:
    """pivot_wider with names glued from several columns; with
    ``name_values`` the output columns come in that order ('slowest')."""
    key = F.concat_ws(sep, *[F.col(c) for c in names_from])
    g = df.withColumn("_name", key).groupBy(*ids)
    g = g.pivot("_name", list(name_values)) if name_values is not None else g.pivot("_name")
    return g.agg(F.first(value))


def with_total_row(df: DataFrame, label_col: str, label: str, sums: Sequence[str],
                   null_propagating: bool = True) -> DataFrame:
    """Append a total row; like R's ``sum`` without na.rm a
    NULL anywhere makes the total NULL."""
    aggs = []
    for c in sums:
        s = F.sum(c)
        if null_propagating:
            s = F.when(F.count(c) < F.count(F.lit(1)), F.lit(None)).otherwise(s)
        aggs.append(s.alias(c))
    tot = df.agg(*aggs).select(F.lit(label).alias(label_col), *sums)
    return df.unionByName(tot.select(*df.columns))


def order_by_labels(df: DataFrame, col: str, labels: Sequence[str]) -> DataFrame:
    """O2: order rows by a fixed label order (factor levels)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(col))
    return df.orderBy(pos, col)


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Column names matching a regular expression (schema only)."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]
