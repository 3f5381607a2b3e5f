"""Suppressed employment cross-tabs: aggregate, suppress, pivot.

``PIVOT (max(v) FOR k IN (...))`` over a grouped, suppressed CTE: the inputs
of the rule are summed by (row labels, cell) from the finest cells, the rule
is a scalar on that small result, and the pivot runs on it. ``CUBE(year, a,
b) HAVING year IS NOT NULL`` keeps the year in every grouping set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise.functions.suppress import suppression_merge, suppression_rule


def suppressed_crosstab(base: DataFrame, rows: Sequence[str | Column],
                        cells: Sequence[tuple[str, str]], grouping: str = "plain",
                        key: Column | None = None) -> DataFrame:
    """Suppressed cross-tab of cells that hold the rule's inputs.

    ``key`` names the pivot cell of a row, e.g. the year or 'county,year';
    ``cells`` lists the cells shown: rows in unlisted cells still make their
    group appear (with NULL cells), as PIVOT does.
    """
    row_cols = [F.col(r) if isinstance(r, str) else r for r in rows]
    b = base.select(*row_cols, key.cast("string").alias("_cell"), "_s_cov", "_s_priv", "_s_rp", "_m_rp", "_s_rpc")
    names = b.columns[:len(rows)]
    if grouping == "cube":
        sets = [[n for n, keep in zip(names, mask) if keep]
                for mask in _subsets(len(names))]
        g = b.groupingSets([["_cell", *s_] for s_ in sets], "_cell", *names)
        agg = g.agg(*suppression_merge(), F.grouping_id().alias("_gid"))
        by = [*names, "_gid"]
    elif grouping == "plain":
        agg = b.groupBy("_cell", *names).agg(*suppression_merge())
        by = names
    else:
        raise ValueError(grouping)
    cellv = agg.select(*by, "_cell", suppression_rule().alias("_v"))
    piv = cellv.groupBy(*by).pivot("_cell", [n for n, _ in cells]).agg(F.first("_v"))
    return piv.select(*names, *[F.col(f"`{n}`") for n, _ in cells])


def _subsets(n: int):
    """All keep-masks of n columns, full set first (CUBE order)."""
    out = []
    for m in range(2 ** n - 1, -1, -1):
        out.append([bool(m >> (n - 1 - i) & 1) for i in range(n)])
    return out


def year_key(year_col: str = "data_year") -> Column:
    return F.col(year_col)


def header_key(county_col: str = "county_id", year_col: str = "data_year", sep: str = ",") -> Column:
    return F.concat_ws(sep, F.col(county_col).cast("string"), F.col(year_col).cast("string"))


def year_cells(years: Sequence[int], year_col: str = "data_year") -> list[tuple[str, str]]:
    return [(str(y), f"{year_col} = {int(y)}") for y in years]


def header_cells(counties: Sequence[int], years: Sequence[int], county_col: str = "county_id",
                 year_col: str = "data_year", sep: str = ",") -> list[tuple[str, str]]:
    """R2: the 'county,year' header pivot (county-major order)."""
    return [(f"{c}{sep}{y}", f"{county_col} = {int(c)} AND {year_col} = {int(y)}")
            for c in counties for y in years]
