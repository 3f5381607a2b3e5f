"""Worker demographics (WD1-WD8 estimates, WD9-WD22 cross-tab sheets).

Persons are filtered to workers, income is inflated to reference-year
dollars and binned, then weighted counts / shares / medians with
replicate-weight MOEs are estimated by county and for the region in one
pass each, and reshaped into the fourteen sheets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import labels as L
from acrewise.operators.reshape import columns_matching, order_by_labels, pivot_wider, unpivot_long
from acrewise.operators.survey import weighted_counts, weighted_medians
from acrewise.sources import fixtures as fx
from acrewise.sources.readers import read_microdata
from acrewise.sources.sinks import intermediates, materialized, save_sheets
from acrewise.sources.tables import Tables

# Survey year of the run, and the published annual averages of
# the consumer price index (CPI-U, all items) that dollars are inflated by.
DATA_YEAR = 2011
DOLLAR_REFYEAR = 2021
CPI_U = {2011: 224.939, 2012: 229.594, 2013: 232.957, 2014: 236.736, 2015: 237.017, 2016: 240.007,
         2017: 245.120, 2018: 251.107, 2019: 255.657, 2020: 258.811, 2021: 270.970}
INCOME_FACTOR = CPI_U[DOLLAR_REFYEAR] / CPI_U[DATA_YEAR]


def real_dollars(value: Column, year: Column, refyear: int = DOLLAR_REFYEAR) -> Column:
    """a value in dollars of ``refyear``, by the index of the row's data
    year; NULL for a year the index table does not hold."""
    factor = F.lit(None).cast("double")
    for y, index in CPI_U.items():
        factor = F.when(year == y, CPI_U[refyear] / index).otherwise(factor)
    return value * factor


COUNTY_LEVELS = P.COUNTY_ORDER
KEYS = {"prace": "PRACE", "ed_attain": "ED_ATTAIN", "pincp2021_bin": "PINCP2021_BIN"}


PERSON_VARIABLES = ["person_id", "county", "prace", "ed_attain", "cow", "pincp", "mi_jobsector"]


def workers(t: Tables, persons: DataFrame | None = None) -> DataFrame:
    """F26 + P16 + X5: workers only, PINCP2021, income bin, industrial flag.
    ``persons``: the microdata, if not the fixture view."""
    p = fx.persons(t) if persons is None else persons
    p = p.filter(F.col("cow").isNotNull() & ~F.col("cow").rlike("^Unemployed"))
    p = p.withColumn("pincp2021", real_dollars(F.col("pincp"), F.lit(DATA_YEAR)))
    return p.select(
        F.lit(DATA_YEAR).alias("DATA_YEAR"),
        F.col("county").alias("COUNTY"), F.col("prace").alias("PRACE"), F.col("ed_attain").alias("ED_ATTAIN"),
        F.col("mi_jobsector").alias("MI_JOBSECTOR"),
        F.col("pincp2021").alias("PINCP2021"),
        L.income_bin("pincp2021", "pincp").alias("PINCP2021_BIN"),
        F.when(F.col("mi_jobsector").isNotNull(), "Industrial").otherwise("Non-Industrial").alias("industrial"),
        "pwgtp", *[f"pwgtp{r}" for r in range(1, P.N_REPLICATES + 1)])


def combined_counts(w: DataFrame, key: str) -> DataFrame:
    """Counts by county and for the region (COUNTY = 'Region')."""
    est = weighted_counts(w, [["COUNTY", "industrial", key], ["industrial", key]],
                          ["COUNTY", "industrial", key])
    est = est.withColumn("COUNTY", F.coalesce("COUNTY", F.lit("Region"))).drop("_level")
    return order_by_labels(est.select(F.lit(DATA_YEAR).alias("DATA_YEAR"), "*"), "COUNTY", COUNTY_LEVELS)


def sector_counts(w: DataFrame, key: str) -> DataFrame:
    est = weighted_counts(w, [["MI_JOBSECTOR", key]], ["MI_JOBSECTOR", key]).drop("_level")
    return est.select(F.lit(DATA_YEAR).alias("DATA_YEAR"), F.lit("Region").alias("COUNTY"), "*")


def combined_median(w: DataFrame, target: str = "PINCP2021") -> DataFrame:
    """Medians by county and for the region."""
    est = weighted_medians(w, target, [["COUNTY", "industrial"], ["industrial"]], ["COUNTY", "industrial"])
    est = est.withColumn("COUNTY", F.coalesce("COUNTY", F.lit("Region"))).drop("_level")
    return order_by_labels(est.select(F.lit(DATA_YEAR).alias("DATA_YEAR"), "*"), "COUNTY", COUNTY_LEVELS)


def sector_median(w: DataFrame, target: str = "PINCP2021") -> DataFrame:
    est = weighted_medians(w, target, [["MI_JOBSECTOR"]], ["MI_JOBSECTOR"]).drop("_level")
    return est.select(F.lit(DATA_YEAR).alias("DATA_YEAR"), F.lit("Region").alias("COUNTY"), "*")


def wd1_files(t, prm=P.DEFAULT):
    """WD1 from a microdata file, read by its variable list."""
    path = f"{intermediates(t.spark)}/microdata-{hashlib.sha1(t.sf_dir.encode()).hexdigest()[:16]}"
    fx.persons(t).write.mode("overwrite").parquet(path)
    return combined_counts(workers(t, read_microdata(t.spark, path, PERSON_VARIABLES)), "PRACE")


def wd1_region(t, prm=P.DEFAULT):
    """The cross-tab of estimates that hold the region alone: it stays long."""
    return xtab(combined_counts(_w(t), "PRACE").filter(F.col("COUNTY") == "Region"), "count", region_only=True)


def xtab(data: DataFrame, stat: str, region_only: bool = False) -> DataFrame:
    """Keep ``stat`` and ``stat_moe`` (NA -> 0), then sectors or
    counties become columns '<name>_<stat>' with value and MOE side by side."""
    cols = data.columns
    key = None if "_median" in stat else next((c for c in ("PRACE", "ED_ATTAIN", "PINCP2021_BIN") if c in cols), None)
    measures = columns_matching(data, r"^(count|share|PINCP2021_median)(_moe)?$")
    ids = [c for c in cols if c not in measures and c != "DATA_YEAR"]
    long = unpivot_long(data.drop("DATA_YEAR"), ids, measures)
    long = long.filter(F.col("var_name").isin(stat, f"{stat}_moe")).withColumn("value", F.coalesce("value", F.lit(0.0)))
    if region_only:  # no county to spread over columns: one row per value
        return long
    if "MI_JOBSECTOR" in cols:
        id_cols = [key] if key else [c for c in ids if c != "MI_JOBSECTOR"]
        return pivot_wider(long, id_cols, ["MI_JOBSECTOR", "var_name"], "value")
    names = [f"{c}_{v}" for c in COUNTY_LEVELS for v in (stat, f"{stat}_moe")]
    id_cols = ["industrial"] + ([key] if key else [])
    return pivot_wider(long, id_cols, ["COUNTY", "var_name"], "value", names)


def _w(t):
    return workers(t)


def wd1(t, prm=P.DEFAULT):
    return combined_counts(_w(t), "PRACE")


def wd2(t, prm=P.DEFAULT):
    return combined_counts(_w(t), "ED_ATTAIN")


def wd3(t, prm=P.DEFAULT):
    return combined_counts(_w(t), "PINCP2021_BIN")


def wd4(t, prm=P.DEFAULT):
    return sector_counts(_w(t), "PRACE")


def wd5(t, prm=P.DEFAULT):
    return sector_counts(_w(t), "ED_ATTAIN")


def wd6(t, prm=P.DEFAULT):
    return sector_counts(_w(t), "PINCP2021_BIN")


def wd7(t, prm=P.DEFAULT):
    return combined_median(_w(t))


def wd8(t, prm=P.DEFAULT):
    return sector_median(_w(t))


_EST = [wd1, wd2, wd3, wd4, wd5, wd6, wd7, wd8]
# sheet -> (estimate, statistic), in the order of the original workbook
SHEETS = ([(i, "share") for i in range(0, 3)] + [(i, "count") for i in range(0, 3)]
          + [(i, "share") for i in range(3, 6)] + [(i, "count") for i in range(3, 6)]
          + [(6, "PINCP2021_median"), (7, "PINCP2021_median")])


def _sheet(n):
    est, stat = SHEETS[n]

    def run(t, prm=P.DEFAULT):
        # the eight estimates are built once per session and shared by the
        # sheets (the original kept them in one list)
        data = materialized(t.spark, ("wd_estimate", est, t.sf_dir), lambda: _EST[est](t, prm))
        return xtab(data, stat)
    run.__name__ = f"sheet{n + 1}"
    run.__doc__ = f"Sheet{n + 1}: {stat} cross-tab of WD{est + 1}."
    return run


REPORTS = {f"WD{i + 1}": f for i, f in enumerate(_EST)}
REPORTS.update({"WD1_files": wd1_files, "WD1_region": wd1_region})
REPORTS.update({f"WD{9 + n}": _sheet(n) for n in range(len(SHEETS))})


def write_workbook(t: Tables, out_dir: str, prm=P.DEFAULT) -> list[str]:
    """The fourteen cross-tabs as sheets Sheet1..Sheet14, one CSV
    directory each (the workbook of the original)."""
    sheets = {f"Sheet{n + 1}": _sheet(n)(t, prm) for n in range(len(SHEETS))}
    return save_sheets(sheets, out_dir)
