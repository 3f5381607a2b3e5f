"""Gross and net land supply (GS1-GS6, NS9-NS13, plus a union-mask GS1).

The original multiplies polygon layers with ``JOIN ... ON 1=1`` and lets
the geometry functions return zero for disjoint pairs. Here only pairs
and triples whose boxes overlap are formed (grid-cell equi-joins); the
counts the cross joins multiplied by become scalar subqueries, and the
zero cells are filled from the label sets (``pivot_filled``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import geometry as geo
from acrewise.operators.areas import (erase_each, erase_union_area, pair_areas, pivot_filled,
                                      snap_sqft)
from acrewise.sources import layers
from acrewise.sources.tables import Tables

ACRE = P.SQFT_PER_ACRE
NON_IND = "Non-Industrial"
SEG_LABELS = (*P.SEGMENTS_2015,)


# ----------------------------------------------------------------- layers
def four_counties(t: Tables) -> DataFrame:
    return layers.counties_layer(t).filter(F.col("county_fip").isin(*P.COUNTY_FIPS))


def water(t: Tables) -> DataFrame:
    """Largest water bodies: masks of order 0."""
    return layers.masks_layer(t).filter(F.col("mask_order") == 0).select("mask_id", "rings")


def exclusions_2013(t: Tables) -> DataFrame:
    """2013 exclusion layer: every other mask."""
    return layers.masks_layer(t).filter(F.col("mask_order") != 0).select("mask_id", "rings")


def inventory_2015(t: Tables) -> DataFrame:
    """2015 inventory: zones with the older segment names."""
    z = layers.zones_layer(t)
    seg = (F.when(F.col("ind_type") == "Military Industrial", "Military")
           .when(F.col("ind_type").isin(*P.SEGMENTS_2015), F.col("ind_type")))
    return z.select("zone_id", seg.alias("segment"), "rings")


def net_2013(t: Tables) -> DataFrame:
    """2013 net supply layer: parcel shapes with a net flag."""
    p = layers.parcels_layer(t)
    k = F.col("parcel_row") % 3
    flag = F.when(k == 0, "vacant").when(k == 1, "redevelopable").otherwise("developed")
    return p.select(F.col("parcel_row").alias("net_id"), flag.alias("net_flag"), "rings")


def rgeo_factor_sum(t: Tables, metro: float = P.URBAN_FACTOR_SQL, other: float = P.SUBURBAN_FACTOR_SQL) -> Column:
    """Σ over regional-geography rows of the Metro factor: what
    ``LEFT JOIN rg ON 1=1`` multiplies each area by (D12). Empty -> one NULL row."""
    rg = layers.rgeo_layer(t)
    agg = rg.select(F.count(F.lit(1)).alias("n"),
                    F.sum(F.when(F.col("class_desc") == "Metro", metro).otherwise(other)).alias("s"))
    return agg.select(F.when(F.col("n") == 0, F.lit(other)).otherwise(F.col("s"))).scalar()


def _count(df: DataFrame) -> Column:
    return df.select(F.count(F.lit(1))).scalar()


def _acres(sqft: Column, digits: int = 2, factor: float | Column | None = None) -> Column:
    v = snap_sqft(sqft) / ACRE
    if factor is not None:
        v = v * factor
    return F.round(v, digits)


# ---------------------------------------------------------------- reports
def gs1(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Industrial acres by county and type, water erased per water body."""
    c = four_counties(t)
    z = layers.zones_layer(t)
    e = erase_each(c, "county_key", z, "zone_id", water(t), "mask_id", prm)
    v = (e.join(c.select("county_key", "county_nm"), "county_key")
         .join(z.select("zone_id", "ind_type"), "zone_id")
         .groupBy("county_nm", "ind_type").agg(_acres(F.sum("area")).alias("acres")))
    return pivot_filled(v, "county_nm", "ind_type", "acres", P.IND_TYPES_2023,
                        c.select("county_nm").distinct(), z.select("ind_type"))


def gs1_union(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """GS1 with every water acre erased once (masks as one union)."""
    c = four_counties(t)
    z = layers.zones_layer(t)
    e = erase_union_area(c, "county_key", water(t), "mask_id", z, "zone_id", prm)
    v = (e.join(c.select("county_key", "county_nm"), "county_key")
         .join(z.select("zone_id", "ind_type"), "zone_id")
         .groupBy("county_nm", "ind_type").agg(_acres(F.sum("area")).alias("acres")))
    return pivot_filled(v, "county_nm", "ind_type", "acres", P.IND_TYPES_2023,
                        c.select("county_nm").distinct(), z.select("ind_type"))


def gs2(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Industrial acres by MIC and type; untyped inventory -> Non-Industrial."""
    m = layers.mic_layer(t).filter(F.col("mic").isNotNull()).withColumnRenamed("zone_id", "mic_id")
    z = layers.zones_layer(t).withColumn("ind_type", F.coalesce("ind_type", F.lit(NON_IND)))
    e = erase_each(m, "mic_id", z, "zone_id", water(t), "mask_id", prm)
    v = (e.join(m.select("mic_id", "mic"), "mic_id").join(z.select("zone_id", "ind_type"), "zone_id")
         .groupBy("mic", "ind_type").agg(_acres(F.sum("area")).alias("acres")))
    return pivot_filled(v, "mic", "ind_type", "acres", (*P.IND_TYPES_2023, NON_IND),
                        m.select("mic").distinct(), z.select("ind_type"))


def gs3(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """MIC acres without water, per overlapping water body (objectid <> 1).
    A centre that meets no water body keeps one row (objectid NULL) with its
    whole area; its disjoint pairs would only repeat that row."""
    m = layers.mic_layer(t).filter(F.col("mic").isNotNull()).withColumnRenamed("zone_id", "mic_id")
    w = water(t).filter(F.col("mask_id") != 1)
    pa = pair_areas(m, "mic_id", w, "mask_id", prm).filter(F.col("area") > 0)
    marea = m.select("mic_id", "mic", geo.area("rings").alias("_ma"))
    out = marea.join(pa, "mic_id", "left").select(
        "mic", F.col("mask_id").alias("objectid"),
        F.round(snap_sqft(F.col("_ma") - F.coalesce("area", F.lit(0.0))) / ACRE, 6).alias("acres"))
    return out.orderBy("mic", "objectid")


def gs4(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """MIC acres inclusive."""
    m = layers.mic_layer(t).filter(F.col("mic").isNotNull())
    return m.select("mic", F.round(geo.area("rings") / ACRE, 2).alias("acres")).orderBy("mic")


def gs5(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """2015 inventory acres by county and segment, water erased."""
    c = four_counties(t)
    i = inventory_2015(t)
    w = water(t)
    e = erase_each(c, "county_key", i, "zone_id", w, "mask_id", prm)
    v = (e.join(c.select("county_key", "county_nm"), "county_key")
         .join(i.select("zone_id", "segment"), "zone_id")
         .groupBy("county_nm", "segment").agg(_acres(F.sum("area")).alias("acres")))
    rows = c.select("county_nm").distinct().filter(_count(w) > 0)   # inner JOIN on water
    return pivot_filled(v, "county_nm", "segment", "acres", SEG_LABELS, rows, i.select("segment"))


def gs6(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """2015 inventory acres by MIC and segment, water erased."""
    m = layers.mic_layer(t).filter(F.col("mic").isNotNull()).withColumnRenamed("zone_id", "mic_id")
    i = inventory_2015(t).withColumn("segment", F.coalesce("segment", F.lit(NON_IND)))
    w = water(t)
    e = erase_each(m, "mic_id", i, "zone_id", w, "mask_id", prm)
    v = (e.join(m.select("mic_id", "mic"), "mic_id").join(i.select("zone_id", "segment"), "zone_id")
         .groupBy("mic", "segment").agg(_acres(F.sum("area")).alias("acres")))
    rows = m.select("mic").distinct().filter(_count(w) > 0)
    return pivot_filled(v, "mic", "segment", "acres", (*SEG_LABELS, NON_IND), rows, i.select("segment"))


def ns9(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """2013 comparison: county x net flag, exclusions erased, Metro factor."""
    c = four_counties(t)
    n = net_2013(t)
    ex = exclusions_2013(t)
    e = erase_each(c, "county_key", n, "net_id", ex, "mask_id", prm)
    f = rgeo_factor_sum(t)
    v = (e.join(c.select("county_key", "county_nm"), "county_key").join(n.select("net_id", "net_flag"), "net_id")
         .groupBy("net_flag", "county_nm").agg(_acres(F.sum("area"), factor=f).alias("acres")))
    return pivot_filled(v, "county_nm", "net_flag", "acres", P.NET_FLAGS_2013,
                        c.select("county_nm").distinct(), n.select("net_flag"))


def ns10(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """2013 comparison: MIC x net flag (exclusion layer joined but unused)."""
    m = layers.mic_layer(t).withColumnRenamed("zone_id", "mic_id")
    n = net_2013(t)
    k = _count(exclusions_2013(t)) * rgeo_factor_sum(t)
    v = (pair_areas(m, "mic_id", n, "net_id", prm)
         .join(m.select("mic_id", "mic"), "mic_id").join(n.select("net_id", "net_flag"), "net_id")
         .groupBy("net_flag", "mic").agg(_acres(F.sum("area"), factor=k).alias("acres")))
    rows = m.select("mic").distinct().filter(_count(exclusions_2013(t)) > 0)
    return pivot_filled(v, "mic", "net_flag", "acres", P.NET_FLAGS_2013, rows, n.select("net_flag"))


def ns11(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """2013 estimate: county x net flag, Metro factor."""
    c = four_counties(t)
    n = net_2013(t)
    f = rgeo_factor_sum(t)
    v = (pair_areas(c, "county_key", n, "net_id", prm)
         .join(c.select("county_key", "county_nm"), "county_key").join(n.select("net_id", "net_flag"), "net_id")
         .groupBy("net_flag", "county_nm").agg(_acres(F.sum("area"), factor=f).alias("acres")))
    return pivot_filled(v, "county_nm", "net_flag", "acres", P.NET_FLAGS_2013,
                        c.select("county_nm").distinct(), n.select("net_flag"))


def ns12(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """2013 estimate: regional class x net flag, factor 0.9."""
    rg = layers.rgeo_layer(t)
    n = net_2013(t)
    v = (pair_areas(rg, "rgeo_id", n, "net_id", prm)
         .join(rg.select("rgeo_id", "class_desc"), "rgeo_id").join(n.select("net_id", "net_flag"), "net_id")
         .groupBy("net_flag", "class_desc").agg(_acres(F.sum("area"), factor=0.9).alias("acres")))
    return pivot_filled(v, "class_desc", "net_flag", "acres", P.NET_FLAGS_2013,
                        rg.select("class_desc").distinct(), n.select("net_flag"))


def ns13(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """2013 estimate: MIC x net flag, water erased, factor 0.88."""
    m = layers.mic_layer(t).withColumnRenamed("zone_id", "mic_id")
    n = net_2013(t)
    e = erase_each(m, "mic_id", n, "net_id", water(t), "mask_id", prm)
    v = (e.join(m.select("mic_id", "mic"), "mic_id").join(n.select("net_id", "net_flag"), "net_id")
         .groupBy("net_flag", "mic").agg(_acres(F.sum("area"), factor=P.URBAN_FACTOR_SQL).alias("acres")))
    return pivot_filled(v, "mic", "net_flag", "acres", P.NET_FLAGS_2013,
                        m.select("mic").distinct(), n.select("net_flag"))


REPORTS = {"GS1": gs1, "GS1_union": gs1_union, "GS2": gs2, "GS3": gs3, "GS4": gs4, "GS5": gs5,
           "GS6": gs6, "NS9": ns9, "NS10": ns10, "NS11": ns11, "NS12": ns12, "NS13": ns13}
