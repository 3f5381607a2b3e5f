"""Parcel net supply (NS1-NS8): repeated ids, improved and unimproved
parcels with the one-pass flag, the tagged parcel table and net acres.

The source ran this as MySQL inserts, a file hand-off and SQL Server
updates; here it is one lazy DAG. Tagging by four polygon layers (zones,
counties, MICs, regional geographies) is a single point-in-polygon join
over the union of the layers, then a conditional min per layer (D10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import geometry as geo
from acrewise.functions import labels as L
from acrewise.operators.areas import erase_union_area, erase_union_parts, erase_union_polygons, snap_sqft
from acrewise.operators.polygons import measured
from acrewise.operators.spatial import point_in_polygon_pairs
from acrewise.sources import fixtures as fx
from acrewise.sources import layers
from acrewise.sources.sinks import materialized
from acrewise.sources.tables import Tables

PID = "fiprcl_id"


def repeated_ids(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """NS1: parcel ids that occur more than once."""
    return (fx.parcels(t).groupBy(F.col("parcel_id").alias(PID)).count()
            .filter(F.col("count") > 1).select(PID))


def _parcel_base(t: Tables) -> DataFrame:
    p = fx.parcels(t)
    cx = F.round((F.col("x0") + F.col("x1")) / 2, 2).cast("decimal(11,2)")
    cy = F.round((F.col("y0") + F.col("y1")) / 2, 2).cast("decimal(11,2)")
    return p.select(F.col("parcel_id").alias(PID), F.col("gross_sqft").cast("decimal(18,2)").alias("gross_sqft"),
                    "land_use_type_id", cx.alias("x_coord_sp"), cy.alias("y_coord_sp"))


def improved(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """NS2: parcels with buildings, Σ improvement value, one-pass flag.
    Buildings are summed per parcel before the join (partial aggregation)."""
    b = fx.buildings(t).groupBy(F.col("parcel_id").alias(PID)).agg(
        F.sum("improvement_value").alias("impval"))
    p = _parcel_base(t).join(repeated_ids(t), PID, "left_anti").join(b, PID)
    return p.select(PID, "gross_sqft", "impval", L.flag_preset_mysql("impval", "gross_sqft").alias("flag"),
                    "land_use_type_id", "x_coord_sp", "y_coord_sp")


def unimproved(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """NS3: parcels without buildings: value 0, flag 'v'."""
    b = fx.buildings(t).select(F.col("parcel_id").alias(PID))
    p = _parcel_base(t).join(b, PID, "left_anti").join(repeated_ids(t), PID, "left_anti")
    return p.select(PID, "gross_sqft", F.lit(0).cast("bigint").alias("impval"), F.lit("v").alias("flag"),
                    "land_use_type_id", "x_coord_sp", "y_coord_sp")


def parcel_values(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """The prclbldg table, improved ∪ unimproved."""
    return improved(t, prm).unionByName(unimproved(t, prm))


def tag_layers(t: Tables) -> DataFrame:
    """The four tagging layers as one layer: (tag_fid, kind, label, rings)."""
    def fid(kind, key):
        return F.concat_ws(":", F.lit(kind), F.col(key).cast("string")).alias("tag_fid")
    z = layers.zones_layer(t).select(fid("ind", "zone_id"), F.lit("ind").alias("kind"),
                                     L.zone_class_for_parcel("ind_type").alias("label"), "rings")
    c = (layers.counties_layer(t).filter(F.col("county_fip").isin(*P.COUNTY_FIPS))
         .select(fid("county", "county_key"), F.lit("county").alias("kind"), F.col("county_fip").alias("label"),
                 "rings"))
    m = layers.mic_layer(t).select(fid("mic", "zone_id"), F.lit("mic").alias("kind"), F.col("mic").alias("label"),
                                   "rings")
    r = layers.rgeo_layer(t).select(fid("urban", "rgeo_id"), F.lit("urban").alias("kind"),
                                    L.urban_flag("class_desc", "juris").alias("label"), "rings")
    allx = z.unionByName(c).unionByName(m).unionByName(r)
    return allx


def industrial_parcels(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """NS4: the tagged parcel table (ilx_indprcl23), materialized once per
    session since NS5-NS8 all read it."""
    return materialized(t.spark, ("ilx", t.sf_dir, prm), lambda: build_industrial_parcels(t, prm))


def build_industrial_parcels(t: Tables, prm=P.DEFAULT) -> DataFrame:
    v = parcel_values(t, prm)
    pts = v.select(PID, F.col("x_coord_sp").cast("double").alias("x"), F.col("y_coord_sp").cast("double").alias("y"))
    tl = tag_layers(t)
    pairs = point_in_polygon_pairs(pts, PID, "x", "y", tl, "tag_fid", "rings", prm.cell_size, prm.band_width)
    lab = pairs.join(tl.select("tag_fid", "kind", "label"), "tag_fid")
    tags = lab.groupBy(PID).agg(
        F.min(F.when((F.col("kind") == "ind") & (F.col("label") != ""), F.col("label"))).alias("ind_type"),
        F.min(F.when(F.col("kind") == "county", F.col("label"))).cast("smallint").alias("county_id"),
        F.min(F.when(F.col("kind") == "mic", F.col("label"))).alias("mic"),
        F.min(F.when(F.col("kind") == "urban", F.col("label"))).alias("urban"))
    x = v.join(tags.filter(F.col("ind_type").isNotNull()), PID)
    ratio = F.try_divide(F.col("impval").cast("decimal(20,0)"), F.col("gross_sqft"))
    return x.select(
        PID, "ind_type", "county_id", "mic", "impval", "gross_sqft",
        F.col("land_use_type_id").cast("smallint").alias("land_use_type_id"),
        L.flag_preset_tsql("flag", "impval", "gross_sqft").alias("flag"),
        F.when(F.col("gross_sqft") > 0, ratio).otherwise(F.lit(0)).cast("decimal(11,2)").alias("value_ratio"),
        "urban")


def orphans(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """NS5: tagged parcels missing from their source table (expect 0)."""
    x = industrial_parcels(t, prm)
    return x.join(parcel_values(t, prm), PID, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def net_parcel_areas(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Parcel polygons with every exclusion mask erased
    (prcl23_netx): (fiprcl_id, net_area); materialized once per session."""
    return materialized(t.spark, ("netx", t.sf_dir, prm), lambda: build_net_parcel_areas(t, prm))


def build_net_parcel_areas(t: Tables, prm=P.DEFAULT) -> DataFrame:
    p = layers.parcels_layer(t)
    a = erase_union_area(p, "parcel_row", layers.masks_layer(t), "mask_id", prm=prm)
    return a.join(p.select("parcel_row", F.col("parcel_id").alias(PID)), "parcel_row") \
        .select(PID, snap_sqft(F.col("area")).alias("net_area"))


def net_parcel_polygons(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """The net parcel polygons themselves, (parcel_row, rings), one row
    per part; saved once."""
    return materialized(t.spark, ("netx_polygons", t.sf_dir, prm), lambda: erase_union_parts(
        layers.parcels_layer(t).select("parcel_row", "rings"), "parcel_row", layers.masks_layer(t), "mask_id", prm))


def net_polygons_measured(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """S17 polygons by parcel: area and extent."""
    box = geo.bbox("rings")
    parts = net_parcel_polygons(t, prm).select("parcel_row", geo.area("rings").alias("a"), box.alias("b"))
    return parts.groupBy("parcel_row").agg(snap_sqft(F.sum("a")).alias("net_area"), F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"),
                                           F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax"))


def net_polygons_assembled(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """The net parcels as one polygon row each, with holes."""
    p = layers.parcels_layer(t).select("parcel_row", "rings")
    return measured(erase_union_polygons(p, "parcel_row", layers.masks_layer(t), "mask_id", prm), ["parcel_row"])


def _net(t, prm, where, key):
    x = industrial_parcels(t, prm).filter(where)
    p = net_parcel_areas(t, prm)
    f = F.when(F.col("urban") == "Y", P.URBAN_FACTOR_SQL).otherwise(P.SUBURBAN_FACTOR_SQL)
    cte = x.join(p, PID).groupBy("flag", key).agg(
        F.round(F.sum(F.col("net_area") * f) / P.SQFT_PER_ACRE, 2).alias("acres"))
    return cte.groupBy(key).pivot("flag", ["v", "r"]).agg(F.max("acres"))


def _park_rule():
    lu = F.col("land_use_type_id")
    return (((L.not_blank("mic")) & (lu == P.PARK_USE_TYPE)) | ~lu.isin(*P.EXCLUDED_USE_TYPES_WITH_PARK))


def ns6(t, prm=P.DEFAULT):
    """Net acres by MIC x flag."""
    return _net(t, prm, L.not_blank("mic") & ~F.col("land_use_type_id").isin(*P.EXCLUDED_USE_TYPES), "mic")


def ns7(t, prm=P.DEFAULT):
    """Net acres by county x flag (park rule, flags v and r)."""
    return _net(t, prm, _park_rule() & F.col("flag").isin("v", "r"), "county_id")


def ns8(t, prm=P.DEFAULT):
    """Net acres by inventory type x flag (park rule, flags v and r)."""
    return _net(t, prm, _park_rule() & F.col("flag").isin("v", "r"), "ind_type")


REPORTS = {"NS1": repeated_ids, "NS2": improved, "NS3": unimproved, "NS2_3": parcel_values,
           "NS4": industrial_parcels, "NS5": orphans, "S17_net_areas": net_parcel_areas, "S17_net_polygons": net_polygons_measured,
           "S17_assembled": net_polygons_assembled,
           "NS6": ns6, "NS7": ns7, "NS8": ns8}
