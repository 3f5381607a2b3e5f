"""Queries that isolate one operator each (those no report isolates):
G1 + S4 (text geometry, repair), G5 centroid, G6 re-projection, G7 point
in polygon, G9 / G11 pair overlay, G12 erase, G14 dissolve, A9 suppression,
W1 row index. Each reads the driver tables through the stand-in views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import geometry as geo
from acrewise.functions import labels as L
from acrewise.functions.suppress import suppression_merge, suppression_rule
from acrewise.operators import overlay as ov
from acrewise.operators.areas import erase_union_area, pair_areas, repair_crossings, snap_sqft
from acrewise.operators.joins import first_match
from acrewise.operators.rows import key_violations, row_index
from acrewise.operators.spatial import point_in_polygon_pairs, tag_points
from acrewise.plans.employment import employment_base
from acrewise.sources import fixtures as fx
from acrewise.sources import layers
from acrewise.sources.layers import wkt_polygon_rings
from acrewise.sources.readers import named_layer
from acrewise.sources.tables import Tables


def g1_wkt_repair(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """S4 + G1 + G3: parcels written as clockwise, closed WKT text, parsed,
    repaired (closing point dropped, re-oriented) and measured."""
    p = fx.parcels(t)
    wkt = F.format_string("POLYGON ((%s %s, %s %s, %s %s, %s %s, %s %s))",
                          "x0", "y0", "x0", "y1", "x1", "y1", "x1", "y0", "x0", "y0")
    lay = p.select("parcel_row", wkt_polygon_rings(wkt).alias("rings"))
    return lay.select("parcel_row", F.size(F.col("rings")[0]).alias("n_points"),
                      snap_sqft(geo.area("rings")).alias("area"))


def g5_centroid(t: Tables, prm=P.DEFAULT) -> DataFrame:
    p = layers.parcels_layer(t)
    c = geo.centroid("rings")
    return p.select("parcel_row", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


def g1_crossings(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """G1 on rings that cross, touch or run over themselves, one shape per
    parcel in turn: bow-tie, holed box, box with a spike, two boxes that touch
    in a point, doubly wound box; area and centroid after the repair."""
    p = fx.parcels(t)
    mx, my = "(x0 + x1) / 2", "(y0 + y1) / 2"

    def ring(*pts):
        return "array(" + ", ".join(f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))" for x, y in pts) + ")"
    box = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    hole = [("x0 + 5", "y0 + 5"), ("x0 + 5", "y0 + 8"), ("x0 + 9", "y0 + 8"), ("x0 + 9", "y0 + 5")]
    shapes = [f"array({ring(('x0', 'y0'), ('x1', 'y1'), ('x1', 'y0'), ('x0', 'y1'))})", f"array({ring(*box)}, {ring(*hole)})",
              f"array({ring(*box, ('x0 - 10', 'y1'), ('x0', 'y1'))})", f"array({ring(('x0', 'y0'), (mx, 'y0'), (mx, my), ('x1', my), ('x1', 'y1'), (mx, 'y1'), (mx, my), ('x0', my))})",
              f"array({ring(*box, *box)})"]
    case = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(shapes))
    lay = p.select("parcel_row", F.explode(F.array(F.struct(F.expr(f"CASE parcel_row % 5 {case} END").alias("r")))).alias("o"))
    lay = repair_crossings(lay.select("parcel_row", F.col("o.r").alias("rings")), "parcel_row", prm)
    c = geo.centroid("rings")
    return lay.select("parcel_row", snap_sqft(geo.area("rings")).alias("area"), F.round(c["x"], 4).alias("cx"), F.round(c["y"], 4).alias("cy"))


def g6_reproject(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Degrees to state plane feet, and those back to degrees."""
    p = fx.parcels(t).select("parcel_row", (F.col("x0") / 4000 - 123.5).alias("lon"), (F.col("y0") / 10000 + 47.1).alias("lat"))
    f = p.withColumn("f", geo.to_state_plane("lon", "lat"))
    back = geo.to_wgs84(F.col("f.x"), F.col("f.y"))
    return f.select("parcel_row", F.round("f.x", 3).alias("x"), F.round("f.y", 3).alias("y"), F.round(back["x"], 7).alias("lon"), F.round(back["y"], 7).alias("lat"))


def g7_pip(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Parcel centroids in zones, border inclusive, every match."""
    p = fx.parcels(t).select("parcel_row", ((F.col("x0") + F.col("x1")) / 2).alias("x"),
                             ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return point_in_polygon_pairs(p, "parcel_row", "x", "y", layers.zones_layer(t), "zone_id", "rings",
                                  prm.cell_size, prm.band_width)


def g11_overlay_join(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """One row per (parcel, zone) that overlap, attributes of
    both, overlap area re-measured in acres."""
    p = layers.parcels_layer(t)
    z = layers.zones_layer(t)
    a = pair_areas(p, "parcel_row", z, "zone_id", prm).filter(F.col("area") > 0)
    return (a.join(p.select("parcel_row", "parcel_id"), "parcel_row").join(z.select("zone_id", "ind_type"), "zone_id")
            .select("parcel_row", "parcel_id", "zone_id", "ind_type",
                    F.round(snap_sqft(F.col("area")) / P.SQFT_PER_ACRE, 9).alias("acres")))


def g12_erase(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Zones with every mask erased (each acre once): remaining acres."""
    z = layers.zones_layer(t)
    a = erase_union_area(z, "zone_id", layers.masks_layer(t), "mask_id", prm=prm)
    return a.select("zone_id", F.round(snap_sqft(F.col("area")) / P.SQFT_PER_ACRE, 9).alias("acres"))


def g14_dissolve(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Zones dissolved by inventory type (overlaps counted once), acres."""
    z = layers.zones_layer(t).filter(F.col("ind_type").isNotNull())
    pieces = ov.group_pieces(z.select(F.col("ind_type").alias("g"), F.col("zone_id").alias("_fid"),
                                      F.lit(0).alias("layer")),
                             ov.layer_pieces(z, "zone_id", prm.band_width).withColumnRenamed("zone_id", "_fid"),
                             "_fid")
    u = ov.slab_overlay(pieces, 1, lambda n: n[0] != 0, band=prm.band_width, max_pieces=prm.max_band_pieces)
    return u.select(F.col("g").alias("ind_type"),
                    F.round(snap_sqft(F.col("area")) / P.SQFT_PER_ACRE, 9).alias("acres"))


def a9_suppress(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """The suppression rule alone, by year and industry group."""
    b = employment_base(t, P.YEARS_6, prm=prm)
    agg = b.groupBy("data_year", "manuf_industrial_group").agg(*suppression_merge())
    return agg.select("data_year", "manuf_industrial_group", suppression_rule().alias("emp_covered"))


def w1_row_index(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Distributed 1..n row index over the parcel table (by parcel_row)."""
    return row_index(fx.parcels(t).select("parcel_row", "parcel_id"), ["parcel_row"])


def s3_named_layers(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Every layer by its name, with its features and area."""
    out = None
    for name in ("micen", "cities", "regional_geographies", "county_background", "inventory", "zoning", "exclusions", "largest_waterbodies"):
        one = named_layer(t, name).agg(F.count(F.lit(1)).alias("n"), snap_sqft(F.sum(geo.area("rings"))).alias("area")).select(F.lit(name).alias("layer"), "n", "area")
        out = one if out is None else out.unionByName(one)
    return out


def s13_key_check(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """What breaks the key of the county parcel files (their id read as
    a number: some are not numeric, some occur twice)."""
    p = fx.county_parcels(t).select(F.col("parcel_id_raw").try_cast("bigint").alias("parcel_id"))
    return key_violations(p, ["parcel_id"])


def f18_presets(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """The three updates on parcels of which a third have no flag
    yet and some no value: each update fires."""
    p = fx.parcels(t)
    k = F.col("parcel_row")
    p = p.select("parcel_row", "gross_sqft", F.when(k % 3 == 1, "v").when(k % 3 == 2, "").alias("flag"),
                 F.when(k % 7 == 0, F.lit(None)).when(k % 7 < 3, F.lit(0)).otherwise((k * 7919) % 20000).cast("double").alias("impval"))
    return p.select("parcel_row", L.flag_preset_tsql("flag", "impval", "gross_sqft").alias("flag"),
                    L.value_ratio("impval", "gross_sqft").cast("double").alias("value_ratio"))


def tagged_parcels(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Parcel centroids with the name of the centre that holds
    them (lowest name where several do), or the default."""
    p = fx.parcels(t).select("parcel_row", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    tags = tag_points(p, "parcel_row", "x", "y", layers.mic_layer(t), "zone_id", "mic", "mic",
                      default=P.NOT_IN_MIC, cell=prm.cell_size, band=prm.band_width)
    return first_match(tags, "parcel_row", "mic")


REPORTS = {"S3_named_layers": s3_named_layers, "S13_key_check": s13_key_check, "F18_presets": f18_presets, "G8_tagged_parcels": tagged_parcels,
           "G1_wkt_repair": g1_wkt_repair, "G1_crossings": g1_crossings, "G5_centroid": g5_centroid, "G6_reproject": g6_reproject,
           "G7_pip": g7_pip, "G11_overlay_join": g11_overlay_join, "G12_erase": g12_erase,
           "G14_dissolve": g14_dissolve, "A9_suppress": a9_suppress, "W1_row_index": w1_row_index}
