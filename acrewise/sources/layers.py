"""Polygon layers (S2-S4): ring-array DataFrames from the fixture boxes or
from well-known text held in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise.functions import geometry as geo
from acrewise.sources import fixtures as fx
from acrewise.sources.tables import Tables, view


def boxes_to_layer(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rectangle columns x0,y0,x1,y1 -> ring geometry. A box with x0 < x1
    and y0 < y1 is already a valid counter-clockwise ring, so the repair
    pass (G1) is not needed; degenerate boxes are dropped."""
    ok = (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    return df.filter(ok).select(*keep, geo.rect_rings("x0", "y0", "x1", "y1").alias("rings"))


def wkt_polygon_rings(wkt: str | Column) -> Column:
    """POLYGON / MULTIPOLYGON well-known text -> rings. Each part is a
    parenthesised list of rings (outer first); parsing is regexp + split on
    one row, JVM-side; ``repair_parts`` orients every part."""
    c = F.col(wkt) if isinstance(wkt, str) else wkt
    parts = F.regexp_extract_all(c, F.lit(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)"), 1)

    def parse_ring(r):
        pts = F.split(F.trim(r), r"\s*,\s*")
        return F.transform(pts, lambda p: geo.pt(F.split(F.trim(p), r"\s+")[0].cast("double"),
                                                 F.split(F.trim(p), r"\s+")[1].cast("double")))

    def parse_part(part):
        return F.transform(F.regexp_extract_all(part, F.lit(r"\(([^()]+)\)"), 1), parse_ring)
    return geo.repair_parts(F.transform(parts, parse_part))


@view
def zones_layer(t: Tables) -> DataFrame:
    return boxes_to_layer(fx.zones(t), ["zone_id", "ind_type"])


@view
def counties_layer(t: Tables) -> DataFrame:
    return boxes_to_layer(fx.counties(t), ["county_key", "county_fip", "county_nm"])


@view
def masks_layer(t: Tables) -> DataFrame:
    return boxes_to_layer(fx.masks(t), ["mask_id", "mask_order"])


@view
def mic_layer(t: Tables) -> DataFrame:
    return boxes_to_layer(fx.mic_areas(t), ["zone_id", "mic"])


@view
def rgeo_layer(t: Tables) -> DataFrame:
    return boxes_to_layer(fx.regional_geographies(t), ["rgeo_id", "class_desc", "juris"])


@view
def parcels_layer(t: Tables) -> DataFrame:
    return boxes_to_layer(fx.parcels(t), ["parcel_id", "parcel_row", "gross_sqft", "land_use_type_id"])


@view
def zoning_layer(t: Tables) -> DataFrame:
    return boxes_to_layer(fx.zoning(t), ["zone_id", "county_code", "county", "category", "ind_code"])


@view
def city_layer(t: Tables) -> DataFrame:
    return boxes_to_layer(fx.cities(t), ["city_id", "city"])


@view
def county_parcels_layer(t: Tables) -> DataFrame:
    return boxes_to_layer(fx.county_parcels(t), ["parcel_row", "parcel_id_raw", "county_id"])
