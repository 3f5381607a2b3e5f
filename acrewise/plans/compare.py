"""Exclusion waterfall and parcel-selection method comparison (RS1-RS15).

Layer clean-up (RS1, RS2) -> six-mask waterfall (RS3) -> county parcels
with centroid tags (RS4, X3) -> parcel attributes and flags (RS5, X4) ->
three selection methods (RS6-RS8) -> acreage summaries with a region row
(RS9-RS14) -> one county's industrial parcels with shares (RS15, X2).
Parcels meet zones only through grid-cell candidate joins; the remaining
zone geometry after the waterfall is a layer of trapezoid parts, so every
later intersection is the same pair-area join.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import geometry as geo
from acrewise.functions import labels as L
from acrewise.operators import overlay as ov
from acrewise.operators.areas import dissolve_polygons, pair_areas, snap_sqft, waterfall
from acrewise.operators.polygons import measured, polygons
from acrewise.operators.rows import keep_first, row_index
from acrewise.operators.spatial import point_in_polygon_pairs
from acrewise.sources import fixtures as fx
from acrewise.sources import layers
from acrewise.sources.readers import read_tsv
from acrewise.sources.sinks import export_tsv, intermediates, materialized
from acrewise.sources.tables import Tables

ACRE = P.SQFT_PER_ACRE
KEPT_CODES = (1, 2)
# fixed values: the six exclusion steps, in the order they are erased
STEPS = ("water", "wetlands", "tier_a", "tier_b", "tier_c", "public")


def _r9(c):
    return F.round(c, 9)


# ------------------------------------------------------------ RS1 - RS3
def zoned_layer(t: Tables, keep: str = "all", prm=P.DEFAULT) -> DataFrame:
    """RS1 / RS2: county names cleaned, acreage, positive only, indexed.
    ``keep``: 'all', 'kept' (Ind_Code in 1,2) or 'excluded' (the rest, NULL
    codes included as with R's ``!(x %in% ...)``). Saved once per session
    (the original saved each layer too)."""
    return materialized(t.spark, ("zoned", t.sf_dir, keep), lambda: _build_zoned(t, keep))


def _build_zoned(t: Tables, keep: str) -> DataFrame:
    z = layers.zoning_layer(t)
    in_codes = F.coalesce(F.col("ind_code").isin(*KEPT_CODES), F.lit(False))
    if keep == "kept":
        z = z.filter(in_codes)
    elif keep == "excluded":
        z = z.filter(~in_codes)
    z = z.select("zone_id", L.county_name_clean("county", "county_code").alias("county_name"), "category",
                 (geo.area("rings") / ACRE).alias("total_acreage"), geo.drop_zm("rings").alias("rings"))
    z = z.filter(F.col("total_acreage") > 0)
    return row_index(z, ["zone_id"])


def _out_layer(df: DataFrame) -> DataFrame:
    return df.select("index", "county_name", "category", _r9(F.col("total_acreage")).alias("total_acreage"))


def rs1(t, prm=P.DEFAULT):
    return _out_layer(zoned_layer(t, "all"))


def rs2(t, prm=P.DEFAULT):
    return _out_layer(zoned_layer(t, "kept"))


def rs2_excluded(t, prm=P.DEFAULT):
    return _out_layer(zoned_layer(t, "excluded"))


def _masks(t):
    return layers.masks_layer(t)


def rs3(t, prm=P.DEFAULT):
    """Waterfall: area cut at each step and what remains, per feature."""
    z = zoned_layer(t, "kept")
    wf = waterfall(z.select("index", "rings"), "index", _masks(t), "mask_id", "mask_order", len(STEPS), prm)
    # an explicit CASE: element_at over a literal array with a NULL index
    # does not return NULL in this Spark version
    step = None
    for i, name in enumerate(STEPS):
        step = F.when(F.col("step") == i, name) if step is None else step.when(F.col("step") == i, name)
    out = wf.join(z.select("index", "county_name", "category"), "index").select(
        "index", "county_name", "category", F.coalesce(step, F.lit("remaining")).alias("step"),
        _r9(snap_sqft(F.col("area")) / ACRE).alias("acres"))
    return out.filter(F.col("acres") > 0)


def step_parts(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """The polygons of the waterfall: (index, step, rings), one row per part;
    ``step`` is the erase that takes the part (0..5), NULL if none does. The
    cut layer of step i is ``step = i``; the layer that is left after it is
    ``step IS NULL OR step > i``."""
    z = zoned_layer(t, "kept")
    return waterfall(z.select("index", "rings"), "index", _masks(t), "mask_id", "mask_order", len(STEPS), prm, geometry="steps")


def rs3_steps(t, prm=P.DEFAULT):
    """RS3 with both layers of each step: acres cut by it and acres left
    after it, measured on the polygons."""
    z = zoned_layer(t, "kept").select("index", "county_name", "category")
    acres = step_parts(t, prm).select("index", "step", geo.area("rings").alias("a"))
    step = F.col("step")
    per = acres.groupBy("index").agg(*[F.coalesce(F.sum(F.when(step == i, F.col("a"))), F.lit(0.0)).alias(f"c{i}") for i in range(len(STEPS))],
                                     *[F.coalesce(F.sum(F.when(step.isNull() | (step > i), F.col("a"))), F.lit(0.0)).alias(f"l{i}") for i in range(len(STEPS))])
    rows = per.select("index", F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.col(f"c{i}").alias("c"), F.col(f"l{i}").alias("l"))
                                                   for i, n in enumerate(STEPS)])).alias("r"))
    return z.join(rows, "index").select("index", "county_name", "category", "r.step", _r9(snap_sqft(F.col("r.c")) / ACRE).alias("cut_acres"),
                                        _r9(snap_sqft(F.col("r.l")) / ACRE).alias("remaining_acres"))


def step_polygons(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """Both layers of each waterfall step as polygons: (index, step, kept,
    polygons), what the step cuts (kept false) and what is left after it."""
    order = F.coalesce("step", F.lit(len(STEPS)))
    layer = lambda i, kept: F.struct(F.lit(i).alias("step"), F.lit(kept).alias("kept"))
    rows = F.array(*[F.when(order == i, layer(i, False)) for i in range(len(STEPS))], *[F.when(order > i, layer(i, True)) for i in range(len(STEPS))])
    parts = step_parts(t, prm).select("index", "rings", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("s"))
    return polygons(parts.select("index", "s.step", "s.kept", "rings"), ["index", "step", "kept"], prm=prm)


def rs3_polygons(t, prm=P.DEFAULT):
    """RS3 with the polygons of both layers of each step."""
    return measured(step_polygons(t, prm), ["index", "step", "kept"])


def county_polygons(t, prm=P.DEFAULT):
    """The kept zoning layer dissolved by county, as polygons."""
    z = zoned_layer(t, "kept").filter(F.col("county_name").isNotNull())
    return measured(dissolve_polygons(z, "index", "county_name", prm), ["county_name"])


def remaining_parts(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """What is left of the zoning layer after all six erases, as trapezoid parts:
    (part_id, index, county_name, category, rings); materialized."""
    def build():
        z = zoned_layer(t, "kept")
        parts = waterfall(z.select("index", "rings"), "index", _masks(t), "mask_id", "mask_order",
                          len(STEPS), prm, geometry=True)
        parts = parts.join(z.select("index", "county_name", "category"), "index")
        # a trapezoid is told apart by its feature, its x-range and its lower left and upper right heights
        r = F.col("rings")[0]
        return parts.withColumn("part_id", F.concat_ws(":", "index", r[0]["x"], r[0]["y"], r[1]["x"], r[2]["y"]))
    return materialized(t.spark, ("remaining_parts", t.sf_dir, prm), build)


# ------------------------------------------------------------ RS4
def _tags(t: Tables, pts: DataFrame, pid: str, prm) -> DataFrame:
    """MIC, regional geography and city of each point, all matches (one
    row per kind and match): (pid, kind, label)."""
    def fid(kind, key):
        return F.concat_ws(":", F.lit(kind), F.col(key).cast("string")).alias("tag_fid")
    lay = (layers.mic_layer(t).select(fid("mic", "zone_id"), F.lit("mic").alias("kind"), F.col("mic").alias("label"), "rings")
           .unionByName(layers.rgeo_layer(t).select(fid("rgeo", "rgeo_id"), F.lit("rgeo").alias("kind"),
                                                    F.col("class_desc").alias("label"), "rings"))
           .unionByName(layers.city_layer(t).select(fid("city", "city_id"), F.lit("city").alias("kind"),
                                                    F.col("city").alias("label"), "rings")))
    pairs = point_in_polygon_pairs(pts, pid, "x", "y", lay, "tag_fid", "rings", prm.cell_size, prm.band_width)
    return pairs.join(lay.select("tag_fid", "kind", "label"), "tag_fid").select(pid, "kind", "label")


def _parcel_fips(county_id, parcel_integer):
    return F.concat(county_id.cast("string"), parcel_integer.cast("string"))


def region_parcels(t: Tables, prm=P.DEFAULT) -> DataFrame:
    """X3 for all county files at once: numeric parcel_id_fips, acreage,
    county, MIC / regional geography / city from the centroid (defaults
    when outside), one row per parcel_id_fips (the lowest row wins)."""
    def build():
        cp = layers.county_parcels_layer(t)
        pint = F.col("parcel_id_raw").try_cast("decimal(20,0)")
        cp = cp.select("parcel_row", "county_id", "rings", (geo.area("rings") / ACRE).alias("parcel_acreage"),
                       pint.alias("_pint")).filter(F.col("_pint").isNotNull())
        cp = cp.withColumn("parcel_id_fips", _parcel_fips(F.col("county_id"), F.col("_pint")).try_cast("bigint"))
        c = geo.centroid("rings")
        pts = cp.select("parcel_row", c["x"].alias("x"), c["y"].alias("y"))
        tags = _tags(t, pts, "parcel_row", prm).groupBy("parcel_row").agg(
            *[F.min(F.when(F.col("kind") == k, F.col("label"))).alias(k) for k in ("mic", "rgeo", "city")])
        out = cp.join(tags, "parcel_row", "left").select(
            "parcel_row", "parcel_id_fips", "parcel_acreage", "county_id",
            L.county_name_from_id("county_id").alias("county_name"),
            F.coalesce("mic", F.lit(P.NOT_IN_MIC)).alias("mic"),
            F.coalesce("rgeo", F.lit(P.RURAL)).alias("rgeo"),
            F.coalesce("city", F.lit(P.UNINCORPORATED)).alias("city"), "rings")
        return keep_first(out, ["parcel_id_fips"], ["parcel_row"])
    return materialized(t.spark, ("region_parcels", t.sf_dir, prm), build)


RS4_COLS = ["parcel_id_fips", "parcel_acreage", "county_id", "county_name", "mic", "rgeo", "city"]


def rs4(t, prm=P.DEFAULT):
    r = region_parcels(t, prm)
    return r.select(*[(_r9(F.col(c)).alias(c) if c == "parcel_acreage" else c) for c in RS4_COLS])


# ------------------------------------------------------------ RS5
def _fips_from_text(df: DataFrame) -> DataFrame:
    pint = F.col("parcel_id_fips").try_cast("decimal(20,0)")
    df = df.withColumn("_pint", pint).dropna("any")
    return df.withColumn("parcel_id_fips", _parcel_fips(F.col("county_id"), F.col("_pint")).try_cast("bigint")) \
        .drop("_pint")


def parcel_files(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The parcel and building tables handed over as tab-separated files and
    read back from there (S5, S11), as the original got them."""
    def handed(name, df, types):
        path = f"{intermediates(t.spark)}/files-{hashlib.sha1(t.sf_dir.encode()).hexdigest()[:16]}/{name}"
        export_tsv(df, path)
        return read_tsv(t.spark, path, df.columns, types)
    return (handed("parcels", fx.parcel_data(t), {"county_id": "int", "land_use_type_id": "int", "gross_sqft": "double"}),
            handed("buildings", fx.building_data(t), {"county_id": "int"}))


def parcel_attributes(t: Tables, prm=P.DEFAULT, files: bool = False) -> DataFrame:
    """Land use, size and Σ improvement value per parcel, joined to the
    region parcels; flags, urban, adjustment factor, use code; use code Y.
    ``files``: take both tables from tab-separated files."""
    def build():
        parcels, buildings = parcel_files(t) if files else (fx.parcel_data(t), fx.building_data(t))
        d = _fips_from_text(parcels).select("parcel_id_fips", "land_use_type_id", "gross_sqft")
        b = _fips_from_text(buildings)
        iv = F.coalesce(F.col("improvement_value").try_cast("double").try_cast("int"), F.lit(0))
        b = b.select("parcel_id_fips", iv.alias("improvement_value")).groupBy("parcel_id_fips").agg(
            F.sum("improvement_value").alias("improvement_value"))
        pdata = d.join(b, "parcel_id_fips", "left").withColumn(
            "improvement_value", F.coalesce("improvement_value", F.lit(0)))
        p = region_parcels(t, prm).join(pdata, "parcel_id_fips", "left").dropna("any")
        p = p.withColumn("gross_sqft", F.col("gross_sqft").cast("double"))
        p = p.withColumn("impval", L.ratio_r("improvement_value", "gross_sqft"))
        p = p.withColumn("development_flag", L.development_flag_r("impval", prm.flag_preset))
        p = p.withColumn("urban", L.urban_flag("rgeo", "city"))
        p = p.withColumn("adjustement_factor", F.when(F.col("urban") == "Y", F.lit(prm.urban_deduction))
                         .otherwise(F.lit(prm.suburban_deduction)))
        lu = F.coalesce(F.col("land_use_type_id").cast("int"), F.lit(0))
        p = p.withColumn("land_use_type_id", lu)
        in_mic = F.col("mic") != P.NOT_IN_MIC
        use = (F.when(in_mic & (lu == P.PARK_USE_TYPE), "Y").when(~in_mic & (lu == P.PARK_USE_TYPE), "N")
               .when(~lu.isin(*P.EXCLUDED_USE_TYPES_R), "Y").otherwise("N"))
        return p.withColumn("use_code", use).filter(F.col("use_code") == "Y")
    return materialized(t.spark, ("parcel_attributes", t.sf_dir, prm, files), build)


RS5_COLS = RS4_COLS + ["land_use_type_id", "gross_sqft", "improvement_value", "impval", "development_flag",
                       "urban", "adjustement_factor", "use_code"]


def _rs5_out(p: DataFrame) -> DataFrame:
    p = p
    return p.select(*[(_r9(F.col(c)).alias(c) if c == "parcel_acreage" else c) for c in RS5_COLS])


def rs5(t, prm=P.DEFAULT):
    return _rs5_out(parcel_attributes(t, prm))


def rs5_files(t, prm=P.DEFAULT):
    """RS5 from tab-separated files."""
    return _rs5_out(parcel_attributes(t, prm, files=True))


# ------------------------------------------------------ RS6 - RS8 methods
def _parcel_zone_areas(t, parcels: DataFrame, prm) -> DataFrame:
    """(parcel_row, index, category, area) for parcels meeting the remaining zones."""
    parts = remaining_parts(t, prm)
    geom = parcels.select("parcel_row", "rings").dropDuplicates(["parcel_row"])
    pa = pair_areas(geom, "parcel_row", parts.select("part_id", "rings"), "part_id", prm)
    return (pa.join(parts.select("part_id", "index", "category"), "part_id")
            .groupBy("parcel_row", "index", "category").agg(F.sum("area").alias("area"))
            .filter(F.col("area") > 0))


SEL_COLS = ["parcel_id_fips", "county_name", "mic", "development_flag", "adjustement_factor"]


def method_polygons(t, prm=P.DEFAULT) -> DataFrame:
    """RS6 (method A): parcels intersected with the zones, re-measured."""
    p = parcel_attributes(t, prm)
    a = _parcel_zone_areas(t, p, prm)
    return p.join(a, "parcel_row").select(*SEL_COLS, "index", "category",
                                          _r9(snap_sqft(F.col("area")) / ACRE).alias("parcel_acreage"))


def centroid_selected(t, prm=P.DEFAULT) -> DataFrame:
    """RS7 (method B): whole parcels whose centroid lies in a zone."""
    p = parcel_attributes(t, prm)
    parts = remaining_parts(t, prm)
    c = geo.centroid("rings")
    pts = p.select("parcel_row", c["x"].alias("x"), c["y"].alias("y")).dropDuplicates(["parcel_row"])
    hit = point_in_polygon_pairs(pts, "parcel_row", "x", "y", parts.select("part_id", "rings"), "part_id",
                                 "rings", prm.cell_size, prm.band_width)
    ids = hit.join(p.select("parcel_row", "parcel_id_fips"), "parcel_row").select("parcel_id_fips")
    return p.join(ids, "parcel_id_fips", "left_semi")


def rs7(t, prm=P.DEFAULT):
    p = centroid_selected(t, prm)
    return p.select(*SEL_COLS, _r9(F.col("parcel_acreage")).alias("parcel_acreage"))


def method_trimmed(t, prm=P.DEFAULT) -> DataFrame:
    """RS8 (method C): centroid-selected parcels, trimmed to the zones."""
    p = centroid_selected(t, prm)
    a = _parcel_zone_areas(t, p, prm)
    return p.join(a, "parcel_row").select(*SEL_COLS, "index", "category",
                                          _r9(snap_sqft(F.col("area")) / ACRE).alias("parcel_acreage"))


# -------------------------------------------------------- summaries
def acreage_summary(df: DataFrame, by: str, label: str, digits: int = P.FINAL_DEC) -> DataFrame:
    """Adjusted acres by a label x flag (R rounding, half to even), wide
    Vacant / Redevelopable / Total, plus a Region row from the rounded
    values (NULL-propagating sums)."""
    x = df.withColumn("_adj", F.col("adjustement_factor") * F.col("parcel_acreage")) \
        .filter(F.col("development_flag") != "Not Redevelopable")
    g = x.groupBy(by, "development_flag").agg(F.bround(F.sum("_adj"), digits).alias("acres"))
    w = g.groupBy(by).pivot("development_flag", ["Vacant", "Redevelopable"]).agg(F.first("acres"))
    w = w.select(F.col(by).alias(label), "Vacant", "Redevelopable",
                 (F.col("Vacant") + F.col("Redevelopable")).alias("Total"))
    aggs = [F.when(F.count(c) < F.count(F.lit(1)), F.lit(None)).otherwise(F.sum(c)).alias(c)
            for c in ("Vacant", "Redevelopable", "Total")]
    region = w.agg(*aggs).select(F.lit("Region").alias(label), "Vacant", "Redevelopable", "Total")
    return w.unionByName(region)


def rs9(t, prm=P.DEFAULT):
    return acreage_summary(centroid_selected(t, prm), "county_name", "County")


def rs10(t, prm=P.DEFAULT):
    return acreage_summary(method_trimmed(t, prm), "county_name", "County")


def rs11(t, prm=P.DEFAULT):
    return acreage_summary(method_polygons(t, prm), "county_name", "County")


def rs12(t, prm=P.DEFAULT):
    return acreage_summary(method_polygons(t, prm), "mic", "MIC")


def rs13(t, prm=P.DEFAULT):
    return acreage_summary(method_polygons(t, prm), "category", "Category")


def rs14(t, prm=P.DEFAULT):
    """Summary of the remaining zoned land: acres by county
    (rounded half to even) and a Region row, in county order."""
    z = zoned_layer(t, "kept")
    wf = waterfall(z.select("index", "rings"), "index", _masks(t), "mask_id", "mask_order", len(STEPS), prm)
    rem = wf.filter(F.col("step").isNull()).join(z.select("index", "county_name"), "index")
    by = rem.groupBy("county_name").agg(F.bround(F.sum(F.col("area") / ACRE), 0).alias("acres"))
    region = by.agg(F.bround(F.sum("acres"), 0).alias("acres")).select(F.lit("Region").alias("county_name"), "acres")
    out = by.unionByName(region)
    pos = F.array_position(F.array(*[F.lit(c) for c in P.COUNTY_ORDER]), F.col("county_name"))
    return out.orderBy(pos).select(F.col("county_name").alias("County"), F.col("acres").alias("Acres"))


def rs15(t, prm=P.DEFAULT, threshold: float = P.PARCEL_SIZE_THRESHOLD):
    """X2 for every county file: parcel area inside the county's dissolved
    zoned land, share of the parcel, at least ``threshold`` acres;
    text key county id + numeric parcel id. Tag matches fan out (no
    de-duplication in this function of the original)."""
    cp = layers.county_parcels_layer(t).withColumn("parcel_acreage", geo.area("rings") / ACRE)
    parts = remaining_parts(t, prm)
    cand = ov.bbox_pairs(cp.select("parcel_row", "rings"), "parcel_row", parts.select("part_id", "rings"),
                         "part_id", prm.cell_size)
    cand = (cand.join(cp.select("parcel_row", "county_id"), "parcel_row")
            .join(parts.select("part_id", "county_name"), "part_id")
            .filter(L.county_name_from_id("county_id") == F.col("county_name")))
    band = prm.band_width
    subj = cand.select(F.col("parcel_row").alias("g")).distinct().withColumn("_fid", F.col("g")) \
        .withColumn("layer", F.lit(0))
    pieces = ov.group_pieces(subj, ov.layer_pieces(cp, "parcel_row", band).withColumnRenamed("parcel_row", "_fid"),
                             "_fid")
    zp = cand.select(F.col("parcel_row").alias("g"), F.col("part_id").alias("_fid"), F.lit(1).alias("layer"),
                     F.col("_ox0").alias("xmin"), F.col("_ox1").alias("xmax"))
    pieces = pieces.unionByName(
        ov.group_pieces(zp, ov.layer_pieces(parts, "part_id", band).withColumnRenamed("part_id", "_fid"), "_fid", band))
    inter = ov.slab_overlay(pieces, 2, lambda n: (n[0] != 0) & (n[1] != 0), band=prm.band_width,
                            max_pieces=prm.max_band_pieces).select(
        F.col("g").alias("parcel_row"), (snap_sqft(F.col("area")) / ACRE).alias("total_acreage"))
    x = cp.join(inter, "parcel_row").withColumn("parcel_share", F.col("total_acreage") / F.col("parcel_acreage"))
    x = x.filter(F.col("total_acreage") >= threshold)
    # tags of every candidate parcel's centroid, as one row per parcel with
    # the matches of each layer; exploding the three lists is the fan-out of
    # the original's three left joins (a point lies in few polygons)
    c = geo.centroid("rings")
    pts = cp.join(cand.select("parcel_row").distinct(), "parcel_row", "left_semi") \
        .select("parcel_row", c["x"].alias("x"), c["y"].alias("y"))
    kinds = (("mic", P.NOT_IN_MIC), ("rgeo", P.RURAL), ("city", P.UNINCORPORATED))
    tags = _tags(t, pts, "parcel_row", prm).groupBy("parcel_row").agg(
        *[F.collect_list(F.when(F.col("kind") == k, F.col("label"))).alias(k) for k, _ in kinds])
    x = x.join(tags, "parcel_row", "left")
    for kind, default in kinds:
        lst = F.coalesce(F.col(kind), F.array().cast("array<string>"))
        x = x.withColumn(kind, F.explode(F.when(F.size(lst) > 0, lst).otherwise(F.array(F.lit(default)))))
    pint = F.col("parcel_id_raw").try_cast("decimal(20,0)")
    x = x.withColumn("_pint", pint).filter(F.col("_pint").isNotNull())
    return x.select(_parcel_fips(F.col("county_id"), F.col("_pint")).alias("parcel_fips"),
                    _r9(F.col("total_acreage")).alias("total_acreage"),
                    _r9(F.col("parcel_share")).alias("parcel_share"), "mic", "rgeo", "city")


def rs6(t, prm=P.DEFAULT):
    return method_polygons(t, prm)


def rs8(t, prm=P.DEFAULT):
    return method_trimmed(t, prm)


REPORTS = {"RS1": rs1, "RS2": rs2, "RS2_excluded": rs2_excluded, "RS3": rs3, "RS3_steps": rs3_steps, "RS3_polygons": rs3_polygons, "G14_county_polygons": county_polygons,
           "RS4": rs4, "RS5": rs5, "RS5_files": rs5_files,
           "RS6": rs6, "RS7": rs7, "RS8": rs8, "RS9": rs9, "RS10": rs10, "RS11": rs11, "RS12": rs12,
           "RS13": rs13, "RS14": rs14, "RS15": rs15}
