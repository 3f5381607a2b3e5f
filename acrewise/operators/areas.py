"""Area building blocks on polygon layers: overlap areas for candidate
pairs and triples, literal 'each mask' erase, masks as one union, and the
pivot with zero cells the original cross joins produced."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import geometry as geo
from acrewise.operators import depth as dp
from acrewise.operators import dissolve as ds
from acrewise.operators import overlay as ov
from acrewise.operators.polygons import polygons


def pair_areas(a: DataFrame, fa: str, b: DataFrame, fb: str, prm: P.Params = P.DEFAULT) -> DataFrame:
    """(fa, fb, area) for every pair of features of two layers that overlap."""
    pairs = ov.bbox_pairs(a, fa, b, fb, prm.cell_size)
    return ov.pair_area(pairs, fa, fb, ov.layer_pieces(a, fa, prm.band_width),
                        ov.layer_pieces(b, fb, prm.band_width), prm.band_width, prm.max_band_pieces)


def triple_areas(a: DataFrame, fa: str, b: DataFrame, fb: str, c: DataFrame, fc: str,
                 prm: P.Params = P.DEFAULT) -> DataFrame:
    """(fa, fb, fc, area) for every triple whose three features overlap.

    ``b`` is the hub: candidates are the overlapping (b, c) pairs joined to
    the overlapping (a, b) pairs on b. Pass the layer of the smallest
    features as ``b`` (zones, parcels), so a big feature of ``a`` (a
    county) never pairs all of its members with each other."""
    bc = ov.bbox_pairs(b, fb, c, fc, prm.cell_size)
    ab = ov.bbox_pairs(a, fa, b, fb, prm.cell_size).select(
        fa, fb, *[F.col(f"_o{k}").alias(f"_ab{k}") for k in ("x0", "y0", "x1", "y1")])
    # the three boxes overlap iff the two overlap boxes (both inside b's box) do
    trip = (bc.join(ab, fb)
            .filter((F.greatest("_ox0", "_abx0") < F.least("_ox1", "_abx1"))
                    & (F.greatest("_oy0", "_aby0") < F.least("_oy1", "_aby1")))
            .select(fa, fb, fc, "base", F.greatest("_ox0", "_abx0").alias("_ox0"), F.least("_ox1", "_abx1").alias("_ox1")))
    return ov.triple_area(trip, fa, fb, fc, ov.layer_pieces(a, fa, prm.band_width),
                          ov.layer_pieces(b, fb, prm.band_width), ov.layer_pieces(c, fc, prm.band_width),
                          prm.band_width, prm.max_band_pieces)


def masked_areas(a: DataFrame, fa: str, b: DataFrame, fb: str, masks: DataFrame, fm: str,
                 prm: P.Params = P.DEFAULT) -> DataFrame:
    """(fa, fb, _t) with _t = Σ_M area(A∩B∩M). Right-angled features go by the
    depth of the masks (``depth``), whose work does not grow with the number of
    overlapping pairs; triples with any other feature are formed one by one.
    A row stands for its copies as often as the joins of ``triple_areas`` on a
    repeated key would count it."""
    (pa, oa), (pb, ob), (pm, om) = (dp.plain_features(*x) for x in ((a, fa), (b, fb), (masks, fm)))
    t = dp.integrals(dp.pair_corners(pa, fa, pb, fb, prm), [fa, fb],
                     dp.layer_corners(pm, fm, F.col("copies") * F.col("copies"), prm.band_width))
    t = (t.join(pa.select(fa, F.col("copies").alias("_na")), fa).join(pb.select(fb, F.col("copies").alias("_nb")), fb)
         .select(fa, fb, (F.col("_t") * F.col("_na") * F.col("_na") * F.col("_nb") * F.col("_nb") * F.col("_nb")).alias("_t")))

    def rows(plain: DataFrame, layer: DataFrame, fid: str) -> DataFrame:
        return layer.select(fid, "rings").join(plain.select(fid), fid, "left_semi")
    odd = [(a, b, om)] if om is not None else []
    odd += [(a, ob, rows(pm, masks, fm))] if ob is not None else []
    odd += [(oa, rows(pb, b, fb), rows(pm, masks, fm))] if oa is not None else []
    for x, y, z in odd:
        t = t.unionByName(triple_areas(x, fa, y, fb, z, fm, prm).groupBy(fa, fb).agg(F.sum("area").alias("_t")))
    return t.groupBy(fa, fb).agg(F.sum("_t").alias("_t")) if odd else t


def erase_each(a: DataFrame, fa: str, b: DataFrame, fb: str, masks: DataFrame, fm: str,
               prm: P.Params = P.DEFAULT) -> DataFrame:
    """Σ over masks of area((A ∖ M) ∩ B) per (fa, fb), the literal reading of
    ``A.STDifference(M).STIntersection(B)`` under ``JOIN M ON 1=1`` (D11):
    n_masks · area(A∩B) − Σ_M area(A∩B∩M). The mask count is a scalar
    subquery; with no masks the original yields NULL."""
    n = masks.select(F.count(F.lit(1)).alias("n")).scalar()
    pa = pair_areas(a, fa, b, fb, prm)
    tr = masked_areas(a, fa, b, fb, masks, fm, prm)
    out = pa.join(tr, [fa, fb], "left")
    val = F.when(n > 0, n * F.col("area") - F.coalesce(F.col("_t"), F.lit(0.0)))
    return out.select(fa, fb, val.alias("area"))


def erase_union_area(a: DataFrame, fa: str, masks: DataFrame, fm: str, b: DataFrame | None = None,
                     fb: str | None = None, prm: P.Params = P.DEFAULT) -> DataFrame:
    """area(A ∖ ∪M) per feature of A (or area((A ∩ B) ∖ ∪M) per pair when
    ``b`` is given), each acre counted once however many masks cover it: the
    masks are dissolved by cells first, so a feature meets cells, not masks."""
    band = prm.band_width
    cells, outline = ds.dissolved(masks, fm, prm)
    if b is None:
        # only features that meet a mask go through the slab overlay; the
        # rest keep their own area (one shoelace per row, no shuffle)
        mp = ov.bbox_pairs(a, fa, cells, "_cell", prm.cell_size).select(
            F.col(fa).alias("g"), F.col("_cell").alias("_fid"), F.col("_ox0").alias("xmin"), F.col("_ox1").alias("xmax"))
        hit = mp.select(F.col("g").alias(fa)).distinct()
        subj = a.join(hit, fa, "left_semi").select(F.col(fa).alias("g"), F.col(fa).alias("_fid"),
                                                   F.lit(0).alias("layer"))
        pieces = [ov.group_pieces(subj, ov.layer_pieces(a, fa, band).withColumnRenamed(fa, "_fid"), "_fid")]
        pieces.append(ov.group_pieces(mp.withColumn("layer", F.lit(1)), outline.withColumnRenamed("_cell", "_fid"), "_fid", band))
        keep = lambda n: (n[0] != 0) & (n[1] == 0)
        n_layers = 2
        untouched = a.join(hit, fa, "left_anti").select(fa, geo.area("rings").alias("area"))
    else:
        # members of each (a, b) group in one pass over the candidate pairs:
        # the a feature (layer 0), the b feature (layer 1) and every cell of
        # masks meeting the b feature (layer 2); all pieces come from one tagged
        # union of the three layers, joined once on (kind, fid)
        ab = ov.bbox_pairs(a, fa, b, fb, prm.cell_size).select(
            F.struct(F.col(fa).alias(fa), F.col(fb).alias(fb)).alias("g"), fa, fb,
            F.col("_ox0").alias("xmin"), F.col("_ox1").alias("xmax"))
        bm = ov.bbox_pairs(b, fb, cells, "_cell", prm.cell_size).select(fb, F.col("_cell").alias("_mf"), "_ox0", "_ox1")
        own = ab.select("g", F.explode(F.array(
            F.struct(F.lit(0).alias("layer"), F.lit("a").alias("_kind"), F.col(fa).cast("string").alias("_fid")),
            F.struct(F.lit(1).alias("layer"), F.lit("b").alias("_kind"), F.col(fb).cast("string").alias("_fid"))
        )).alias("_m"), "xmin", "xmax").select("g", "_m.*", "xmin", "xmax")
        mk = (ab.join(bm, fb).select("g", F.lit(2).alias("layer"), F.lit("m").alias("_kind"), F.col("_mf").alias("_fid"),
                                     F.greatest("xmin", "_ox0").alias("xmin"), F.least("xmax", "_ox1").alias("xmax"))
              .filter("xmax > xmin"))
        members = own.unionByName(mk)
        lp = (ov.layer_pieces(a, fa, band).select(F.lit("a").alias("_kind"), F.col(fa).cast("string").alias("_fid"),
                                                  "band", "l", "r", "yl", "yr", "c")
              .unionByName(ov.layer_pieces(b, fb, band).select(F.lit("b").alias("_kind"),
                                                               F.col(fb).cast("string").alias("_fid"),
                                                               "band", "l", "r", "yl", "yr", "c"))
              .unionByName(outline.select(F.lit("m").alias("_kind"), F.col("_cell").alias("_fid"), "band", "l", "r", "yl", "yr", "c")))
        pieces = [ov.group_pieces(members, lp, ["_kind", "_fid"], band)]
        keep = lambda n: (n[0] != 0) & (n[1] != 0) & (n[2] == 0)
        n_layers = 3
    allp = pieces[0]
    for p in pieces[1:]:
        allp = allp.unionByName(p)
    res = ov.slab_overlay(allp, n_layers, keep, band=prm.band_width, max_pieces=prm.max_band_pieces)
    if b is None:
        # a feature wholly covered has no kept trapezoid: area 0
        cut = subj.select(F.col("g").alias(fa)).join(res.select(F.col("g").alias(fa), "area"), fa, "left")
        return cut.select(fa, F.coalesce("area", F.lit(0.0)).alias("area")).unionByName(untouched)
    res = ab.select(fa, fb).join(res.select(F.col("g")[fa].alias(fa), F.col("g")[fb].alias(fb), "area"),
                                 [fa, fb], "left")
    return res.select(fa, fb, F.coalesce("area", F.lit(0.0)).alias("area"))  # pairs wholly erased: 0


def _erased(a: DataFrame, fa: str, masks: DataFrame, fm: str, whole, prm: P.Params) -> tuple[DataFrame, DataFrame]:
    """The trapezoids (fa, rings) of features with the masks erased, and the
    features that need no overlay: those that meet no mask and are ``whole``."""
    band = prm.band_width
    cells, outline = ds.dissolved(masks, fm, prm)
    mp = ov.bbox_pairs(a, fa, cells, "_cell", prm.cell_size).select(
        F.col(fa).alias("g"), F.col("_cell").alias("_fid"), F.lit(1).alias("layer"), F.col("_ox0").alias("xmin"), F.col("_ox1").alias("xmax"))
    # rows of a repeated key stay apart where no mask's box meets them; a cell's extent is wider than those
    many = a.groupBy(fa).count().where("count > 1").select(fa)
    met = ov.bbox_pairs(a.select(fa, "rings").join(many, fa, "left_semi"), fa, masks, fm, prm.cell_size).select(fa)
    hit = mp.select(F.col("g").alias(fa)).join(many, fa, "left_anti").union(met).distinct().withColumn("_hit", F.lit(True))
    tagged = a.join(hit, fa, "left").withColumn("_own", F.col("_hit").isNull() & whole)
    own = tagged.filter(~F.col("_own")).select(F.col(fa).alias("g"), F.col(fa).alias("_fid"), F.lit(0).alias("layer"))
    pieces = ov.group_pieces(own, ov.layer_pieces(a, fa, band).withColumnRenamed(fa, "_fid"), "_fid").unionByName(
        ov.group_pieces(mp, outline.withColumnRenamed("_cell", "_fid"), "_fid", band))
    parts = ov.slab_overlay(pieces, 2, lambda n: (n[0] != 0) & (n[1] == 0), geometry=True, band=band, max_pieces=prm.max_band_pieces)
    return parts.select(F.col("g").alias(fa), "rings"), tagged.filter("_own").select(fa, "rings")


def erase_union_parts(a: DataFrame, fa: str, masks: DataFrame, fm: str, prm: P.Params = P.DEFAULT) -> DataFrame:
    """What ``erase_union_area`` measures: (fa, rings), one row per trapezoid.
    A feature that meets no mask keeps its own rings, one that is wholly
    covered has no row."""
    parts, own = _erased(a, fa, masks, fm, F.lit(True), prm)
    return parts.unionByName(own)


def erase_union_polygons(a: DataFrame, fa: str, masks: DataFrame, fm: str, prm: P.Params = P.DEFAULT) -> DataFrame:
    """G12 as polygons: (fa, polygons), one row a feature with outer rings and
    holes. A feature of one outer ring that meets no mask keeps its rings."""
    outer = lambda r: geo.ring_signed_area(r) > 0
    parts, own = _erased(a, fa, masks, fm, F.size(F.filter("rings", outer)) == 1, prm)
    kept = own.select(fa, F.array(F.struct(F.filter("rings", outer)[0].alias("outer"), F.filter("rings", lambda r: ~outer(r)).alias("holes"))).alias("polygons"))
    return polygons(parts, [fa], prm=prm).union(kept)


def dissolve_polygons(layer: DataFrame, fid: str, by: str, prm: P.Params = P.DEFAULT) -> DataFrame:
    """(by, polygons), the union of the features of each value."""
    pieces = ov.group_pieces(layer.select(F.col(by).alias("g"), F.col(fid).alias("_fid"), F.lit(0).alias("layer")),
                             ov.layer_pieces(layer, fid, prm.band_width).withColumnRenamed(fid, "_fid"), "_fid")
    parts = ov.slab_overlay(pieces, 1, lambda n: n[0] != 0, geometry=True, band=prm.band_width, max_pieces=prm.max_band_pieces)
    return polygons(parts.select(F.col("g").alias(by), "rings"), [by], prm=prm)


def repair_crossings(layer: DataFrame, fid: str, prm: P.Params = P.DEFAULT) -> DataFrame:
    """G1 for rings that cross or run over themselves: every feature that is
    not plainly convex goes through a one-layer slab pass; where the area of
    its nonzero-winding region differs from its shoelace area, the region's
    trapezoids replace its rings (so area, centroid and overlay agree)."""
    band = prm.band_width
    odd = layer.filter(~geo.is_convex("rings"))
    pieces = ov.group_pieces(odd.select(F.col(fid).alias("g"), F.col(fid).alias("_fid"), F.lit(0).alias("layer")),
                             ov.layer_pieces(odd, fid, band).withColumnRenamed(fid, "_fid"), "_fid")
    parts = ov.slab_overlay(pieces, 1, lambda n: n[0] != 0, geometry=True, band=band, max_pieces=prm.max_band_pieces)
    solved = parts.groupBy("g").agg(F.sum("area").alias("_a"), F.flatten(F.collect_list("rings")).alias("_new"))
    j = layer.join(solved, layer[fid] == solved["g"], "left")
    differs = F.abs(F.col("_a") - geo.area("rings")) > 1e-6 * F.greatest(F.lit(1.0), F.col("_a"))
    fixed = F.when(F.coalesce(differs, F.lit(False)), F.col("_new")).otherwise(F.col("rings"))
    # a one-row generator: the choice is made once per feature, also where a
    # caller maps over the rings
    once = j.select(*[F.col(c) for c in layer.columns if c != "rings"], F.explode(F.array(F.struct(fixed.alias("r")))).alias("_o"))
    return once.select(*[F.col("_o.r").alias("rings") if c == "rings" else F.col(c) for c in layer.columns])


def snap_sqft(c: Column) -> Column:
    """Sums of exact integer areas come back within 1e-9 of the integer;
    snapping to 1e-6 ft² keeps later rounding identical to exact arithmetic."""
    return F.round(c, 6)


def pivot_filled(values: DataFrame, row_col: str, label_col: str, value_col: str,
                 labels: Sequence[str], rows: DataFrame, present: DataFrame) -> DataFrame:
    """R1 with the zero cells of a cross join: ``values`` holds the overlapping
    (row, label, value) cells; every row of ``rows`` appears, and a label
    that exists in ``present`` (one column ``label_col``) but has no overlap
    with a row gets 0.0, as ``STIntersection(...).STArea()`` of a disjoint
    pair did. Labels absent from the layer stay NULL.

    The zero cells are the listed labels exploded per row and semi-joined
    to the labels present (an equi-join on the label, no cross join)."""
    row_keys = rows.select(row_col).distinct()
    zeros = (row_keys.select(row_col, F.explode(F.array(*[F.lit(v) for v in labels])).alias(label_col))
             .join(present.select(label_col).distinct(), label_col, "left_semi")
             .select(row_col, label_col, F.lit(0.0).alias(value_col), F.lit(1).alias("_z")))
    vals = values.select(row_col, label_col, F.col(value_col).cast("double").alias(value_col), F.lit(0).alias("_z"))
    u = vals.unionByName(zeros)
    real = F.col("_z") == 0
    cell = u.groupBy(row_col, label_col).agg(
        F.when(F.count(F.when(real, 1)) > 0, F.max(F.when(real, F.col(value_col))))
         .otherwise(F.max(F.when(~real, F.col(value_col)))).alias(value_col))
    piv = cell.groupBy(row_col).pivot(label_col, list(labels)).agg(F.first(value_col))
    return row_keys.join(piv, row_col, "left").select(row_col, *[F.col(f"`{v}`") for v in labels])


def waterfall(layer: DataFrame, fid: str, masks: DataFrame, fm: str, order_col: str, n_orders: int,
              prm: P.Params = P.DEFAULT, geometry: bool | str = False) -> DataFrame:
    """Erase mask layers in turn (order 0, 1, ...). One labelled slab
    pass gives, per feature, the area each step cuts (the first covering
    mask wins) and what remains (label NULL). With ``geometry=True`` the
    remaining parts come back as rings (one trapezoid per row); with
    ``geometry="steps"`` all parts do, with the step that cuts them (NULL for
    what remains), so the cut layer of a step and the layer that is left
    after it are filters of one result.

    Every feature of the (inventory-sized) layer goes through the pass, with
    the masks of each order dissolved by cells: a mask layer's own overlaps
    decide nothing."""
    band = prm.band_width
    box = geo.bbox("rings")
    subj = layer.select(F.col(fid).alias("g"), F.lit("f").alias("_kind"), F.col(fid).cast("string").alias("_fid"), F.lit(0).alias("layer"),
                        box["xmin"].alias("xmin"), box["xmax"].alias("xmax"))
    cells, outline = ds.dissolved(masks, fm, prm, F.col(order_col) + 1)
    mp = (ov.bbox_pairs(layer, fid, cells, "_cell", prm.cell_size)
          .join(cells.select("_cell", "layer"), "_cell")
          .select(F.col(fid).alias("g"), F.lit("m").alias("_kind"), F.col("_cell").alias("_fid"), "layer",
                  F.col("_ox0").alias("xmin"), F.col("_ox1").alias("xmax")))
    lp = (ov.layer_pieces(layer, fid, band).select(F.lit("f").alias("_kind"), F.col(fid).cast("string").alias("_fid"),
                                                   "band", "l", "r", "yl", "yr", "c")
          .unionByName(outline.select(F.lit("m").alias("_kind"), F.col("_cell").alias("_fid"), "band", "l", "r", "yl", "yr", "c")))
    pieces = ov.group_pieces(subj.unionByName(mp), lp, ["_kind", "_fid"], band)
    n_layers = n_orders + 1

    def first_cover(n):
        out = None
        for k in range(1, n_layers):
            out = F.when(n[k] != 0, F.lit(k - 1)) if out is None else out.when(n[k] != 0, F.lit(k - 1))
        return out

    if geometry == "steps":
        res = ov.slab_overlay(pieces, n_layers, lambda n: n[0] != 0, label=first_cover, geometry=True, band=band,
                              max_pieces=prm.max_band_pieces)
        return res.select(F.col("g").alias(fid), F.col("label").alias("step"), "rings")
    if geometry:
        keep = lambda n: (n[0] != 0) & (first_cover(n).isNull())
        res = ov.slab_overlay(pieces, n_layers, keep, geometry=True, band=band, max_pieces=prm.max_band_pieces)
        return res.select(F.col("g").alias(fid), "rings")
    res = ov.slab_overlay(pieces, n_layers, lambda n: n[0] != 0, label=first_cover, band=band,
                          max_pieces=prm.max_band_pieces)
    return res.select(F.col("g").alias(fid), F.col("label").alias("step"), "area")
