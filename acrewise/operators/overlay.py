"""Polygon overlay as joins, aggregations and windows on an edge table.

Edges are cut into fixed-width x-bands; every quantity below is a sum over
x, so bands are independent and the work per group is bounded by the
edges of one band, not of the whole polygon.

G9  ``pair_area`` / ``triple_area``: with signs c = +1 for an edge running
    right-to-left and -1 otherwise, the indicator of a polygon is
    Σ_e c_e [x in e][y < y_e(x)], so
        area(A∩B)   = Σ_{a,b}   c_a c_b   ∫ min(y_a, y_b) dx
        area(A∩B∩C) = Σ_{a,b,c} c_a c_b c_c ∫ min(y_a, y_b, y_c) dx
    over the common x-range of the edges (closed form, pure Column math).
G10 ``slab_overlay``: per group and band, all edge end-points and edge
    crossings cut x into slabs; inside a slab edges do not cross, so a
    window ordered by height gives running winding counts per layer and
    the trapezoid between consecutive edges belongs to every layer whose
    count is non-zero. Any predicate on the counts (intersection,
    difference, union, first covering mask) selects the pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrewise.functions import geometry as geo
from acrewise.operators import tiles
from acrewise.operators.spatial import at_levels, box_cells, cell_width, level_of, polygon_edges
from acrewise.operators.tiles import SUB_BANDS, sql_interp
from acrewise.session import ensure_checkpoint_dir


# ------------------------------------------------------------------ pieces
def banded_pieces(edges: DataFrame, band: float, keys: Sequence[str]) -> DataFrame:
    """Non-vertical edges clipped to x-bands.

    Output: keys..., band, l, r, yl, yr, c (c = +1 right-to-left, -1 else).
    """
    e = edges.filter("ax <> bx").selectExpr(
        *[f"`{k}`" for k in keys],
        "least(ax, bx) AS _l", "greatest(ax, bx) AS _r",
        "CASE WHEN bx < ax THEN by ELSE ay END AS _yl", "CASE WHEN bx < ax THEN ay ELSE by END AS _yr",
        "CASE WHEN bx < ax THEN 1 ELSE -1 END AS c",
        f"explode(sequence(CAST(floor(least(ax, bx) / {band!r}) AS BIGINT), "
        f"CAST(floor(greatest(ax, bx) / {band!r}) AS BIGINT))) AS band")
    e = e.selectExpr("*", f"greatest(_l, band * {band!r}) AS l", f"least(_r, (band + 1) * {band!r}) AS r") \
        .filter("r > l")
    return e.selectExpr(*[f"`{k}`" for k in keys], "band", "l", "r",
                        f"{sql_interp('_l', '_r', '_yl', '_yr', 'l')} AS yl",
                        f"{sql_interp('_l', '_r', '_yl', '_yr', 'r')} AS yr", "c")


def layer_pieces(layer: DataFrame, fid: str, band: float, rings: str = "rings") -> DataFrame:
    return banded_pieces(polygon_edges(layer, fid, rings), band, [fid])


# --------------------------------------------------------- candidate pairs
def _filed(layer: DataFrame, fid: str, rings: str, cell: float, tag: str) -> DataFrame:
    x = layer.select(F.col(fid).alias(tag), geo.bbox(rings).alias(f"{tag}_bb"))
    return x.withColumn(f"{tag}_level", level_of(F.col(f"{tag}_bb"), cell))


def bbox_pairs(a: DataFrame, fa: str, b: DataFrame, fb: str, cell: float,
               rings_a: str = "rings", rings_b: str = "rings") -> DataFrame:
    """(fa, fb, base, _ox0, _oy0, _ox1, _oy1) for every pair of features
    whose boxes overlap with positive area (the _o* columns are the overlap
    box). ``base`` is a per-pair height the integrals are measured from.

    A pair meets at the level of its larger feature: each feature is filed in
    the cells of its own level, and the smaller one looks into its cells of the
    other layer's levels above (``seek`` tells which of the two looks). Each
    pair is kept in one cell only (the cell of the lower-left corner of the box
    overlap), so no distinct is needed."""
    xa, xb = _filed(a, fa, rings_a, cell, "_a"), _filed(b, fb, rings_b, cell, "_b")

    def cells(x: DataFrame, tag: str, other: DataFrame, theirs: str, first: int, seek: str) -> DataFrame:
        home = x.withColumn("level", F.col(f"{tag}_level")).withColumn("seek", F.lit(theirs))
        above = at_levels(x, F.col(f"{tag}_level") + first, other, f"{theirs}_level").withColumn("seek", F.lit(seek))
        return box_cells(home.unionByName(above).drop(f"{tag}_level"), f"{tag}_bb", cell)
    ca = cells(xa, "_a", xb, "_b", 0, "_a")  # features of one level: a looks
    cb = cells(xb, "_b", xa, "_a", 1, "_b")
    ox0 = F.greatest("_a_bb.xmin", "_b_bb.xmin")
    oy0 = F.greatest("_a_bb.ymin", "_b_bb.ymin")
    w = cell_width(F.col("level"), cell)
    j = ca.join(cb, ["seek", "level", "cx", "cy"]).filter(
        (ox0 < F.least("_a_bb.xmax", "_b_bb.xmax")) & (oy0 < F.least("_a_bb.ymax", "_b_bb.ymax"))
        & (F.col("cx") == F.floor(ox0 / w)) & (F.col("cy") == F.floor(oy0 / w)))
    return j.select(F.col("_a").alias(fa), F.col("_b").alias(fb), oy0.alias("base"),
                    ox0.alias("_ox0"), oy0.alias("_oy0"),
                    F.least("_a_bb.xmax", "_b_bb.xmax").alias("_ox1"), F.least("_a_bb.ymax", "_b_bb.ymax").alias("_oy1"))


# ------------------------------------------------------------- closed form
def sql_int_min2(l: str, r: str, f0: str, f1: str, g0: str, g1: str) -> str:
    """SQL text: ∫_l^r min(f, g) dx for f, g linear with the given end values,
    as (∫f + ∫g − ∫|f − g|) / 2 with |f − g| split at its zero."""
    w = f"({r} - {l})"
    d0, d1 = f"({f0} - {g0})", f"({f1} - {g1})"
    abs_int = (f"CASE WHEN {d0} * {d1} >= 0 THEN {w} * abs({d0} + {d1}) / 2 "
               f"ELSE {w} * try_divide({d0} * {d0} + {d1} * {d1}, 2 * (abs({d0}) + abs({d1}))) END")
    return f"(({w} * ({f0} + {f1}) / 2 + {w} * ({g0} + {g1}) / 2 - ({abs_int})) / 2)"


def _side(p: DataFrame, fid: str, tag: str) -> DataFrame:
    return p.select(F.col(fid).alias(tag), F.col("band").alias(f"{tag}_band"),
                    *[F.col(c).alias(f"{tag}_{c}") for c in ("l", "r", "yl", "yr", "c")])


def _at_sql(tag: str, x: str) -> str:
    return sql_interp(f"{tag}_l", f"{tag}_r", f"{tag}_yl", f"{tag}_yr", x)


def near_overlap(pairs: DataFrame, pieces: DataFrame, fid: str, band: float) -> DataFrame:
    """The pairs with those pieces of feature ``fid`` that reach into the
    pair's overlap box (``_ox0``, ``_ox1``): the bands of the box are spelled
    out first, so a feature with many edges is joined on (feature, band) and
    gives a small partner the edges near it, not all of them. Exact, as the
    other feature has no edges beyond the box's x-range."""
    if "_ox0" not in pairs.columns:
        return pairs.join(pieces, fid)
    spelled = pairs.withColumn("band", F.explode(F.sequence(
        F.floor(F.col("_ox0") / band), F.floor(F.col("_ox1") / band))))
    return spelled.join(pieces, [fid, "band"]).filter("r > _ox0 AND l < _ox1")


def met_pieces(pairs: DataFrame, fa: str, fb: str, pieces_a: DataFrame, pieces_b: DataFrame,
               band: float | None = None, max_pieces: int | None = None) -> DataFrame:
    """Every two pieces of a candidate pair's features over a common x-range:
    (fa, fb, base, _s, _L, _R, _pa_*, _pb_*) with the product of their signs and
    the range.

    With ``band`` and ``max_pieces``, a (b-feature, band) with more edges is
    cut into sub-bands and the a-side edges are mapped onto that feature's
    grid (clipped), so a small feature meeting a huge, detailed one joins
    only the edges of its own sub-band."""
    ka, kb = pieces_a.columns[0], pieces_b.columns[0]
    if band is not None and max_pieces is not None:
        grid = band_grid(pieces_b, kb, max_pieces)
        a_rows = near_overlap(pairs, pieces_a.withColumnRenamed(ka, fa), fa, band)
        a_rows = onto_grid(a_rows.withColumnRenamed(fb, "_fbk"), grid.withColumnRenamed(kb, "_fbk"),
                           "_fbk", band, clip=True).withColumnRenamed("_fbk", fb)
        b_rows = onto_grid(pieces_b, grid, kb, band, clip=True)
        pa = a_rows.select(fa, fb, "base", F.col("sband").alias("_pa_band"),
                           *[F.col(c).alias(f"_pa_{c}") for c in ("l", "r", "yl", "yr", "c")])
        pb = b_rows.select(F.col(kb).alias("_pb"), F.col("sband").alias("_pb_band"),
                           *[F.col(c).alias(f"_pb_{c}") for c in ("l", "r", "yl", "yr", "c")])
        j = pa.join(pb, (F.col(fb) == F.col("_pb")) & (F.col("_pa_band") == F.col("_pb_band")))
    else:
        pa = _side(pieces_a, ka, "_pa")
        pb = _side(pieces_b, kb, "_pb")
        j = (pairs.join(pa, F.col(fa) == F.col("_pa"))
             .join(pb, (F.col(fb) == F.col("_pb")) & (F.col("_pa_band") == F.col("_pb_band"))))
    return j.selectExpr(f"`{fa}`", f"`{fb}`", "base", "_pa_c * _pb_c AS _s",
                     "greatest(_pa_l, _pb_l) AS _L", "least(_pa_r, _pb_r) AS _R",
                     "_pa_l", "_pa_r", "_pa_yl", "_pa_yr", "_pb_l", "_pb_r", "_pb_yl", "_pb_yr").filter("_R > _L")


def pair_area(pairs: DataFrame, fa: str, fb: str, pieces_a: DataFrame, pieces_b: DataFrame,
              band: float | None = None, max_pieces: int | None = None) -> DataFrame:
    """Exact overlap area for each candidate pair -> (fa, fb, area), from
    the pieces that ``met_pieces`` joins."""
    j = met_pieces(pairs, fa, fb, pieces_a, pieces_b, band, max_pieces)
    j = j.selectExpr(f"`{fa}`", f"`{fb}`", "_s", "_L", "_R",
                     f"{_at_sql('_pa', '_L')} - base AS f0", f"{_at_sql('_pa', '_R')} - base AS f1",
                     f"{_at_sql('_pb', '_L')} - base AS g0", f"{_at_sql('_pb', '_R')} - base AS g1")
    term = F.expr(f"_s * {sql_int_min2('_L', '_R', 'f0', 'f1', 'g0', 'g1')}")
    return j.groupBy(fa, fb).agg(F.sum(term).alias("area"))


def triple_area(triples: DataFrame, fa: str, fb: str, fc: str,
                pieces_a: DataFrame, pieces_b: DataFrame, pieces_c: DataFrame,
                band: float | None = None, max_pieces: int | None = None) -> DataFrame:
    """G9 for three layers: area(A∩B∩C) per candidate triple; min of three
    lines = min(min(f, g), h), split where f and g cross.

    With ``band`` and ``max_pieces``, every band in which some feature of
    any of the three layers holds more edges is cut into the finest
    sub-band grid any of them needs there, and all three layers are clipped
    onto that one grid (exact: the integral is a sum over x)."""
    ka, kb, kc = pieces_a.columns[0], pieces_b.columns[0], pieces_c.columns[0]
    if band is not None and max_pieces is not None:
        hot = (band_grid(pieces_a, ka, max_pieces).select("band", "_k")
               .unionByName(band_grid(pieces_b, kb, max_pieces).select("band", "_k"))
               .unionByName(band_grid(pieces_c, kc, max_pieces).select("band", "_k"))
               .groupBy("band").agg(F.max("_k").alias("_k")).withColumn("_all", F.lit(0)))

        def regrid(p):
            g = onto_grid(p.withColumn("_all", F.lit(0)), hot, "_all", band, clip=True)
            return g.drop("_all").withColumnRenamed("band", "_wide").withColumnRenamed("sband", "band")
        pieces_a, pieces_b, pieces_c = regrid(pieces_a), regrid(pieces_b), regrid(pieces_c)
    pa = _side(pieces_a, ka, "_pa")
    pb = _side(pieces_b, kb, "_pb")
    pc = _side(pieces_c, kc, "_pc")
    on_a = F.col(fa) == F.col("_pa")
    if band is not None and "_ox0" in triples.columns:
        # the bands of the triple's overlap box first, as in near_overlap
        triples = triples.withColumn("_tb", F.explode(F.sequence(F.floor(F.col("_ox0") / band), F.floor(F.col("_ox1") / band))))
        wide = pieces_a.select(F.col(ka).alias("_pa"), F.col("_wide" if "_wide" in pieces_a.columns else "band").alias("_pa_wide"),
                               F.col("band").alias("_pa_band"), *[F.col(c).alias(f"_pa_{c}") for c in ("l", "r", "yl", "yr", "c")])
        pa, on_a = wide, on_a & (F.col("_tb") == F.col("_pa_wide")) & (F.col("_pa_r") > F.col("_ox0")) & (F.col("_pa_l") < F.col("_ox1"))
    j = (triples.join(pa, on_a)
         .join(pb, (F.col(fb) == F.col("_pb")) & (F.col("_pa_band") == F.col("_pb_band")))
         .join(pc, (F.col(fc) == F.col("_pc")) & (F.col("_pa_band") == F.col("_pc_band"))))
    j = j.selectExpr(f"`{fa}`", f"`{fb}`", f"`{fc}`", "base", "_pa_c * _pb_c * _pc_c AS _s",
                     "greatest(_pa_l, _pb_l, _pc_l) AS _L", "least(_pa_r, _pb_r, _pc_r) AS _R",
                     *[f"{t}_{c}" for t in ("_pa", "_pb", "_pc") for c in ("l", "r", "yl", "yr")]).filter("_R > _L")
    j = j.selectExpr(f"`{fa}`", f"`{fb}`", f"`{fc}`", "_s", "_L", "_R",
                     f"{_at_sql('_pa', '_L')} - base AS f0", f"{_at_sql('_pa', '_R')} - base AS f1",
                     f"{_at_sql('_pb', '_L')} - base AS g0", f"{_at_sql('_pb', '_R')} - base AS g1",
                     f"{_at_sql('_pc', '_L')} - base AS h0", f"{_at_sql('_pc', '_R')} - base AS h1")
    # split at the crossing of f and g (t = 1 when they do not cross)
    j = j.selectExpr("*", "CASE WHEN (f0 - g0) * (f1 - g1) < 0 THEN try_divide(f0 - g0, (f0 - g0) - (f1 - g1)) "
                          "ELSE CAST(1 AS DOUBLE) END AS _t")
    j = j.selectExpr(f"`{fa}`", f"`{fb}`", f"`{fc}`", "_s", "_L", "_R", "h0", "h1",
                     "_L + (_R - _L) * _t AS _xc", "least(f0, g0) AS m0", "least(f1, g1) AS m1",
                     "CASE WHEN (f0 - g0) * (f1 - g1) < 0 THEN f0 + (f1 - f0) * _t ELSE least(f1, g1) END AS mc",
                     "h0 + (h1 - h0) * _t AS hc")
    term = F.expr(f"_s * ({sql_int_min2('_L', '_xc', 'm0', 'mc', 'h0', 'hc')} + "
                  f"{sql_int_min2('_xc', '_R', 'mc', 'm1', 'hc', 'h1')})")
    return j.groupBy(fa, fb, fc).agg(F.sum(term).alias("area"))


def band_grid(pieces: DataFrame, fid: str, max_pieces: int) -> DataFrame:
    """(fid, band, _k): how many sub-bands each hot (feature, band) is cut
    into — more than ``max_pieces`` edges -> ceil(n / max_pieces). Only hot keys are listed (small: one row per hot band)."""
    cnt = pieces.groupBy(fid, "band").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_pieces)
    return cnt.select(fid, "band", F.least(F.ceil(F.col("_n") / max_pieces), F.lit(SUB_BANDS)).cast("int").alias("_k"))


def onto_grid(df: DataFrame, grid: DataFrame, fid: str, band: float, clip: bool) -> DataFrame:
    """Give rows with an x-range [l, r] (a point has l = r) the sub-band key
    ``sband`` of the grid of feature ``fid``: one row per sub-band the range
    meets. ``clip=True`` also cuts l, r, yl, yr to the sub-band, so every x
    is in exactly one sub-band (needed where x-ranges are integrated)."""
    # join by column names only: the grid is usually derived from the same
    # frame, and bound column references would be ambiguous in a self-join
    g = grid.select(F.col(fid).alias("_gf"), F.col("band").alias("_gb"), "_k")
    j = df.withColumnRenamed(fid, "_lf").join(
        g, (F.col("_lf") == F.col("_gf")) & (F.col("band") == F.col("_gb")), "left")
    j = j.drop("_gf", "_gb").withColumnRenamed("_lf", fid)
    k = F.coalesce(F.col("_k"), F.lit(1))
    lo = F.col("band") * band
    w = F.lit(band) / k
    last = k - 1
    # an unclipped edge may start in an earlier band: clamp to the band's sub-bands
    first_sub = F.greatest(F.least(F.floor((F.col("l") - lo) / w).cast("int"), last), F.lit(0))
    last_sub = F.greatest(F.least(F.floor((F.col("r") - lo) / w).cast("int"), last), F.lit(0))
    j = j.withColumn("_sub", F.explode(F.sequence(first_sub, last_sub)))
    if clip:
        nl = F.greatest(F.col("l"), lo + F.col("_sub") * w)
        nr = F.least(F.col("r"), lo + (F.col("_sub") + 1) * w)
        j = j.select("*", nl.alias("_nl"), nr.alias("_nr")).filter(F.col("_nr") > F.col("_nl"))
        # both new heights from the original end points, in one projection
        rest = [c for c in j.columns if c not in ("l", "r", "yl", "yr", "_nl", "_nr")]
        j = j.select(*rest, F.col("_nl").alias("l"), F.col("_nr").alias("r"),
                     F.expr(sql_interp("l", "r", "yl", "yr", "_nl")).alias("yl"),
                     F.expr(sql_interp("l", "r", "yl", "yr", "_nr")).alias("yr"))
    return j.withColumn("sband", F.col("band") * SUB_BANDS + F.col("_sub")).drop("_k", "_sub")


def slab_overlay(pieces: DataFrame, n_layers: int,
                 keep: Callable[[list[Column]], Column],
                 label: Callable[[list[Column]], Column] | None = None,
                 geometry: bool = False, band: float | None = None,
                 max_pieces: int | None = None, outline: bool = False) -> DataFrame:
    """Boolean overlay of ``n_layers`` layers within each group ``g``.

    ``pieces``: g, layer (0..n_layers-1), band, l, r, yl, yr, c — banded
    edges of every feature taking part in group g. ``keep(counts)`` picks
    trapezoids from the per-layer winding counts; ``label(counts)`` tags
    them (e.g. the first covering mask). Returns (g, [label], area) or, with
    ``geometry=True``, one 4-point ring per kept trapezoid, or, with
    ``outline=True``, the edges between what is kept and what is not, as banded
    pieces (g, band, l, r, yl, yr, c).

    All work is keyed by (g, band), and by tile where a (g, band) holds more
    than ``max_pieces`` edges (``tiles``): the edges are hash-partitioned on
    it, and the crossing search, the slab join and both windows reuse that
    partitioning; besides them only the slab boundaries (one number a row) are
    dealt once, before the final per-group sum. Tiles are disjoint, so areas add up; parts end at their
    sides.
    """
    k = ["g", "band", "tile"]
    hot = False
    if max_pieces is not None:
        # written once: the search for hot bands and the overlay read the edges
        # from there, and a lost executor does not repeat the joins before
        folder = f"{ensure_checkpoint_dir(pieces.sparkSession).rstrip('/')}/slabs-{uuid.uuid4().hex}"
        pieces = tiles.written(pieces, f"{folder}/edges")
        hot = tiles.any_hot(pieces, max_pieces)
    if hot:
        pieces = tiles.written(tiles.tiled(pieces, band, max_pieces), f"{folder}/tiles")
    else:
        pieces = pieces.withColumn("tile", F.lit(0))
    pieces = pieces.repartition(*k)
    # 1. slab boundaries: piece ends and crossings of pieces in the group
    # (dealt anew after the union, whose partitioning is not to be relied on: session.plain_unions)
    ends = pieces.selectExpr(*k, "explode(array(l, r)) AS x")
    bounds = ends.union(tiles.crossings(pieces, k, hot)).repartition(*k).distinct()
    w = Window.partitionBy(*k).orderBy("x")
    slabs = (bounds.withColumn("x1", F.lead("x").over(w)).filter(F.col("x1").isNotNull())
             .withColumnRenamed("x", "x0"))
    # 2. pieces spanning each slab, with heights at both slab sides
    s = slabs.join(pieces, k).filter("l <= x0 AND r >= x1")
    source = ["l", "r", "yl", "yr"] if outline else []
    s = s.selectExpr(*k, "x0", "x1", "layer", "-c AS w", *source,
                     f"CASE WHEN x0 = l THEN yl ELSE {sql_interp('l', 'r', 'yl', 'yr', 'x0')} END AS y0",
                     f"CASE WHEN x1 = r THEN yr ELSE {sql_interp('l', 'r', 'yl', 'yr', 'x1')} END AS y1")
    # 3. running winding counts per layer, bottom to top
    order = [F.col("y0") + F.col("y1"), F.col("layer"), F.col("w")]
    ws = Window.partitionBy(*k, "x0").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wn = Window.partitionBy(*k, "x0").orderBy(*order)
    cnt_cols = [F.sum(F.when(F.col("layer") == i, F.col("w")).otherwise(0)).over(ws).alias(f"n{i}")
                for i in range(n_layers)]
    s = s.select("*", *cnt_cols,
                 F.lead("y0").over(wn).alias("ny0"), F.lead("y1").over(wn).alias("ny1"))
    counts = [F.col(f"n{i}") for i in range(n_layers)]
    if outline:
        below = [F.col(f"n{i}") - F.when(F.col("layer") == i, F.col("w")).otherwise(0) for i in range(n_layers)]
        inside, under = F.col("ny0").isNotNull() & keep(counts), keep(below)
        s = s.select("g", F.shiftright("band", 20).alias("band") if hot else F.col("band"), "x0", "x1", *source,
                     F.when(under & ~inside, 1).when(inside & ~under, -1).alias("c"))
        return _joined_up(s.filter(F.col("c").isNotNull()))
    s = s.filter(F.col("ny0").isNotNull() & keep(counts))
    s = s.withColumn("area", F.expr("(x1 - x0) * ((ny0 - y0) + (ny1 - y1)) / 2"))
    if label is not None:
        s = s.withColumn("label", label(counts))
    if geometry:
        ring = F.expr("array(array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y1), "
                      "named_struct('x', x1, 'y', ny1), named_struct('x', x0, 'y', ny0)))")
        cols = ["g", *(["label"] if label is not None else []), "area"]
        return s.filter(F.col("area") > 0).select(*cols, ring.alias("rings"))
    gcols = ["g", *(["label"] if label is not None else [])]
    return s.groupBy(*gcols).agg(F.sum("area").alias("area"))


def _joined_up(s: DataFrame) -> DataFrame:
    """Stretches [x0, x1] of source edges (l, r, yl, yr) -> pieces: what follows
    on one line becomes one piece, what runs over it the other way cancels."""
    level = F.col("yl") == F.col("yr")
    line = [F.when(~level, F.col(c)).alias(f"_{c}") for c in ("l", "r")] + [F.col(c).alias(f"_{c}") for c in ("yl", "yr")]
    s = s.select("g", "band", *line, F.explode(F.array(F.struct(F.col("x0").alias("p"), F.col("c")), F.struct(F.col("x1").alias("p"), (-F.col("c")).alias("c")))).alias("e"))
    k = ["g", "band", "_l", "_r", "_yl", "_yr"]
    ends = s.groupBy(*k, F.col("e.p").alias("l")).agg(F.sum("e.c").alias("c")).where("c <> 0")
    along = Window.partitionBy(*k).orderBy("l")
    runs = ends.select(*k, "l", F.lead("l").over(along).alias("r"), F.sum("c").over(along).alias("c")).where("c <> 0 AND r IS NOT NULL")
    at = lambda x: f"CASE WHEN _yl = _yr THEN _yl ELSE {sql_interp('_l', '_r', '_yl', '_yr', x)} END"
    return runs.selectExpr("g", "band", "l", "r", f"{at('l')} AS yl", f"{at('r')} AS yr", "CAST(c AS INT) AS c")


def group_pieces(members: DataFrame, layer_pieces_by_fid: DataFrame, fid_col: str | Sequence[str], band: float | None = None) -> DataFrame:
    """Attach the banded pieces of each member feature to its group.

    ``members``: g, layer, the feature's column(s), and optionally a clip
    window xmin/xmax: then only the bands of the window are joined (``band``
    is their width) and the pieces are cut to it, so a huge feature gives
    each group the edges above its window alone."""
    on = [fid_col] if isinstance(fid_col, str) else list(fid_col)
    if "xmin" not in members.columns:
        j = members.join(layer_pieces_by_fid, on)
        return j.select("g", "layer", "band", "l", "r", "yl", "yr", "c")
    if band is not None:
        members = members.withColumn("band", F.explode(F.sequence(F.floor(F.col("xmin") / band), F.floor(F.col("xmax") / band))))
        on = [*on, "band"]
    j = members.join(layer_pieces_by_fid, on)
    j = j.selectExpr("*", "greatest(l, xmin) AS _nl", "least(r, xmax) AS _nr").filter("_nr > _nl")
    return j.selectExpr("g", "layer", "band", "_nl AS l", "_nr AS r",
                        f"{sql_interp('l', 'r', 'yl', 'yr', '_nl')} AS yl",
                        f"{sql_interp('l', 'r', 'yl', 'yr', '_nr')} AS yr", "c")
