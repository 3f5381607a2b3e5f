"""A layer dissolved cell by cell (G14), for overlays that only ask whether any
of its features covers a place.

Where many features lie over each other, a group of the slab overlay that holds
them all costs their number squared, for edges that decide nothing. So the
features are clipped to the grid cells of their level (nine at most) and the
union of each cell is taken once, in rounds: some ``CHUNK`` edges at first, then
``FAN`` of such unions, and so on. Each round leaves only the outline of what is
covered, so a cell covered wholly goes on as two edges, however many features
cover it, and the work is in proportion to the features.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import geometry as geo
from acrewise.operators import overlay as ov
from acrewise.operators.spatial import cell_width, level_of, polygon_edges
from acrewise.operators.tiles import sql_interp, written
from acrewise.session import ensure_checkpoint_dir

CHUNK = 64  # edges of a cell that are dissolved at once
FAN = 16    # unions that are dissolved at once
CELL = ["layer", "level", "cx", "cy"]


def cell_pieces(layer: DataFrame, fid: str, prm: P.Params, by: Column) -> DataFrame:
    """Banded edges of each feature clipped to the cells of its level: (layer,
    level, cx, cy, part, band, l, r, yl, yr, c), ``part`` telling features apart.
    What lies above or below a cell is put on its upper or lower side, so the
    winding counts inside are as before."""
    x = layer.select(F.xxhash64(F.col(fid)).alias("part"), by.cast("int").alias("layer"), geo.bbox("rings").alias("bb"), "rings")
    x = x.where("layer IS NOT NULL AND bb IS NOT NULL").withColumn("level", level_of(F.col("bb"), prm.cell_size))
    x = x.withColumn("w", cell_width(F.col("level"), prm.cell_size))
    x = x.select(F.struct("part", "layer", "level", "w", F.floor(F.col("bb.ymin") / F.col("w")).alias("cy0"),
                          F.floor(F.col("bb.ymax") / F.col("w")).alias("cy1")).alias("_who"), "rings")
    p = ov.banded_pieces(polygon_edges(x, "_who"), prm.band_width, ["_who"]).select("_who.*", "band", "l", "r", "yl", "yr", "c")
    p = p.selectExpr("*", "explode(sequence(floor(l / w), floor(r / w))) AS cx")
    p = p.selectExpr("*", "greatest(l, cx * w) AS _nl", "least(r, (cx + 1) * w) AS _nr").where("_nr > _nl")
    p = p.selectExpr("part", "layer", "level", "cx", "w", "cy0", "cy1", "band", "_nl AS l", "_nr AS r", f"{sql_interp('l', 'r', 'yl', 'yr', '_nl')} AS yl",
                     f"{sql_interp('l', 'r', 'yl', 'yr', '_nr')} AS yr", "c")
    p = p.selectExpr("*", "explode(sequence(cy0, cy1)) AS cy").selectExpr("*", "cy * w AS _b", "(cy + 1) * w AS _t")
    # cut where the edge crosses the lower and the upper side
    at = lambda y: f"CASE WHEN ({y} - yl) * ({y} - yr) < 0 THEN least(greatest(l + (r - l) * try_divide({y} - yl, yr - yl), l), r) END"
    p = p.selectExpr("*", f"array_sort(filter(array(l, {at('_b')}, {at('_t')}, r), v -> v IS NOT NULL)) AS _x")
    p = p.selectExpr("*", "explode(sequence(0, size(_x) - 2)) AS _i").selectExpr("*", "_x[_i] AS _nl", "_x[_i + 1] AS _nr").where("_nr > _nl")
    y = lambda v: f"least(greatest(CASE WHEN {v} = l THEN yl WHEN {v} = r THEN yr ELSE {sql_interp('l', 'r', 'yl', 'yr', v)} END, _b), _t)"
    return p.selectExpr(*CELL, "part", "band", "_nl AS l", "_nr AS r", f"{y('_nl')} AS yl", f"{y('_nr')} AS yr", "c")


def dissolved(layer: DataFrame, fid: str, prm: P.Params = P.DEFAULT, by: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The union of a layer, or of each value of ``by`` (a whole number), as one
    feature a cell: (_cell, layer, rings) with the extent of what is covered
    there as rings, and its outline (_cell, band, l, r, yl, yr, c). Cells of one
    level do not overlap, those of several may."""
    folder = f"{ensure_checkpoint_dir(layer.sparkSession).rstrip('/')}/dissolved-{uuid.uuid4().hex}"
    p = written(cell_pieces(layer, fid, prm, F.lit(0) if by is None else by), f"{folder}/pieces")
    chunks = written(p.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_n")), f"{folder}/chunks")
    left = chunks.agg(F.max("_n")).first()[0] or 1
    p = p.join(chunks, CELL).withColumn("part", F.expr("pmod(part, _n)"))
    while True:
        rows = p.select(F.struct(*CELL, "part").alias("g"), F.lit(0).alias("layer"), "band", "l", "r", "yl", "yr", "c")
        p = ov.slab_overlay(rows, 1, lambda n: n[0] != 0, band=prm.band_width, max_pieces=prm.max_band_pieces, outline=True).select("g.*", "band", "l", "r", "yl", "yr", "c")
        if left == 1:
            break
        left, p = -(-left // FAN), p.withColumn("part", F.expr(f"part div {FAN}"))
    out = written(p.select(F.concat_ws(":", *CELL).alias("_cell"), "layer", "band", "l", "r", "yl", "yr", "c"), f"{folder}/outline")
    box = out.groupBy("_cell", "layer").agg(F.min("l").alias("x0"), F.max("r").alias("x1"), F.min(F.least("yl", "yr")).alias("y0"), F.max(F.greatest("yl", "yr")).alias("y1"))
    return box.select("_cell", "layer", geo.rect_rings("x0", "y0", "x1", "y1").alias("rings")), out.drop("layer")
