"""Spatial joins on a grid, written as equi-joins plus exact residual tests.

* The grid has levels (G17), whose cells are 4 times as wide from one to the
  next. A feature is filed at the level of its own size, where its bounding box
  covers nine cells at most; a point looks into its cell of each level that holds
  features. (level, cell) is an ordinary hash-join key, so the spatial index of
  a database becomes a shuffle (or broadcast) join that Spark plans by itself.
* The exact point-in-polygon test (G7) shoots a vertical ray up from the
  point. Every polygon edge is split over fixed-width x-bands, so the only
  edges the ray can cross are in the point's band: a second equi-join on
  (polygon, band), then a count per (point, polygon) pair. Borders count as
  inside (STIntersects), via an on-edge test in the same aggregate.

Work per candidate pair is the number of polygon edges in one band, not in
the whole polygon, so large, detailed polygons stay cheap per point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise.functions import geometry as geo

STEP = 4.0             # width of a cell in cells of the level below
LOWEST, HIGHEST = -3, 9  # levels; level 0 has the cells of Params.cell_size


def polygon_edges(layer: DataFrame, fid: str, rings: str = "rings") -> DataFrame:
    """Edge table: one row per directed polygon edge.

    Columns: fid, ax, ay, bx, by (direction as stored, so after
    ``repair_rings`` interiors lie to the left of each edge).
    """
    ring = F.explode(F.col(rings)).alias("_ring")
    e = layer.select(F.col(fid), ring).select(fid, F.explode(geo.ring_edges(F.col("_ring"))).alias("_e"))
    return e.select(fid,
                    F.col("_e.a.x").alias("ax"), F.col("_e.a.y").alias("ay"),
                    F.col("_e.b.x").alias("bx"), F.col("_e.b.y").alias("by"))


def band_pieces(edges: DataFrame, band: float) -> DataFrame:
    """Edges spread over every x-band they touch (closed range)."""
    lx = F.least("ax", "bx")
    rx = F.greatest("ax", "bx")
    return edges.withColumn(
        "band", F.explode(F.sequence(F.floor(lx / band), F.floor(rx / band))))


def level_of(box: Column, cell: float) -> Column:
    """The lowest level at which a box is at most two cells wide and high, so
    that it covers nine cells at most (more only beyond ``HIGHEST``)."""
    side = F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"])
    level = F.ceil(F.log(side / (2 * cell)) / math.log(STEP)).cast("int")
    return F.when(box.isNotNull(), F.least(F.greatest(F.coalesce(level, F.lit(LOWEST)), F.lit(LOWEST)), F.lit(HIGHEST)))


def cell_width(level: Column, cell: float) -> Column:
    return F.pow(F.lit(STEP), level) * cell


def box_cells(boxes: DataFrame, box: str, cell: float, level: str = "level") -> DataFrame:
    """A row with ``cx``, ``cy`` for each cell of its level that a box covers."""
    w, b = cell_width(F.col(level), cell), F.col(box)
    return (boxes.withColumn("cx", F.explode(F.sequence(F.floor(b["xmin"] / w), F.floor(b["xmax"] / w))))
            .withColumn("cy", F.explode(F.sequence(F.floor(b["ymin"] / w), F.floor(b["ymax"] / w)))))


def at_levels(rows: DataFrame, first: Column, layer: DataFrame, level: str = "level") -> DataFrame:
    """A row for each level from ``first`` upwards at which ``layer`` has
    features. The levels of a layer are ``HIGHEST - LOWEST + 1`` rows at most."""
    held = F.broadcast(layer.select(F.col(level).alias("_held")).distinct())
    every = F.when(first <= HIGHEST, F.sequence(first, F.lit(HIGHEST)))
    return rows.withColumn("level", F.explode(every)).join(held, F.col("level") == F.col("_held"), "left_semi")


def polygon_cells(layer: DataFrame, fid: str, rings: str, cell: float) -> DataFrame:
    """(fid, _bb, level, cx, cy) for every cell of its level that the polygon's
    box covers."""
    boxes = layer.select(F.col(fid), geo.bbox(rings).alias("_bb"))
    return box_cells(boxes.withColumn("level", level_of(F.col("_bb"), cell)), "_bb", cell)


def point_in_polygon_pairs(points: DataFrame, pid: str, x: str, y: str,
                           polys: DataFrame, fid: str, rings: str = "rings",
                           cell: float = 1000.0, band: float = 1000.0,
                           max_pieces: int | None = 4096) -> DataFrame:
    """All (pid, fid) with the point inside or on the border of the polygon.

    A point in several polygons yields several rows (D9/D22: ``multi='all'``).
    A (polygon, band) with more than ``max_pieces`` edges is cut into
    sub-bands and each point joins only the edges of its own sub-band.
    """
    pts = points.select(F.col(pid), F.col(x).alias("_px"), F.col(y).alias("_py")) \
        .filter(F.col("_px").isNotNull() & F.col("_py").isNotNull())
    cells = polygon_cells(polys, fid, rings, cell)
    w = cell_width(F.col("level"), cell)
    cand = (at_levels(pts, F.lit(LOWEST), cells)
            .withColumn("cx", F.floor(F.col("_px") / w))
            .withColumn("cy", F.floor(F.col("_py") / w))
            .join(cells, ["level", "cx", "cy"])
            .filter((F.col("_px") >= F.col("_bb.xmin")) & (F.col("_px") <= F.col("_bb.xmax"))
                    & (F.col("_py") >= F.col("_bb.ymin")) & (F.col("_py") <= F.col("_bb.ymax")))
            .select(pid, fid, "_px", "_py", F.floor(F.col("_px") / band).alias("band")))
    pieces = band_pieces(polygon_edges(polys, fid, rings), band)
    if max_pieces is not None:
        from acrewise.operators.overlay import band_grid, onto_grid
        pieces = pieces.withColumn("l", F.least("ax", "bx")).withColumn("r", F.greatest("ax", "bx"))
        grid = band_grid(pieces, fid, max_pieces)
        cand = onto_grid(cand.withColumn("l", F.col("_px")).withColumn("r", F.col("_px")), grid, fid, band,
                         clip=False).drop("band", "l", "r").withColumnRenamed("sband", "band")
        pieces = onto_grid(pieces, grid, fid, band, clip=False).drop("band", "l", "r") \
            .withColumnRenamed("sband", "band")
    j = cand.join(pieces, [fid, "band"]).filter(
        (F.col("_px") >= F.least("ax", "bx")) & (F.col("_px") <= F.greatest("ax", "bx")))
    lx, rx = F.least("ax", "bx"), F.greatest("ax", "bx")
    nonvert = F.col("ax") != F.col("bx")
    y_at = F.col("ay") + (F.col("by") - F.col("ay")) * (F.col("_px") - F.col("ax")) / (F.col("bx") - F.col("ax"))
    crosses = nonvert & (F.col("_px") >= lx) & (F.col("_px") < rx) & (y_at > F.col("_py"))
    cross_prod = ((F.col("bx") - F.col("ax")) * (F.col("_py") - F.col("ay"))
                  - (F.col("by") - F.col("ay")) * (F.col("_px") - F.col("ax")))
    on_edge = ((cross_prod == 0)
               & (F.col("_py") >= F.least("ay", "by")) & (F.col("_py") <= F.greatest("ay", "by")))
    agg = j.groupBy(pid, fid).agg(
        F.sum(F.when(crosses, 1).otherwise(0)).alias("_n"),
        F.max(F.when(on_edge, 1).otherwise(0)).alias("_on"))
    return agg.filter((F.col("_on") == 1) | (F.col("_n") % 2 == 1)).select(pid, fid)


def tag_points(points: DataFrame, pid: str, x: str, y: str, layer: DataFrame, fid: str,
               label: str, out: str, default: str | None = None, multi: str = "all",
               rings: str = "rings", cell: float = 1000.0, band: float = 1000.0) -> DataFrame:
    """Attach the label of the polygon(s) each point falls in.

    ``multi='all'`` keeps one row per matching polygon (left join fan-out);
    ``multi='one'`` keeps the lowest label (D10). Unmatched points get
    ``default`` (NULL when None).
    """
    pairs = point_in_polygon_pairs(points, pid, x, y, layer, fid, rings, cell, band)
    labelled = pairs.join(layer.select(fid, F.col(label).alias(out)), fid).select(pid, out)
    if multi == "one":
        labelled = labelled.groupBy(pid).agg(F.min(out).alias(out))
    res = points.join(labelled, pid, "left")
    if default is not None:
        res = res.withColumn(out, F.coalesce(F.col(out), F.lit(default)))
    return res
