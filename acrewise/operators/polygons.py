"""Polygons from the trapezoids of the slab overlay: boundary assembly.

1. Sides. Lower and upper sides of a kept trapezoid run along edges, left and
   right ones along slab borders. A slanted side that two trapezoids share
   stands twice, in opposite directions, and cancels. Level and upright sides
   are put on their line (one y, one x): each adds its direction where it
   begins and takes it away where it ends, and where the running sum is not 0
   there is boundary. So sides of different length cancel as well, and what
   follows on one line becomes one edge.
2. Rings. Every edge has the region at its left; its successor begins where it
   ends (the sharpest left turn, where rings touch in a point). Rings are
   linked by pointer jumping: after round k every edge knows the least edge of
   the 2**k that follow and how far it is, so the rounds are the logarithm of
   the longest ring, and no task holds more than rows of a join.
3. Points between two edges of one direction are left out.
4. A ring with the region outside (clockwise) is a hole; it goes to the smallest
   outer ring of its feature that is larger and holds a point of it.

The result is one row a feature. A ring is one value, so it meets in one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import geometry as geo
from acrewise.operators.rows import row_index
from acrewise.operators.spatial import point_in_polygon_pairs
from acrewise.operators.tiles import written
from acrewise.session import ensure_checkpoint_dir

DIGITS = 6  # decimals of a foot that coordinates are snapped to


def _on_lines(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, at, lo, hi, way) of sides on one line each -> the stretches whose
    ways do not cancel, with way 1 or -1."""
    ends = sides.select(*keys, "at", F.col("lo").alias("p"), "way").union(sides.select(*keys, "at", F.col("hi").alias("p"), -F.col("way")))
    ends = ends.groupBy(*keys, "at", "p").agg(F.sum("way").alias("way")).where("way <> 0")
    line = Window.partitionBy(*keys, "at").orderBy("p")
    runs = ends.select(*keys, "at", F.col("p").alias("lo"), F.lead("p").over(line).alias("hi"), F.sum("way").over(line).alias("way"))
    return runs.where("way <> 0 AND hi IS NOT NULL").withColumn("way", F.signum("way").cast("int"))


def boundary_edges(parts: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """Trapezoids (keys, rings) -> directed edges (keys, x, y, u, v) from (x, y)
    to (u, v), the region at their left."""
    p = [F.round(F.col(rings)[0][k][c], DIGITS) for k, c in ((0, "x"), (1, "x"), (0, "y"), (1, "y"), (2, "y"), (3, "y"))]
    t = parts.select(*keys, *[c.alias(n) for c, n in zip(p, ("x0", "x1", "a0", "a1", "b1", "b0"))])
    flat = t.selectExpr(*keys, "x0", "x1", "explode(array(struct(a0 AS l, a1 AS r, 1 AS way), struct(b0 AS l, b1 AS r, -1 AS way))) AS s").selectExpr(*keys, "x0", "x1", "s.*")
    level = _on_lines(flat.where("l = r").selectExpr(*keys, "l AS at", "x0 AS lo", "x1 AS hi", "way"), keys)
    slanted = flat.where("l <> r").groupBy(*keys, "x0", "l", "x1", "r").agg(F.sum("way").alias("way")).where("way <> 0")
    upright = t.selectExpr(*keys, "explode(array(struct(x1 AS at, a1 AS lo, b1 AS hi, 1 AS way), struct(x0 AS at, a0 AS lo, b0 AS hi, -1 AS way))) AS s").selectExpr(*keys, "s.*")
    upright = _on_lines(upright.where("hi > lo"), keys)
    turned = lambda a, b, c, d: [f"CASE WHEN way > 0 THEN {p} ELSE {q} END AS {n}" for p, q, n in ((a, c, "x"), (b, d, "y"), (c, a, "u"), (d, b, "v"))]
    return (level.selectExpr(*keys, *turned("lo", "at", "hi", "at")).union(upright.selectExpr(*keys, *turned("at", "lo", "at", "hi")))
            .union(slanted.selectExpr(*keys, *turned("x0", "l", "x1", "r"))))


def linked_rings(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, y, u, v) -> (keys, ring, place, x, y): the ring of each edge,
    named by its least edge, and its place along it."""
    spark = edges.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rings-{uuid.uuid4().hex}"
    edges = row_index(edges, [*keys, "x", "y", "u", "v"], "id")
    begins = edges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("id").alias("to"), F.col("x").alias("bx"), F.col("y").alias("by"),
                          (F.col("u") - F.col("x")).alias("dx"), (F.col("v") - F.col("y")).alias("dy"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("u") == F.col("bx"), F.col("v") == F.col("by")]
    turn = F.expr("atan2((u - x) * dy - (v - y) * dx, (u - x) * dx + (v - y) * dy)")
    follow = edges.join(begins, on).groupBy("id").agg(F.max(F.struct(turn.alias("turn"), "to"))["to"].alias("jump"))
    now = written(follow.select("id", "jump", F.col("id").alias("least"), F.lit(0).cast("long").alias("off")), f"{folder}/round0")
    step = 1
    while True:
        then = now.select(F.col("id").alias("jump"), F.col("jump").alias("further"), F.col("least").alias("l2"), F.col("off").alias("o2"))
        less = F.col("l2") < F.col("least")
        now = written(now.join(then, "jump").select("id", F.col("further").alias("jump"), F.least("least", "l2").alias("least"),
                                                     F.when(less, F.col("o2") + step).otherwise(F.col("off")).alias("off"), less.alias("moved")), f"{folder}/round{step}")
        step *= 2
        going, now = now.where("moved"), now.drop("moved")
        if going.isEmpty():
            break
    # the least edge comes first, then the one that is farthest from it
    place = F.when(F.col("off") == 0, F.lit(0)).otherwise(-F.col("off"))
    first = F.when(F.col("off") == 0, 0).otherwise(1)
    return edges.join(now, "id").select(*keys, F.col("least").alias("ring"), F.struct(first.alias("a"), place.alias("b")).alias("place"), "x", "y")


def _without_straight_points(ring: str) -> str:
    """SQL text: the ring without points whose edges have one direction."""
    prev, nxt = f"{ring}[(i + size({ring}) - 1) % size({ring})]", f"{ring}[(i + 1) % size({ring})]"
    dx0, dy0, dx1, dy1 = f"(p.x - {prev}.x)", f"(p.y - {prev}.y)", f"({nxt}.x - p.x)", f"({nxt}.y - p.y)"
    return (f"filter({ring}, (p, i) -> abs({dx0} * {dy1} - {dy0} * {dx1}) > {4 * 10 ** -DIGITS!r} * (abs({dx0}) + abs({dy0}) + abs({dx1}) + abs({dy1})) "
            f"OR {dx0} * {dx1} + {dy0} * {dy1} < 0)")


def polygons(parts: DataFrame, keys: Sequence[str], rings: str = "rings", prm: P.Params = P.DEFAULT) -> DataFrame:
    """Trapezoids (keys, rings) -> one row a feature: (keys, polygons), an
    array of (outer, holes) whose rings do not repeat their first point."""
    folder = f"{ensure_checkpoint_dir(parts.sparkSession).rstrip('/')}/polygons-{uuid.uuid4().hex}"
    parts = written(parts.select(*keys, rings), f"{folder}/parts")  # read for each kind of side
    points = linked_rings(boundary_edges(parts, keys, rings), keys)
    ring = points.groupBy(*keys, "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("r"))
    ring = ring.select(*keys, "ring", F.expr(_without_straight_points("r")).alias("r")).where("size(r) > 2")
    ring = written(ring.withColumn("area", geo.area(F.array("r"))), f"{folder}/rings")

    outer, holes = ring.where("area > 0"), ring.where("area < 0")
    at = holes.selectExpr("ring", "(r[0].x + r[1].x) / 2 AS px", "(r[0].y + r[1].y) / 2 AS py")
    inside = point_in_polygon_pairs(at, "ring", "px", "py", outer.select(F.col("ring").alias("outer_ring"), F.array("r").alias("rings")), "outer_ring", "rings",
                                    prm.cell_size, prm.band_width)
    h = holes.select(*[F.col(k).alias(f"_{k}") for k in keys], "ring", F.col("r").alias("hole"), F.abs("area").alias("size"))
    o = outer.select(*keys, F.col("ring").alias("outer_ring"), F.col("area").alias("outer_size"))
    fits = inside.join(h, "ring").join(o, "outer_ring").where("outer_size > size")
    for k in keys:
        fits = fits.where(F.col(k).eqNullSafe(F.col(f"_{k}")))
    home = fits.groupBy("ring").agg(F.min(F.struct("outer_size", "outer_ring"))["outer_ring"].alias("outer_ring"))
    mine = home.join(h.select("ring", "hole"), "ring").groupBy("outer_ring").agg(F.array_sort(F.collect_list(F.struct("ring", "hole"))).alias("hs"))
    whole = outer.join(mine, outer["ring"] == mine["outer_ring"], "left").select(*keys, "ring", F.struct(
        F.col("r").alias("outer"), F.coalesce(F.transform("hs", lambda x: x["hole"]), F.array().cast(mine.select(F.transform("hs", lambda x: x["hole"])).dtypes[0][1])).alias("holes")).alias("p"))
    return whole.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "p"))), lambda x: x["p"]).alias("polygons"))


def polygon_rings(polygons: str = "polygons"):
    """All rings of a feature's polygons, each outer ring followed by its holes."""
    return F.flatten(F.transform(polygons, lambda p: F.concat(F.array(p["outer"]), p["holes"])))


def measured(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_polygons, n_rings, n_points, area) of assembled polygons."""
    x = df.select(*keys, F.size("polygons").cast("long").alias("n_polygons"), polygon_rings().alias("rings"))
    return x.select(*keys, "n_polygons", F.size("rings").cast("long").alias("n_rings"), F.size(F.flatten("rings")).cast("long").alias("n_points"),
                    F.round(geo.area("rings"), 6).alias("area"))
