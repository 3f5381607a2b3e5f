"""The grid of several levels: few cells for a feature of any size, no pair lost."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from acrewise.operators import overlay as ov
from acrewise.operators.spatial import at_levels, point_in_polygon_pairs, polygon_cells


def boxes(seed: int, count: int) -> list[tuple[int, float, float, float, float]]:
    """Boxes of sides from 0.01 to 400,000 feet, some with sides that are
    exactly two cells of a level."""
    rng = random.Random(seed)
    out = []
    for k in range(count):
        x, y = rng.uniform(-3e5, 3e5), rng.uniform(-3e5, 3e5)
        side = 2000.0 * 4 ** rng.randint(-2, 3) if k % 5 == 0 else 10 ** rng.uniform(-2, 5.6)
        if k % 5 == 0:
            x, y = side * (x // side), side * (y // side)
        out.append((k, x, y, x + side, y + side * rng.uniform(0.2, 1)))
    return out


def layer(spark, rows, fid):
    ring = "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))) + ")"
    df = spark.createDataFrame(rows, f"{fid} int, x0 double, y0 double, x1 double, y1 double")
    return df.select(fid, F.array(F.expr(ring)).alias("rings"))


def test_cells_of_a_feature_are_nine_at_most(spark):
    cells = polygon_cells(layer(spark, boxes(1, 400), "f"), "f", "rings", 1000.0)
    got = cells.groupBy("f").count().agg(F.count("*"), F.min("count"), F.max("count")).first()
    assert got[0] == 400 and got[1] >= 1 and got[2] <= 9


def test_pairs_across_levels_equal_brute_force(spark):
    a, b = boxes(2, 250), boxes(3, 250)
    want = sorted((p[0], q[0]) for p in a for q in b
                  if max(p[1], q[1]) < min(p[3], q[3]) and max(p[2], q[2]) < min(p[4], q[4]))
    pairs = ov.bbox_pairs(layer(spark, a, "fa"), "fa", layer(spark, b, "fb"), "fb", 1000.0)
    assert len(want) > 400
    assert sorted((r.fa, r.fb) for r in pairs.collect()) == want


def test_points_meet_polygons_of_every_level(spark):
    a = boxes(4, 200)
    rng = random.Random(5)
    pts = [(k, rng.uniform(-3e5, 3e5), rng.uniform(-3e5, 3e5)) for k in range(500)]
    pts += [(500 + r[0], r[1], r[2]) for r in a]          # the corners, which count as inside
    want = sorted((p, r[0]) for p, x, y in pts for r in a if r[1] <= x <= r[3] and r[2] <= y <= r[4])
    df = spark.createDataFrame(pts, "pid int, x double, y double")
    got = point_in_polygon_pairs(df, "pid", "x", "y", layer(spark, a, "f"), "f")
    assert sorted((r.pid, r.f) for r in got.collect()) == want


def test_only_levels_that_hold_features_are_looked_into(spark):
    cells = polygon_cells(layer(spark, [(1, 0.0, 0.0, 1500.0, 1500.0), (2, 0.0, 0.0, 4e5, 4e5)], "f"), "f", "rings", 1000.0)
    points = spark.range(10)
    assert at_levels(points, F.lit(-3), cells).count() == 20


def test_empty_layers_and_features_without_rings(spark):
    some, none = layer(spark, boxes(6, 5), "fa"), layer(spark, [], "fb")
    assert ov.bbox_pairs(some, "fa", none, "fb", 1000.0).count() == 0
    bare = spark.createDataFrame([(1, None)], "fb int, rings array<array<struct<x:double,y:double>>>")
    assert ov.bbox_pairs(some, "fa", bare, "fb", 1000.0).count() == 0
