"""Polygons assembled from trapezoids: rings, holes, touching corners."""

import pytest
from pyspark.sql import functions as F

from acrewise.operators import overlay as ov
from acrewise.operators import polygons as pg

RINGS = "rings array<array<struct<x: double, y: double>>>"


def box(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def union(spark, shapes, band=3.0, limit=None):
    """shapes (g, rings) -> the trapezoids of each group's union."""
    df = spark.createDataFrame([(i, g, r) for i, (g, r) in enumerate(shapes)], f"fid long, g long, {RINGS}")
    gp = ov.group_pieces(df.select("g", F.lit(0).alias("layer"), "fid"), ov.layer_pieces(df, "fid", band), "fid")
    return ov.slab_overlay(gp, 1, lambda n: n[0] != 0, geometry=True, band=band, max_pieces=limit)


@pytest.mark.parametrize("limit", [None, 6])
def test_rings_holes_and_touching_corners(spark, limit):
    shapes = [
        (1, [box(0, 0, 4, 4)]), (1, [box(4, 1, 7, 3)]),                                     # side by side: 8 corners
        (2, [box(0, 0, 10, 10), box(2, 2, 8, 8)[::-1]]), (2, [box(4, 4, 6, 6)]),           # an island in a hole
        (3, [box(0, 0, 2, 2)]), (3, [box(2, 2, 4, 4)]),                                     # touch in a corner
        (4, [box(0, 0, 3, 1)]), (4, [box(0, 2, 3, 3)]), (4, [box(0, 0, 1, 3)]), (4, [box(2, 0, 3, 3)]),  # a frame of four
        (5, [ring((0, 0), (8, 0), (4, 6))]), (5, [ring((0, 4), (4, -2), (8, 4))]),          # a star of two triangles
        (6, [box(0, 0, 9, 9), box(1, 1, 2, 2)[::-1], box(2, 2, 3, 3)[::-1], box(5, 5, 6, 7)[::-1]]),  # two holes that touch, and one
    ]
    got = pg.polygons(union(spark, shapes, limit=limit), ["g"])
    rows = {r.g: r for r in pg.measured(got, ["g"]).collect()}
    want = {1: (1, 1, 8, 22), 2: (2, 3, 12, 68), 3: (2, 2, 8, 8), 4: (1, 2, 8, 8), 6: (1, 3, 4 + 8 + 4, 77)}
    for g, w in want.items():
        assert tuple(rows[g])[1:4] == w[:3] and rows[g].area == pytest.approx(w[3]), g
    assert (rows[5].n_polygons, rows[5].n_rings, rows[5].n_points) == (1, 1, 12)
    p = {r.g: r.polygons for r in got.collect()}
    assert sorted(len(x.holes) for x in p[2]) == [0, 1]
    assert [len(x.outer) for x in p[2] if x.holes] == [4]
    for x in (x for ps in p.values() for x in ps):
        area = lambda r: sum(a.x * b.y - b.x * a.y for a, b in zip(r, r[1:] + r[:1])) / 2
        assert area(x.outer) > 0 and all(area(h) < 0 for h in x.holes)


def test_long_rings_are_linked(spark):
    """A comb of 200 teeth: one ring, whatever its length, and no point lost."""
    teeth = [(1, [box(2 * k, 0, 2 * k + 1, 5)]) for k in range(200)] + [(1, [box(0, -1, 399, 0)])]
    r = pg.measured(pg.polygons(union(spark, teeth, band=50.0, limit=64), ["g"]), ["g"]).first()
    assert (r.n_polygons, r.n_rings, r.area) == (1, 1, 399 + 1000)
    assert r.n_points == 2 + 4 * 200 - 2 + 0


def test_empty_input(spark):
    none = union(spark, [(1, [box(0, 0, 1, 1)])]).where("g = 2")
    assert pg.polygons(none, ["g"]).count() == 0
