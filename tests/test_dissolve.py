"""Masks dissolved by cells: the same erase, and groups that do not grow with
the number of masks over a place."""

import random

import pytest
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.operators import areas as ar
from acrewise.operators import dissolve as ds
from acrewise.operators import overlay as ov

RINGS = "rings array<array<struct<x: double, y: double>>>"


def box(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def shapes(seed, count):
    """Boxes, triangles and boxes with a hole, of sides from 20 to 9,000 feet."""
    rng = random.Random(seed)
    out = []
    for k in range(count):
        x, y, side = rng.uniform(-4000, 4000), rng.uniform(-4000, 4000), 20 * 450 ** rng.random() ** 2
        if k % 3 == 0:
            rings = [[{"x": x, "y": y}, {"x": x + side, "y": y + side * rng.uniform(-0.4, 0.4)}, {"x": x + side * rng.uniform(-0.5, 1), "y": y + side}]]
        elif k % 3 == 1:
            rings = [box(round(x), round(y), round(x) + round(side), round(y) + round(side / 2) + 1)]
        else:
            rings = [box(x, y, x + side, y + side), box(x + side / 3, y + side / 4, x + side / 2, y + side / 2)[::-1]]
        out.append((k - k % 7 // 6, k % 4, rings))      # some ids stand twice
    return out


def layer(spark, rows, fid):
    return spark.createDataFrame(rows, f"{fid} long, ord int, {RINGS}")


def plainly(a, masks, n_layers, keep, label=None):
    """The overlay with every mask in the group of every feature."""
    own = a.select(F.col("f").alias("g"), F.col("f").alias("_fid"), F.lit(0).alias("layer"))
    every = masks.select(F.monotonically_increasing_id().alias("_fid"), (F.col("ord") + 1).alias("layer"), "rings").localCheckpoint()
    mp = a.select(F.col("f").alias("g")).crossJoin(every.select("_fid", "layer" if n_layers > 2 else F.lit(1).alias("layer")))
    p = ov.group_pieces(own, ov.layer_pieces(a, "f", 1000.0).withColumnRenamed("f", "_fid"), "_fid").unionByName(
        ov.group_pieces(mp, ov.layer_pieces(every, "_fid", 1000.0), "_fid"))
    return ov.slab_overlay(p, n_layers, keep, label)


def test_erase_and_waterfall_equal_the_overlay_of_all_masks(spark, monkeypatch):
    monkeypatch.setattr(ds, "CHUNK", 12)  # several rounds, and tiles in some
    monkeypatch.setattr(ds, "FAN", 3)
    prm = P.Params(max_band_pieces=40)
    a = layer(spark, [(k, 0, [box(x, y, x + s, y + s)]) for k, (x, y, s) in enumerate([(-3000, -2500, 700), (100, 50, 1900), (900, 2000, 300), (30000, 0, 50)])], "f")
    masks = layer(spark, shapes(7, 60), "m")
    want = {r.g: r.area for r in plainly(a, masks, 2, lambda n: (n[0] != 0) & (n[1] == 0)).collect()}
    got = {r.f: r.area for r in ar.erase_union_area(a, "f", masks, "m", prm=prm).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[3] == 2500
    assert got == {k: pytest.approx(want.get(k, 0.0), abs=1e-5) for k in got}
    first = lambda n: F.when(n[1] != 0, 0).when(n[2] != 0, 1).when(n[3] != 0, 2).when(n[4] != 0, 3)
    want = {(r.g, r.label): r.area for r in plainly(a, masks, 5, lambda n: n[0] != 0, first).collect() if r.area > 1e-6}
    got = {(r.f, r.step): r.area for r in ar.waterfall(a, "f", masks, "m", "ord", 4, prm).collect() if r.area > 1e-6}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in want.items()}


def most_edges(monkeypatch, run) -> int:
    """The edges of the largest group of the last overlay that ``run`` makes."""
    sizes, inner = [], ov.slab_overlay

    def counted(pieces, *args, **kwargs):
        sizes.append(pieces.groupBy("g").count().agg(F.max("count")).first()[0])
        return inner(pieces, *args, **kwargs)
    monkeypatch.setattr(ov, "slab_overlay", counted)
    run()
    monkeypatch.undo()
    return sizes[-1]


def heap(count):
    """Masks that lie over one place, each a little aside."""
    return [(k, k % 2, [box(k % 10, k % 7, 300 + k % 13, 300 + k % 11)]) for k in range(count)]


def test_a_group_does_not_grow_with_the_masks_over_it(spark, monkeypatch):
    a = layer(spark, [(1, 0, [box(-50, -50, 350, 350)])], "f")
    many = layer(spark, heap(400), "m")
    for run in (lambda m: ar.erase_union_area(a, "f", m, "m"), lambda m: ar.erase_union_parts(a, "f", m, "m"),
                lambda m: ar.erase_union_area(a, "f", m, "m", a.withColumnRenamed("f", "b"), "b"),
                lambda m: ar.waterfall(a, "f", m, "m", "ord", 2)):
        assert most_edges(monkeypatch, lambda: run(many)) < 100


def test_no_masks(spark):
    a = layer(spark, [(1, 0, [box(0, 0, 10, 10)])], "f")
    none = layer(spark, [], "m")
    assert ar.erase_union_area(a, "f", none, "m").first().area == 100
    assert [(r.step, r.area) for r in ar.waterfall(a, "f", none, "m", "ord", 2).collect()] == [(None, 100)]


def test_copies_that_meet_no_mask_stay_apart(spark):
    """A repeated key between two masks of one cell, and one that meets a mask."""
    a = layer(spark, [(1, 0, [box(40, 40, 60, 60)])] * 2 + [(2, 0, [box(0, 0, 20, 20)])] * 2, "f")
    masks = layer(spark, [(1, 0, [box(0, 0, 10, 10)]), (2, 0, [box(90, 90, 99, 99)])], "m")
    parts = ar.erase_union_parts(a, "f", masks, "m").select("f", F.expr("rings[0][2].x - rings[0][0].x").alias("w"))
    assert sorted(r.w for r in parts.where("f = 1").collect()) == [20, 20]
    rows = ar.erase_union_polygons(a, "f", masks, "m").groupBy("f").count().collect()
    assert {r.f: r["count"] for r in rows} == {1: 2, 2: 1}
