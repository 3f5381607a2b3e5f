"""Depth of masks by corners: the same sums as the triples one by one, which
right-angled features do not form."""

import random

import pytest
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.operators import areas as ar
from acrewise.operators import depth as dp

RINGS = "rings array<array<struct<x: double, y: double>>>"


def box(x0, y0, x1, y1):
    return [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def ell(x, y, s):
    return [{"x": float(x + a * s), "y": float(y + b * s)} for a, b in ((0, 0), (3, 0), (3, 1), (1, 1), (1, 2), (0, 2))]


def right_angled(seed, count, side):
    """Boxes, L-shapes and boxes with a hole; whole places, so many are shared."""
    rng = random.Random(seed)
    out = []
    for k in range(count):
        x, y, s = rng.randrange(-40, 40) * 50, rng.randrange(-40, 40) * 50, rng.randrange(1, side)
        out.append((k, [[box(x, y, x + 3 * s, y + 2 * s)], [ell(x, y, s)], [box(x, y, x + 9 * s, y + 9 * s), box(x + s, y + 2 * s, x + 3 * s, y + 4 * s)[::-1]]][k % 3]))
    return out


def layer(spark, rows, fid):
    return spark.createDataFrame(rows, f"{fid} long, {RINGS}")


def by_triples(a, b, m, prm):
    t = ar.triple_areas(a, "a", b, "b", m, "m", prm).groupBy("a", "b").agg(F.sum("area").alias("t"))
    return {(r.a, r.b): r.t for r in t.collect()}


def same(got, want, **near):
    assert {k: v for k, v in got.items() if abs(v) > 1e-3} == {k: pytest.approx(v, **near) for k, v in want.items() if abs(v) > 1e-3}


@pytest.mark.parametrize("strips, few", [(256, 16), (4, 2), (1, 1)])
def test_depth_equals_the_triples(spark, monkeypatch, strips, few):
    monkeypatch.setattr(dp, "STRIPS", strips)
    monkeypatch.setattr(dp, "FEW", few)
    a = layer(spark, [(0, [box(-2000, -2100, 100, 2000)]), (1, [ell(-300, -500, 900)])], "a")
    b, m = layer(spark, right_angled(3, 40, 60), "b"), layer(spark, right_angled(5, 90, 130), "m")
    prm = P.Params(max_band_pieces=16)
    got = {(r.a, r.b): r._t for r in ar.masked_areas(a, "a", b, "b", m, "m", prm).collect()}
    want = by_triples(a, b, m, prm)
    assert len(want) > 20
    same(got, want, abs=1e-6)


def test_slanted_repeated_and_missing_keys(spark):
    slant = [[{"x": -900.0, "y": -800.0}, {"x": 1000.5, "y": -200.0}, {"x": 300.0, "y": 1200.0}]]
    one = [box(0.25, 0.5, 700.75, 900.125)]
    a = layer(spark, [(0, [box(-2000, -2000, 2000, 2000)]), (1, slant), (2, one), (2, one), (None, one)], "a")
    b = layer(spark, [*right_angled(3, 12, 60), (3, [box(-90, -90, 900, 900)]), (20, one), (20, one), (21, slant), (None, one)], "b")
    m = layer(spark, [*right_angled(5, 20, 130), (4, [box(-500, -500, 500, 500)]), (30, one), (30, one), (31, slant), (None, one), (32, None)], "m")
    for x, y, z in ((a, b, m), (a.where("a <> 1"), b.where("b NOT IN (3, 21)"), m.where("m NOT IN (4, 31)"))):
        got = {(r.a, r.b): r._t for r in ar.masked_areas(x, "a", y, "b", z, "m").collect()}
        same(got, by_triples(x, y, z, P.DEFAULT), rel=1e-9)


def test_right_angled_features_form_no_triples(spark, monkeypatch):
    """Before, each overlapping (feature, mask) pair was a row."""
    def none(*args, **kw):
        raise AssertionError("triples are formed")
    monkeypatch.setattr(ar, "triple_areas", none)
    a = layer(spark, [(0, [box(0, 0, 100, 100)])], "a")
    b = layer(spark, [(k, [box(k, k, k + 10, k + 10)]) for k in range(50)], "b")
    m = layer(spark, [(k, [box(-5, -5, 105, 105)]) for k in range(60)] + [(60, [box(0, 0, 3, 2)])], "m")
    got = {r.b: r.area for r in ar.erase_each(a, "a", b, "b", m, "m").collect()}
    assert got == {k: pytest.approx(100 - {0: 6, 1: 2}.get(k, 0)) for k in range(50)}


def test_no_masks(spark):
    a = layer(spark, [(0, [box(0, 0, 100, 100)])], "a")
    b = layer(spark, [(0, [box(1, 1, 5, 5)])], "b")
    assert [r.area for r in ar.erase_each(a, "a", b, "b", layer(spark, [], "m"), "m").collect()] == [None]
