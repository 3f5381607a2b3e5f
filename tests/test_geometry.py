"""Hand-made shapes: areas, overlay and point-in-polygon against known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from acrewise.functions import geometry as geo
from acrewise.operators import overlay as ov
from acrewise.operators import tiles
from acrewise.operators.spatial import point_in_polygon_pairs

L_SHAPE = [[(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]]
OFFSET_SQ = [[(1, 1), (3, 1), (3, 3), (1, 3)]]
TRIANGLE = [[(0, 0), (5, 0), (0, 5)]]
HOLED = [[(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (2, 4), (4, 4), (4, 2)]]
BOWTIE = [[(0, 0), (2, 2), (2, 0), (0, 2)]]
SHAPES = {1: L_SHAPE, 2: OFFSET_SQ, 3: TRIANGLE, 4: HOLED, 5: BOWTIE}


def layer(spark, ids):
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in SHAPES[i]]) for i in ids]
    df = spark.createDataFrame(rows, "fid long, raw array<array<struct<x:double,y:double>>>")
    return df.select("fid", geo.repair_rings("raw").alias("rings"))


def test_area_and_repair(spark):
    df = layer(spark, [1, 2, 3, 4]).select("fid", geo.area("rings").alias("a")).orderBy("fid")
    assert [r.a for r in df.collect()] == [12.0, 4.0, 12.5, 32.0]


def test_centroid(spark):
    c = layer(spark, [2]).select(geo.centroid("rings").alias("c")).first().c
    assert (c.x, c.y) == pytest.approx((2.0, 2.0))


@pytest.mark.parametrize("a,b,want", [(1, 2, 3.0), (1, 3, 11.0), (4, 3, 12.0), (2, 3, 3.5)])
def test_pair_area(spark, a, b, want):
    la = layer(spark, [a]).withColumnRenamed("fid", "fa")
    lb = layer(spark, [b]).withColumnRenamed("fid", "fb")
    pairs = ov.bbox_pairs(la, "fa", lb, "fb", cell=1.5)
    pa = ov.layer_pieces(la, "fa", band=1.7)
    pb = ov.layer_pieces(lb, "fb", band=1.7)
    got = ov.pair_area(pairs, "fa", "fb", pa, pb).first().area
    assert got == pytest.approx(want)


def test_triple_area(spark):
    la = layer(spark, [1]).withColumnRenamed("fid", "fa")
    lb = layer(spark, [2]).withColumnRenamed("fid", "fb")
    lc = layer(spark, [3]).withColumnRenamed("fid", "fc")
    trip = spark.createDataFrame([(1, 2, 3, 0.0)], "fa long, fb long, fc long, base double")
    got = ov.triple_area(trip, "fa", "fb", "fc", ov.layer_pieces(la, "fa", 1.3),
                         ov.layer_pieces(lb, "fb", 1.3), ov.layer_pieces(lc, "fc", 1.3)).first().area
    # L ∩ square = [1,2]x[1,3] ∪ [2,3]x[1,2]; below x+y=5 everywhere except nothing -> 3
    assert got == pytest.approx(3.0)


def _slab(spark, members, n_layers, keep, label=None):
    lay = layer(spark, sorted({m[2] for m in members}))
    pieces = ov.layer_pieces(lay, "fid", band=2.5)
    mem = spark.createDataFrame(members, "g long, layer int, fid long")
    gp = ov.group_pieces(mem, pieces, "fid")
    return ov.slab_overlay(gp, n_layers, keep, label)


def test_slab_intersection_difference_union(spark):
    m = [(1, 0, 1), (1, 1, 3)]
    inter = _slab(spark, m, 2, lambda n: (n[0] != 0) & (n[1] != 0)).first().area
    diff = _slab(spark, m, 2, lambda n: (n[0] != 0) & (n[1] == 0)).first().area
    union = _slab(spark, m, 2, lambda n: (n[0] != 0) | (n[1] != 0)).first().area
    assert inter == pytest.approx(11.0)
    assert diff == pytest.approx(1.0)
    assert union == pytest.approx(12 + 12.5 - 11)


def test_slab_hole_and_two_masks(spark):
    m = [(1, 0, 4), (1, 1, 3), (1, 1, 2)]
    # holed square minus (triangle ∪ offset square)
    got = _slab(spark, m, 2, lambda n: (n[0] != 0) & (n[1] == 0)).first().area
    # triangle ∪ square inside the holed square: triangle∩holed = 12.5 - 0.5 (hole part x+y<=5 in [2,4]^2)
    # square [1,3]^2 minus hole [2,4]^2 -> 3, minus overlap with triangle (square below x+y=5 -> all
    # of [1,3]^2 except corner above 5: 0.5) => union area in holed = 12 + 3 - (3 - 0.5*?)
    tri_in = 12.5 - 0.5          # hole ∩ triangle = triangle x+y<=5 over [2,4]^2 = 0.5
    sq_in = 4 - 1                # square minus hole overlap [2,3]^2
    sq_tri_in = 4 - 0.5 - 1 + 0  # (square ∩ triangle) minus hole: 3.5 - (hole∩sq∩tri = 1 - 0.5 = 0.5)
    sq_tri_in = 3.5 - 0.5
    assert got == pytest.approx(32 - (tri_in + sq_in - sq_tri_in))


def test_slab_first_cover_label(spark):
    m = [(1, 0, 1), (1, 1, 2), (1, 2, 3)]

    def first(n):
        return F.when(n[1] != 0, F.lit(1)).when(n[2] != 0, F.lit(2))
    df = _slab(spark, m, 3, lambda n: n[0] != 0, label=first)
    got = {r.label: r.area for r in df.collect()}
    assert got[1] == pytest.approx(3.0)          # L ∩ square
    assert got[2] == pytest.approx(11.0 - 3.0)   # rest of L ∩ triangle
    assert got[None] == pytest.approx(12 - 11.0)


def test_bowtie_area(spark):
    # repaired self-crossing ring: the two lobes, 1 each
    got = _slab(spark, [(1, 0, 5)], 1, lambda n: n[0] != 0).first().area
    assert got == pytest.approx(2.0)


def test_point_in_polygon_border_inclusive(spark):
    poly = layer(spark, [1, 4])
    pts = spark.createDataFrame(
        [(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 4.0, 1.0), (4, 2.0, 3.0), (5, 3.0, 5.0), (6, 7.0, 1.0)],
        "pid long, x double, y double")
    got = {(r.pid, r.fid) for r in point_in_polygon_pairs(pts, "pid", "x", "y", poly, "fid",
                                                          cell=2.0, band=1.5).collect()}
    want = {(1, 1), (1, 4), (3, 1), (3, 4), (4, 1), (4, 4), (5, 4)}
    assert got == want


def test_hot_band_split_is_exact(spark):
    """Splitting every (group, band) into sub-bands leaves areas unchanged."""
    lay = layer(spark, [1, 2, 3, 4])
    pieces = ov.layer_pieces(lay, "fid", band=7.0)
    mem = spark.createDataFrame([(1, 0, 4), (1, 1, 3), (1, 1, 2), (2, 0, 1), (2, 1, 3)], "g long, layer int, fid long")
    gp = ov.group_pieces(mem, pieces, "fid")
    keep = lambda n: (n[0] != 0) & (n[1] == 0)
    whole = {r.g: r.area for r in ov.slab_overlay(gp, 2, keep).collect()}
    split = {r.g: r.area for r in ov.slab_overlay(gp, 2, keep, band=7.0, max_pieces=2).collect()}
    assert whole.keys() == split.keys()
    for g in whole:
        assert split[g] == pytest.approx(whole[g])
    assert whole[1] == pytest.approx(20.0)
    assert whole[2] == pytest.approx(1.0)


@pytest.mark.parametrize("a,b,want", [(1, 2, 3.0), (1, 3, 11.0), (4, 3, 12.0), (2, 3, 3.5)])
def test_pair_area_on_sub_band_grid(spark, a, b, want):
    """A forced fine grid on the b side (max one edge per band) is exact."""
    la = layer(spark, [a]).withColumnRenamed("fid", "fa")
    lb = layer(spark, [b]).withColumnRenamed("fid", "fb")
    pairs = ov.bbox_pairs(la, "fa", lb, "fb", cell=1.5)
    got = ov.pair_area(pairs, "fa", "fb", ov.layer_pieces(la, "fa", 3.0), ov.layer_pieces(lb, "fb", 3.0),
                       band=3.0, max_pieces=1).first().area
    assert got == pytest.approx(want)


def test_point_in_polygon_on_sub_band_grid(spark):
    poly = layer(spark, [1, 4, 3])
    pts = spark.createDataFrame(
        [(i, float(x), float(y)) for i, (x, y) in enumerate(
            [(1, 1), (3, 3), (4, 1), (2, 3), (3, 5), (7, 1), (2.5, 2.5), (0, 5), (2, 2), (4, 4), (0.5, 4.5)])],
        "pid long, x double, y double")
    coarse = {(r.pid, r.fid) for r in point_in_polygon_pairs(pts, "pid", "x", "y", poly, "fid", cell=2.0,
                                                            band=6.0, max_pieces=None).collect()}
    fine = {(r.pid, r.fid) for r in point_in_polygon_pairs(pts, "pid", "x", "y", poly, "fid", cell=2.0,
                                                          band=6.0, max_pieces=1).collect()}
    assert coarse == fine and len(coarse) > 5


def test_pair_area_many_sub_bands_sloped(spark):
    """Sloped edges cut into many sub-bands (triangle x skewed quad)."""
    tri = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 40.0, "y": 0.0}, {"x": 0.0, "y": 40.0}]])],
                                "fa long, rings array<array<struct<x:double,y:double>>>")
    quad = spark.createDataFrame([(2, [[{"x": 5.0, "y": 1.0}, {"x": 35.0, "y": 3.0}, {"x": 30.0, "y": 20.0},
                                       {"x": 2.0, "y": 30.0}]])],
                                 "fb long, rings array<array<struct<x:double,y:double>>>")
    pairs = ov.bbox_pairs(tri, "fa", quad, "fb", cell=10.0)
    pa, pb = ov.layer_pieces(tri, "fa", 64.0), ov.layer_pieces(quad, "fb", 64.0)
    coarse = ov.pair_area(pairs, "fa", "fb", pa, pb).first().area
    fine = ov.pair_area(pairs, "fa", "fb", pa, pb, band=64.0, max_pieces=1).first().area
    assert fine == pytest.approx(coarse)
    assert coarse > 0


def test_triple_area_on_sub_band_grid(spark):
    la = layer(spark, [1]).withColumnRenamed("fid", "fa")
    lb = layer(spark, [2]).withColumnRenamed("fid", "fb")
    lc = layer(spark, [3]).withColumnRenamed("fid", "fc")
    trip = spark.createDataFrame([(1, 2, 3, 0.0)], "fa long, fb long, fc long, base double")
    pa, pb, pc = ov.layer_pieces(la, "fa", 3.0), ov.layer_pieces(lb, "fb", 3.0), ov.layer_pieces(lc, "fc", 3.0)
    coarse = ov.triple_area(trip, "fa", "fb", "fc", pa, pb, pc).first().area
    fine = ov.triple_area(trip, "fa", "fb", "fc", pa, pb, pc, band=3.0, max_pieces=1).first().area
    assert coarse == pytest.approx(3.0) and fine == pytest.approx(3.0)


def test_big_polygon_gives_small_ones_their_edges_only(spark):
    """One polygon with 20,000 edges and 50 small boxes: joined rows follow
    the edges near each box, and the areas stay right."""
    import math

    from acrewise.operators.areas import pair_areas
    n = 20_000
    ring = [(5000 + 4000 * math.cos(2 * math.pi * i / n), 5000 + 4000 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    big = [(1, [[{"x": x, "y": y} for x, y in [*ring, ring[0]]]])]
    boxes = [(i, [[{"x": a + dx, "y": 5000.0 + dy} for dx, dy in ((0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0), (0.0, 0.0))]])
             for i, a in enumerate(2000.0 + 120 * k for k in range(50))]
    schema = "{} long, rings array<array<struct<x: double, y: double>>>"
    a, b = spark.createDataFrame(big, schema.format("fa")), spark.createDataFrame(boxes, schema.format("fb"))
    got = pair_areas(a, "fa", b, "fb").collect()
    assert len(got) == 50 and all(abs(r.area - 400) < 1e-3 for r in got)
    pairs = ov.bbox_pairs(a, "fa", b, "fb", 1000.0)
    pieces = ov.layer_pieces(a, "fa", 1000.0)
    near = ov.near_overlap(pairs, pieces, "fa", 1000.0).count()
    assert near < 0.02 * 50 * n


def test_projection_control_points(spark):
    """The worked example that EPSG publishes for this projection method
    (Texas South Central, NAD27), and the inverse; the origin of EPSG:2285."""
    foot = 1200 / 3937
    texas = geo.Conic(a=6378206.4, f=1 / 294.9786982, lat1=28 + 23 / 60, lat2=30 + 17 / 60, lat0=27 + 50 / 60, lon0=-99.0, easting=2_000_000 * foot)
    df = spark.createDataFrame([(-96.0, 28.5)], "lon double, lat double").withColumn("f", geo.to_state_plane("lon", "lat", texas))
    r = df.select("f.*", geo.to_wgs84(F.col("f.x"), F.col("f.y"), texas).alias("b")).first()
    assert abs(r.x - 2963503.91) < 0.02 and abs(r.y - 254759.80) < 0.02
    assert abs(r.b.x + 96) < 1e-9 and abs(r.b.y - 28.5) < 1e-9
    o = spark.createDataFrame([(-120.833333333333, 47.0)], "lon double, lat double").select(geo.to_state_plane("lon", "lat").alias("f")).first().f
    assert abs(o.x - 500000 / foot) < 1e-3 and abs(o.y) < 1e-3


def test_self_crossing_rings_are_resolved(spark):
    from acrewise.operators.areas import repair_crossings

    def ring(*pts):
        return [{"x": float(x), "y": float(y)} for x, y in pts]
    shapes = [(1, [ring((0, 0), (2, 2), (2, 0), (0, 2))]),                                            # bow-tie
              (2, [ring((0, 0), (6, 0), (6, 6), (0, 6)), ring((2, 2), (2, 4), (4, 4), (4, 2))]),      # hole
              (3, [ring((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))]),                            # L
              (4, [ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (1, 0), (1, 1), (0, 1))]),            # twice round
              (5, [ring((0, 0), (3, 0), (3, 3), (0, 3))])]
    df = spark.createDataFrame(shapes, "id long, rings array<array<struct<x: double, y: double>>>")
    out = repair_crossings(df, "id")
    got = {r.id: (r.a, r.c.x, r.c.y) for r in out.select("id", geo.area("rings").alias("a"), geo.centroid("rings").alias("c")).collect()}
    want = {1: (2, 1, 1), 2: (32, 3, 3), 3: (12, 5 / 3, 5 / 3), 4: (1, .5, .5), 5: (9, 1.5, 1.5)}
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))
    kept = {r.id for r in out.join(df.withColumnRenamed("rings", "old"), "id").where("rings = old").collect()}
    assert kept == {2, 3, 5}


def _star(rng, n, cx, cy, size):
    """A ring of n points around (cx, cy), with vertical and horizontal edges."""
    pts = []
    for k in range(n):
        t, d = 2 * math.pi * k / n, size * rng.uniform(0.3, 1)
        pts.append((round(cx + d * math.cos(t), 2), round(cy + d * math.sin(t), 2)))
        if k % 5 == 0:
            pts.append((pts[-1][0], round(pts[-1][1] + 0.37, 2)))
        if k % 7 == 0:
            pts.append((round(pts[-1][0] + 0.41, 2), pts[-1][1]))
    return [{"x": x, "y": y} for x, y in pts]


def test_tiles_carry_winding(spark):
    """Detailed rings cut into many tiles, some of them empty inside a ring,
    give the areas of the uncut overlay."""
    rng = random.Random(8)
    square = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (20, 0), (20, 20), (0, 20))]
    shapes = [(1, [_star(rng, 120, 10, 10, 9)]), (2, [_star(rng, 90, 14, 8, 7)]), (3, [square]), (4, [_star(rng, 150, 4, 13, 4)])]
    lay = spark.createDataFrame(shapes, "fid long, rings array<array<struct<x: double, y: double>>>")
    pieces = ov.layer_pieces(lay, "fid", band=6.0)
    mem = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2), (2, 1, 4), (3, 0, 3), (3, 1, 4)], "g long, layer int, fid long")
    gp = ov.group_pieces(mem, pieces, "fid").cache()
    for limits, keep in (((60, 9), lambda n: (n[0] != 0) & (n[1] == 0)), ((9,), lambda n: (n[0] != 0) & (n[1] != 0))):
        whole = {r.g: r.area for r in ov.slab_overlay(gp, 2, keep).collect()}
        for limit in limits:
            cut = {r.g: r.area for r in ov.slab_overlay(gp, 2, keep, band=6.0, max_pieces=limit).collect()}
            assert cut.keys() == whole.keys()
            for g in whole:
                assert cut[g] == pytest.approx(whole[g], rel=1e-9)
    rows = tiles.tiled(gp, 6.0, 9)
    empty = rows.groupBy("g", "band", "tile").agg(F.max("kind").alias("k"), F.min("kind").alias("least"), F.sum(F.abs("c")).alias("c"))
    assert empty.where("least = 2 AND c > 0").count() > 0   # no edge of its own, but inside


def _spanning(spark, n, rise="id"):
    """n edges that span a band, in closed pairs (a strip's lower and upper side)."""
    return spark.range(n).selectExpr("1L AS g", "0 AS layer", "0L AS band", "0D AS l", "10D AS r", "CAST(id AS DOUBLE) AS yl", f"CAST({rise} AS DOUBLE) AS yr",
                                     "CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END AS c")


def test_spanning_edges_stay_in_tiles(spark):
    """32,768 edges that span their band: no tile holds more than the limit,
    and half of the strips between them are inside."""
    n, limit = 32_768, 4096
    rows = _spanning(spark, n)
    per = tiles.tiled(rows, 10.0, limit).groupBy("band", "tile").count()
    assert per.agg(F.max("count")).first()[0] <= limit and per.agg(F.sum("count")).first()[0] <= 1.2 * n
    area = ov.slab_overlay(rows, 1, lambda k: k[0] != 0, band=10.0, max_pieces=limit).first().area
    assert area == pytest.approx(10 * n / 2)


def test_pairs_grow_with_edges_and_crossings(spark):
    """Spanning edges are paired only where their orders at the sides differ."""
    limit, pairs = 256, {}
    for n in (8192, 16_384, 32_768):
        # every 64th edge swaps places with its neighbour
        rows = _spanning(spark, n, "CASE WHEN id % 64 = 10 THEN id + 1.5 WHEN id % 64 = 11 THEN id - 1.5 ELSE id END")
        t = tiles.tiled(rows, 10.0, limit)
        pairs[n] = tiles.crossing_pairs(t, ["g", "band", "tile"]).count()
        assert pairs[n] <= n
        assert tiles.crossings(t, ["g", "band", "tile"]).count() in (n // 64, 2 * (n // 64))
    assert pairs[32_768] <= 4.5 * pairs[8192]


def test_all_crossings_of_spanning_edges_are_found(spark):
    rng = random.Random(4)
    right = [float(k + rng.choice([0, 0, 0, 7.3, -5.6, 40.2])) for k in range(300)]
    rows = spark.createDataFrame([(1, 0, 0, 0.0, 10.0, float(k), right[k], 1) for k in range(300)], "g long, layer int, band long, l double, r double, yl double, yr double, c int")
    want = sum(right[i] > right[j] for i in range(300) for j in range(i + 1, 300))
    one = tiles.tiled(rows, 10.0, 1_000_000).withColumns({"kind": F.lit(1), "_x0": F.lit(0.0), "_x1": F.lit(10.0)})
    pairs = tiles.crossing_pairs(one, ["g", "band", "tile"])
    found = {tuple(sorted((r.a_yl, r.b_yl))) for r in pairs.collect() if (r.a_yl - r.b_yl) * (r.a_yr - r.b_yr) < 0}
    assert len(found) == want and pairs.count() <= 300 + 6 * want
