"""Small public helpers: tagging with defaults (G8), first match (J11),
fixed pivot (R1), label order (O2), pattern column pick (P6), county ids (F9)."""

from pyspark.sql import functions as F

from acrewise.functions import geometry as geo
from acrewise.functions import labels as L
from acrewise.operators.joins import first_match
from acrewise.operators.reshape import columns_matching, order_by_labels, pivot_fixed
from acrewise.operators.spatial import tag_points


def _boxes(spark):
    df = spark.createDataFrame([(1, "A", 0.0, 0.0, 4.0, 4.0), (2, "B", 2.0, 2.0, 6.0, 6.0)],
                               "fid long, name string, x0 double, y0 double, x1 double, y1 double")
    return df.select("fid", "name", geo.rect_rings("x0", "y0", "x1", "y1").alias("rings"))


def test_tag_points_all_and_one(spark):
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0), (3, 9.0, 9.0)], "pid long, x double, y double")
    lay = _boxes(spark)
    allm = sorted((r.pid, r.tag) for r in tag_points(pts, "pid", "x", "y", lay, "fid", "name", "tag",
                                                     default="none", cell=2.0, band=2.0).collect())
    assert allm == [(1, "A"), (2, "A"), (2, "B"), (3, "none")]
    one = sorted((r.pid, r.tag) for r in tag_points(pts, "pid", "x", "y", lay, "fid", "name", "tag",
                                                    default="none", multi="one", cell=2.0, band=2.0).collect())
    assert one == [(1, "A"), (2, "A"), (3, "none")]


def test_first_match_lowest_label(spark):
    pairs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "id long, label string")
    assert {r.id: r.label for r in first_match(pairs, "id", "label").collect()} == {1: "a", 2: "c"}


def test_pivot_fixed_keeps_unlisted_groups(spark):
    df = spark.createDataFrame([("x", 2005, "1"), ("x", 2010, "2"), ("y", 2021, "3")], "g string, yr int, v string")
    out = {r.g: (r["2005"], r["2010"]) for r in pivot_fixed(df, ["g"], "yr", [2005, 2010], "v").collect()}
    assert out == {"x": ("1", "2"), "y": (None, None)}   # a group only in an unlisted year stays, all NULL


def test_label_order_and_columns(spark):
    df = spark.createDataFrame([("Region",), ("King",), ("Pierce",)], "County string")
    assert [r.County for r in order_by_labels(df, "County", ["King", "Kitsap", "Pierce", "Region"]).collect()] == \
        ["King", "Pierce", "Region"]
    wide = spark.createDataFrame([(1, 2, 3, 4)], "count int, count_moe int, share int, other int")
    assert columns_matching(wide, r"^(count|share)(_moe)?$") == ["count", "count_moe", "share"]
    ids = spark.createDataFrame([("King",), ("Snohomish",), ("x",)], "n string")
    assert [r.c for r in ids.select(L.county_id_from_name("n").alias("c")).collect()] == [33, 61, None]
    pos = ids.select(L.label_order("n", ["Snohomish", "King"]).alias("p")).collect()
    assert [r.p for r in pos] == [2, 1, 0]
