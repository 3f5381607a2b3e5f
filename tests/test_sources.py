"""Sources and sinks: TSV round trip, GeoJSON / WKT parsing, sheets,
checkpointed reuse, key checks."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from acrewise.functions import geometry as geo
from acrewise.operators.rows import key_violations, keep_first, row_index
from acrewise.sources import fixtures as fx
from acrewise.sources.layers import wkt_polygon_rings
from acrewise.sources.readers import geojson_polygon_rings, named_layer, read_tsv
from acrewise.sources.sinks import export_tsv, materialized, save_sheets
from acrewise.sources.tables import Tables

SF = "/root/testdata/sf0.001"


def test_tsv_round_trip(spark):
    t = Tables(spark, SF)
    d = fx.parcel_data(t)
    out = os.path.join(tempfile.mkdtemp(prefix="acrewise-tsv-"), "parcels_all")
    export_tsv(d, out)
    back = read_tsv(spark, out, d.columns, {"county_id": "int", "land_use_type_id": "int", "gross_sqft": "double"})
    assert back.count() == d.count()
    assert back.exceptAll(d.select(*[F.col(c).cast(back.schema[c].dataType) for c in d.columns])).count() == 0


def test_geojson_and_wkt(spark):
    df = spark.createDataFrame([
        ('{"type":"Polygon","coordinates":[[[0,0],[0,6],[6,6],[6,0],[0,0]],[[2,2],[4,2],[4,4],[2,4],[2,2]]]}',
         "POLYGON ((0 0, 0 6, 6 6, 6 0, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"),
        ('{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,1],[0,0]]],[[[5,5],[7,5],[7,7],[5,7],[5,5]]]]}',
         "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 7 5, 7 7, 5 7, 5 5)))"),
    ], "gj string, wkt string")
    r = df.select(geojson_polygon_rings("gj").alias("a"), wkt_polygon_rings("wkt").alias("b"))
    r = r.select(geo.area("a").alias("ga"), geo.area("b").alias("wa"), F.size("a").alias("n")).collect()
    assert [x.ga for x in r] == [32.0, 5.0]
    assert [x.wa for x in r] == [32.0, 5.0]
    assert [x.n for x in r] == [2, 2]


def test_named_layers(spark):
    t = Tables(spark, SF)
    assert named_layer(t, "micen").count() == 25
    assert named_layer(t, "county_background").count() == 5
    with pytest.raises(KeyError):
        named_layer(t, "nope")


def test_sheets_and_materialized(spark):
    t = Tables(spark, SF)
    out = tempfile.mkdtemp(prefix="acrewise-sheets-")
    paths = save_sheets({"Sheet1": fx.industry_dims(t).limit(5)}, out)
    assert spark.read.option("header", True).csv(paths[0]).count() == 5
    calls = []

    def build():
        calls.append(1)
        return fx.industry_dims(t)
    a = materialized(spark, ("test-dims", SF), build)
    b = materialized(spark, ("test-dims", SF), build)
    assert len(calls) == 1 and a.count() == b.count() == fx.industry_dims(t).count()


def test_rows_helpers(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (2, "bb"), (None, "n")], "k int, v string")
    idx = [r["index"] for r in row_index(df.filter("k IS NOT NULL"), ["k", "v"]).orderBy("index").collect()]
    assert idx == [1, 2, 3, 4]
    first = {r.k: r.v for r in keep_first(df.filter("k IS NOT NULL"), ["k"], ["v"]).collect()}
    assert first == {1: "a", 2: "b", 3: "c"}
    bad = {(r.k, r.problem) for r in key_violations(df, ["k"]).collect()}
    assert bad == {(None, "null"), (2, "repeated")}


def test_workbook_sheets(spark):
    from acrewise.plans.demographics import write_workbook
    out = tempfile.mkdtemp(prefix="acrewise-wb-")
    paths = write_workbook(Tables(spark, SF), out)
    assert [os.path.basename(p) for p in paths] == [f"Sheet{i}" for i in range(1, 15)]
    assert spark.read.option("header", True).csv(paths[0]).count() > 0


def test_read_microdata_prunes_columns(spark):
    from acrewise.sources.readers import read_microdata
    t = Tables(spark, SF)
    out = os.path.join(tempfile.mkdtemp(prefix="acrewise-pums-"), "persons")
    fx.persons(t).write.mode("overwrite").parquet(out)
    df = read_microdata(spark, out, ["county", "prace"], weight="pwgtp", n_replicates=80)
    assert df.columns[:3] == ["county", "prace", "pwgtp"] and len(df.columns) == 83
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "mi_jobsector" not in plan.split("ReadSchema")[1]
    assert df.count() == fx.persons(t).count()


def test_row_index_over_many_partitions(spark):
    """No row is lost or misnumbered when the input fills many partitions and
    the reader uses columns beyond the key."""
    n = 1_200_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        df = spark.range(n).selectExpr("(id * 7919) % 1200007 AS k", "concat('row ', id) AS payload", "id")
        out = row_index(df, ["k"])
        got = out.selectExpr("count(*) AS n", "count(DISTINCT index) AS d", "min(index) AS lo", "max(index) AS hi", "count(DISTINCT payload) AS p").first()
        assert tuple(got) == (n, n, 1, n, n)
        from pyspark.sql import Window
        from pyspark.sql import functions as F
        late = out.withColumn("b", F.floor(F.col("index") / 1000)).withColumn(
            "before", F.lag("k").over(Window.partitionBy("b").orderBy("index"))).where("before >= k").count()
        assert late == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_intermediates_outlive_a_session(spark, tmp_path):
    """A second build is a reload when the folder is kept, and a rewrite on request."""
    from acrewise.sources.sinks import materialized
    spark.conf.set("spark.acrewise.intermediates", str(tmp_path))
    built = []

    def build(n):
        def f():
            built.append(n)
            return spark.range(n)
        return f
    try:
        assert materialized(spark, ("x", "here", 1), build(3)).count() == 3
        from acrewise.sources import sinks
        sinks._DONE.clear()  # what a new session starts with
        assert materialized(spark, ("x", "here", 1), build(4)).count() == 3
        assert materialized(spark, ("x", "there", 1), build(5)).count() == 5
        assert materialized(spark, ("x", "here", 1), build(6), recalculate=True).count() == 6
        assert built == [3, 5, 6]
    finally:
        spark.conf.unset("spark.acrewise.intermediates")


def test_changed_inputs_are_recomputed_and_unchanged_ones_reloaded(spark, tmp_path):
    """A report's own intermediate: reloaded by a second session, built anew
    when a table, a parameter or the code changes, or on request."""
    import json
    import shutil

    from acrewise import params as P
    from acrewise.plans import parcels
    from acrewise.sources import sinks
    from acrewise.sources.tables import Tables
    folder = str(tmp_path / "tables")
    shutil.copytree(SF, folder, copy_function=shutil.copyfile)
    for x in [tmp_path / "tables", *(tmp_path / "tables").rglob("*")]:
        x.chmod(0o755)
    spark.conf.set("spark.acrewise.intermediates", str(tmp_path / "kept"))

    def files():
        sinks._DONE.clear()  # what a new session starts with
        rows = parcels.net_parcel_areas(Tables(spark, folder), P.DEFAULT)
        return rows.count(), {f: f.stat().st_mtime_ns for f in (tmp_path / "kept").rglob("part-*.parquet")}
    try:
        n, first = files()
        assert n and files() == (n, first)
        (note,) = (tmp_path / "kept").glob("netx-*/_manifest.json")
        assert any(f.endswith(".parquet") for f, _, _ in json.loads(note.read_text())["inputs"][folder])
        spark.conf.set("spark.acrewise.recalculate", "true")
        assert files()[1].keys() != first.keys()
        spark.conf.unset("spark.acrewise.recalculate")
        spark.read.parquet(f"{SF}/customer.parquet").where("c_custkey % 2 = 0").write.mode("overwrite").parquet(f"{folder}/customer.parquet")
        m, third = files()
        assert 0 < m < n and len(third) > len(first)
    finally:
        spark.conf.unset("spark.acrewise.recalculate")
        spark.conf.unset("spark.acrewise.intermediates")
