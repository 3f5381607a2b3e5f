"""Employment cross-tabs by land status.

Plan shape: facts ⋈ industry ⋈ (locations ⟕ correspondence) -> the inputs of
the suppression rule at the finest grain, saved once -> per report an
aggregate of those cells, the rule, a pivot, order. The two dimension sides
are broadcast behind a row-count bound, so the fact table is scanned once,
never shuffled for the joins, and only partial aggregates cross the network.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import labels as L
from acrewise.functions.suppress import suppression_inputs
from acrewise.operators.crosstab import header_cells, header_key, suppressed_crosstab, year_cells, year_key
from acrewise.operators.joins import bounded_broadcast
from acrewise.operators.spatial import point_in_polygon_pairs
from acrewise.sources import fixtures as fx
from acrewise.sources import layers
from acrewise.sources.sinks import materialized
from acrewise.sources.tables import Tables

LOC = "workplace_location_id"


def correspondence(t: Tables, prm: P.Params = P.DEFAULT) -> DataFrame:
    """(workplace_location_id, ind_type) for every workplace point that
    lies in (or on the border of) an inventory polygon; one row per
    distinct pair, as GROUP BY id, ind_type. Materialized once per session
    (the original built it as a table so later reports need no spatial
    query)."""
    return materialized(t.spark, ("correspondence", t.sf_dir, prm),
                        lambda: build_correspondence(t, prm))


def build_correspondence(t: Tables, prm: P.Params = P.DEFAULT) -> DataFrame:
    loc = fx.workplace_location_dims(t).select(LOC, "x", "y")
    z = layers.zones_layer(t)
    pairs = point_in_polygon_pairs(loc, LOC, "x", "y", z, "zone_id", "rings",
                                   prm.cell_size, prm.band_width)
    zl = bounded_broadcast(z.select("zone_id", "ind_type"), prm.broadcast_max_rows)
    return pairs.join(zl, "zone_id").select(LOC, "ind_type").distinct()


def correspondence_qc(t: Tables, prm: P.Params = P.DEFAULT) -> DataFrame:
    """E0 QC: correspondence rows without a class."""
    return correspondence(t, prm).filter(F.col("ind_type").isNull())


FINEST = ["data_year", "county_id", "mic", "ind_type", "placed", "manuf_industrial_group", "manuf_industrial_detail"]


def employment_cells(t: Tables, prm: P.Params = P.DEFAULT) -> DataFrame:
    """The inputs of the suppression rule at the finest grain any report
    needs. They are sums and a maximum, so every report (and every cube)
    aggregates these cells; the facts are read and joined once. ``placed``
    tells a workplace with a correspondence row from one without."""
    return materialized(t.spark, ("employment_cells", t.sf_dir, prm), lambda: build_employment_cells(t, prm))


def build_employment_cells(t: Tables, prm: P.Params = P.DEFAULT) -> DataFrame:
    ind = bounded_broadcast(fx.industry_dims(t), prm.broadcast_max_rows)
    loc = fx.workplace_location_dims(t).select(LOC, "county_id", "mic")
    corr = correspondence(t, prm)
    tagged = loc.join(corr.withColumn("placed", F.lit(True)), LOC, "left")
    # |loc left join corr| <= |loc| + |corr|: bound by the two inputs
    tagged = bounded_broadcast(tagged, prm.broadcast_max_rows, bound_by=[loc, corr])
    rows = fx.workplace_facts(t).join(ind, "industry_id").join(tagged, LOC)
    return rows.groupBy(*FINEST).agg(*suppression_inputs())


def employment_base(t: Tables, years, corr_join: str = "left",
                    prm: P.Params = P.DEFAULT) -> DataFrame:
    """The cells of some years; ``inner`` keeps placed workplaces only."""
    cells = employment_cells(t, prm).filter(F.col("data_year").isin(*years))
    return cells.filter("placed") if corr_join == "inner" else cells


# ------------------------------------------------------------------ reports
def _status3():
    return L.land_status_3("ind_type").alias("Industrial_Land_Status")


def _status2():
    return L.land_status_2("ind_type").alias("Industrial_Land_Status")


def _job(name="IndustrialJob"):
    return L.industrial_job("manuf_industrial_group").alias(name)


def e1(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_6, prm=prm)
    r = suppressed_crosstab(b, [_status3(), "manuf_industrial_group", _job()], year_cells(P.YEARS_6), key=year_key())
    return r.orderBy("Industrial_Land_Status", "manuf_industrial_group")


def e2(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_6, prm=prm)
    r = suppressed_crosstab(b, [_status3(), _job()], year_cells(P.YEARS_6), grouping="cube", key=year_key())
    r = r.filter((F.col("IndustrialJob") != "Non-Industrial") | F.col("IndustrialJob").isNull())
    return r.orderBy("Industrial_Land_Status")


def e3(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_6, prm=prm)
    r = suppressed_crosstab(b, ["manuf_industrial_group", _job()], year_cells(P.YEARS_6), key=year_key())
    return r.orderBy("manuf_industrial_group")


def e4(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_6, prm=prm)
    r = suppressed_crosstab(b, [_status2(), "manuf_industrial_group", "manuf_industrial_detail"],
                            year_cells(P.YEARS_6), key=year_key())
    return r.orderBy("Industrial_Land_Status", "manuf_industrial_group", "manuf_industrial_detail")


def e5(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_6, prm=prm)
    r = suppressed_crosstab(b, ["manuf_industrial_group", "manuf_industrial_detail"], year_cells(P.YEARS_6), key=year_key())
    return r.orderBy("manuf_industrial_group", "manuf_industrial_detail")


def e6(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_6, prm=prm).filter(L.not_non_industrial())
    r = suppressed_crosstab(b, [_status2()], year_cells(P.YEARS_6), key=year_key())
    return r.orderBy("Industrial_Land_Status")


def _hdr():
    return header_cells(P.COUNTY_IDS, P.YEARS_5)


def e7(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_5, prm=prm)
    r = suppressed_crosstab(b, [_status3(), "manuf_industrial_group"], _hdr(), key=header_key())
    return r.orderBy("Industrial_Land_Status", "manuf_industrial_group")


def e8(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_5, prm=prm)
    return suppressed_crosstab(b, ["manuf_industrial_group"], _hdr(), key=header_key()).orderBy("manuf_industrial_group")


def e9(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_5, prm=prm).filter(L.not_non_industrial())
    return suppressed_crosstab(b, [_status3()], _hdr(), key=header_key()).orderBy("Industrial_Land_Status")


def e10(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_5, prm=prm)
    return suppressed_crosstab(b, [_status3()], _hdr(), key=header_key()).orderBy("Industrial_Land_Status")


def e11(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_5, prm=prm)
    return suppressed_crosstab(b, [], _hdr(), key=header_key())


def e12(t, prm=P.DEFAULT):
    """Header list 'county-year' for the county x year combinations that
    occur in the facts (the original listed them as constants)."""
    f = fx.workplace_facts(t).filter(F.col("data_year").isin(*P.YEARS_5)).select(LOC, "data_year")
    loc = bounded_broadcast(
        fx.workplace_location_dims(t).filter(F.col("county_id").isin(*P.COUNTY_IDS)).select(LOC, "county_id"),
        prm.broadcast_max_rows)
    h = f.join(loc, LOC).select(F.concat_ws("-", F.col("county_id").cast("string"),
                                            F.col("data_year").cast("string")).alias("headers"))
    return h.distinct()


def _core_base(t, prm):
    b = employment_base(t, P.YEARS_5, corr_join="inner", prm=prm)
    return b.filter(F.col("ind_type") != P.LIMITED)


def _cat(other="Other"):
    return L.land_category("ind_type", other).alias("ind_type")


def e13(t, prm=P.DEFAULT):
    r = suppressed_crosstab(_core_base(t, prm), [_cat(), _job("IndjobYN")], _hdr(), key=header_key())
    return r.orderBy("ind_type", "IndjobYN")


def e14(t, prm=P.DEFAULT):
    r = suppressed_crosstab(_core_base(t, prm), [_cat(), _job("IndjobYN")], year_cells(P.YEARS_5), key=year_key())
    return r.orderBy("ind_type", "IndjobYN")


def e15(t, prm=P.DEFAULT):
    return suppressed_crosstab(_core_base(t, prm), [_cat()], year_cells(P.YEARS_5), key=year_key()).orderBy("ind_type")


def e16(t, prm=P.DEFAULT):
    return suppressed_crosstab(_core_base(t, prm), [_cat()], _hdr(), key=header_key()).orderBy("ind_type")


def _mic_base(t, prm):
    return employment_base(t, P.YEARS_6, prm=prm).filter(L.not_blank("mic"))


def e17(t, prm=P.DEFAULT):
    r = suppressed_crosstab(_mic_base(t, prm), ["mic", "manuf_industrial_group"], year_cells(P.YEARS_5),
                            grouping="cube", key=year_key())
    return r.orderBy("mic", "manuf_industrial_group")


def e18(t, prm=P.DEFAULT):
    b = _mic_base(t, prm).filter(L.not_non_industrial())
    return suppressed_crosstab(b, ["mic"], year_cells(P.YEARS_5), key=year_key()).orderBy("mic")


def e19(t, prm=P.DEFAULT):
    r = suppressed_crosstab(_mic_base(t, prm), ["manuf_industrial_group"], year_cells(P.YEARS_5),
                            grouping="cube", key=year_key())
    return r.orderBy("manuf_industrial_group")


def e20(t, prm=P.DEFAULT):
    b = _mic_base(t, prm).filter(L.not_non_industrial())
    return suppressed_crosstab(b, [], year_cells(P.YEARS_5), key=year_key())


def e21(t, prm=P.DEFAULT):
    b = employment_base(t, P.YEARS_5, prm=prm)
    r = suppressed_crosstab(b, [_cat(None), "manuf_industrial_group"], year_cells(P.YEARS_5), key=year_key())
    return r.orderBy("ind_type", "manuf_industrial_group")


REPORTS = {f"E{i}": f for i, f in enumerate(
    [None, e1, e2, e3, e4, e5, e6, e7, e8, e9, e10, e11, e12, e13, e14, e15, e16, e17, e18, e19, e20, e21])
    if f is not None}
REPORTS["E0"] = correspondence
REPORTS["E0_qc"] = correspondence_qc
