"""Stand-in views over the driver tables (see FIXTURES.md part B).

The reference ships no data; these views give each report family inputs
with the reference's column names. They are plain projections of the
driver tables, so each report's work grows with the tables. The same
definitions, as SQL text, feed the DuckDB oracle (plans/oracle_sql.py).

Differences to FIXTURES.md: ``masks`` uses every supplier row (no id cut),
and the labelling layers (MIC, regional geography, city) are defined here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrewise.sources.tables import Tables, view


def _dbl(c: Column) -> Column:
    return c.cast("double")


# ---------------------------------------------------------------- employment
@view
def workplace_facts(t: Tables) -> DataFrame:
    li = t.lineitem
    y = F.year("l_shipdate")
    data_year = (F.when(y == 1995, 2005).when(y == 1996, 2010).when(y == 1997, 2015)
                 .when(y == 1998, 2020).when(y == 1999, 2021).when(y == 2000, 2022)
                 .otherwise(2023))
    return li.select(
        data_year.alias("data_year"),
        F.col("l_partkey").alias("industry_id"),
        F.col("l_suppkey").alias("workplace_location_id"),
        F.col("l_quantity").alias("jobcount_raw"),
        F.when(F.col("l_orderkey") % 50 == 0, F.lit(0.125))
         .otherwise(F.col("l_quantity") * F.lit(0.5)).alias("jobcount_covered"),
        F.when(F.col("l_orderkey") % 7 < 5, F.lit(0).cast("bigint"))
         .otherwise(F.col("l_suppkey") + 1).alias("confid_firm_id"),
    )


@view
def industry_dims(t: Tables) -> DataFrame:
    p = t.part
    return p.select(
        F.col("p_partkey").alias("industry_id"),
        F.when(F.col("p_size") % 4 == 0, 0).otherwise(1).alias("private_sector"),
        F.when(F.col("p_type") == "STANDARD", F.lit("z Non-Industrial"))
         .otherwise(F.lower("p_type")).alias("manuf_industrial_group"),
        F.col("p_brand").alias("manuf_industrial_detail"),
    )


@view
def workplace_location_dims(t: Tables) -> DataFrame:
    s = t.supplier
    k4 = F.col("s_nationkey") % 4
    k5 = F.col("s_nationkey") % 5
    return s.select(
        F.col("s_suppkey").alias("workplace_location_id"),
        F.when(k4 == 0, 33).when(k4 == 1, 35).when(k4 == 2, 53).otherwise(61).alias("county_id"),
        F.when(k5 == 0, F.lit("")).when(k5 == 1, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("MIC "), k5.cast("string"))).alias("mic"),
        _dbl((F.col("s_suppkey") * 7919) % 10007).alias("x"),
        _dbl((F.col("s_suppkey") * 6151) % 10009).alias("y"),
    )


# ------------------------------------------------------------ polygon layers
@view
def zones(t: Tables) -> DataFrame:
    """Inventory of industrial zones: one rectangle per nation row."""
    n = t.nation
    k = F.col("n_nationkey")
    k6 = k % 6
    x0 = (k * 1237) % 8000
    y0 = (k * 2113) % 8000
    return n.select(
        k.alias("zone_id"),
        F.when(k6 == 0, "Core Industrial").when(k6 == 1, "Industrial-Commercial")
         .when(k6 == 2, "Aviation Operations").when(k6 == 3, "Military Industrial")
         .when(k6 == 4, "Limited Industrial").otherwise(F.lit(None).cast("string"))
         .alias("ind_type"),
        _dbl(x0).alias("x0"), _dbl(y0).alias("y0"),
        _dbl(x0 + 1200 + 40 * k).alias("x1"), _dbl(y0 + 1800).alias("y1"),
    )


@view
def counties(t: Tables) -> DataFrame:
    """County background: five vertical strips, one per region row."""
    r = t.region
    k = F.col("r_regionkey")
    fip = (F.when(k == 0, "033").when(k == 1, "035").when(k == 2, "053")
           .when(k == 3, "061").otherwise("057"))
    name = (F.when(k == 0, "King").when(k == 1, "Kitsap").when(k == 2, "Pierce")
            .when(k == 3, "Snohomish").otherwise("Thurston"))
    return r.select(
        k.alias("county_key"), fip.alias("county_fip"), name.alias("county_nm"),
        _dbl(k * 2100).alias("x0"), F.lit(0.0).alias("y0"),
        _dbl((k + 1) * 2100).alias("x1"), F.lit(10500.0).alias("y1"),
    )


@view
def masks(t: Tables) -> DataFrame:
    """Exclusion masks (water, wetlands, tiers A-C, public use = order 0..5)."""
    s = t.supplier
    k = F.col("s_suppkey")
    x0 = (k * 3571) % 9500
    y0 = (k * 4133) % 9500
    return s.select(
        k.alias("mask_id"), (k % 6).cast("int").alias("mask_order"),
        _dbl(x0).alias("x0"), _dbl(y0).alias("y0"),
        _dbl(x0 + 300 + k % 97).alias("x1"), _dbl(y0 + 250 + k % 89).alias("y1"),
    )


@view
def mic_areas(t: Tables) -> DataFrame:
    """Manufacturing/industrial centres: the zone rectangles, named by key."""
    z = zones(t)
    return z.select("zone_id", F.concat(F.lit("MIC "), (F.col("zone_id") % 4).cast("string")).alias("mic"),
                    "x0", "y0", "x1", "y1")


@view
def regional_geographies(t: Tables) -> DataFrame:
    """Regional geography classes on the county strips; Bremerton is one
    Metro strip so both outcomes of the urban flag occur."""
    c = counties(t)
    k = F.col("county_key")
    return c.select(
        k.alias("rgeo_id"),
        F.when(k % 2 == 0, "Metro").otherwise("Urban").alias("class_desc"),
        F.when(k == 2, "Bremerton").otherwise(F.concat(F.lit("City "), k.cast("string"))).alias("juris"),
        "x0", "y0", "x1", "y1",
    )


# ---------------------------------------------------------- parcels, buildings
@view
def parcels(t: Tables) -> DataFrame:
    c = t.customer
    k = F.col("c_custkey")
    x0 = (k * 7919) % 9973
    y0 = (k * 6151) % 9967
    return c.select(
        F.when(k % 40 == 1, k - 1).otherwise(k).alias("parcel_id"),
        k.alias("parcel_row"),
        _dbl(x0).alias("x0"), _dbl(y0).alias("y0"),
        _dbl(x0 + 5 * (20 + k % 37)).alias("x1"), _dbl(y0 + 5 * (15 + k % 29)).alias("y1"),
        F.when(k % 50 == 3, F.lit(0.0))
         .otherwise(_dbl((20 + k % 37) * (15 + k % 29))).alias("gross_sqft"),
        F.when(k % 31 == 0, F.lit(None).cast("int")).otherwise((k % 30).cast("int"))
         .alias("land_use_type_id"),
    )


@view
def buildings(t: Tables) -> DataFrame:
    """One building per order. Every third parcel stays without buildings:
    its orders are given to the parcel before it."""
    o = t.orders
    k = F.col("o_custkey")
    return o.select(
        F.when(k % 3 == 0, k - 1).otherwise(k).alias("parcel_id"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(0).cast("bigint"))
         .otherwise((F.col("o_orderkey") % 9000).cast("bigint")).alias("improvement_value"),
    )


# ------------------------------------------------------------------ persons
@view
def persons(t: Tables, n_replicates: int = 80) -> DataFrame:
    """Person microdata with a weight and ``n_replicates`` replicate weights.

    The few columns of the table are a small file of one or two splits, which
    become ``n_replicates`` columns here: the rows are dealt over all cores
    first, or a task or two would do all the sums."""
    tasks = 3 * t.spark.sparkContext.defaultParallelism
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").repartition(tasks)
    k = F.col("c_custkey")
    n4 = F.col("c_nationkey") % 4
    reps = [F.expr(f"1 + (c_custkey * {2 * r + 1} + {r}) % 9").alias(f"pwgtp{r}") for r in range(1, n_replicates + 1)]
    return c.select(
        k.alias("person_id"),
        F.when(n4 == 0, "King").when(n4 == 1, "Kitsap").when(n4 == 2, "Pierce")
         .otherwise("Snohomish").alias("county"),
        F.col("c_mktsegment").alias("prace"),
        F.when(k % 23 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("ed"), (F.col("c_nationkey") % 3).cast("string"))).alias("ed_attain"),
        F.when(k % 17 == 0, "Unemployed").when(k % 19 == 0, F.lit(None).cast("string"))
         .otherwise("Private").alias("cow"),
        F.when(k % 13 == 0, F.lit(None).cast("bigint")).otherwise((k * 7919) % 150000).alias("pincp"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("sector"), (k % 4).cast("string"))).alias("mi_jobsector"),
        (1 + k % 9).alias("pwgtp"),
        *reps,
    )


# ------------------------------------------------- R comparison inputs
@view
def zoning(t: Tables) -> DataFrame:
    """Zoning layer of industrial uses (County_FLU, County, Ind_Category,
    Ind_Code): county names are missing or given as FIPS text on some rows,
    so the clean-up falls back and maps codes; codes 1 and 2 are the two
    kept (non-limited) classes."""
    z = zones(t)
    k = F.col("zone_id")
    k4 = k % 4
    code = F.when(k4 == 0, "033").when(k4 == 1, "035").when(k4 == 2, "053").otherwise("061")
    name = F.when(k4 == 0, "King").when(k4 == 1, "Kitsap").when(k4 == 2, "Pierce").otherwise("Snohomish")
    county = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, code).otherwise(name)
    return z.select("zone_id", code.alias("county_code"), county.alias("county"),
                    F.coalesce("ind_type", F.lit("Other Industrial")).alias("category"),
                    (k % 6 + 1).cast("int").alias("ind_code"), "x0", "y0", "x1", "y1")


@view
def cities(t: Tables) -> DataFrame:
    """City layer: the zone boxes, one of them Bremerton."""
    z = zones(t)
    k = F.col("zone_id")
    return z.select(k.alias("city_id"),
                    F.when(k == 2, "Bremerton").otherwise(F.concat(F.lit("City "), k.cast("string"))).alias("city"),
                    "x0", "y0", "x1", "y1")


@view
def county_parcels(t: Tables) -> DataFrame:
    """County parcel files as one table: the county a parcel id belongs to,
    and its id as text (zero padded; every 53rd id is not numeric)."""
    p = parcels(t)
    pid = F.col("parcel_id")
    k4 = pid % 4
    cid = F.when(k4 == 0, 33).when(k4 == 1, 35).when(k4 == 2, 53).otherwise(61)
    raw = F.when(F.col("parcel_row") % 53 == 0, F.concat(F.lit("X"), pid.cast("string"))) \
        .otherwise(F.lpad(pid.cast("string"), 8, "0"))
    return p.select("parcel_row", raw.alias("parcel_id_raw"), cid.alias("county_id"),
                    "x0", "y0", "x1", "y1", "gross_sqft", "land_use_type_id")


@view
def parcel_data(t: Tables) -> DataFrame:
    """parcels_all: id text, county, land use, size."""
    cp = county_parcels(t)
    return cp.select(F.col("parcel_id_raw").alias("parcel_id_fips"), "county_id", "land_use_type_id", "gross_sqft")


@view
def building_data(t: Tables) -> DataFrame:
    """buildings_all: id text, county, improvement value as text."""
    b = buildings(t)
    pid = F.col("parcel_id")
    k4 = pid % 4
    cid = F.when(k4 == 0, 33).when(k4 == 1, 35).when(k4 == 2, 53).otherwise(61)
    return b.select(F.lpad(pid.cast("string"), 8, "0").alias("parcel_id_fips"), cid.alias("county_id"),
                    F.col("improvement_value").cast("string").alias("improvement_value"))
