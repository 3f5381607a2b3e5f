"""Readers for the inputs the original analyses pulled from databases and
files (S1, S3, S4, S5, S6). All are plain Spark readers; parsing of text
columns is Column math on each row, so it scales with the partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrewise.functions import geometry as geo
from acrewise.sources import layers
from acrewise.sources.tables import Tables


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int,
              num_partitions: int, properties: dict | None = None) -> DataFrame:
    """A fact or dimension table from a database, read in parallel
    ranges of ``partition_column`` (one query per partition)."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                           numPartitions=num_partitions, properties=properties or {})


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], types: dict[str, str] | None = None) -> DataFrame:
    """Tab-separated text with a header. Every column is read as text
    and converted with ``try_cast`` (a bad value becomes NULL, as the R
    reader's parse failures became NA)."""
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    df = spark.read.csv(path, sep="\t", header=True, schema=schema)
    for c, t in (types or {}).items():
        df = df.withColumn(c, F.col(c).try_cast(t))
    return df


def read_microdata(spark: SparkSession, path: str, variables: Sequence[str], weight: str = "pwgtp",
                   n_replicates: int = 80, fmt: str = "parquet") -> DataFrame:
    """Person microdata restricted to the variables asked for plus the
    weight and its replicates (the scan reads only those columns)."""
    reps = [f"{weight}{r}" for r in range(1, n_replicates + 1)]
    return spark.read.format(fmt).load(path).select(*variables, weight, *reps)


def geojson_polygon_rings(text: str | Column) -> Column:
    """GeoJSON Polygon / MultiPolygon text -> rings (parts flattened,
    closing points dropped, re-oriented by ``repair_rings``)."""
    c = F.col(text) if isinstance(text, str) else text
    coords = F.get_json_object(c, "$.coordinates")
    kind = F.get_json_object(c, "$.type")
    poly = F.array(F.from_json(coords, "array<array<array<double>>>"))
    multi = F.from_json(coords, "array<array<array<array<double>>>>")
    parts = F.when(kind == "Polygon", poly).when(kind == "MultiPolygon", multi)
    pts = F.transform(parts, lambda part: F.transform(part, lambda r: F.transform(r, lambda p: geo.pt(p[0], p[1]))))
    return geo.repair_parts(pts)


def named_layer(t: Tables, name: str) -> DataFrame:
    """A polygon layer by the name the analyses used."""
    table = {
        "micen": layers.mic_layer, "cities": layers.city_layer,
        "regional_geographies": layers.rgeo_layer, "county_background": layers.counties_layer,
        "inventory": layers.zones_layer, "zoning": layers.zoning_layer,
        "exclusions": layers.masks_layer,
    }
    if name == "largest_waterbodies":
        return layers.masks_layer(t).filter(F.col("mask_order") == 0)
    if name not in table:
        raise KeyError(f"unknown layer {name!r}")
    return table[name](t)
