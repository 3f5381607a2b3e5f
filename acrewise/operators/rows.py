"""Row-level helpers: distributed row index (W1), keep first per key (W2),
repeated keys (A2), uniqueness / not-null checks (S13)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrewise.session import ensure_checkpoint_dir


def row_index(df: DataFrame, order: Sequence[str], name: str = "index", start: int = 1) -> DataFrame:
    """1..n in the order of ``order`` (unique keys) without a single-task
    window. The range-partitioned frame is written once, each row with the
    number of its partition; counts and rows are read from that file, so both
    see the same partitions whatever columns a caller uses. The counts (one
    row per partition) give each partition its offset."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/row-index-{uuid.uuid4().hex}"
    (df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).write.parquet(folder))
    parts = spark.read.parquet(folder)
    offs = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n")).select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = parts.withColumn("_loc", F.row_number().over(Window.partitionBy("_pid").orderBy(*order)))
    idx = F.col("_off") + F.col("_loc") + (start - 1)
    return local.join(F.broadcast(offs), "_pid").select(idx.cast("long").alias(name), *df.columns)


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``distinct(key, .keep_all = TRUE)``; among rows of a key the first
    in ``order`` is kept, which must tell the rows of a key apart. The least
    order value of each key is a narrow aggregate, combined map-side, so a
    key holding a third of the rows is never gathered in one task; the rows
    come back by a semi-join and wide columns (geometry) are never sorted."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(f"_first.{c}").alias(f"_o{i}") for i, c in enumerate(order)])
    on = [df[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)] + [df[c].eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)]
    return df.join(first, on, "left_semi")


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """A2: keys that occur more than once (map-side partial counts)."""
    return df.groupBy(*key).count().filter(F.col("count") > 1).select(*key)


def key_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows breaking PRIMARY KEY NOT NULL (NULL or repeated key)."""
    nulls = df.filter(" OR ".join(f"`{k}` IS NULL" for k in key)).select(*key).withColumn("problem", F.lit("null"))
    reps = repeated_keys(df.dropna(subset=list(key)), key).withColumn("problem", F.lit("repeated"))
    return nulls.unionByName(reps)
