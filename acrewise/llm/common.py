"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrewise.operators.rows import row_index
from acrewise.session import ensure_checkpoint_dir

#: A word is a run of anything but these: the space and \t \n \v \f \r.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text, in order (null: empty array)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def names(df: DataFrame, *bases: str) -> list[str]:
    """For each base a column name that ``df`` does not use yet (Spark
    resolves names without regard to case, so the test does too)."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = f"_{base}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_outputs(df: DataFrame, outputs: dict[str, Column]) -> list[Column]:
    """The select list that keeps df's columns, but for those an output of
    the same name replaces, followed by the outputs."""
    new = {k.lower() for k in outputs}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in new] + [v.alias(k) for k, v in outputs.items()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession) -> str:
    """A new folder name inside the shared folder of spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back:
    cuts the lineage, and the copy outlives any executor."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILE_ROWS = 100_000


def in_files(df: DataFrame, rows: int) -> DataFrame:
    """df, whose size goes with ``rows``, in as many partitions as are worth a
    file, at least one a core: a few rows would else be written to as many
    files as a shuffle has partitions. For narrow rows, as it holds for all
    that the last stage does."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now. It does so
    when their objects are collected, which an idle driver may put off; the
    last step's are held until its events have been heard."""
    for _ in range(3):
        time.sleep(1)
        gc.collect()
        spark._jvm.System.gc()


def dropped(spark: SparkSession, folder: str, name: str) -> None:
    """Delete one scratch table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()


def on_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the Python workers: once
    an application the driver's file server hands them its source."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/acrewise", "zip", root, "acrewise"))
        _SHIPPED.add(sc.applicationId)
    return df.mapInArrow(fn, schema)


def fixed(df: DataFrame, **cols: Column) -> DataFrame:
    """df with further columns that are computed once per row. A plain select
    may be merged into the next one, and an array expression inside a lambda
    would then be computed anew for every element; a generator of one row is
    never merged."""
    (s,) = names(df, "fixed")
    out = df.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))).alias(s))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"{s}.{k}") for k in cols])


def numbered(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """df with a column that tells documents of one id apart, and its name: 0
    where no other row has the id, else (null ids too) a number for each
    distinct pair of id and text, by 128 bits of the text. Texts move only
    where ids are null or repeated."""
    number, digest = names(df, "number", "digest")
    own = F.col(f"`{key}`")
    shared = df.groupBy(own.alias("i")).count().where("count > 1 OR i IS NULL").select("i")
    shared = stored(shared, scratch(df.sparkSession), "shared-ids")
    if shared.isEmpty():
        return df.withColumn(number, F.lit(0).cast("long")), number
    x = df.withColumn(digest, F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))))
    pairs = x.select(own.alias("j"), F.col(digest).alias("h")).join(shared, F.col("j").eqNullSafe(F.col("i")), "left_semi").distinct()
    known = row_index(pairs, ["j", "h"], "n")
    out = x.join(known, own.eqNullSafe(F.col("j")) & (F.col(digest) == F.col("h")), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce("n", F.lit(0)).alias(number)), number


def row_key(df: DataFrame, key: str, text: str) -> Column:
    """What tells rows apart where a step must find its row again: id and
    text. Rows equal in both are interchangeable."""
    return F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("fp"))


def matching(df: DataFrame, own: Column, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df whose key ``own`` is in ``keys.k`` (or, as an anti
    join, is not), columns unchanged."""
    mine, theirs = names(df, "own", "theirs")
    return df.withColumn(mine, own).join(keys.select(F.col("k").alias(theirs)), F.col(mine).eqNullSafe(F.col(theirs)), how).drop(mine)


PICK_BITS = 1 << 24


def bitmap_rows(keys: DataFrame, at: Column) -> DataFrame:
    """(bucket, bits): the bitmap of the numbers ``at`` (1 and up, as Spark's
    buckets begin at 1), 4 KB a row."""
    return (keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))


def low_bits(keys: DataFrame, column: str, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits, packed, of the low bits of a column of
    hashes: its rows are put together on the driver, size / 8 bytes whatever
    the number of keys."""
    out = np.zeros(size // 8, np.uint8)
    for bucket, bits in bitmap_rows(keys, F.col(column).bitwiseAND(size - 1) + 1).toLocalIterator():
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def has_bit(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (8 * len(packed) - 1)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def flagged(df: DataFrame, own: Column, keys: DataFrame, theirs: Column, folder: str, name: str, flag: str) -> DataFrame:
    """df with a column that is true where the row's key is one of ``keys``,
    and for few others: a bitmap of the keys' hashes, 2 MB whatever their
    number, is broadcast, so that wide rows for which a join decides nothing
    are not shuffled for it. It decides how much moves, never the result of
    that join."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(PICK_BITS)) + 1
    place, bucket, bits = names(df, "place", "bucket", "bits")
    known = bitmap_rows(keys, at(theirs))
    known = stored(in_files(known, PICK_BITS >> 15), folder, name).select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    x = df.withColumn(place, at(own))
    x = x.join(F.broadcast(known), F.bitmap_bucket_number(place) == F.col(bucket), "left")
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return x.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)).alias(flag))


def picked(df: DataFrame, own: Column, keys: DataFrame, theirs: Column, folder: str, name: str) -> DataFrame:
    """The rows of df whose key may be one of ``keys``, and few others."""
    (flag,) = names(df, "flag")
    return flagged(df, own, keys, theirs, folder, name, flag).where(F.col(flag)).drop(flag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
