"""Sinks (S9, S11, S12, S14, S15) and reuse of saved intermediates.

``materialized`` is the recompute-or-reload switch of the original scripts:
the frame is written as Parquet into the shared folder (so a lost executor
does not lose it, its lineage is cut and readers prune columns), and read
from there afterwards. With ``spark.acrewise.intermediates`` set to a shared
folder the files outlive the session and a later one reloads them, as long as
the manifest beside them (input files, parameters, code) is what it would be
now; without it they belong to the application and lie in
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import pathlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from acrewise.session import ensure_checkpoint_dir

_DONE: set[str] = set()


def intermediates(spark: SparkSession) -> str:
    """The folder that saved intermediates lie in."""
    kept = spark.conf.get("spark.acrewise.intermediates", None)
    return (kept or f"{ensure_checkpoint_dir(spark).rstrip('/')}/acrewise-{spark.sparkContext.applicationId}").rstrip("/")


def _written(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


@functools.cache
def code_version() -> str:
    """A digest of this package's source."""
    root = pathlib.Path(__file__).resolve().parents[1]
    total = hashlib.sha1()
    for f in sorted(root.rglob("*.py")):
        total.update(f.relative_to(root).as_posix().encode() + b"\0" + f.read_bytes())
    return total.hexdigest()


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Every file below a folder with its size and time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    files, out = fs.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def manifest(spark: SparkSession, key: tuple, inputs: Sequence[str] | None = None) -> str:
    """What a saved frame depends on, as JSON: its key (name and parameters),
    the files of its inputs (by default those of the folders that the key
    names), and the code."""
    if inputs is None:
        inputs = [k for k in key if isinstance(k, str) and "/" in k]
    return json.dumps({"key": repr(key), "code": code_version(), "inputs": {p: listing(spark, p) for p in inputs}}, sort_keys=True)


def _note(spark: SparkSession, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json")
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def materialized(spark: SparkSession, key: tuple, build: Callable[[], DataFrame],
                 recalculate: bool | None = None, inputs: Sequence[str] | None = None) -> DataFrame:
    """Write once, read after. ``key`` names the frame, its
    inputs and its parameters. The saved table lies under a digest of its
    manifest, which is kept beside its files: when an input file, a parameter
    or the code has changed the table is not found and is built anew, else it
    is reloaded, in a later session too. ``recalculate`` (by default the
    setting ``spark.acrewise.recalculate``, which so reaches every report)
    writes it anew once a session whatever is there."""
    told = manifest(spark, key, inputs)
    path = f"{intermediates(spark)}/{key[0]}-{hashlib.sha1(told.encode()).hexdigest()[:16]}"
    asked = spark.conf.get("spark.acrewise.recalculate", "false").lower() == "true" and path not in _DONE
    if (asked if recalculate is None else recalculate) or (path not in _DONE and not _written(spark, path)):
        build().write.mode("overwrite").parquet(path)
        _note(spark, path, told)
    _DONE.add(path)
    return spark.read.parquet(path)


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table (re-runs are repeatable)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def load(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Reload a saved intermediate."""
    return spark.read.format(fmt).load(path)


def save_sheets(sheets: dict[str, DataFrame], out_dir: str) -> list[str]:
    """One CSV directory per sheet name (the workbook of the
    original). Sheets are small result tables; each is written by Spark as
    a single CSV part with a header."""
    paths = []
    for name, df in sheets.items():
        p = os.path.join(out_dir, name)
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(p)
        paths.append(p)
    return paths


def export_tsv(df: DataFrame, path: str) -> None:
    """Hand a table to another system as tab-separated text."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
