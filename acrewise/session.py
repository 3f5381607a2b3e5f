"""Session helpers: one place for the settings the jobs rely on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "acrewise",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE on and the UI off.

    On a cluster the master and the shuffle width come from spark-submit;
    the defaults here are for local runs and tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode runs everything in the driver JVM: give it the heap
            # (on a cluster, executor and driver memory come from spark-submit)
            builder = builder.config("spark.driver.memory", os.environ.get("ACREWISE_DRIVER_MEMORY", "16g"))
    local = bool(master) and master.startswith("local")
    if shuffle_partitions or local:
        # locally one partition per core; on a cluster the submitted config
        # (sized to the data) stands, and AQE coalesces small partitions
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8))
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def plain_unions(spark: SparkSession) -> None:
    """Let no plan count on the partitioning of a union.

    Spark 4.1 takes a union of equally partitioned sides as partitioned
    likewise and saves the exchange after it, but adaptive execution coalesces
    the partitions of each side on its own: rows of one key then lie in several
    partitions and an aggregate or window above gives wrong rows (RS14's total
    was 119 for 604). Called wherever a session enters the library.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; only when it is unset on a local
    master (tests) do we pick a scratch folder of our own. Elsewhere the
    executors would not see such a folder, so an unset setting is an error.
    """
    plain_unions(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="acrewise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path
