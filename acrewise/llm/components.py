"""Connected components by alternating stars, in a logarithmic number of
rounds. Each round is two joins of the edges with the minimum neighbour of a
node; the edges of a round are written to the shared folder, so a lost
executor costs one round at most. They come in files by their number, as few
edges would else make a file for each partition in each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrewise.llm.common import dropped, in_files, scratch, stored


def _least_neighbour(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (u, root): the smallest node that each node reaches;
    nodes without edges do not appear. Null nodes are not allowed; loops and
    repeated edges do no harm."""
    folder = scratch(edges.sparkSession)
    rows = edges.count()
    now = stored(in_files(edges.select("u", "v").where("u <> v").distinct(), rows), folder, "round0")
    seen, i = None, 0
    while True:
        i += 1
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.where("v > u").join(_least_neighbour(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(in_files(large, rows), folder, f"large{i}")
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _least_neighbour(down)
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = stored(in_files(small.where("u <> v").distinct(), rows), folder, f"round{i}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(edges.sparkSession, folder, f"round{i - 1}")
        dropped(edges.sparkSession, folder, f"large{i}")
        if state == seen or not state[0]:
            return now.withColumnRenamed("v", "root")
        seen = state
