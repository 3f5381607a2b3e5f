"""Tables of a few rows come in a few files, whatever the shuffle's width."""

import random

import pytest
from pyspark.sql import functions as F

from acrewise.llm import components, jaccard_join
from acrewise.llm.common import FILE_ROWS, in_files


@pytest.fixture
def wide(spark):
    """Shuffles of 64 partitions that are not coalesced."""
    new = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def watched(monkeypatch, module):
    """The number of files of each table that the module stores, by name."""
    seen, was = {}, module.stored

    def stored(df, folder, name):
        out = was(df, folder, name)
        seen[name] = len(out.inputFiles())
        return out
    monkeypatch.setattr(module, "stored", stored)
    return seen


def test_components_of_few_edges_come_in_few_files(wide, monkeypatch):
    seen = watched(monkeypatch, components)
    edges = wide.range(3000).where("id % 10 < 9").select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r.u: r.root for r in components.components(edges).collect()}
    assert got == {k: k - k % 10 for k in range(3000) if k % 10}
    assert max(seen.values()) <= wide.sparkContext.defaultParallelism


def test_jaccard_join_of_few_documents_writes_few_files(wide, monkeypatch):
    seen = watched(monkeypatch, jaccard_join)
    rng = random.Random(5)
    texts = [[f"w{rng.randint(0, 10 ** 6)}" for _ in range(60)] for _ in range(200)]
    rows = [(2 * k, " ".join(t)) for k, t in enumerate(texts)] + [(2 * k + 1, " ".join(t[:-1])) for k, t in enumerate(texts)]
    got = jaccard_join.Join().classes(wide.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.k.id, r.component_id) for r in got.collect()} == {(k, k - k % 2) for k in range(400)}
    assert max(seen[k] for k in ("homes", "members", "placed", "part", "leaders")) <= wide.sparkContext.defaultParallelism


def test_many_rows_keep_their_partitions(wide):
    x = wide.range(10).repartition(64)
    assert in_files(x, 100 * FILE_ROWS).rdd.getNumPartitions() == 64
    assert in_files(x, 5 * FILE_ROWS).rdd.getNumPartitions() == max(5, wide.sparkContext.defaultParallelism)
