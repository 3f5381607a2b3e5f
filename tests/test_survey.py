"""Weighted medians by selection, against the frequency-expanded values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from acrewise.operators.survey import weighted_medians


def expanded(values, weights):
    v = np.repeat(values, np.maximum(weights, 0))
    return float(np.median(v)) if len(v) else None


def test_medians_equal_the_expanded_values(spark):
    """Ties, zero weights, null values and groups, one row, no weight at all."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), rng.choice([None, 5.0, 5.0, 7.25, -1.0, float(rng.randint(0, 40)), rng.uniform(0, 9e6)]),
             *[rng.choice([0, 1, 2, 9, 150]) for _ in range(4)]) for _ in range(700)]
    rows += [("one", "x", 3.0, 1, 0, 2, 0), ("none", "x", 8.0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "c string, k string, v double, w int, w1 int, w2 int, w3 int")
    got = {(r.c, r.k, r._level): (r.v_median, r.v_median_moe) for r in weighted_medians(df, "v", [["c", "k"], ["k"]], ["c", "k"], "w", 3).collect()}
    groups = {(c, k, 0) for c, k, v, *_ in rows if c is not None and v is not None} | {(None, k, 1) for _, k, v, *_ in rows if v is not None}
    assert got.keys() == groups
    for c, k, level in groups:
        some = [r for r in rows if r[2] is not None and r[1] == k and (level == 1 or r[0] == c)]
        meds = [expanded([r[2] for r in some], [r[3 + j] for r in some]) for j in range(4)]
        med, moe = got[c, k, level]
        if meds[0] is None:
            assert med is None
            continue
        assert med == pytest.approx(meds[0], abs=1e-8)
        if None in meds:
            assert moe is None
        else:
            assert moe == pytest.approx(1.645 * (4 / 3 * sum((m - meds[0]) ** 2 for m in meds[1:])) ** 0.5, abs=1e-6)


def test_a_million_values_in_one_group(spark):
    """All values of the group are different, and most of them lie close
    together: no exact percentile, and few rows are sorted by value."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("g").alias("c"), (F.when(F.col("id") % 1000 == 0, F.col("id") * 1e6).otherwise(F.col("id") * 0.37 + 1)).alias("v"),
                               (F.col("id") % 5).alias("w"), (F.col("id") % 3 + 1).alias("w1"))
    out = weighted_medians(df, "v", [["c"]], ["c"], "w", 1)
    plan = out._jdf.queryExecution().toString()
    assert " percentile(" not in plan and "percentile_approx" in plan
    i = np.arange(n)
    v = np.where(i % 1000 == 0, i * 1e6, i * 0.37 + 1)
    med, rep = (expanded(v, w) for w in (i % 5, i % 3 + 1))
    r = out.first()
    assert r.v_median == pytest.approx(med, abs=1e-6) and r.v_median_moe == pytest.approx(1.645 * 2 * abs(rep - med), abs=1e-4)
