"""The person table is spread over the cores before its replicate weights are made."""

from acrewise.operators.survey import BUCKETS, _cuts_below
from acrewise.sources import fixtures as fx
from acrewise.sources.tables import Tables


def test_persons_are_dealt_over_the_cores(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    p = fx.persons(t)
    assert p.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert p.count() == t.customer.count()


def test_cuts_below_a_value(spark):
    cuts = [float(k // 2 * 2) for k in range(2, BUCKETS, 2)]
    rows = [(v, n) for v in (-1.0, 0.0, 2.0, 2.5, 17.0, 254.0, 1e9, float("nan")) for n in (0, 1, 2, 100, len(cuts))]
    df = spark.createDataFrame([(v, cuts[:n]) for v, n in rows], "v double, cuts array<double>")
    got = [r.n for r in df.selectExpr(f"{_cuts_below('cuts', 'v')} AS n").collect()]
    assert got == [n if v != v else sum(c < v for c in cuts[:n]) for v, n in rows]
