"""How deep masks lie over the pairs of two layers, without meeting the masks
one by one.

With D(x, y) the number of masks over a point, Σ_M area(A ∩ B ∩ M) is the
integral of D over A ∩ B. Of polygons with level and upright edges alone, D is
a sum over corners, Σ_i w_i [x >= x_i][y >= y_i], so the integral of D over all
to the lower left of (x, y) is

    S(x, y) = Σ_{x_i < x, y_i < y}  w_i (x - x_i)(y - y_i)

and the integral over A ∩ B is a signed sum of S at the corners of A ∩ B. Pairs
of overlapping features grow with the product of their layers, corners do not.

S is four sums over the corners to the lower left. The corners' places along x
are written with hexadecimal digits (strips between quantiles first, then the
rank within the strip). Two places differ first at one digit, so for each digit
a corner is copied to the greater digits beside its own, and a place looks for
its own digit: it finds every corner to its left once, over all digits. What
remains is a running sum along y, in a window for each digit and interval of
y; what lies below an interval is added to it as one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrewise import params as P
from acrewise.functions import geometry as geo
from acrewise.operators import overlay as ov
from acrewise.operators.tiles import written
from acrewise.session import ensure_checkpoint_dir

STRIPS = 256   # quantiles of x and of y: two hexadecimal digits
FEW = 16       # intervals of y where a window holds one strip at most
CELL = ["digit", "node", "part"]
SUMS = {"_n": "w", "_nx": "w * x", "_ny": "w * y", "_nxy": "w * x * y"}


def right_angled(rings: str = "rings") -> Column:
    """All edges are level or upright."""
    return F.forall(rings, lambda r: F.forall(geo.ring_edges(r), lambda e: (e["a"]["x"] == e["b"]["x"]) | (e["a"]["y"] == e["b"]["y"])))


def plain_features(layer: DataFrame, fid: str) -> tuple[DataFrame, DataFrame | None]:
    """The features whose depth can be summed by corners, once each with the
    number of their copies (fid, rings, copies), and the rows of the others:
    with slanted edges, or of one key and several shapes (None if there are
    none). Rows without a key take part in no join."""
    rows = layer.where(F.col(fid).isNotNull() & F.col("rings").isNotNull()).select(fid, "rings")
    kinds = rows.select(fid, F.coalesce(right_angled(), F.lit(False)).alias("_plain"), F.xxhash64("rings").alias("_shape")).groupBy(fid).agg(
        F.count(F.lit(1)).alias("copies"), (F.min("_plain") & (F.min("_shape") == F.max("_shape"))).alias("_plain"))
    folder = f"{ensure_checkpoint_dir(layer.sparkSession).rstrip('/')}/copies-{uuid.uuid4().hex}"
    special = written(kinds.where("copies > 1 OR NOT _plain"), folder)  # the few that are not one plain row
    found = {r["_plain"] for r in special.select("_plain").distinct().collect()}
    if not found:
        return rows.withColumn("copies", F.lit(1).cast("long")), None
    marked = rows.join(special, fid, "left")
    once = marked.where("_plain").dropDuplicates([fid])
    plain = marked.where("_plain IS NULL").withColumn("copies", F.lit(1).cast("long")).unionByName(once).drop("_plain")
    return plain, rows.join(special.where("NOT _plain"), fid, "left_semi") if False in found else None


def layer_corners(layer: DataFrame, fid: str, weight: Column, band: float) -> DataFrame:
    """(x, y, w) with Σ w [X >= x][Y >= y] the depth of a layer (fid, rings, ...)
    of right-angled polygons, each counted ``weight`` times."""
    rows = layer.select(F.struct(F.col(fid), weight.alias("w")).alias("_who"), "rings")
    p = ov.layer_pieces(rows, "_who", band).select("_who.w", "l", "r", "yl", "c")
    return (p.select(F.inline(F.array(F.struct(F.col("l").alias("x"), F.col("yl").alias("y"), (-F.col("c") * F.col("w")).alias("w")),
                                      F.struct(F.col("r").alias("x"), F.col("yl").alias("y"), (F.col("c") * F.col("w")).alias("w")))))
            .groupBy("x", "y").agg(F.sum("w").alias("w")).where("w <> 0"))


def pair_corners(a: DataFrame, fa: str, b: DataFrame, fb: str, prm: P.Params) -> DataFrame:
    """(fa, fb, x, y, w) for the overlap of each pair of right-angled features:
    the integral of any D over it is Σ w S(x, y)."""
    pairs = ov.bbox_pairs(a, fa, b, fb, prm.cell_size)
    p = ov.met_pieces(pairs, fa, fb, ov.layer_pieces(a, fa, prm.band_width), ov.layer_pieces(b, fb, prm.band_width),
                      prm.band_width, prm.max_band_pieces)
    y = F.least("_pa_yl", "_pb_yl").alias("y")
    return (p.select(fa, fb, F.inline(F.array(F.struct(F.col("_L").alias("x"), y, (-F.col("_s")).alias("w")),
                                              F.struct(F.col("_R").alias("x"), y, F.col("_s").alias("w")))))
            .groupBy(fa, fb, "x", "y").agg(F.sum("w").alias("w")).where("w <> 0"))


def _strip(rows: DataFrame, x: str, cuts: str, out: str) -> DataFrame:
    """Rows with ``out``, the number of the column ``cuts`` up to x, found by
    halving; cuts are STRIPS - 1 values, filled up with infinity."""
    rows, step = rows.withColumn(out, F.lit(0)), STRIPS // 2
    while step:
        rows = rows.withColumn(out, F.expr(f"{out} + IF({x} >= {cuts}[{out} + {step - 1}], {step}, 0)"))
        step //= 2
    return rows


def _part(top: int) -> str:
    return f"IF(digit = {top}, _row, _row div {STRIPS // FEW})"


def integrals(places: DataFrame, keys: Sequence[str], corners: DataFrame) -> DataFrame:
    """(keys, _t) with _t = Σ w S(x, y) over the rows (keys, x, y, w) of
    ``places``, S as above of ``corners`` (x, y, w)."""
    folder = f"{ensure_checkpoint_dir(corners.sparkSession).rstrip('/')}/depth-{uuid.uuid4().hex}"
    corners = written(corners, f"{folder}/corners")
    at = [i / STRIPS for i in range(1, STRIPS)]
    q = corners.agg(*[F.array_distinct(F.percentile_approx(k, at or [0.5], 10_000)).alias(k) for k in ("x", "y")])
    # the middle, from which distances are taken (that keeps the sums small), and the cuts
    middle = [F.expr(f"coalesce(get({k}, size({k}) div 2), 0D)").alias(f"_m{k}") for k in ("x", "y")]
    full = [F.expr(f"slice(concat(coalesce({k}, CAST(array() AS ARRAY<DOUBLE>)), array_repeat(CAST('Infinity' AS DOUBLE), {STRIPS})), 1, {STRIPS})").alias(f"_c{k}") for k in ("x", "y")]
    cuts = F.broadcast(written(q.select(*middle, *full), f"{folder}/cuts"))  # one row
    along = Window.partitionBy("_strip").orderBy("x")
    c = written(_strip(corners.crossJoin(cuts.select("_cx")), "x", "_cx", "_strip").drop("_cx").withColumn("_rank", F.dense_rank().over(along) - 1), f"{folder}/ranked")
    last = c.agg(F.max("_rank")).first()[0]
    if last is None:
        return places.select(*keys, F.lit(0.0).alias("_t")).limit(0)
    inner = 1                              # digits of the rank, which may be one more than the last
    while 16 ** inner <= last + 1:
        inner += 1
    top = inner + 1
    # places: the corners' x of their strip that lie to the left of theirs
    own = _strip(places.select(F.struct(*keys).alias("_key"), "x", "y", "w").crossJoin(cuts.select("_cx")), "x", "_cx", "_strip").drop("_cx").withColumn("_rank", F.lit(0))
    xs = c.select("x", "_strip").distinct().select(F.lit(None).cast(own.schema["_key"].dataType).alias("_key"), "x", F.lit(None).cast("double").alias("y"),
                                                   F.lit(None).cast("long").alias("w"), "_strip", F.lit(1).alias("_rank"))
    before = Window.partitionBy("_strip").orderBy("x", "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.unionByName(xs).withColumn("_rank", F.sum("_rank").over(before)).where("w IS NOT NULL")

    def placed(rows: DataFrame) -> DataFrame:
        rows = _strip(rows.crossJoin(cuts.select("_cy", "_mx", "_my")), "y", "_cy", "_row").drop("_cy").withColumn("_pos", F.expr(f"CAST(_strip AS BIGINT) * {16 ** inner} + _rank"))
        rows = rows.withColumn("x", F.col("x") - F.col("_mx")).withColumn("y", F.col("y") - F.col("_my"))
        rows = rows.withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(top))))
        return rows.withColumn("_up", F.expr("shiftright(_pos, 4 * digit)")).withColumn("part", F.expr(_part(top)))

    copies = (placed(c).where("_up % 16 < 15")
              .withColumn("node", F.explode(F.expr("sequence(_up + 1, _up - _up % 16 + 15)")))
              .select(*CELL, "y", *[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in SUMS.items()]))
    # what lies below an interval of y, for each interval above one with corners
    up = Window.partitionBy("digit", "node").orderBy("part")
    sums = copies.groupBy(*CELL).agg(*[F.sum(k).alias(k) for k in SUMS])
    below = sums.select("digit", "node", "part", *[F.sum(k).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(k) for k in SUMS],
                        F.coalesce(F.lead("part").over(up), F.expr(f"IF(digit = {top}, {STRIPS}, {FEW}) - 1")).alias("_next"))
    below = below.where("_next > part").withColumn("part", F.explode(F.expr("sequence(part + 1, _next)"))).select(*CELL, F.lit(None).cast("double").alias("y"), *SUMS)
    asked = placed(own).where("_up % 16 > 0").withColumn("node", F.col("_up")).select(*CELL, "y", *[F.lit(0.0).alias(k) for k in SUMS], "_key", "x", "w")
    held = copies.unionByName(below).select("*", F.lit(None).cast(own.schema["_key"].dataType).alias("_key"), F.lit(None).cast("double").alias("x"),
                                            F.lit(None).cast("long").alias("w"))
    run = Window.partitionBy(*CELL).orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = held.unionByName(asked).select("_key", "x", "y", "w", *[F.sum(k).over(run).alias(k) for k in SUMS]).where("w IS NOT NULL")
    t = s.groupBy("_key").agg(F.sum(F.expr("w * (x * (y * _n - _ny) - (y * _nx - _nxy))")).alias("_t")).select("_key.*", "_t")
    return written(t, f"{folder}/sums")  # so the plans after it, and a lost executor, do not repeat it
