"""Tiles of a hot (group, band) for the slab overlay.

A (group, band) with more edges than a task shall hold is cut in x *and* y.
Every tile then is an overlay of its own: its edges clipped to it, a marker
along its lower and upper side, and along its lower side the winding counts of
all that lies below.

The counts at a height change with x only where an edge below ends and none
goes on, that is where an edge crosses the cut (or a vertical edge does, which
the overlay leaves out). So every clipped edge adds its weight where it begins
and takes it away where it ends; at a vertex that adds up to nothing, and what
is left over is summed upwards over the tiles of a column. Edges that enter at
the column's left side make the count there.

``crossing_pairs`` lists the pairs of edges that may cross. Edges that span
their tile cross only if their orders at its two sides differ: each covers the
ranks between its places in both orders, and only edges that share a rank are
paired, which is in proportion to the edges and their crossings. Edges that end
inside a tile are paired with the edges of that tile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrewise.session import ensure_checkpoint_dir

SUB_BANDS = 1 << 20   # band ids become band * SUB_BANDS + column
KNOTS = 64            # quantiles of the heights that the cuts follow


def sql_interp(l: str, r: str, yl: str, yr: str, x: str) -> str:
    """SQL text: height at ``x`` of the segment (l, yl)-(r, yr)."""
    return f"({yl} + ({yr} - {yl}) * try_divide({x} - {l}, {r} - {l}))"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_bands(pieces: DataFrame, band: float, max_pieces: int) -> DataFrame:
    """(g, band, _kx, _cuts) of each (g, band) with more than ``max_pieces``
    edges: the number of columns and the heights of the cuts between rows.

    An edge is copied into each column and row that it passes, so cuts run
    along the edges: the fewer columns the wider the edges are, the fewer rows
    the taller, and as many of both as bring a tile to half of the limit. The
    cuts follow quantiles of the edges' heights."""
    lo, hi = F.least("yl", "yr"), F.greatest("yl", "yr")
    n = pieces.groupBy("g", "band").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("r") - F.col("l")) / band).alias("_wide"),
        F.sum(hi - lo).alias("_tall"), F.min(lo).alias("_y0"), F.max(hi).alias("_y1")).where(F.col("_n") > max_pieces)
    tall = F.coalesce(F.try_divide("_tall", F.col("_y1") - F.col("_y0")), F.lit(0.0))
    n = n.select("g", "band", "_n", "_y0", "_y1", F.greatest("_wide", F.lit(1e-9)).alias("_wide"), F.greatest(tall, F.lit(1e-9)).alias("_tall"))
    tiles = F.greatest(4 * F.col("_n") / max_pieces, 64 * F.col("_wide") * F.col("_tall") / max_pieces ** 2)
    n = n.withColumn("_tiles", tiles)
    kx = F.least(F.greatest(F.floor(F.sqrt(F.col("_tiles") * F.col("_tall") / F.col("_wide"))), F.lit(1)), F.ceil("_tiles"), F.lit(SUB_BANDS))
    n = n.withColumn("_kx", kx.cast("int")).withColumn("_ky", F.ceil(F.col("_tiles") / F.col("_kx")).cast("int"))
    at = [i / KNOTS for i in range(1, KNOTS)]
    knots = (pieces.join(n.select("g", "band"), ["g", "band"], "left_semi").groupBy("g", "band")
             .agg(F.percentile_approx((F.col("yl") + F.col("yr")) / 2, at, 10_000).alias("_q")))
    n = n.join(knots, ["g", "band"]).withColumn("_q", F.concat(F.array("_y0"), "_q", F.array("_y1")))
    some = F.least("_ky", F.lit(KNOTS))           # knots used
    each = F.ceil(F.col("_ky") / some).cast("int")  # rows between two of them
    n = n.select("g", "band", "_kx", "_q", some.alias("_some"), each.alias("_each"))
    cuts = F.expr(f"""CASE WHEN _some * _each < 2 THEN CAST(array() AS ARRAY<DOUBLE>) ELSE array_sort(array_distinct(transform(sequence(1, greatest(_some * _each - 1, 1)), j ->
        _q[CAST({KNOTS} * (j div _each) / _some AS INT)] + (_q[CAST({KNOTS} * (j div _each + 1) / _some AS INT)] - _q[CAST({KNOTS} * (j div _each) / _some AS INT)])
          * (j % _each) / _each))) END""")
    return n.select("g", "band", "_kx", cuts.alias("_cuts"))


def row_of(y: str) -> str:
    """SQL text: the row that holds height y, the number of ``_cuts`` up to it
    (found by halving)."""
    return (f"aggregate(sequence(1, 32), named_struct('a', 0, 'b', size(_cuts)), (s, i) -> CASE WHEN s.a >= s.b THEN s "
            f"WHEN _cuts[(s.a + s.b) div 2] <= {y} THEN named_struct('a', CAST((s.a + s.b) div 2 + 1 AS INT), 'b', s.b) "
            f"ELSE named_struct('a', s.a, 'b', CAST((s.a + s.b) div 2 AS INT)) END).a")


def _clipped(p: DataFrame, band: float) -> DataFrame:
    """Edges of hot bands, joined with ``hot_bands``, cut into tiles: band is
    the column, tile the row, _x0 and _x1 the column's sides."""
    w = f"({band!r} / _kx)"
    x = p.selectExpr("*", f"band * {band!r} AS _lo", f"least(greatest(CAST(floor((l - band * {band!r}) / {w}) AS INT), 0), _kx - 1) AS _c0",
                     f"least(greatest(CAST(floor((r - band * {band!r}) / {w}) AS INT), 0), _kx - 1) AS _c1")
    x = x.selectExpr("*", "explode(sequence(_c0, _c1)) AS _col")
    x = x.selectExpr("*", f"_lo + _col * {w} AS _x0", f"_lo + (_col + 1) * {w} AS _x1")
    x = x.selectExpr("*", "CASE WHEN _col > _c0 THEN greatest(l, _x0) ELSE l END AS _nl", "CASE WHEN _col < _c1 THEN least(r, _x1) ELSE r END AS _nr").where("_nr > _nl")
    x = x.selectExpr("g", "layer", "c", "band", "_kx", "_cuts", "_col", "_x0", "_x1", "_nl AS l", "_nr AS r",
                     f"CASE WHEN _nl = l THEN yl ELSE {sql_interp('l', 'r', 'yl', 'yr', '_nl')} END AS yl",
                     f"CASE WHEN _nr = r THEN yr ELSE {sql_interp('l', 'r', 'yl', 'yr', '_nr')} END AS yr")
    x = x.selectExpr("*", f"explode(sequence({row_of('least(yl, yr)')}, {row_of('greatest(yl, yr)')})) AS tile")
    x = x.selectExpr("*", "CASE WHEN tile > 0 THEN _cuts[tile - 1] END AS _b", "get(_cuts, tile) AS _t")
    at = lambda y: f"least(greatest(l + (r - l) * try_divide({y} - yl, yr - yl), l), r)"
    low, high = f"{at('_b')}", f"{at('_t')}"
    x = x.selectExpr(
        "g", "layer", "c", f"band * {SUB_BANDS} + _col AS band", "tile", "_x0", "_x1", "l", "r", "yl", "yr", "_b", "_t",
        f"CASE WHEN yl < _b THEN {low} WHEN yl > _t THEN {high} ELSE l END AS _nl", f"CASE WHEN yr < _b THEN {low} WHEN yr > _t THEN {high} ELSE r END AS _nr")
    x = x.where("_nr > _nl")
    return x.selectExpr("g", "layer", "band", "tile", "_nl AS l", "_nr AS r",
                        "CASE WHEN yl < _b THEN _b WHEN yl > _t THEN _t ELSE yl END AS yl", "CASE WHEN yr < _b THEN _b WHEN yr > _t THEN _t ELSE yr END AS yr",
                        "c", "_x0", "_x1")


def _sides(hot: DataFrame, band: float) -> DataFrame:
    """Every tile of the hot bands: (g, band, tile, _x0, _x1, _b, _t)."""
    t = hot.selectExpr("*", "explode(sequence(0, _kx - 1)) AS _col").selectExpr("*", "explode(sequence(0, size(_cuts))) AS tile")
    w = f"({band!r} / _kx)"
    return t.selectExpr("g", f"band * {SUB_BANDS} + _col AS band", "tile", f"band * {band!r} + _col * {w} AS _x0", f"band * {band!r} + (_col + 1) * {w} AS _x1",
                        "CASE WHEN tile > 0 THEN _cuts[tile - 1] END AS _b", "get(_cuts, tile) AS _t")


def _lower_sides(clipped: DataFrame, sides: DataFrame) -> DataFrame:
    """Pieces along the lower side of each tile that carry the winding counts
    of what lies below."""
    k = ["g", "band"]
    begins = clipped.selectExpr(*k, "layer", "tile", "l AS x", "-c AS w")
    ends = clipped.where("r < _x1").selectExpr(*k, "layer", "tile", "r AS x", "c AS w")
    left = begins.union(ends).groupBy(*k, "layer", "x", "tile").agg(F.sum("w").alias("w")).where("w <> 0")
    up = Window.partitionBy(*k, "layer", "x").orderBy("tile")
    run = left.select(*k, "layer", "x", "tile", F.sum("w").over(up).alias("w"), F.lead("tile").over(up).alias("_next")).where("w <> 0 AND _next > tile")
    change = run.select(*k, "layer", "x", "w", F.explode(F.sequence(F.col("tile") + 1, "_next")).alias("tile"))
    along = Window.partitionBy(*k, "tile", "layer").orderBy("x")
    count = change.select(*k, "tile", "layer", "x", F.sum("w").over(along).alias("w"), F.lead("x").over(along).alias("_next")).where("w <> 0")
    return count.join(sides, [*k, "tile"]).selectExpr(
        "g", "layer", "band", "tile", "x AS l", "coalesce(_next, _x1) AS r", "_b AS yl", "_b AS yr", "CAST(-w AS INT) AS c", "_x0", "_x1").where("r > l")


def tiled(pieces: DataFrame, band: float, max_pieces: int) -> DataFrame:
    """Edges (g, layer, band, l, r, yl, yr, c) with ``tile``, the sides of
    their tile and ``kind``: 0 for an edge of a band that is not hot, 1 for one
    of a hot band's tile, 2 for the lower and upper sides of its tiles, which
    take part in the overlay but cross nothing."""
    folder = f"{ensure_checkpoint_dir(pieces.sparkSession).rstrip('/')}/tiles-{uuid.uuid4().hex}"
    p = pieces
    hot = written(hot_bands(p, band, max_pieces), f"{folder}/hot")
    cols = ["g", "layer", "band", "tile", "l", "r", "yl", "yr", "c", "_x0", "_x1"]
    cold = p.join(hot.select("g", "band"), ["g", "band"], "left_anti").selectExpr(
        "g", "layer", f"band * {SUB_BANDS} AS band", "0 AS tile", "l", "r", "yl", "yr", "c", "CAST(NULL AS DOUBLE) AS _x0", "CAST(NULL AS DOUBLE) AS _x1", "0 AS kind")
    inner = written(_clipped(p.join(hot, ["g", "band"]), band).select(*cols), f"{folder}/inner")
    sides = _sides(hot, band)
    lower = _lower_sides(inner, sides)
    marks = sides.selectExpr("g", "0 AS layer", "band", "tile", "_x0 AS l", "_x1 AS r", "explode(filter(array(_b, _t), y -> y IS NOT NULL)) AS yl", "_x0", "_x1")
    marks = marks.selectExpr("g", "layer", "band", "tile", "l", "r", "yl", "yl AS yr", "0 AS c", "_x0", "_x1")
    return (cold.unionByName(inner.withColumn("kind", F.lit(1)))
            .unionByName(lower.unionByName(marks).withColumn("kind", F.lit(2))))


def any_hot(pieces: DataFrame, max_pieces: int) -> bool:
    return not pieces.groupBy("g", "band").count().where(F.col("count") > max_pieces).isEmpty()


def crossing_pairs(pieces: DataFrame, keys: list[str], tiled: bool = True) -> DataFrame:
    """Pairs of edges of one tile that may cross: keys and both edges' l, r,
    yl, yr as a_*, b_*. Where no band is hot (``tiled`` false) no edge spans a
    tile, and the edges of a band are paired."""
    side = lambda s, df: df.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("l", "r", "yl", "yr")])
    meet = ("greatest(a_l, b_l) < least(a_r, b_r) AND greatest(a_yl, a_yr) > least(b_yl, b_yr) AND greatest(b_yl, b_yr) > least(a_yl, a_yr)")
    if not tiled:
        return side("a", pieces).join(side("b", pieces), keys).where(meet)
    live = pieces.where("kind < 2")
    spans = F.coalesce((F.col("l") <= F.col("_x0")) & (F.col("r") >= F.col("_x1")), F.lit(False))
    both = side("a", live.where(~spans)).join(side("b", live), keys).where(meet)
    edge = F.struct("l", "r", "yl", "yr")
    left, right = (Window.partitionBy(*keys).orderBy(*cols) for cols in (("yl", "yr", "layer", "c"), ("yr", "yl", "layer", "c")))
    ranked = live.where(spans).select(*keys, edge.alias("e"), F.row_number().over(left).alias("i"), F.row_number().over(right).alias("j"))
    ranked = ranked.select(*keys, "e", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    begin = ranked.select(*keys, F.col("e").alias("a"), F.col("lo").alias("rank"))
    cover = ranked.select(*keys, F.col("e").alias("b"), F.explode(F.sequence("lo", "hi")).alias("rank"))
    same = begin.join(cover, [*keys, "rank"]).where(F.col("a") != F.col("b"))
    return both.unionByName(same.select(*keys, *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("l", "r", "yl", "yr")]))


def crossings(pieces: DataFrame, keys: list[str], tiled: bool = True) -> DataFrame:
    """keys and x of every proper crossing."""
    at = lambda s, x: sql_interp(f"{s}_l", f"{s}_r", f"{s}_yl", f"{s}_yr", x)
    p = crossing_pairs(pieces, keys, tiled).selectExpr("*", "greatest(a_l, b_l) AS _L", "least(a_r, b_r) AS _R")
    p = p.selectExpr(*keys, "_L", "_R", f"{at('a', '_L')} - {at('b', '_L')} AS _d0", f"{at('a', '_R')} - {at('b', '_R')} AS _d1").where("_d0 * _d1 < 0")
    return p.selectExpr(*keys, "_L + (_R - _L) * try_divide(_d0, _d0 - _d1) AS x")
