"""Polygon geometry as Column expressions.

Model: ``rings: array<array<struct<x:double,y:double>>>``, first ring the
outer boundary, further rings holes, first point not repeated. After
``repair_rings`` outer rings run counter-clockwise and holes clockwise, so
signed areas add up (holes subtract). Everything here is a higher-order
function on one row: no shuffle, no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from acrewise import params as P


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pt(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


# SQL text of the per-row geometry math: one expression per call keeps
# plan construction cheap (one round trip instead of hundreds) and gives
# Catalyst a single higher-order expression to optimise.
def _sql_next(r: str) -> str:
    return f"concat(slice({r}, 2, greatest(size({r}) - 1, 0)), slice({r}, 1, 1))"


def _sql_ring_area2(r: str) -> str:
    """Twice the signed area of ring ``r`` (SQL text)."""
    return (f"aggregate(zip_with({r}, {_sql_next(r)}, (a, b) -> a.x * b.y - b.x * a.y), "
            f"CAST(0 AS DOUBLE), (s, v) -> s + v)")


def rect_rings(x0, y0, x1, y1) -> Column:
    """Axis-aligned rectangle as one counter-clockwise ring."""
    if all(isinstance(c, str) for c in (x0, y0, x1, y1)):
        def p(a, b):
            return f"named_struct('x', CAST({a} AS DOUBLE), 'y', CAST({b} AS DOUBLE))"
        return F.expr(f"array(array({p(x0, y0)}, {p(x1, y0)}, {p(x1, y1)}, {p(x0, y1)}))")
    return F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1)))


def _next_points(ring: Column) -> Column:
    """The ring rotated by one point: element i is point i+1 (wrapping)."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def ring_edges(ring: Column) -> Column:
    """array<struct<a:struct<x,y>, b:struct<x,y>>> of consecutive point pairs."""
    return F.arrays_zip(ring.alias("a"), _next_points(ring).alias("b"))


def ring_signed_area(ring: Column) -> Column:
    """Shoelace sum; positive for counter-clockwise rings."""
    return F.aggregate(
        ring_edges(ring), F.lit(0.0),
        lambda acc, e: acc + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2.0


def area(rings) -> Column:
    """Polygon area (ft² for EPSG:2285), holes subtracted."""
    if isinstance(rings, str):
        return F.expr(f"aggregate(`{rings}`, CAST(0 AS DOUBLE), (acc, r) -> acc + {_sql_ring_area2('r')}) / 2")
    return F.aggregate(_c(rings), F.lit(0.0), lambda acc, r: acc + ring_signed_area(r))


def acres(rings) -> Column:
    """Area in acres."""
    return area(rings) / P.SQFT_PER_ACRE


def is_convex(rings: str) -> Column:
    """One ring that turns one way only and goes round once (its x-direction
    changes twice at most); such a ring cannot cross itself."""
    r = f"`{rings}`[0]"
    nxt, nxt2 = _sql_next(r), _sql_next(_sql_next(r))
    turn = (f"zip_with(zip_with({r}, {nxt}, (p, q) -> named_struct('p', p, 'q', q)), {nxt2}, (e, c) -> "
            "(e.p.x - e.q.x) * (c.y - e.q.y) - (e.p.y - e.q.y) * (c.x - e.q.x))")
    way = f"filter(zip_with({r}, {nxt}, (a, b) -> sign(b.x - a.x)), d -> d <> 0)"
    changes = f"size(filter(zip_with({way}, concat(slice({way}, 2, greatest(size({way}) - 1, 0)), slice({way}, 1, 1)), (a, b) -> a <> b), c -> c))"
    return F.expr(f"size(`{rings}`) = 1 AND (forall({turn}, t -> t >= 0) OR forall({turn}, t -> t <= 0)) AND {changes} <= 2")


def bbox(rings) -> Column:
    """struct<xmin,ymin,xmax,ymax> over all rings."""
    if isinstance(rings, str):
        f = f"flatten(`{rings}`)"
        return F.expr(f"named_struct('xmin', array_min(transform({f}, p -> p.x)), "
                      f"'ymin', array_min(transform({f}, p -> p.y)), "
                      f"'xmax', array_max(transform({f}, p -> p.x)), "
                      f"'ymax', array_max(transform({f}, p -> p.y)))")
    flat = F.flatten(_c(rings))
    xs = F.transform(flat, lambda p: p["x"])
    ys = F.transform(flat, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def centroid(rings) -> Column:
    """Area-weighted centroid (struct<x,y>) from ring moments."""
    if not isinstance(rings, str):
        raise TypeError("centroid takes a column name")
    def moment(which):
        return (f"aggregate(`{rings}`, CAST(0 AS DOUBLE), (acc, r) -> acc + aggregate(zip_with(r, {_sql_next('r')}, "
                f"(a, b) -> (a.{which} + b.{which}) * (a.x * b.y - b.x * a.y)), CAST(0 AS DOUBLE), (s, v) -> s + v))")
    a6 = f"(aggregate(`{rings}`, CAST(0 AS DOUBLE), (acc, r) -> acc + {_sql_ring_area2('r')}) * 3)"
    return F.expr(f"named_struct('x', try_divide({moment('x')}, {a6}), 'y', try_divide({moment('y')}, {a6}))")


def drop_zm(rings) -> Column:
    """Keep only x and y of every point."""
    return F.transform(_c(rings), lambda r: F.transform(r, lambda p: pt(p["x"], p["y"])))


def repair_parts(parts, snap: float = 1e-3) -> Column:
    """G1 on ``array<array<array<point>>>`` (polygon parts, each an outer
    ring and its holes): snap to a grid, drop a repeated closing point and
    consecutive duplicates, drop rings with fewer than three points, orient
    each part's outer ring counter-clockwise and its holes clockwise, and
    return the flat ring array. Self-crossing rings are kept as they are
    (their lobes carry winding +1 and -1, which the slab overlay resolves)."""
    def snap_pt(p):
        return pt(F.round(p["x"] / snap) * snap, F.round(p["y"] / snap) * snap)

    def clean(r):
        s_ = F.transform(r, snap_pt)
        # keep point i when it differs from point i-1 (cyclic, so a closing copy goes)
        prev = F.concat(F.slice(s_, -1, 1), F.slice(s_, 1, F.greatest(F.size(s_) - 1, F.lit(0))))
        z = F.arrays_zip(s_.alias("p"), prev.alias("q"))
        kept = F.filter(z, lambda e: (e["p"]["x"] != e["q"]["x"]) | (e["p"]["y"] != e["q"]["y"]))
        return F.transform(kept, lambda e: e["p"])

    def orient(r, i):
        want_ccw = i == 0
        is_ccw = ring_signed_area(r) > 0
        return F.when(want_ccw == is_ccw, r).otherwise(F.reverse(r))

    def fix_part(part):
        rings = F.filter(F.transform(part, clean), lambda r: F.size(r) >= 3)
        return F.transform(rings, orient)
    return F.flatten(F.transform(_c(parts), fix_part))


def repair_rings(rings, snap: float = 1e-3) -> Column:
    """G1 for one polygon: the first ring is the outer boundary, the rest
    are holes (see ``repair_parts``)."""
    return repair_parts(F.array(_c(rings)), snap)


# ----------------------------------------------------- G6: EPSG:4326 <-> 2285
# Lambert conformal conic, two standard parallels. Fixed values of the
# projection definition (NAD83 / Washington North, US survey feet):
@dataclass(frozen=True)
class Conic:
    a: float = 6378137.0                # ellipsoid
    f: float = 1 / 298.257222101
    lat1: float = 47.5
    lat2: float = 48.7333333333333
    lat0: float = 47.0
    lon0: float = -120.833333333333
    easting: float = 500000.0           # metres
    northing: float = 0.0
    foot: float = 1200.0 / 3937.0       # metres per US survey foot

    @property
    def e(self):
        return math.sqrt(2 * self.f - self.f * self.f)

    def _m(self, phi):
        return math.cos(phi) / math.sqrt(1 - (self.e * math.sin(phi)) ** 2)

    def _t(self, phi):
        s = self.e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    @property
    def n(self):
        p1, p2 = math.radians(self.lat1), math.radians(self.lat2)
        return (math.log(self._m(p1)) - math.log(self._m(p2))) / (math.log(self._t(p1)) - math.log(self._t(p2)))

    @property
    def scale(self):
        p1 = math.radians(self.lat1)
        return self.a * self._m(p1) / (self.n * self._t(p1) ** self.n)

    @property
    def r0(self):
        return self.scale * self._t(math.radians(self.lat0)) ** self.n


STATE_PLANE = Conic()


def to_state_plane(lon, lat, to: Conic = STATE_PLANE) -> Column:
    """Project degrees to feet (struct<x,y>), EPSG:2285 unless said otherwise."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon))
    s = F.sin(phi) * to.e
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), to.e / 2)
    r = F.lit(to.scale) * F.pow(t, to.n)
    theta = (lam - math.radians(to.lon0)) * to.n
    x = (r * F.sin(theta) + to.easting) / to.foot
    y = (F.lit(to.r0) - r * F.cos(theta) + to.northing) / to.foot
    return F.struct(x.alias("x"), y.alias("y"))


def to_wgs84(x, y, of: Conic = STATE_PLANE) -> Column:
    """Inverse of ``to_state_plane`` (struct<x:lon, y:lat>), fixed-point
    latitude iteration unrolled to a constant depth."""
    xm = _c(x) * of.foot - of.easting
    ym = F.lit(of.r0) - (_c(y) * of.foot - of.northing)
    r = F.sqrt(xm * xm + ym * ym) * (1 if of.n > 0 else -1)
    t = F.pow(r / of.scale, 1 / of.n)
    theta = F.atan2(xm, ym)
    phi = F.lit(math.pi / 2) - 2 * F.atan(t)
    for _ in range(6):
        s = F.sin(phi) * of.e
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.pow((1 - s) / (1 + s), of.e / 2))
    lon = F.degrees(theta / of.n) + of.lon0
    return F.struct(lon.alias("x"), F.degrees(phi).alias("y"))


def transform_rings(rings, to_srid: int) -> Column:
    """Re-project every point of a ring array between 4326 and 2285."""
    if to_srid == P.SRID_STATE_PLANE:
        f = lambda p: to_state_plane(p["x"], p["y"])
    elif to_srid == P.SRID_WGS84:
        f = lambda p: to_wgs84(p["x"], p["y"])         # noqa: E731
    else:
        raise ValueError("only EPSG:4326 and EPSG:2285 are supported")
    return F.transform(_c(rings), lambda r: F.transform(r, f))
