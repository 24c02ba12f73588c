"""Geometry as plain Spark values.

A geometry is a struct (gtype, parts, xmin, ymin, xmax, ymax): parts of rings of points.
A point is one part of one ring of one point; a line one part of one ring; a polygon one
part of an outer ring and its holes, each closed. Coordinates are planar metres (UTM) or
degrees by column-name convention. Every function here is a Column expression except the
few that need a sweep over whole geometries, which are Arrow functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanspark.functions.validity import st_is_valid  # noqa: F401

PARTS = "array<array<array<struct<x:double,y:double>>>>"
GEOMETRY = f"struct<gtype:string,parts:{PARTS},xmin:double,ymin:double,xmax:double,ymax:double>"

# WGS84 and UTM: fixed values.
A, FLATTENING, UTM_SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
E2 = FLATTENING * (2 - FLATTENING)


def _c(value: Column | str | float) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(float(value))


def xy(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def geometry(gtype: Column | str, parts: Column) -> Column:
    """A geometry from its parts, with bounds."""
    gtype = F.lit(gtype) if isinstance(gtype, str) else gtype
    points = F.flatten(F.flatten(parts))
    low, high = (lambda k: F.array_min(F.transform(points, lambda p: p[k]))), (lambda k: F.array_max(F.transform(points, lambda p: p[k])))
    return F.struct(gtype.alias("gtype"), parts.alias("parts"), low("x").alias("xmin"), low("y").alias("ymin"), high("x").alias("xmax"), high("y").alias("ymax"))


def point(x, y) -> Column:
    x, y = _c(x).cast("double"), _c(y).cast("double")
    return F.struct(F.lit("POINT").alias("gtype"), F.array(F.array(F.array(xy(x, y)))).alias("parts"), x.alias("xmin"), y.alias("ymin"), x.alias("xmax"), y.alias("ymax"))


def line(points: Column) -> Column:
    return geometry("LINESTRING", F.array(F.array(points)))


def rectangle(x0, y0, x1, y1) -> Column:
    x0, y0, x1, y1 = (_c(v).cast("double") for v in (x0, y0, x1, y1))
    ring = F.array(xy(x0, y0), xy(x1, y0), xy(x1, y1), xy(x0, y1), xy(x0, y0))
    return F.struct(F.lit("POLYGON").alias("gtype"), F.array(F.array(ring)).alias("parts"), x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))


def polygon(rings: Column) -> Column:
    return geometry("POLYGON", F.array(rings))


def multi(gtype: str, parts: Column) -> Column:
    return geometry(gtype, parts)


# Families and checks


def family(g: Column) -> Column:
    """point, line or polygon; a MULTILINESTRING counts as polygon in rule scopes, as the rules expect."""
    return F.when(g["gtype"] == "POINT", "point").when(g["gtype"] == "LINESTRING", "line").when(g["gtype"].isNotNull(), "polygon")


def is_areal(g: Column) -> Column:
    return g["gtype"].isin("POLYGON", "MULTIPOLYGON")


def is_empty(g: Column) -> Column:
    return F.size(F.flatten(F.flatten(g["parts"]))) <= 0


def segments(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _cross(s: Column) -> Column:
    return s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area, relative to the first point so that large coordinates lose no digits."""
    o = ring[0]
    near = F.transform(ring, lambda p: F.struct((p["x"] - o["x"]).alias("x"), (p["y"] - o["y"]).alias("y")))
    return F.abs(F.aggregate(segments(near), F.lit(0.0), lambda t, s: t + _cross(s))) / 2


def st_area(g: Column) -> Column:
    """Area of a (multi)polygon, outer rings less holes; 0 for anything else."""
    part = lambda p: F.aggregate(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), ring_area(p[0]), lambda t, hole: t - ring_area(hole))
    return F.when(is_areal(g), F.aggregate(g["parts"], F.lit(0.0), lambda t, p: t + part(p))).otherwise(0.0)


# Distances


def _segment_distance2(s: Column, x: Column, y: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    px, py = x - s["a"]["x"], y - s["a"]["y"]
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.least(F.greatest((px * dx + py * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    ex, ey = px - t * dx, py - t * dy
    return ex * ex + ey * ey


def segment_distance(s: Column, t: Column) -> Column:
    """Distance of two segments struct(a, b): 0 where they cross or touch, else the least from an end to the other."""
    side = lambda o, p: (o["b"]["x"] - o["a"]["x"]) * (p["y"] - o["a"]["y"]) - (o["b"]["y"] - o["a"]["y"]) * (p["x"] - o["a"]["x"])
    apart = lambda o, p: ((side(o, p["a"]) > 0) & (side(o, p["b"]) < 0)) | ((side(o, p["a"]) < 0) & (side(o, p["b"]) > 0))
    ends = [_segment_distance2(o, p[e]["x"], p[e]["y"]) for o, p in ((s, t), (t, s)) for e in "ab"]
    return F.when(apart(s, t) & apart(t, s), 0.0).otherwise(F.sqrt(F.least(*ends)))


def _inside(part: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings of a part."""
    crosses = lambda s: ((s["a"]["y"] > y) != (s["b"]["y"] > y)) & (x < (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])
    count = F.aggregate(F.flatten(F.transform(part, segments)), F.lit(0), lambda n, s: n + F.when(crosses(s), 1).otherwise(0))
    return count % 2 == 1


def st_distance(g: Column, x, y) -> Column:
    """Planar distance of a point to the nearest place of a geometry; 0 inside a polygon."""
    x, y = _c(x), _c(y)
    ring = lambda r: F.when(F.size(r) == 1, F.pow(r[0]["x"] - x, 2.0) + F.pow(r[0]["y"] - y, 2.0)).otherwise(F.array_min(F.transform(segments(r), lambda s: _segment_distance2(s, x, y))))
    border = F.array_min(F.transform(F.flatten(g["parts"]), ring))
    within = is_areal(g) & F.exists(g["parts"], lambda p: _inside(p, x, y))
    return F.when(within, 0.0).otherwise(F.sqrt(border))


def box_distance(g: Column, x, y) -> Column:
    """Distance to the bounds; exact for points and axis-parallel rectangles, never more than st_distance."""
    x, y = _c(x), _c(y)
    dx = F.greatest(g["xmin"] - x, x - g["xmax"], F.lit(0.0))
    dy = F.greatest(g["ymin"] - y, y - g["ymax"], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def st_dwithin(g: Column, x, y, r) -> Column:
    """Inclusive; the bounds are looked at first."""
    return F.when(box_distance(g, x, y) <= _c(r), st_distance(g, x, y) <= _c(r)).otherwise(False)


def st_covers(g: Column, x, y) -> Column:
    """Whether a polygon covers a point, its border included."""
    x, y = _c(x), _c(y)
    near = (x >= g["xmin"]) & (x <= g["xmax"]) & (y >= g["ymin"]) & (y <= g["ymax"])
    on = F.exists(F.flatten(F.transform(F.flatten(g["parts"]), segments)), lambda s: _segment_distance2(s, x, y) == 0)
    return F.when(near & is_areal(g), F.exists(g["parts"], lambda p: _inside(p, x, y)) | on).otherwise(False)


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """(east, north) on WGS84 at a latitude, by the radii of curvature."""
    w = 1 - E2 * F.pow(F.sin(F.radians(lat)), 2.0)
    return F.radians(F.lit(1.0)) * F.cos(F.radians(lat)) * A / F.sqrt(w), F.radians(F.lit(1.0)) * (A * (1 - E2)) / F.pow(w, 1.5)


def geo_distance_m(lon1, lat1, lon2, lat2) -> Column:
    """Metres on WGS84 by the local radii of curvature; under a millimetre off within 100 m."""
    lon1, lat1, lon2, lat2 = (_c(v) for v in (lon1, lat1, lon2, lat2))
    east, north = metres_per_degree((lat1 + lat2) / 2)
    return F.sqrt(F.pow((lat2 - lat1) * north, 2.0) + F.pow((lon2 - lon1) * east, 2.0))


# Boxes


def bbox_overlaps(a: Column, b: Column) -> Column:
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def extent(g: Column) -> list[Column]:
    """Aggregates: the bounds of a group."""
    return [F.min(g["xmin"]).alias("xmin"), F.min(g["ymin"]).alias("ymin"), F.max(g["xmax"]).alias("xmax"), F.max(g["ymax"]).alias("ymax")]


# Reference systems: Krüger series to the third order, under a millimetre within a zone.


def _series() -> tuple[float, list[float], list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return radius, alpha, beta


def to_utm(lon, lat, zone: int = 36) -> tuple[Column, Column]:
    """(easting, northing) of northern degrees."""
    lon, lat = _c(lon), _c(lat)
    radius, alpha, _ = _series()
    e = math.sqrt(E2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EASTING + UTM_SCALE * radius * east, UTM_SCALE * radius * north


def from_utm(x, y, zone: int = 36) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees."""
    x, y = _c(x), _c(y)
    radius, _, beta = _series()
    xi0, eta0 = y / (UTM_SCALE * radius), (x - FALSE_EASTING) / (UTM_SCALE * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    n = FLATTENING / (2 - FLATTENING)
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta), F.cos(xi))
    return F.degrees(lam) + (zone * 6 - 183), F.degrees(phi)


def to_mercator(lon, lat) -> tuple[Column, Column]:
    lon, lat = _c(lon), _c(lat)
    return A * F.radians(lon), A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def map_coordinates(g: Column, convert) -> Column:
    """A geometry with every point converted by ``convert(x, y) -> (x, y)``."""

    def moved(p: Column) -> Column:
        x, y = convert(p["x"], p["y"])
        return xy(x, y)

    return geometry(g["gtype"], F.transform(g["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, moved))))


# Rewrites and text


def boundary(g: Column) -> Column:
    """The rings of a polygon as lines."""
    return geometry("MULTILINESTRING", F.transform(F.flatten(g["parts"]), lambda ring: F.array(ring)))


def collect_lines(g: Column) -> Column:
    """Aggregate: all lines of a group as one MULTILINESTRING."""
    return F.flatten(F.collect_list(g["parts"]))


def canonical(g: Column) -> Column:
    """Text that is equal for equal shapes: each closed ring starts at its least point."""

    def turned(ring: Column) -> Column:
        open_ = F.slice(ring, 1, F.size(ring) - 1)
        at = F.array_position(open_, F.array_min(open_)).cast("int")
        closed = (F.size(ring) > 3) & (ring[0] == F.element_at(ring, -1))
        rolled = F.concat(F.slice(open_, at, F.size(open_)), F.slice(open_, 1, F.greatest(at - 1, F.lit(0))))
        return F.when(closed, rolled).otherwise(ring)

    return F.to_json(F.struct(g["gtype"].alias("t"), F.array_sort(F.transform(g["parts"], lambda p: F.transform(p, turned))).alias("p")))


def st_equals(a: Column, b: Column) -> Column:
    return canonical(a).eqNullSafe(canonical(b))


def to_geojson(g: Column, digits: int = 6) -> Column:
    """GeoJSON text with rounded coordinates."""
    pair = lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))
    rings = F.transform(g["parts"], lambda part: F.transform(part, lambda ring: F.transform(ring, pair)))
    kinds = {"POINT": ("Point", rings[0][0][0]), "LINESTRING": ("LineString", rings[0][0]), "POLYGON": ("Polygon", rings[0]), "MULTIPOLYGON": ("MultiPolygon", rings), "MULTILINESTRING": ("MultiLineString", F.transform(rings, lambda p: p[0]))}
    out = F.lit(None).cast("string")
    for gtype, (name, body) in kinds.items():
        out = F.when(g["gtype"] == gtype, F.to_json(F.struct(F.lit(name).alias("type"), body.alias("coordinates")))).otherwise(out)
    return out


# Influence kernels


def k_quartic(d, r) -> Column:
    d, r = _c(d), _c(r)
    return F.when(d < r, F.pow(1 - F.pow(d / r, 2.0), 2.0)).otherwise(0.0)


def k_half(d, half) -> Column:
    """2 ** -(d / half) ** 2: one half at the half distance."""
    return F.exp(-math.log(2) * F.pow(_c(d) / _c(half), 2.0))


def size_quality(area, reference, least) -> Column:
    return _c(least) + (1 - _c(least)) * (1 - F.exp(-_c(area) / _c(reference)))


def bounded_bonus(primary, total, cap, saturation) -> Column:
    primary, total = _c(primary), _c(total)
    return primary + (1 - primary) * cap * (1 - F.exp(-F.greatest(total - primary, F.lit(0.0)) / saturation))


# Whole-geometry sweeps, vectorised per batch


def arrow_rings(parts: pa.ListArray) -> Iterator[list[list[np.ndarray]]]:
    """Parts of rings of points of each geometry of an Arrow column; a null one has none."""
    levels = [parts, parts.flatten(), parts.flatten().flatten()]
    part_at, ring_at, point_at = (np.r_[0, np.cumsum(np.nan_to_num(a.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))] for a in levels)
    points = levels[2].flatten()
    xy = np.column_stack([points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)])
    for g in range(len(parts)):
        yield [[xy[point_at[r] : point_at[r + 1]] for r in range(ring_at[p], ring_at[p + 1])] for p in range(part_at[g], part_at[g + 1])]


def _edges(parts: list[list[np.ndarray]]) -> np.ndarray:
    found = [np.concatenate([r[:-1], r[1:]], axis=1) if len(r) > 1 else np.concatenate([r, r], axis=1) for part in parts for r in part]
    return np.concatenate(found) if found else np.zeros((0, 4))


def _holds(part: list[np.ndarray], x: float, y: float) -> bool:
    odd = False
    for r in part:
        a, b = r[:-1], r[1:]
        up = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        odd ^= bool((up & (x < at)).sum() % 2)
    return odd


def _meet(p: np.ndarray, q: np.ndarray, tolerance: float = 1e-12) -> bool:
    """Whether any segment of p touches any of q."""
    if not len(p) or not len(q):
        return False
    a, b, c, d = p[:, None, :2], p[:, None, 2:], q[None, :, :2], q[None, :, 2:]
    turn = lambda o, u, v: (u[..., 0] - o[..., 0]) * (v[..., 1] - o[..., 1]) - (u[..., 1] - o[..., 1]) * (v[..., 0] - o[..., 0])
    t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    overlap = (np.maximum(np.minimum(a, b), np.minimum(c, d)) <= np.minimum(np.maximum(a, b), np.maximum(c, d)) + tolerance).all(axis=-1)
    return bool((overlap & (t1 * t2 <= tolerance) & (t3 * t4 <= tolerance)).any())


def _near(edges: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The edges whose bounds meet the bounds of the others."""
    if not len(edges) or not len(other):
        return edges[:0]
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    return edges[(low <= other.reshape(-1, 2).max(axis=0)).all(axis=1) & (high >= other.reshape(-1, 2).min(axis=0)).all(axis=1)]


def _intersect(p: list[list[np.ndarray]], p_kind: str, q: list[list[np.ndarray]], q_kind: str) -> bool:
    pe, qe = _edges(p), _edges(q)
    if _meet(_near(pe, qe), _near(qe, pe)):
        return True
    for own, kind, other in ((p, p_kind, q), (q, q_kind, p)):
        if "POLYGON" in kind and any(_holds(part, *other_part[0][0]) for part in own for other_part in other):
            return True
    return False


@F.arrow_udf(T.BooleanType())
def _intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    kinds = zip(a.field("gtype").to_pylist(), b.field("gtype").to_pylist(), strict=True)
    rings = zip(arrow_rings(a.field("parts")), arrow_rings(b.field("parts")), strict=True)
    return pa.array([bool(k and m and _intersect(p, k, q, m)) for (k, m), (p, q) in zip(kinds, rings, strict=True)], pa.bool_())


def st_intersects(a: Column, b: Column) -> Column:
    """Any two geometries share a place. Call it behind ``bbox_overlaps``, as ``intersects`` does."""
    return _intersects(a, b)


def intersects_box(g: Column, x0, y0, x1, y1) -> Column:
    """Whether a geometry meets an axis-parallel box, in Column arithmetic (Liang-Barsky clip per segment)."""
    x0, y0, x1, y1 = (_c(v) for v in (x0, y0, x1, y1))

    def clipped(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        low, high = F.lit(0.0), F.lit(1.0)
        ok = F.lit(True)
        for p, d, lo, hi in ((s["a"]["x"], dx, x0, x1), (s["a"]["y"], dy, y0, y1)):
            ta, tb = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
            ok = ok & F.when(d == 0, (p >= lo) & (p <= hi)).otherwise(True)
            low = F.when(d == 0, low).otherwise(F.greatest(low, F.least(ta, tb)))
            high = F.when(d == 0, high).otherwise(F.least(high, F.greatest(ta, tb)))
        return ok & (low <= high)

    near = (g["xmin"] <= x1) & (g["xmax"] >= x0) & (g["ymin"] <= y1) & (g["ymax"] >= y0)
    corner = is_areal(g) & F.exists(g["parts"], lambda p: _inside(p, x0, y0))
    alone = F.exists(F.flatten(g["parts"]), lambda r: (F.size(r) == 1) & (r[0]["x"] >= x0) & (r[0]["x"] <= x1) & (r[0]["y"] >= y0) & (r[0]["y"] <= y1))
    sides = F.exists(F.flatten(F.transform(F.flatten(g["parts"]), segments)), clipped)
    return F.when(near, alone | sides | corner).otherwise(False)


def _representative(gtype: str, rings: list[list[np.ndarray]]) -> dict:
    if gtype == "LINESTRING" or gtype == "MULTILINESTRING":
        r = rings[0][0]
        step = np.hypot(*np.diff(r, axis=0).T)
        if not step.sum():
            return {"x": r[0, 0], "y": r[0, 1]}
        half, at = step.sum() / 2, np.concatenate([[0], np.cumsum(step)])
        k = min(int(np.searchsorted(at, half, "right")) - 1, len(step) - 1)
        t = (half - at[k]) / step[k] if step[k] else 0.0
        return {"x": r[k, 0] + t * (r[k + 1, 0] - r[k, 0]), "y": r[k, 1] + t * (r[k + 1, 1] - r[k, 1])}
    if "POLYGON" in gtype:
        part = max(rings, key=lambda p: np.ptp(p[0][:, 0]) * np.ptp(p[0][:, 1]))
        ys = np.unique(np.concatenate([r[:, 1] for r in part]))
        mid = (ys[0] + ys[-1]) / 2
        if (ys == mid).any():
            k = int(np.searchsorted(ys, mid))
            mid = (ys[k] + ys[k + 1]) / 2 if k + 1 < len(ys) else mid
        cuts = []
        for r in part:
            a, b = r[:-1], r[1:]
            up = (a[:, 1] > mid) != (b[:, 1] > mid)
            cuts += ((b[up, 0] - a[up, 0]) * (mid - a[up, 1]) / (b[up, 1] - a[up, 1]) + a[up, 0]).tolist()
        cuts.sort()
        spans = [(cuts[i + 1] - cuts[i], cuts[i], cuts[i + 1]) for i in range(0, len(cuts) - 1, 2)]
        _, x0, x1 = max(spans)
        return {"x": (x0 + x1) / 2, "y": mid}
    return {"x": rings[0][0][0, 0], "y": rings[0][0][0, 1]}


@F.arrow_udf(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
def representative_point(g: pa.Array) -> pa.Array:
    """The point itself, the middle of a line, or a point inside a polygon's widest scan line."""
    found = [_representative(t, p) if t and p else None for t, p in zip(g.field("gtype").to_pylist(), arrow_rings(g.field("parts")), strict=True)]
    return pa.array(found, pa.struct([("x", pa.float64()), ("y", pa.float64())]))
