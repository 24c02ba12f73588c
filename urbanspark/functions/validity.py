"""Validity of whole geometries by one sorted sweep over all sides of an Arrow batch.

A polygon is valid when its rings are closed, have area and four points, cross neither
themselves nor each other, share no stretch, touch another ring in one point at most and
their own in none, its holes lie in its shell and in no other hole, and parts don't
overlap. A line needs two different points, a point one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of sides that a sweep looks at together.
PAIRS = 1 << 20


def _turn(ox, oy, px, py, qx, qy):
    return (px - ox) * (qy - oy) - (py - oy) * (qx - ox)


def _sweep(sides: np.ndarray, owner: np.ndarray):
    """Index pairs (i, j) of sides of one owner whose bounds meet, block by block."""
    low, high = np.minimum(sides[:, :2], sides[:, 2:]), np.maximum(sides[:, :2], sides[:, 2:])
    order = np.lexsort((low[:, 0], owner))
    low, high, owner = low[order], high[order], owner[order]
    # Where the sides stop that begin before this one ends, in its owner: a merge of both sorted orders.
    n = len(order)
    by_end = np.lexsort((np.concatenate([np.zeros(n), np.ones(n)]), np.concatenate([low[:, 0], high[:, 0]]), np.concatenate([owner, owner])))
    begun = np.cumsum(by_end < n)
    stop = np.empty(n, np.int64)
    ends = by_end >= n
    stop[by_end[ends] - n] = begun[ends]
    count = stop - np.arange(n) - 1
    edge = np.concatenate([[0], np.cumsum(count)])
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(edge, edge[first] + PAIRS, "right")) - 1)
        own = count[first:last]
        i = np.repeat(np.arange(first, last), own)
        j = np.arange(len(i)) - np.repeat(edge[first:last] - edge[first], own) + i + 1
        meet = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield order[i[meet]], order[j[meet]]
        first = last


def _touches(sides: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of sides: whether they cross or share a stretch, whether they touch, and where."""
    a, b, c, d = sides[i, :2], sides[i, 2:], sides[j, :2], sides[j, 2:]
    t = [_turn(*p.T, *q.T, *r.T) for p, q, r in ((a, b, c), (a, b, d), (c, d, a), (c, d, b))]
    cross = (t[0] * t[1] < 0) & (t[2] * t[3] < 0)
    flat = (t[0] == 0) & (t[1] == 0)
    axis = (np.abs(b[:, 0] - a[:, 0]) < np.abs(b[:, 1] - a[:, 1])).astype(int)
    rows = np.arange(len(i))
    on = [v[rows, axis] for v in (a, b, c, d)]
    shared = np.minimum(np.maximum(on[0], on[1]), np.maximum(on[2], on[3])) - np.maximum(np.minimum(on[0], on[1]), np.minimum(on[2], on[3]))
    between = lambda p, q, r: (np.minimum(p, q) <= r).all(axis=1) & (r <= np.maximum(p, q)).all(axis=1)
    at = np.full((len(i), 2), np.nan)
    touch = np.zeros(len(i), bool)
    for turn, p, q, r in ((t[0], a, b, c), (t[1], a, b, d), (t[2], c, d, a), (t[3], c, d, b)):
        here = (turn == 0) & between(p, q, r)
        at[here], touch = r[here], touch | here
    return cross | (flat & (shared > 0)), touch, at


def _inside(ring: np.ndarray, points: np.ndarray) -> np.ndarray:
    a, b = ring[:-1], ring[1:]
    x, y = points[:, :1], points[:, 1:]
    up = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return (up & (x < cut)).sum(axis=1) % 2 == 1


def _within(ring: np.ndarray, other: np.ndarray) -> bool:
    """Whether a ring that crosses another nowhere lies in it; a point on the other's border decides nothing, so more are asked."""
    middles = (other[:-1] + other[1:]) / 2
    probes = np.concatenate([other[:-1], middles])
    # of points that aren't on the border all agree; the few that are can't outvote them
    return bool(_inside(ring, probes).mean() > 0.5)


def _parts_ok(rings: list[np.ndarray], part: np.ndarray) -> bool:
    """Holes in their shell and outside each other, parts outside each other."""
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    end = np.r_[first[1:], len(rings)]
    for s, e in zip(first, end, strict=True):
        for k in range(s + 1, e):
            if not _within(rings[s], rings[k]) or any(_within(rings[o], rings[k]) for o in range(s + 1, e) if o != k):
                return False
    for s, e in zip(first, end, strict=True):
        for t, u in zip(first, end, strict=True):
            if s != t and _within(rings[s], rings[t]) and not any(_within(rings[h], rings[t]) for h in range(s + 1, e)):
                return False
    return True


def check(gtype: list[str | None], parts: pa.ListArray) -> np.ndarray:
    """Validity of each geometry of a batch; a null geometry isn't valid."""
    n = len(parts)
    areal = np.array([g in ("POLYGON", "MULTIPOLYGON") for g in gtype], bool)
    linear = np.array([g in ("LINESTRING", "MULTILINESTRING") for g in gtype], bool)
    rings = parts.flatten()
    ring_list = rings.flatten()
    points = ring_list.flatten()
    x, y = (points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    sizes = lambda a: np.nan_to_num(np.asarray(a.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    part_geom = np.repeat(np.arange(n), sizes(parts))
    ring_part = np.repeat(np.arange(len(part_geom)), sizes(rings))
    ring_geom = part_geom[ring_part]
    size = sizes(ring_list)
    start = np.cumsum(size) - size
    ok = np.bincount(ring_geom, minlength=n)[:n] > 0 if len(ring_geom) else np.zeros(n, bool)
    ok &= np.array([g is not None for g in gtype], bool)
    finite = np.isfinite(x) & np.isfinite(y)
    ok[ring_geom[np.repeat(np.arange(len(size)), size)[~finite]]] = False
    ok[ring_geom[size == 0]] = False
    point_ring = np.repeat(np.arange(len(size)), size)
    if len(x):
        full = np.flatnonzero(size > 0)
        last = start[full] + size[full] - 1
        closed = (x[start[full]] == x[last]) & (y[start[full]] == y[last])
        ox, oy = x - x[start[point_ring]], y - y[start[point_ring]]
        turn = np.zeros(len(x))
        turn[:-1] = ox[:-1] * oy[1:] - ox[1:] * oy[:-1]
        turn[last] = 0
        area = np.add.reduceat(turn, start[full])
        bad = areal[ring_geom[full]] & ((size[full] < 4) | ~closed | (area == 0))
        ok[ring_geom[full][bad]] = False
        moved = np.add.reduceat(((ox != 0) | (oy != 0)).astype(int), start[full]) > 0
        ok[ring_geom[full][linear[ring_geom[full]] & ~moved]] = False
    # the sweep: sides of areal geometries that are well so far, without repeated points
    at = np.flatnonzero((point_ring[:-1] == point_ring[1:]) & ((x[:-1] != x[1:]) | (y[:-1] != y[1:]))) if len(x) > 1 else np.zeros(0, np.int64)
    at = at[(areal & ok)[ring_geom[point_ring[at]]]]
    if not len(at):
        return ok
    sides = np.column_stack([x[at], y[at], x[at + 1], y[at + 1]])
    ring = point_ring[at]
    owner = ring_geom[ring]
    begins = np.r_[True, ring[1:] != ring[:-1]]
    place = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
    count = np.bincount(ring, minlength=len(size))
    meetings: list[np.ndarray] = []
    for i, j in _sweep(sides, owner):
        cross, touch, where = _touches(sides, i, j)
        same = ring[i] == ring[j]
        step = np.abs(place[i] - place[j])
        neighbours = same & ((step == 1) | (step == count[ring[i]] - 1))
        # neighbours share their common end; they may not turn back over each other
        ok[owner[i[cross]]] = False
        ok[owner[i[touch & same & ~neighbours]]] = False
        other = touch & ~same & ~cross
        if other.any():
            pair = np.sort(np.column_stack([ring[i[other]], ring[j[other]]]), axis=1)
            meetings.append(np.column_stack([pair, where[other]]))
    if meetings:
        places = np.unique(np.concatenate(meetings), axis=0)
        pairs, times = np.unique(places[:, :2], axis=0, return_counts=True)
        ok[ring_geom[pairs[times > 1, 0].astype(int)]] = False
    for g in np.flatnonzero(ok & areal & (np.bincount(ring_geom, minlength=n) > 1)):
        own = np.flatnonzero(ring_geom == g) if n < 64 else np.arange(np.searchsorted(ring_geom, g), np.searchsorted(ring_geom, g, "right"))
        ok[g] = _parts_ok([np.column_stack([x[start[r] : start[r] + size[r]], y[start[r] : start[r] + size[r]]]) for r in own], ring_part[own])
    return ok


def ring_crosses(ring: np.ndarray) -> bool:
    """Whether sides of a closed ring meet elsewhere than at the ends that neighbours share."""
    ring = ring[np.r_[True, (ring[1:] != ring[:-1]).any(axis=1)]]
    sides = np.column_stack([ring[:-1], ring[1:]])
    n = len(sides)
    for i, j in _sweep(sides, np.zeros(n, np.int64)):
        cross, touch, _ = _touches(sides, i, j)
        step = np.abs(i - j)
        if cross.any() or (touch & (step > 1) & (step < n - 1)).any():
            return True
    return False


@F.arrow_udf(T.BooleanType())
def _swept(g: pa.Array) -> pa.Array:
    there = g.is_valid().to_numpy(zero_copy_only=False)
    kinds = g.field("gtype").to_pylist()
    kinds = [k if t else None for k, t in zip(kinds, there, strict=True)]
    return pa.array(check(kinds, g.field("parts")) & there)


def st_is_valid(g: Column) -> Column:
    """Whether a geometry is valid; null is not.

    Axis-parallel rectangles, points and two-point lines are told by columns alone; only the others go through the sweep.
    """
    part = F.get(g["parts"], 0)
    ring = F.get(part, 0)
    one = (F.size(g["parts"]) == 1) & (F.size(part) == 1)
    at = lambda i, k: F.get(ring, i)[k]
    corner = lambda i, x, y: (at(i, "x") == g[x]) & (at(i, "y") == g[y])
    flat = (g["xmin"] < g["xmax"]) & (g["ymin"] < g["ymax"])
    rectangle = (g["gtype"] == "POLYGON") & one & (F.size(ring) == 5) & flat & corner(0, "xmin", "ymin") & corner(1, "xmax", "ymin") & corner(2, "xmax", "ymax") & corner(3, "xmin", "ymax") & corner(4, "xmin", "ymin")
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    point = (g["gtype"] == "POINT") & one & (F.size(ring) == 1) & finite(at(0, "x")) & finite(at(0, "y"))
    plain = F.coalesce(rectangle | point, F.lit(False))
    return plain | F.coalesce(_swept(F.when(~plain, g)), F.lit(False))
