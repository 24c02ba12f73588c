"""Polygons as grid cells, so that points and shapes meet any number of polygons by equal cells.

Each part of a polygon is cut into the cells of a square grid whose side, a power of two,
follows from its extent: some 16 cells across, 18 at most. A cell that no side touches is
full or left out; the others are partial and carry the sides of their row that lie at or right
of them, which is all that the even-odd rule asks about a point of the cell. So a point
in a full cell needs no test and one in a partial cell few sides, and no polygon is ever
sent whole to a point.

The levels in use are few: one for each doubling of the extent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.functions.session import broadcast_if_small, checkpointed

ACROSS = 16
#: Covering cells up to this many (some hundred bytes each, with their sides) are broadcast; more are joined by shuffle.
BROADCAST_CELLS = 20_000
#: Level of shapes without extent.
LEAST = -40
SIDES = "array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"


def level_of(extent: np.ndarray, across: int = ACROSS) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(np.ceil(np.log2(extent / across)), LEAST).astype(np.int32)


def _row_ranges(sides: np.ndarray, x0: float, y0: float, nx: int, ny: int, s: float, slack: float) -> tuple[np.ndarray, ...]:
    """(side, column, first row, last row) of the cells that each side touches."""
    ax, ay, bx, by = sides.T
    left, right = np.minimum(ax, bx), np.maximum(ax, bx)
    first = np.clip(np.floor((left - slack - x0) / s).astype(np.int64), 0, nx - 1)
    last = np.clip(np.floor((right + slack - x0) / s).astype(np.int64), 0, nx - 1)
    n = last - first + 1
    side = np.repeat(np.arange(len(sides)), n)
    column = np.arange(len(side)) - np.repeat(np.cumsum(n) - n, n) + first[side]
    dx = bx - ax
    with np.errstate(divide="ignore", invalid="ignore"):
        at = lambda x: np.where(dx[side] != 0, ay[side] + (np.clip(x, left[side], right[side]) - ax[side]) / dx[side] * (by - ay)[side], np.nan)
        u, v = at(x0 + column * s - slack), at(x0 + (column + 1) * s + slack)
    upright = dx[side] == 0
    u, v = np.where(upright, ay[side], u), np.where(upright, by[side], v)
    low = np.clip(np.floor((np.minimum(u, v) - slack - y0) / s).astype(np.int64), 0, ny - 1)
    high = np.clip(np.floor((np.maximum(u, v) + slack - y0) / s).astype(np.int64), 0, ny - 1)
    return side, column, low, high


def cells_of(sides: np.ndarray) -> tuple[int, list[tuple[int, int, bool, np.ndarray]]]:
    """The level of a part and its cells: (cx, cy, full, sides)."""
    xs, ys = sides[:, [0, 2]], sides[:, [1, 3]]
    level = int(level_of(np.array(max(np.ptp(xs), np.ptp(ys)))))
    s = 2.0**level
    slack = 1e-12 * max(1.0, float(np.abs(sides).max()))
    cx, cy = int(np.floor((xs.min() - slack) / s)), int(np.floor((ys.min() - slack) / s))
    nx, ny = int(np.floor((xs.max() + slack) / s)) - cx + 1, int(np.floor((ys.max() + slack) / s)) - cy + 1
    x0, y0 = cx * s, cy * s
    _, column, low, high = _row_ranges(sides, x0, y0, nx, ny, s, slack)
    edge = np.zeros((nx, ny + 1), np.int64)
    np.add.at(edge, (column, low), 1)
    np.add.at(edge, (column, high + 1), -1)
    touched = np.cumsum(edge, axis=1)[:, :ny] > 0
    ax, ay, bx, by = sides.T
    out = []
    for j in range(ny):
        y = y0 + (j + 0.5) * s
        up = (ay > y) != (by > y)
        cross = np.sort((bx[up] - ax[up]) * (y - ay[up]) / (by[up] - ay[up]) + ax[up])
        odd = (len(cross) - np.searchsorted(cross, x0 + (np.arange(nx) + 0.5) * s, "right")) % 2 == 1
        own = sides[(np.minimum(ay, by) <= y0 + (j + 1) * s + slack) & (np.maximum(ay, by) >= y0 + j * s - slack)]
        right = np.maximum(own[:, 0], own[:, 2])
        for i in range(nx):
            if touched[i, j]:
                out.append((cx + i, cy + j, False, own[right >= x0 + i * s - slack]))
            elif odd[i]:
                out.append((cx + i, cy + j, True, own[:0]))
    return level, out


def ring_sides(rings: pa.ListArray) -> Iterator[np.ndarray]:
    """The sides (ax, ay, bx, by) of each row's rings, found over the whole batch at once."""
    ring_at = rings.offsets.to_numpy()
    flat = rings.values
    point_at = flat.offsets.to_numpy()
    x, y = (flat.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    side = np.column_stack([x[:-1], y[:-1], x[1:], y[1:]]) if len(x) > 1 else np.zeros((0, 4))
    inner = np.ones(max(len(x) - 1, 0), bool)
    cut = point_at[1:-1]
    inner[cut[(cut > 0) & (cut < len(x))] - 1] = False
    for a, b in zip(ring_at[:-1], ring_at[1:], strict=True):
        p, q = point_at[a], point_at[b]
        yield side[p : max(q - 1, p)][inner[p : max(q - 1, p)]]


def _side_list(blocks: list[np.ndarray]) -> pa.ListArray:
    every = np.concatenate(blocks) if blocks else np.zeros((0, 4))
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int32)
    end = lambda i: pa.StructArray.from_arrays([pa.array(every[:, i].copy()), pa.array(every[:, i + 1].copy())], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([end(0), end(2)], ["a", "b"]))


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [c for c in batch.schema.names if c != "__rings"]
        rings = batch.column("__rings")
        for start in range(0, batch.num_rows, 64):
            of, level, cx, cy, full, sides = [], [], [], [], [], []
            part = rings.slice(start, 64)
            part = pa.concat_arrays([part])  # its offsets begin at 0
            for k, own in enumerate(ring_sides(part)):
                if not len(own):
                    continue
                own_level, cells = cells_of(own)
                for i, j, whole, near in cells:
                    of.append(start + k)
                    level.append(own_level)
                    cx.append(i)
                    cy.append(j)
                    full.append(whole)
                    sides.append(near)
            taken = [batch.column(k).take(pa.array(of, pa.int64())) for k in keys]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(full, pa.bool_()), _side_list(sides)], [*keys, "level", "cx", "cy", "full", "sides"])


def covering(polygons: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """(keys, level, cx, cy, full, sides) of the cells of each part of each (multi)polygon; written once."""
    g = F.col(geom)
    finite = (F.abs(g["xmin"]) < 1e15) & (F.abs(g["ymin"]) < 1e15) & (F.abs(g["xmax"]) < 1e15) & (F.abs(g["ymax"]) < 1e15)
    parts = polygons.where(G.is_areal(g) & finite).select(*keys, F.explode(g["parts"]).alias("__rings"))
    types = {f.name: f.dataType.simpleString() for f in parts.schema}
    return checkpointed(parts.mapInArrow(_cover, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "level int, cx long, cy long, full boolean", f"sides {SIDES}"])))


def levels_of(cover: DataFrame) -> list[int]:
    """The levels in use: one for each doubling of the extent, so a short list."""
    return sorted(r["level"] for r in cover.select("level").distinct().collect())


def cell_index(v: Column, level: Column | int) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(float(level)))).cast("long")


def holds(x: Column, y: Column, sides: str = "sides") -> Column:
    """Whether a cell of a covering covers a point that lies in it, the border included."""
    s = F.col(sides)
    crosses = lambda v: ((v["a"]["y"] > y) != (v["b"]["y"] > y)) & (x < (v["b"]["x"] - v["a"]["x"]) * (y - v["a"]["y"]) / (v["b"]["y"] - v["a"]["y"]) + v["a"]["x"])
    odd = F.aggregate(s, F.lit(0), lambda n, v: n + F.when(crosses(v), 1).otherwise(0)) % 2 == 1
    return F.col("full") | odd | F.exists(s, lambda v: G._segment_distance2(v, x, y) == 0)


def _finite(x: str, y: str) -> Column:
    """A place without a finite coordinate is in no cell."""
    return (F.abs(F.col(x)) < 1e15) & (F.abs(F.col(y)) < 1e15)


def points_in(points: DataFrame, cover: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Every pair of a point and a covering row whose part covers it: the columns of both, but the cells'."""
    points, px, py = points.where(_finite(x, y)), F.col(x), F.col(y)
    at = [F.struct(F.lit(v).alias("level"), cell_index(px, v).alias("cx"), cell_index(py, v).alias("cy")) for v in levels_of(cover)]
    if not at:
        return points.join(cover, F.lit(False)).drop("level", "cx", "cy", "full", "sides")
    placed = points.withColumn("__at", F.explode(F.array(*at)))
    placed = placed.select("*", F.col("__at.level").alias("level"), F.col("__at.cx").alias("cx"), F.col("__at.cy").alias("cy")).drop("__at")
    met = placed.join(broadcast_if_small(cover, BROADCAST_CELLS), ["level", "cx", "cy"]).where(holds(px, py))
    return met.drop("level", "cx", "cy", "full", "sides")


def semi(points: DataFrame, cover: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """The points that any part covers, with their columns; one join for each level in use."""
    px, py = F.col(x), F.col(y)
    left, found = points.where(_finite(x, y)), None
    levels = levels_of(cover)
    for level in levels:
        own = broadcast_if_small(cover.where(F.col("level") == level), BROADCAST_CELLS)
        here = (cell_index(px, level) == F.col("cx")) & (cell_index(py, level) == F.col("cy")) & holds(px, py)
        hit = left.join(own, here, "left_semi")
        found = hit if found is None else found.unionByName(hit)
        if level != levels[-1]:
            left = left.join(own, here, "left_anti")
    return points.limit(0) if found is None else found


def candidates(shapes: DataFrame, cover: DataFrame, key: str, polygon_key: str, geom: str = "geom") -> DataFrame:
    """Distinct (key, polygon_key) of shapes whose bounds share a cell with a part.

    A shape has a level too; a pair meets at the coarser of both, so neither side has more
    than some cells for each level in use, whatever their extents are.
    """
    g = F.col(geom)
    extent = F.greatest(g["xmax"] - g["xmin"], g["ymax"] - g["ymin"])
    own = F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(2.0**LEAST)) / 4)).cast("int"), F.lit(LEAST))
    used = levels_of(cover)
    if not used:
        return shapes.select(key).join(cover.select(polygon_key), F.lit(False))
    leveled = shapes.where(g.isNotNull() & (F.abs(g["xmin"]) < 1e15) & (F.abs(g["ymax"]) < 1e15)).select(key, own.alias("own"), g["xmin"].alias("x0"), g["ymin"].alias("y0"), g["xmax"].alias("x1"), g["ymax"].alias("y1"))
    larger = sorted(r["own"] for r in leveled.where(F.col("own") > used[-1]).select("own").distinct().collect())
    every = F.array(*map(F.lit, used + larger))
    fit = leveled.withColumn("own", F.array_min(F.filter(every, lambda v: v >= F.col("own")))).withColumn("level", F.explode(F.filter(every, lambda v: v >= F.col("own"))))
    across = lambda low, high: F.sequence(cell_index(F.col(low), F.col("level")), cell_index(F.col(high), F.col("level")))
    left = fit.withColumn("cx", F.explode(across("x0", "x1"))).withColumn("cy", F.explode(across("y0", "y1"))).select(key, "own", "level", "cx", "cy")
    up = cover.select(polygon_key, F.col("level").alias("base"), "cx", "cy").withColumn("level", F.explode(F.filter(every, lambda v: v >= F.col("base"))))
    coarse = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level") - F.col("base"))).cast("long").alias(c)
    right = up.select(polygon_key, "base", "level", coarse("cx"), coarse("cy")).distinct()
    met = left.join(broadcast_if_small(right, BROADCAST_CELLS), ["level", "cx", "cy"])
    return met.where((F.col("level") == F.col("own")) | (F.col("level") == F.col("base"))).select(key, polygon_key).distinct()
