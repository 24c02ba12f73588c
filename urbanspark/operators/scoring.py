"""Normalisation curves, weighted composites, distributions, explanations and heatmap tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import pyramid

TILE, BUFFER = 4096, 64


def check_curve(points: list[tuple[float, float]]) -> None:
    """Two points or more, raw values increasing, scores within 0..100 and in one direction."""
    raw, score = [p[0] for p in points], [p[1] for p in points]
    if len(points) < 2 or any(b <= a for a, b in zip(raw, raw[1:], strict=False)):
        raise ValueError("a curve needs two points or more, with increasing raw values")
    if any(not 0 <= s <= 100 for s in score) or not (score == sorted(score) or score == sorted(score, reverse=True)):
        raise ValueError("scores must lie within 0..100 and go in one direction")


def check_weights(weights: dict[str, float], known: set[str] | None = None) -> None:
    if not weights or any(not math.isfinite(w) or not 0 <= w <= 100 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must be finite, within 0..100 and not all zero")
    if known is not None and not set(weights) <= known:
        raise ValueError(f"unknown metrics: {sorted(set(weights) - known)}")


def curve_value(value: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear: clamped at both ends, exact at the anchors."""
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda x: x <= value))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    between = y0 + (y1 - y0) * (value - x0) / (x1 - x0)
    return F.when(value <= xs[0], ys[0]).when(value >= F.element_at(xs, -1), F.element_at(ys, -1)).when(k < n, between)


def curves_frame(spark, curves: dict[str, list[tuple[float, float]]]) -> DataFrame:
    for points in curves.values():
        check_curve(points)
    rows = [(k, [float(x) for x, _ in p], [float(y) for _, y in p]) for k, p in curves.items()]
    return spark.createDataFrame(rows, "metric_key string, xs array<double>, ys array<double>")


def normalize(values: DataFrame, curves: DataFrame) -> DataFrame:
    """(metric_key, cell_id, score): one join of all values with all curves, a few rows."""
    return values.join(F.broadcast(curves), "metric_key").select("metric_key", "cell_id", curve_value(F.col("raw_value"), F.col("xs"), F.col("ys")).alias("score"))


def weights_frame(spark, weights: dict[str, float]) -> DataFrame:
    check_weights(weights)
    return spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "metric_key string, weight double")


def composite(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(cell_id, composite): the weighted sum of a cell's scores over the sum of all weights."""
    joined = scores.join(F.broadcast(weights), "metric_key")
    total = weights.agg(F.sum("weight").alias("total"))
    summed = joined.groupBy("cell_id").agg(F.sum(F.col("score") * F.col("weight")).alias("weighted"))
    return summed.crossJoin(F.broadcast(total)).select("cell_id", (F.col("weighted") / F.col("total")).alias("composite"))


def top_cells(composites: DataFrame, k: int) -> DataFrame:
    """The k best cells, score down then id up, with the statistics of all cells."""
    stats = composites.agg(F.count("*").alias("cells"), F.min("composite").alias("min_score"), F.max("composite").alias("max_score"), F.avg("composite").alias("mean_score"))
    best = composites.orderBy(F.desc("composite"), "cell_id").limit(k)
    return best.crossJoin(F.broadcast(stats))


def distribution(scores: DataFrame, weights: DataFrame, cells: DataFrame, n_metrics: int, by: str = "district_id") -> DataFrame:
    """Count and five exact quantiles per district of the cells that have all metrics."""
    joined = scores.join(F.broadcast(weights), "metric_key").join(cells.select("cell_id", by), "cell_id")
    whole = joined.groupBy("cell_id", by).agg(F.count("*").alias("n"), (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("composite")).where(F.col("n") == n_metrics)
    q = F.percentile("composite", F.array(*(F.lit(p) for p in (0.10, 0.25, 0.50, 0.75, 0.90))))
    return whole.groupBy(by).agg(F.count("*").alias("cells"), q.alias("q")).select(by, "cells", *(F.col("q")[i].alias(name) for i, name in enumerate(("p10", "p25", "p50", "p75", "p90"))))


def summarize(run_stats: DataFrame, weights: DataFrame) -> DataFrame:
    """Bounds and exact mean of the composite from run statistics alone, without score rows."""
    w = F.col("weight")
    return run_stats.join(F.broadcast(weights), "metric_key").agg(
        (F.sum(F.col("min_score") * w) / F.sum(w)).alias("lower"),
        (F.sum(F.col("max_score") * w) / F.sum(w)).alias("upper"),
        (F.sum(F.col("mean_score") * w) / F.sum(w)).alias("mean"),
    )


def evaluate_scenarios(scores: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, cell_id, composite) of a table (scenario, metric_key, weight)."""
    joined = scores.join(F.broadcast(scenarios), "metric_key")
    return joined.groupBy("scenario", "cell_id").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("composite"))


def contributions(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(cell_id, metric_key, contribution): parts that add up to the composite."""
    total = weights.agg(F.sum("weight").alias("total"))
    return scores.join(F.broadcast(weights), "metric_key").crossJoin(F.broadcast(total)).select("cell_id", "metric_key", (F.col("score") * F.col("weight") / F.col("total")).alias("contribution"))


def explain_targets(cells: DataFrame, targets: DataFrame, half: float, quality: Column, *, boxes: bool = False) -> DataFrame:
    """(cell_id, target_id, log_score): the strongest target of each cell, at any distance.

    log_score is ln(quality) less ln 2 (d / half)^2, its exponent floored at -700 and the
    quality at 1e-300; ties go to the least target id. Without targets there are no rows.
    """
    score = lambda d, q: F.log(q) + F.greatest(-math.log(2) * F.pow(d / half, 2.0), F.lit(-700.0))
    best = pyramid.strongest(cells, targets, "cell_id", score, weight=F.greatest(quality, F.lit(1e-300)), boxes=boxes)
    return best.select("cell_id", "target_id", F.col("value").alias("log_score"))


def is_current(runs: DataFrame, pointers: DataFrame) -> DataFrame:
    """Runs with a flag whether a current pointer names them."""
    named = pointers.select("metric_key", F.col("run_id").alias("__current"))
    return runs.join(named, "metric_key", "left").withColumn("is_current", F.col("run_id").eqNullSafe(F.col("__current"))).drop("__current")


def plan_current(weights: DataFrame, pointers: DataFrame, runs: DataFrame, curves: DataFrame) -> DataFrame:
    """(metric_key, weight, run_id, problem) for each weighted metric; problem is null when it can be scored."""
    found = weights.join(pointers, "metric_key", "left").join(runs.select("run_id", "curve_checksum", "cell_count"), "run_id", "left").join(curves.select("metric_key", F.col("curve_checksum").alias("enabled")), "metric_key", "left")
    size = found.agg(F.min("cell_count").alias("__lo"), F.max("cell_count").alias("__hi"))
    problem = F.when(F.col("run_id").isNull(), "missing").when(~F.col("curve_checksum").eqNullSafe(F.col("enabled")), "stale").when(F.col("__lo") != F.col("__hi"), "cell_count")
    return found.crossJoin(F.broadcast(size)).select("metric_key", "weight", "run_id", problem.alias("problem"))


def plan_pinned(weights: DataFrame, pinned: DataFrame, runs: DataFrame) -> DataFrame:
    """The same over explicit (metric_key, run_id)."""
    found = weights.join(pinned, "metric_key", "left").join(runs.select("run_id", F.col("metric_key").alias("__own")), "run_id", "left")
    problem = F.when(F.col("run_id").isNull(), "missing").when(~F.col("__own").eqNullSafe(F.col("metric_key")), "unknown_run")
    return found.select("metric_key", "weight", "run_id", problem.alias("problem"))


def plan_signature(plan: DataFrame, grid_version: str) -> DataFrame:
    """One row: the digest of the grid and the ordered (metric, run, weight)."""
    part = F.concat_ws("=", "metric_key", "run_id", F.col("weight").cast("string"))
    return plan.agg(F.sha2(F.concat_ws("|", F.lit(grid_version), F.array_join(F.array_sort(F.collect_list(part)), "|")), 256).alias("signature"))


# Tiles


def lonlat_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    mx, my = G.to_mercator(lon, lat)
    side = 2 * math.pi * G.A / 2**zoom
    return F.floor((mx + math.pi * G.A) / side), F.floor((math.pi * G.A - my) / side)


def tile_cells(cells: DataFrame, zoom: int, mercator: tuple[str, str, str, str]) -> DataFrame:
    """Cells per tile they touch: (z, tx, ty) exploded from mercator bounds x0, y0, x1, y1."""
    side, half = 2 * math.pi * G.A / 2**zoom, math.pi * G.A
    x0, y0, x1, y1 = (F.col(c) for c in mercator)
    index = lambda v: F.floor(v / side)
    tiled = cells.withColumn("z", F.lit(zoom)).withColumn("tx", F.explode(F.sequence(index(x0 + half), index(x1 + half))))
    return tiled.withColumn("ty", F.explode(F.sequence(index(half - y1), index(half - y0))))


def tile_rows(grids: dict[int, DataFrame], low: int, high: int, mercator: tuple[str, str, str, str], fine: int = 50, coarse: int = 200, switch: int = 13) -> DataFrame:
    """Every cell of every tile of the zooms ``low`` to ``high``: the cells' columns with z, tx, ty and tile-local bounds.

    grids: cells by their size. Each zoom shows one grid, the fine one from ``switch`` on. A
    grid's deepest zoom is cut from its cells, each zoom above rolls up the four tiles below
    it. Rows come in the order of tile and cell id.
    """
    out = None
    for size, zooms in ((fine, range(max(low, switch), high + 1)), (coarse, range(low, min(high, switch - 1) + 1))):
        if not len(zooms):
            continue
        level = tile_cells(grids[size], zooms[-1], mercator)
        for z in reversed(zooms):
            if z != zooms[-1]:
                up = level.withColumns({"z": F.lit(z), "tx": F.floor(F.col("tx") / 2), "ty": F.floor(F.col("ty") / 2)})
                level = up.dropDuplicates(["cell_id", "tx", "ty"])
            out = level if out is None else out.unionByName(level)
    if out is None:
        raise ValueError("no zoom is asked for")
    shown = out.select(*(c for c in out.columns if c not in mercator), *tile_geometry(mercator))
    return shown.repartitionByRange("z", "tx", "ty", "cell_id").sortWithinPartitions("z", "tx", "ty", "cell_id")


def tile_geometry(mercator: tuple[str, str, str, str]) -> list[Column]:
    """Tile-local bounds of a cell, clipped to the tile and its buffer, in 4096 units; y grows downwards."""
    side, half = 2 * math.pi * G.A / F.pow(F.lit(2.0), F.col("z")), math.pi * G.A
    x0, y0, x1, y1 = (F.col(c) for c in mercator)
    unit = lambda v: F.least(F.greatest(F.round(v * TILE), F.lit(-BUFFER)), F.lit(TILE + BUFFER)).cast("int")
    return [unit((x0 + half) / side - F.col("tx")).alias("qx0"), unit((half - y1) / side - F.col("ty")).alias("qy0"), unit((x1 + half) / side - F.col("tx")).alias("qx1"), unit((half - y0) / side - F.col("ty")).alias("qy1")]


def heatmap_tiles(tiled: DataFrame, scores: DataFrame, weights: DataFrame) -> DataFrame:
    """(z, tx, ty, cells, total): composites summed as exact decimals, so order doesn't matter."""
    exact = lambda c: F.col(c).cast("decimal(20,10)")
    summed = scores.join(F.broadcast(weights), "metric_key").groupBy("cell_id").agg((F.sum((exact("score") * exact("weight")).cast("decimal(30,12)")) / F.sum(exact("weight"))).cast("decimal(18,6)").alias("composite"))
    return tiled.join(summed, "cell_id").groupBy("z", "tx", "ty").agg(F.count("*").alias("cells"), F.sum("composite").cast("decimal(28,6)").alias("total"))


def tile_etag(version: str, signature: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(version), F.lit(signature), F.col("z"), F.col("tx"), F.col("ty")), 256)


def grid_for_zoom(zoom: Column, fine: int = 50, coarse: int = 200) -> Column:
    return F.when(zoom >= 13, fine).otherwise(coarse)


def legend_bucket(score: Column, low: float, high: float, stops: int = 5) -> Column:
    """Class 0..stops-1 of a score in a display range, clamped at both ends."""
    return F.least(F.greatest(F.floor((score - low) / (high - low) * stops), F.lit(0)), F.lit(stops - 1)).cast("int")
