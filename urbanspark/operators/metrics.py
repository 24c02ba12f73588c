"""Raw metrics of grid cells over logical targets.

A provider is a function (cells, targets, config) -> DataFrame (cell_id, raw_value,
matches); the registry names six, and a user may add more. Every provider returns a value
for every cell. Targets: (target_id, category, geom, area).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import spatial

Provider = Callable[[DataFrame, DataFrame, dict], DataFrame]
PROVIDERS: dict[str, Provider] = {}


def provider(key: str) -> Callable[[Provider], Provider]:
    def add(f: Provider) -> Provider:
        PROVIDERS[key] = f
        return f

    return add


def _positive(config: dict, *names: str) -> None:
    for n in names:
        if not config[n] > 0:
            raise ValueError(f"{n} must be positive")


def logical_targets(members: DataFrame, facilities: DataFrame) -> DataFrame:
    """Category members with each facility's members as one target.

    members: (object_id, category, geom); facilities: (facility_id, object_id,
    analysis_geom). A target has the sorted ids of its objects and its area.
    """
    joined = members.join(facilities.select("object_id", "facility_id", "analysis_geom"), "object_id", "left")
    alone = joined.where("facility_id IS NULL").select(F.concat(F.lit("o:"), "object_id").alias("target_id"), "category", "geom", F.array("object_id").alias("source_ids"))
    grouped = joined.where("facility_id IS NOT NULL").groupBy("category", "facility_id").agg(F.first("analysis_geom").alias("geom"), F.array_sort(F.collect_set("object_id")).alias("source_ids"))
    grouped = grouped.select(F.concat(F.lit("f:"), "facility_id").alias("target_id"), "category", "geom", "source_ids")
    return alone.unionByName(grouped).withColumn("area", G.st_area(F.col("geom")))


def target_quality(targets: DataFrame) -> DataFrame:
    g = F.col("geom")
    return targets.groupBy("category").agg(
        F.count("*").alias("targets"),
        (F.count("*") - F.count_distinct("target_id")).alias("duplicates"),
        F.count_if(g.isNull() | ~G.st_is_valid(g)).alias("invalid"),
    )


def _every_cell(cells: DataFrame, found: DataFrame) -> DataFrame:
    full = cells.select("cell_id").join(found, "cell_id", "left")
    return full.select("cell_id", F.coalesce("raw_value", F.lit(0.0)).alias("raw_value"), F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))


def _near(cells: DataFrame, targets: DataFrame, radius: float, config: dict) -> DataFrame:
    return spatial.distance_join(cells.select("cell_id", "x", "y"), targets, radius, boxes=config.get("boxes", False)).groupBy("cell_id")


@provider("nearest_distance")
def nearest_distance(cells: DataFrame, targets: DataFrame, config: dict | None = None) -> DataFrame:
    """Metres to the nearest target; a cell that has none, as there are no targets, has no distance: null and no matches."""
    found = spatial.nearest(cells, targets, "cell_id", boxes=(config or {}).get("boxes", False))
    full = cells.select("cell_id").join(found, "cell_id", "left")
    return full.select("cell_id", F.col("distance").alias("raw_value"), F.col("distance").isNotNull().cast("long").alias("matches"))


@provider("count_within_radius")
def count_within_radius(cells: DataFrame, targets: DataFrame, config: dict) -> DataFrame:
    _positive(config, "radius")
    n = F.count("*")
    return _every_cell(cells, _near(cells, targets, config["radius"], config).agg(n.cast("double").alias("raw_value"), n.alias("matches")))


@provider("smooth_influence")
def smooth_influence(cells: DataFrame, targets: DataFrame, config: dict) -> DataFrame:
    _positive(config, "radius")
    r = config["radius"]
    return _every_cell(cells, _near(cells, targets, r, config).agg(F.sum(G.k_quartic("distance", r)).alias("raw_value"), F.count("*").alias("matches")))


def _bounded(influence: Column, cap: float, saturation: float) -> Column:
    """Greatest influence with a bounded bonus for the others, clamped to 1."""
    return F.least(G.bounded_bonus(F.max(influence), F.sum(influence), cap, saturation), F.lit(1.0))


def _check_access(config: dict) -> None:
    _positive(config, "half", "saturation")
    if not 3 <= config["cutoff"] <= 6 or not 0 <= config["cap"] <= 0.35:
        raise ValueError("cutoff must be within 3..6 and cap within 0..0.35")


@provider("primary_accessibility")
def primary_accessibility(cells: DataFrame, targets: DataFrame, config: dict) -> DataFrame:
    config = {"cutoff": 4, "cap": 0.18, "saturation": 1.0} | config
    _check_access(config)
    near = _near(cells, targets, config["half"] * config["cutoff"], config)
    return _every_cell(cells, near.agg(_bounded(G.k_half("distance", config["half"]), config["cap"], config["saturation"]).alias("raw_value"), F.count("*").alias("matches")))


@provider("park_accessibility")
def park_accessibility(cells: DataFrame, targets: DataFrame, config: dict) -> DataFrame:
    config = {"half": 900, "cutoff": 4, "cap": 0.15, "saturation": 0.75, "area_ref": 50_000, "min_quality": 0.2} | config
    _check_access(config)
    influence = G.k_half("distance", config["half"]) * G.size_quality("area", config["area_ref"], config["min_quality"])
    near = _near(cells, targets, config["half"] * config["cutoff"], config)
    return _every_cell(cells, near.agg(_bounded(influence, config["cap"], config["saturation"]).alias("raw_value"), F.count("*").alias("matches")))


@provider("water_accessibility")
def water_accessibility(cells: DataFrame, targets: DataFrame, config: dict) -> DataFrame:
    """The greatest influence alone: waters never add up. Lines have a fixed quality."""
    config = {"half": 1000, "cutoff": 4, "area_ref": 100_000, "min_quality": 0.25, "line_quality": 0.85} | config
    _positive(config, "half", "line_quality")
    quality = F.when(G.is_areal(F.col("geom")), G.size_quality("area", config["area_ref"], config["min_quality"])).otherwise(config["line_quality"])
    near = _near(cells, targets, config["half"] * config["cutoff"], config)
    return _every_cell(cells, near.agg(F.least(F.max(G.k_half("distance", config["half"]) * quality), F.lit(1.0)).alias("raw_value"), F.count("*").alias("matches")))


def run_metrics(cells: DataFrame, targets: DataFrame, registry: list[dict]) -> DataFrame:
    """(metric_key, cell_id, raw_value, matches) of every definition: {key, provider, category, config}.

    All definitions share one table of targets; each is one branch of the same plan.
    """
    out = None
    for d in registry:
        own = targets.where(F.col("category") == d["category"])
        one = PROVIDERS[d["provider"]](cells, own, d.get("config", {})).select(F.lit(d["key"]).alias("metric_key"), "cell_id", "raw_value", "matches")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the registry is empty")
    return out


def metric_sanity(values: DataFrame, semantics: dict[str, str]) -> DataFrame:
    """One row per metric: counts, range, and whether they fit distance, count or index values."""
    kind = F.lit(None).cast("string")
    for key, s in semantics.items():
        kind = F.when(F.col("metric_key") == key, s).otherwise(kind)
    v = F.col("raw_value")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    stats = values.groupBy("metric_key").agg(
        F.count("*").alias("n"),
        F.count_if(bad).alias("non_finite"),
        F.count_if(v < 0).alias("negative"),
        F.count_if(v != F.floor(v)).alias("fractional"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )
    usual = (F.col("non_finite") == 0) & (F.col("negative") == 0)
    spread = F.col("max_value") > F.col("min_value")
    fits = F.when(kind == "count", (F.col("fractional") == 0) & (F.col("max_value") > 0)).otherwise(spread)
    return stats.select("*", (usual & fits).alias("sane"))
