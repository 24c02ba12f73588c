"""Catalog audits: coverage, geometry, validity, evidence and score reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions import geometry as G
from urbanspark.operators import spatial


def coverage_ratio(current: DataFrame, full: DataFrame, districts: DataFrame) -> DataFrame:
    """Current against full counts per district, in percent, and density per square kilometre."""
    area = districts.select("district_id", (G.st_area(F.col("geom")) / 1e6).alias("km2"))
    joined = full.withColumnRenamed("n", "full_count").join(current.withColumnRenamed("n", "current"), "district_id", "left").join(area, "district_id")
    now = F.coalesce("current", F.lit(0))
    return joined.select("district_id", now.alias("current"), "full_count", F.round(100.0 * now / F.col("full_count"), 6).alias("percent"), F.round(F.col("full_count") / F.col("km2"), 6).alias("per_km2"))


def category_totals(df: DataFrame, districts: DataFrame, category: str = "category") -> DataFrame:
    """City-wide totals; an object across districts counts once."""
    inside = spatial.within_districts(df, districts.select(F.col("geom").alias("district_geom")))
    return inside.groupBy(category).agg(F.count("*").alias("n"))


def bbox_split(df: DataFrame, box: tuple[float, float, float, float], by: str, x: str = "x", y: str = "y") -> DataFrame:
    """Counts inside and outside a box, and occupied kilometre cells."""
    x0, y0, x1, y1 = box
    inside = F.col(x).between(x0, x1) & F.col(y).between(y0, y1)
    return df.groupBy(by).agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"), F.count_distinct(F.floor(F.col(x) / 1000), F.floor(F.col(y) / 1000)).alias("occupied"))


def geometry_distribution(df: DataFrame, by: str) -> DataFrame:
    counted = df.groupBy(by, F.col("geom.gtype").alias("gtype")).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy(by)), 6))


def validity_report(df: DataFrame, by: str) -> DataFrame:
    g = F.col("geom")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(g.isNull()).alias("null_geometry"), F.count_if(g.isNotNull() & G.is_empty(g)).alias("empty"), F.count_if(g.isNotNull() & ~G.is_empty(g) & ~G.st_is_valid(g)).alias("invalid"))


def source_geometry(df: DataFrame) -> DataFrame:
    return df.groupBy("source_type", F.col("geom.gtype").alias("gtype")).agg(F.count("*").alias("n"))


def building_split(points: DataFrame, areas: DataFrame) -> DataFrame:
    """One row: buildings, sites, and points that a building's footprint covers."""
    inside = spatial.reached(points, areas.where("building"), 0.0, "id").agg(F.count("id").alias("contained"))
    split = areas.agg(F.count_if("building").alias("buildings"), F.count_if(~F.col("building")).alias("sites"))
    return split.crossJoin(F.broadcast(inside))


def evidence_tiers(pairs: DataFrame, equal: Column) -> DataFrame:
    tier = F.when(equal & F.col("contained"), "STRONG").when(equal | F.col("contained"), "POSSIBLE").otherwise("NOT ENOUGH")
    return pairs.groupBy(tier.alias("tier")).agg(F.count("*").alias("pairs"), F.count_distinct("point_id").alias("points"))


def score_distribution_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.select(F.lit("before").alias("phase"), "composite").unionByName(after.select(F.lit("after").alias("phase"), "composite"))
    return both.groupBy("phase").agg(F.count("*").alias("cells"), F.avg("composite").alias("mean"), F.stddev("composite").alias("deviation"), F.percentile("composite", F.lit(0.5)).alias("median"))


def saturation(scores: DataFrame) -> DataFrame:
    full = F.count_if(F.col("score") == 100)
    return scores.groupBy("metric_key").agg(F.count("*").alias("cells"), full.alias("full_score"), F.round(100.0 * full / F.count("*"), 6).alias("percent"))
