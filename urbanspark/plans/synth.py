"""A deterministic geography over the given tables, for Spark and as SQL.

A plane of 20 km by 20 km; integer arithmetic first, then doubles, so both agree exactly.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import grid

X0, Y0, SIDE = 340000, 6630000, 20000
CELL = 200

RELATIONS = {
    "districts": "districts AS (SELECT n_name AS district_id, n_nationkey AS display_order, CAST(340000 + 4000 * (n_nationkey % 5) AS DOUBLE) AS x0, CAST(6630000 + 4000 * (n_nationkey // 5) AS DOUBLE) AS y0, CAST(344000 + 4000 * (n_nationkey % 5) AS DOUBLE) AS x1, CAST(6634000 + 4000 * (n_nationkey // 5) AS DOUBLE) AS y1 FROM nation)",
    "cells": "cells AS (SELECT 'grid-200m:' || i || ':' || j AS cell_id, i, j, (i + 0.5) * 200.0::DOUBLE AS x, (j + 0.5) * 200.0::DOUBLE AS y, d.district_id FROM range(1700, 1800) a(i), range(33150, 33250) b(j), districts d WHERE (i + 0.5) * 200 BETWEEN x0 AND x1 AND (j + 0.5) * 200 BETWEEN y0 AND y1)",
    "pts": "pts AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, c_custkey % 7 AS ref, CAST(340000 + (c_custkey * 7919) % 20000 AS DOUBLE) AS x, CAST(6630000 + (c_custkey * 104729) % 20000 AS DOUBLE) AS y FROM customer)",
    "areas": "areas AS (SELECT p_partkey AS id, p_name AS name, p_type AS category, p_partkey % 7 AS ref, CAST(340000 + (p_partkey * 6007) % 20000 AS DOUBLE) AS x, CAST(6630000 + (p_partkey * 15013) % 20000 AS DOUBLE) AS y, CAST(10 * p_size AS DOUBLE) AS hw, p_size FROM part)",
    "roads": "roads AS (SELECT o_orderkey AS id, 'Street ' || (o_custkey % 200) AS name, CAST(340000 + 40 * ((o_orderkey * 37) % 120) AS DOUBLE) AS x0, CAST(340025 + 40 * ((o_orderkey * 37) % 120) AS DOUBLE) AS x1, CAST(6630000 + 100 * (o_custkey % 200) AS DOUBLE) AS y, (o_orderkey * 37) % 120 AS slot, o_custkey % 200 AS s FROM orders)",
    "obs": "obs AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS run, arg_max(event_type, (ts, event_id)) AS kind, arg_max(value, (ts, event_id)) AS value, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY 1, 2)",
    "m_near": "m_near AS (SELECT cell_id, min(sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y))) AS v FROM cells c, pts p WHERE p.category = 'BUILDING' GROUP BY 1)",
    "m_count": "m_count AS (SELECT cell_id, CAST(count(p.id) AS DOUBLE) AS v FROM cells c LEFT JOIN pts p ON p.category = 'AUTOMOBILE' AND (c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y) <= 1000000 GROUP BY 1)",
    "park_pairs": "park_pairs AS (SELECT cell_id, a.id, 4 * hw * hw AS area, sqrt(greatest(abs(c.x - a.x) - hw, 0) ** 2 + greatest(abs(c.y - a.y) - hw, 0) ** 2) AS d FROM cells c, areas a WHERE a.category = 'STANDARD')",
    "m_park": "m_park AS (SELECT cell_id, least(m + (1 - m) * 0.15 * (1 - exp(-greatest(t - m, 0) / 0.75)), 1) AS v FROM (SELECT c.cell_id, coalesce(max(k), 0) AS m, coalesce(sum(k), 0) AS t FROM cells c LEFT JOIN (SELECT cell_id, exp(-ln(2) * (d / 900) ** 2) * (0.2 + 0.8 * (1 - exp(-area / 50000))) AS k FROM park_pairs WHERE d <= 3600) USING (cell_id) GROUP BY 1))",
    "scores": """scores AS (
        SELECT 'near' AS metric_key, cell_id, CASE WHEN v <= 300 THEN 100 WHEN v < 600 THEN 100 + (80 - 100) * (v - 300) / (600 - 300) WHEN v < 1000 THEN 80 + (55 - 80) * (v - 600) / (1000 - 600)
            WHEN v < 2000 THEN 55 + (20 - 55) * (v - 1000) / (2000 - 1000) WHEN v < 3000 THEN 20 + (0 - 20) * (v - 2000) / (3000 - 2000) ELSE 0 END AS score FROM m_near
        UNION ALL SELECT 'count', cell_id, CASE WHEN v < 1 THEN 50 * v WHEN v < 2 THEN 50 + 15 * (v - 1) WHEN v < 3 THEN 65 + 10 * (v - 2) WHEN v < 5 THEN 75 + 15 * (v - 3) / 2 WHEN v < 8 THEN 90 + 10 * (v - 5) / 3 ELSE 100 END FROM m_count
        UNION ALL SELECT 'park', cell_id, 100 * v FROM m_park)""",
    "weights": "weights(metric_key, weight) AS (VALUES ('near', 2.0), ('count', 1.0), ('park', 3.0))",
    "composites": "composites AS (SELECT cell_id, sum(score * weight) / 6.0 AS composite FROM scores JOIN weights USING (metric_key) GROUP BY 1)",
    "pairs": "pairs AS (SELECT p.id AS point_id, a.id AS area_id, p.ref AS p_ref, a.ref AS a_ref, p.name AS p_name, a.name AS a_name, sqrt(greatest(abs(p.x - a.x) - hw, 0) ** 2 + greatest(abs(p.y - a.y) - hw, 0) ** 2) AS distance FROM pts p, areas a WHERE p.id % 5 = a.id % 5 AND abs(p.x - a.x) <= hw + 100 AND abs(p.y - a.y) <= hw + 100 AND sqrt(greatest(abs(p.x - a.x) - hw, 0) ** 2 + greatest(abs(p.y - a.y) - hw, 0) ** 2) <= 100)",
}
NEEDS = {"cells": ["districts"], "m_near": ["cells", "pts"], "m_count": ["cells", "pts"], "park_pairs": ["cells", "areas"], "m_park": ["park_pairs"], "scores": ["m_near", "m_count", "m_park"], "composites": ["scores", "weights"], "pairs": ["pts", "areas"]}
CURVES = {
    "near": [(0, 100), (300, 100), (600, 80), (1000, 55), (2000, 20), (3000, 0)],
    "count": [(0, 0), (1, 50), (2, 65), (3, 75), (5, 90), (8, 100)],
    "park": [(0, 0), (1, 100)],
}
WEIGHTS = {"near": 2.0, "count": 1.0, "park": 3.0}


def with_relations(sql: str, relations: Iterable[str]) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for name in relations:
        need(name)
    if not order:
        return sql
    body = sql.strip()
    start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.startswith(w)), "")
    more = body[len(start) :] if start else None
    return (start or "WITH ") + ",\n".join(RELATIONS[n] for n in order) + (f",\n{more}" if more else f"\n{body}")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def districts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    x, y = F.lit(X0) + 4000 * (k % 5), F.lit(Y0) + 4000 * F.floor(k / 5)
    return table(spark, sf, "nation").select(F.col("n_name").alias("district_id"), k.alias("display_order"), G.rectangle(x, y, x + 4000, y + 4000).alias("geom"))


def cells(spark: SparkSession, sf: str, size: int = CELL) -> DataFrame:
    return grid.square_grid(districts(spark, sf), size)


def points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (F.lit(X0) + (k * 7919) % SIDE).cast("double"), (F.lit(Y0) + (k * 104729) % SIDE).cast("double")
    return table(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("category"), (k % 7).alias("ref"), x.alias("x"), y.alias("y"), G.point(x, y).alias("geom"))


def areas(spark: SparkSession, sf: str) -> DataFrame:
    k, hw = F.col("p_partkey"), 10 * F.col("p_size")
    x, y = F.lit(X0) + (k * 6007) % SIDE, F.lit(Y0) + (k * 15013) % SIDE
    return table(spark, sf, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), (k % 7).alias("ref"), "p_size", G.rectangle(x - hw, y - hw, x + hw, y + hw).alias("geom"))


def roads(spark: SparkSession, sf: str) -> DataFrame:
    s, slot = F.col("o_custkey") % 200, (F.col("o_orderkey") * 37) % 120
    x, y = F.lit(X0) + 40 * slot, F.lit(Y0) + 100 * s
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Street "), s.cast("string")).alias("name"), G.line(F.array(G.xy(x, y), G.xy(x + 25, y))).alias("geom"), slot.alias("slot"))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user and day: the last event's type, value and properties."""
    last = F.struct("ts", "event_id")
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.dayofmonth("ts").alias("run")).agg(F.max_by("event_type", last).alias("kind"), F.max_by("value", last).alias("value"), F.max_by("props", last).alias("props"))


def targets(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("target_id"), "category", "geom", G.st_area(F.col("geom")).alias("area"))
