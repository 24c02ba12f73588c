"""Exploded sides of spatial joins are merged: what is broadcast stays small, whatever Spark takes its size for."""

import pytest
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import spatial
from urbanspark.plans import map_queries, spatial_queries, table_queries  # noqa: F401
from urbanspark.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"
#: Any table that is broadcast takes 1 MB at least. The planner's own broadcasts count; those that follow from sizes measured at run time are off.
LIMITS = {"spark.sql.maxBroadcastTableSize": "2m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture
def small_broadcasts(spark):
    for k, v in LIMITS.items():
        spark.conf.set(k, v)
    yield
    for k in LIMITS:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", "facility_candidates facility_evidence evidence_tiers facility_report building_split geodesic_candidates facility_groups facility_roles facility_ids".split())
def test_nothing_large_is_broadcast(spark, small_broadcasts, name):
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()


def shapes(spark):
    """Rectangles from points to 20 km, thin ones and none."""
    i = F.col("id")
    wide, high = F.pow(F.lit(2.0), i % 15) - 1, F.pow(F.lit(2.0), (i * 7) % 13) - 1
    x, y = (i * 7919) % 20000 - 10000, (i * 104729) % 20000 - 10000
    return spark.range(120).select(i.alias("target_id"), (i % 3).alias("k"), F.when(i % 10 != 9, G.rectangle(x, y, x + wide, y + high)).alias("geom"))


@pytest.mark.parametrize("radius", [0.0, 30.0, 400.0])
def test_bins_of_all_sizes_meet_every_pair_once(spark, radius):
    i = F.col("id")
    points = spark.range(400).select(i.alias("cell_id"), (i % 3).alias("k"), ((i * 6007) % 20000 - 10000).cast("double").alias("x"), ((i * 15013) % 20000 - 10000).cast("double").alias("y"))
    got = spatial.distance_join(points, shapes(spark), radius, keys=("k",))
    assert got.columns == ["k", "cell_id", "x", "y", "target_id", "geom", "distance"]
    brute = points.join(shapes(spark).withColumnRenamed("k", "k2"), F.col("k") == F.col("k2")).withColumn("d", G.st_distance(F.col("geom"), "x", "y")).where(F.col("d") <= radius)
    want = sorted((r["cell_id"], r["target_id"], r["d"]) for r in brute.collect())
    assert want and sorted((r["cell_id"], r["target_id"], r["distance"]) for r in got.collect()) == want
    every = points.crossJoin(shapes(spark).select("geom")).where(G.st_distance(F.col("geom"), "x", "y") <= radius).select("cell_id").distinct()
    assert sorted(spatial.reached(points, shapes(spark), radius, "cell_id").collect()) == sorted(every.collect())


def test_geodesic_bins_meet_every_pair_at_any_latitude(spark):
    i = F.col("id")
    lat = F.element_at(F.array(*map(F.lit, (0.0, 60.0, -75.0, 89.999))), (i % 4 + 1).cast("int"))
    points = spark.range(800).select(i.alias("point_id"), (30 + (i * 7919) % 97 / 20000.0).alias("lon"), (lat + (i * 6007) % 89 / 30000.0).alias("lat"))
    lon, side = 30 + (i * 104729) % 97 / 20000.0, F.when(i % 3 == 0, 0.0).otherwise((i % 7) / 1000.0)
    geom = F.when(i % 3 == 0, G.point(lon, lat + 0.001)).otherwise(G.rectangle(lon, lat + 0.001, lon + side, lat + 0.001 + side))
    areas = spark.range(60).select(i.alias("area_id"), geom.alias("geom"))
    east, north = G.metres_per_degree(F.col("lat"))
    local = G.map_coordinates(F.col("geom"), lambda x, y: ((x - F.col("lon")) * east, (y - F.col("lat")) * north))
    brute = points.crossJoin(areas).where(G.st_distance(F.col("geom"), "lon", "lat") <= 0.002).withColumn("d", G.st_distance(local, 0.0, 0.0)).where("d <= 100")
    want = sorted((r["point_id"], r["area_id"], round(r["d"], 6)) for r in brute.collect())
    got = spatial.geodesic_join(points, areas, 100.0)
    assert len(want) > 100 and sorted((r["point_id"], r["area_id"], round(r["distance"], 6)) for r in got.collect()) == want
