import math

import pytest
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.functions import text as T


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def ring(*points):
    return F.array(*(G.xy(F.lit(float(x)), F.lit(float(y))) for x, y in points))


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]


def test_distance_area_and_cover(spark):
    g = G.polygon(F.array(ring(*SQUARE), ring(*HOLE)))
    r = one(spark, G.st_area(g), G.st_distance(g, 2.0, 2.0), G.st_distance(g, 0.5, 0.5), G.st_distance(g, 7.0, 8.0), G.st_covers(g, 4.0, 2.0), G.st_covers(g, 2.0, 2.0), G.st_is_valid(g))
    assert tuple(r) == (12.0, 1.0, 0.0, 5.0, True, False, True)


def test_line_distance_and_within(spark):
    g = G.line(ring((0, 0), (10, 0)))
    r = one(spark, G.st_distance(g, 5.0, 3.0), G.st_distance(g, 13.0, 4.0), G.st_dwithin(g, 13.0, 4.0, 5.0), G.st_dwithin(g, 13.0, 4.0, 4.99), G.family(g))
    assert tuple(r) == (3.0, 5.0, True, False, "line")


def test_utm_round_trip_and_known_place(spark):
    x, y = G.to_utm(F.lit(30.0), F.lit(60.0))
    lon, lat = G.from_utm(x, y)
    r = one(spark, x, y, lon, lat)
    assert r[2] == pytest.approx(30.0, abs=1e-8) and r[3] == pytest.approx(60.0, abs=1e-8)
    # Zone 36's central meridian is 33 degrees east, so the place lies west of it; the meridian arc is about 6 654 km.
    assert 300_000 < r[0] < 350_000 and 6_650_000 < r[1] < 6_660_000


def test_geodesic_is_near_the_sphere(spark):
    r = one(spark, G.geo_distance_m(30.0, 60.0, 30.0, 60.001), G.geo_distance_m(30.0, 60.0, 30.001, 60.0))
    assert r[0] == pytest.approx(111.42, abs=0.05) and r[1] == pytest.approx(55.8, abs=0.05)


def test_intersections(spark):
    box = G.rectangle(0, 0, 4, 4)
    inner, apart, cross = G.rectangle(1, 1, 2, 2), G.rectangle(5, 5, 6, 6), G.line(ring((-1, 2), (6, 2)))
    r = one(spark, G.st_intersects(box, inner), G.st_intersects(box, apart), G.st_intersects(box, cross), G.intersects_box(inner, 0, 0, 4, 4), G.intersects_box(cross, 0, 0, 4, 4), G.intersects_box(apart, 0, 0, 4, 4), G.intersects_box(box, 1, 1, 2, 2))
    assert tuple(r) == (True, False, True, True, True, False, True)


def test_equality_ignores_the_ring_start(spark):
    a = G.polygon(F.array(ring(*SQUARE)))
    b = G.polygon(F.array(ring((4, 4), (0, 4), (0, 0), (4, 0), (4, 4))))
    assert tuple(one(spark, G.st_equals(a, b), G.st_equals(a, G.rectangle(0, 0, 4, 5)))) == (True, False)


def test_representative_points_and_crossings(spark):
    g = G.polygon(F.array(ring(*SQUARE), ring(*HOLE)))
    bow = G.polygon(F.array(ring((0, 0), (4, 4), (4, 0), (0, 4), (0, 0))))
    df = spark.range(1).select(g.alias("g"), G.representative_point(g).alias("p"), G.representative_point(G.line(ring((0, 0), (4, 0)))).alias("m"), G.st_is_valid(bow).alias("b"), G.st_is_valid(g).alias("n"))
    r = df.select("m", G.st_covers(F.col("g"), "p.x", "p.y").alias("c"), "b", "n").first()
    assert (r["m"]["x"], r["m"]["y"]) == (2.0, 0.0) and r["c"] and not r["b"] and r["n"]


def test_kernels(spark):
    r = one(spark, G.k_quartic(0.0, 10), G.k_quartic(10.0, 10), G.k_half(600.0, 600), G.k_half(1200.0, 600), G.bounded_bonus(0.5, 100.0, 0.18, 1.0))
    assert r[0] == 1 and r[1] == 0 and r[2] == pytest.approx(0.5) and r[3] == pytest.approx(0.0625) and r[4] <= 0.59 + 1e-12
    assert math.isclose(one(spark, G.size_quality(0.0, 50_000, 0.2))[0], 0.2)


def test_text_functions(spark):
    r = one(spark, T.normalize_search(F.lit("  Ａ   Ёлочная  ")), T.norm_url(F.lit("HTTPS://www.Example.org/a//")), T.norm_phone(F.lit("+7 (812) 123-45-67; 12")), T.uuid5(F.lit("a")), T.trgm_similarity(F.lit("cat"), F.lit("cat")))
    import uuid

    assert tuple(r) == ("a елочная", "example.org/a", "78121234567", str(uuid.uuid5(uuid.NAMESPACE_URL, "a")), 1.0)


def test_geojson(spark):
    assert one(spark, G.to_geojson(G.point(F.lit(1.23456789), F.lit(2.0))))[0] == '{"type":"Point","coordinates":[1.234568,2.0]}'
