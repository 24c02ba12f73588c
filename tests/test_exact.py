"""Covers, the bounded search, line clusters and validity against brute force on shapes made to be awkward."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.functions import validity
from urbanspark.operators import cover, entities, grid, metrics, scoring, spatial


def geom_rows(spark, rows, schema="id long, parts " + G.PARTS):
    """(id, geom) of (id, gtype, parts as lists of rings of (x, y))."""
    plain = [(i, t, [[[(float(x), float(y)) for x, y in r] for r in p] for p in parts]) for i, t, parts in rows]
    df = spark.createDataFrame(plain, f"id long, gtype string, parts {G.PARTS}")
    return df.select("id", G.geometry(F.col("gtype"), F.col("parts")).alias("geom"))


def star(cx, cy, r, n, rnd):
    """A concave ring around a centre."""
    pts = [(cx + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), cy + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    return [*pts, pts[0]]


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


@pytest.fixture(scope="module")
def polygons(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(30):
        cx, cy, r = rnd.uniform(-2000, 2000), rnd.uniform(-2000, 2000), 10 ** rnd.uniform(0.5, 3.2)
        outer = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 13)]
        hole = [(cx + r * 0.2 * math.cos(a), cy + r * 0.2 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 6)]
        rows.append((i, "POLYGON", [[[*outer[:-1], outer[0]], [*hole[:-1], hole[0]]]] if i % 2 else [[star(cx, cy, r, 11, rnd)]]))
    rows.append((90, "MULTIPOLYGON", [[square(0, 0, 100)], [square(300, 0, 50), square(310, 10, 20)]]))
    rows.append((91, "POLYGON", [[square(-1000, -1000, 2000)]]))
    return geom_rows(spark, rows).cache()


@pytest.fixture(scope="module")
def scattered(spark):
    rnd = random.Random(6)
    places = [(rnd.uniform(-2500, 2500), rnd.uniform(-2500, 2500)) for _ in range(1500)]
    places += [(0, 0), (100, 50), (100, 100), (300, 25), (310, 10), (320, 20), (330, 30), (-1000, 0), (1000, 1000), (999.9999, 1000), (1000.0001, 0), (1e9, 1e9)]
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)] + [(None, 5.0, 5.0), (5000, None, 1.0), (5001, float("nan"), 1.0)], "pid long, x double, y double").cache()


def test_points_meet_the_polygons_that_cover_them(polygons, scattered):
    cells = cover.covering(polygons, ["id"])
    got = {tuple(r) for r in cover.points_in(scattered, cells).select("pid", "id").distinct().collect()}
    want = {tuple(r) for r in scattered.crossJoin(polygons).where(G.st_covers(F.col("geom"), "x", "y")).select("pid", "id").collect()}
    assert got == want and len(want) > 500
    kinds = {r["full"]: r["n"] for r in cells.groupBy("full").agg(F.count("*").alias("n")).collect()}
    assert kinds[True] and cells.groupBy("id").count().agg(F.max("count")).first()[0] <= 2 * 18 * 18
    inside = {r["pid"] for r in grid.covered_by_any(scattered, polygons).collect()}
    assert inside == {p for p, _ in want}
    plan = cover.points_in(scattered, cells)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_polygon_that_covers_first_in_order(polygons, scattered):
    ordered = polygons.withColumns({"district_id": F.col("id").cast("string"), "display_order": F.col("id") % 3})
    got = {tuple(r) for r in spatial.assign_polygon(scattered, ordered, "pid").collect()}
    met = scattered.crossJoin(ordered).where(G.st_covers(F.col("geom"), "x", "y"))
    want = {tuple(r) for r in met.groupBy("pid").agg(F.min_by("district_id", F.struct("display_order", "district_id"))).collect()}
    assert got == want
    assert spatial.assign_polygon(scattered, ordered.where("false"), "pid").count() == 0


def test_shapes_meet_polygons_of_any_size(spark, polygons):
    rnd = random.Random(8)
    shapes = [(i, "LINESTRING", [[[(x := rnd.uniform(-2200, 2200), y := rnd.uniform(-2200, 2200)), (x + rnd.uniform(-1, 1) * (w := 10 ** rnd.uniform(0, 3.5)), y + w)]]]) for i in range(120)]
    shapes += [(200, "POINT", [[[(50, 50)]]]), (201, "POINT", [[[(320, 20)]]]), (202, "POLYGON", [[square(-90000, -90000, 180000)]]), (203, "POLYGON", [[square(312, 12, 3)]])]
    df = geom_rows(spark, shapes).withColumnRenamed("id", "sid")
    areas = polygons.select("id", "geom")
    got = {tuple(r) for r in spatial.polygon_pairs(df, areas, "sid", "id").collect()}
    a, b = F.col("geom"), F.col("__d")
    pairs = df.crossJoin(areas.withColumnRenamed("geom", "__d")).where(G.bbox_overlaps(a, b)).where(G.st_intersects(a, b))
    want = {tuple(r) for r in pairs.select("sid", "id").collect()}
    assert got == want and len(want) > 100 and (203, 90) not in want
    hit = {r["sid"] for r in spatial.within_districts(df, areas.withColumnRenamed("geom", "district_geom")).collect()}
    assert hit == {s for s, _ in want}
    counts = {tuple(r) for r in spatial.district_counts(df.withColumn("kind", F.col("sid") % 2), areas.withColumnRenamed("id", "district_id"), ["kind"]).collect()}
    expected = {}
    for s, p in want:
        expected[p, s % 2] = expected.get((p, s % 2), 0) + 1
    assert counts == {(p, k, n) for (p, k), n in expected.items()}


# The bounded search


def targets_of(spark, places):
    return geom_rows(spark, [(i, "POINT", [[[p]]]) for i, p in enumerate(places)]).withColumnRenamed("id", "target_id").withColumn("area", F.col("target_id") * 10.0)


def test_nearest_is_defined_for_null_ids_far_and_no_targets(spark, scattered):
    rnd = random.Random(9)
    dense = targets_of(spark, [(rnd.gauss(0, 50), rnd.gauss(0, 50)) for _ in range(400)] + [(2_000_000, 0), (2_000_000, 0)])
    for boxes in (True, False):
        got = {r[0]: r[1] for r in spatial.nearest(scattered, dense, "pid", boxes=boxes).collect()}
        brute = scattered.crossJoin(dense).groupBy("pid").agg(F.min(G.st_distance(F.col("geom"), "x", "y")).alias("d")).where("d IS NOT NULL AND NOT isnan(d)")
        want = {r[0]: r[1] for r in brute.collect()}
        assert got.keys() == want.keys() and None in got
        assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert spatial.nearest(scattered, dense.where("false"), "pid").count() == 0
    one = {r[0]: r[1] for r in spatial.nearest(scattered, dense.where("target_id = 400"), "pid").collect()}
    assert one[1500] == 2_000_000.0


def test_nearest_value_of_every_cell(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0)], "cell_id string, x double, y double")
    none = targets_of(spark, [(0, 0)]).where("false")
    assert [tuple(r) for r in metrics.nearest_distance(cells, none).orderBy("cell_id").collect()] == [("a", None, 0), ("b", None, 0)]


def test_strongest_target_has_no_cutoff(spark):
    rnd = random.Random(11)
    cells = spark.createDataFrame([(str(i), rnd.uniform(0, 30_000), rnd.uniform(0, 30_000)) for i in range(150)] + [("far", 600_000.0, 0.0)], "cell_id string, x double, y double")
    targets = targets_of(spark, [(rnd.uniform(0, 3000), rnd.uniform(0, 3000)) for _ in range(200)])
    quality = G.size_quality("area", 500, 0.2)
    got = {r[0]: (r[1], r[2]) for r in scoring.explain_targets(cells, targets, 900.0, quality).collect()}
    score = F.log(F.greatest(quality, F.lit(1e-300))) + F.greatest(-math.log(2) * F.pow(G.st_distance(F.col("geom"), "x", "y") / 900.0, 2.0), F.lit(-700.0))
    each = cells.crossJoin(targets).withColumn("s", score).groupBy("cell_id").agg(F.min(F.struct(-F.col("s"), "target_id")).alias("b"))
    want = {r[0]: (r[1]["target_id"], -r[1]["col1"]) for r in each.collect()}
    assert got.keys() == want.keys() and got["far"][1] == pytest.approx(-700 + math.log(0.2 + 0.8 * (1 - math.exp(-1990 / 500))))
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12) for k in want)
    assert scoring.explain_targets(cells, targets.where("false"), 900.0, quality).count() == 0


# Line clusters


def segment_gap(s, t):
    """Distance of two segments, by hand."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = *s, *t
    turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    if turn(s[0], s[1], t[0]) * turn(s[0], s[1], t[1]) < 0 and turn(t[0], t[1], s[0]) * turn(t[0], t[1], s[1]) < 0:
        return 0.0

    def to(p, a, b):
        ux, uy = b[0] - a[0], b[1] - a[1]
        n = ux * ux + uy * uy
        k = min(1, max(0, ((p[0] - a[0]) * ux + (p[1] - a[1]) * uy) / n)) if n else 0
        return math.hypot(p[0] - a[0] - k * ux, p[1] - a[1] - k * uy)

    return min(to((ax, ay), *t), to((bx, by), *t), to((cx, cy), *s), to((dx, dy), *s))


def clusters_by_hand(lines, gap):
    root = {i: i for i, _, _ in lines}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, k, p) in enumerate(lines):
        for j, m, q in lines[n + 1 :]:
            if k == m and min(segment_gap(s, t) for s in zip(p, p[1:], strict=False) for t in zip(q, q[1:], strict=False)) <= gap:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def lines_frame(spark, lines):
    df = geom_rows(spark, [(i, "LINESTRING", [[p]]) for i, _, p in lines])
    names = spark.createDataFrame([(i, k) for i, k, _ in lines], "id long, name string")
    return df.join(names, "id")


def test_crossing_roads_are_one_street(spark):
    lines = [(1, "x", [(0, 0), (200, 200)]), (2, "x", [(0, 200), (200, 0)]), (3, "x", [(1000, 0), (1200, 0)]), (4, "y", [(0, 0), (200, 200)])]
    got = {r["id"]: r["component"] for r in entities.cluster_lines(lines_frame(spark, lines), "id", "name", 5.0).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    pair = lines_frame(spark, lines[:1]).select(F.col("geom").alias("a")).crossJoin(lines_frame(spark, lines[1:2]).select(F.col("geom").alias("b")))
    assert pair.select(spatial.line_distance(F.col("a"), F.col("b"))).first()[0] == 0.0


@pytest.mark.parametrize(("gap", "seed"), [(30.0, 1), (12.5, 2), (0.0, 3)])
def test_line_clusters_equal_brute_force(spark, gap, seed):
    rnd = random.Random(seed)
    lines = []
    for i in range(140):
        x, y, turn = rnd.uniform(0, 900), rnd.uniform(0, 900), rnd.uniform(0, 7)
        pts = [(x + d * math.cos(turn + d / 200), y + d * math.sin(turn)) for d in (0, *sorted(rnd.uniform(5, 120) for _ in range(rnd.randint(1, 3))))]
        lines.append((i, rnd.choice("ab"), pts))
    lines += [(200, "a", [(2000, 0), (2100, 0)]), (201, "a", [(2000, 30), (2100, 30)]), (202, "a", [(2000, 60.001), (2100, 60.001)]), (203, "b", [(2000, 0), (2100, 0)]), (204, "b", [(2100, 0), (2200, 0)])]
    got = {r["id"]: r["component"] for r in entities.cluster_lines(lines_frame(spark, lines), "id", "name", gap).collect()}
    assert got == clusters_by_hand(lines, gap)


# Validity

BIG, BOW = square(0, 0, 10), [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]
CASES = [
    ("square", "POLYGON", [[BIG]], True),
    ("bow tie", "POLYGON", [[BOW]], False),
    ("concave", "POLYGON", [[[(0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0)]]], True),
    ("spike", "POLYGON", [[[(0, 0), (10, 0), (10, 10), (10, 20), (10, 10), (0, 10), (0, 0)]]], False),
    ("touches itself", "POLYGON", [[[(0, 0), (10, 0), (5, 5), (10, 10), (0, 10), (5, 5), (0, 0)]]], False),
    ("open", "POLYGON", [[[(0, 0), (1, 0), (1, 1), (0, 1)]]], False),
    ("no area", "POLYGON", [[[(0, 0), (1, 0), (2, 0), (0, 0)]]], False),
    ("hole", "POLYGON", [[BIG, square(2, 2, 3)]], True),
    ("hole outside", "POLYGON", [[BIG, square(20, 2, 3)]], False),
    ("hole across", "POLYGON", [[BIG, square(8, 2, 5)]], False),
    ("hole touches once", "POLYGON", [[BIG, [(0, 5), (3, 4), (3, 6), (0, 5)]]], True),
    ("hole touches twice", "POLYGON", [[BIG, [(0, 5), (5, 0), (5, 5), (0, 5)]]], False),
    ("hole along the shell", "POLYGON", [[BIG, square(0, 2, 3)]], False),
    ("holes share a side", "POLYGON", [[BIG, square(2, 2, 2), square(4, 2, 2)]], False),
    ("hole in a hole", "POLYGON", [[BIG, square(2, 2, 6), square(3, 3, 2)]], False),
    ("parts apart", "MULTIPOLYGON", [[BIG], [square(20, 0, 5)]], True),
    ("parts overlap", "MULTIPOLYGON", [[BIG], [square(5, 5, 10)]], False),
    ("part in a part", "MULTIPOLYGON", [[BIG], [square(2, 2, 3)]], False),
    ("part in a hole", "MULTIPOLYGON", [[BIG, square(2, 2, 6)], [square(3, 3, 2)]], True),
    ("equal parts", "MULTIPOLYGON", [[BIG], [BIG]], False),
    ("repeated point", "POLYGON", [[[(0, 0), (10, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]], True),
    ("not finite", "POLYGON", [[[(0, 0), (float("nan"), 0), (10, 10), (0, 10), (0, 0)]]], False),
    ("line", "LINESTRING", [[[(0, 0), (1, 1)]]], True),
    ("crossing line", "LINESTRING", [[BOW[:-1]]], True),
    ("one place", "LINESTRING", [[[(1, 1), (1, 1)]]], False),
    ("point", "POINT", [[[(1, 1)]]], True),
    ("empty", "POLYGON", [], False),
]


def test_validity_of_awkward_shapes(spark):
    df = geom_rows(spark, [(i, t, p) for i, (_, t, p, _) in enumerate(CASES)])
    got = {r["id"]: r["ok"] for r in df.select("id", G.st_is_valid(F.col("geom")).alias("ok")).collect()}
    assert {CASES[i][0]: ok for i, ok in got.items()} == {n: ok for n, _, _, ok in CASES}
    assert spark.range(1).select(G.st_is_valid(F.lit(None).cast(G.GEOMETRY))).first()[0] is False


def test_sweep_finds_the_crossings_that_pairs_find():
    rnd = np.random.default_rng(4)
    for n in (3, 8, 40, 300):
        ring = rnd.normal(size=(n, 2))
        ring = np.concatenate([ring, ring[:1]])
        assert validity.ring_crosses(ring) == (n > 3)
        angle = np.sort(rnd.uniform(0, 2 * np.pi, n))
        round_ = np.column_stack([np.cos(angle), np.sin(angle)])
        assert not validity.ring_crosses(np.concatenate([round_, round_[:1]]))
