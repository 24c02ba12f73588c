"""Assembly against golden cases and a plain stitcher."""

import random

import pytest
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.sources import assembly


def lines_frame(spark, rows):
    plain = [(r, s, "LINESTRING", [[[(float(x), float(y)) for x, y in pts]]]) for r, s, pts in rows]
    df = spark.createDataFrame(plain, f"relation_id long, sequence int, gtype string, parts {G.PARTS}")
    return df.select("relation_id", "sequence", G.geometry(F.col("gtype"), F.col("parts")).alias("geom"))


def cut_ring(rnd, ring, relation, start):
    """A closed ring as scattered pieces, some of them turned round."""
    at = sorted(rnd.sample(range(1, len(ring) - 1), k=min(len(ring) - 2, rnd.randint(1, 6))))
    pieces = [ring[a : b + 1] for a, b in zip([0, *at], [*at, len(ring) - 1], strict=True)]
    pieces = [p[::-1] if rnd.random() < 0.5 else p for p in pieces]
    rnd.shuffle(pieces)
    return [(relation, start + i, p) for i, p in enumerate(pieces)]


def circle(x, y, r, n):
    import math

    pts = [(round(x + r * math.cos(2 * math.pi * k / n), 3), round(y + r * math.sin(2 * math.pi * k / n), 3)) for k in range(n)]
    return [*pts, pts[0]]


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))) / 2


def test_rings_of_any_length_come_together(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for relation in range(40):
        outer, hole, apart = circle(0, 0, 100, rnd.randint(4, 60)), circle(0, 0, 20, rnd.randint(3, 20)), circle(500, 0, 50, rnd.randint(3, 30))
        use = [outer, *([hole] if relation % 2 else []), *([apart] if relation % 3 == 0 else [])]
        for ring in use:
            rows += cut_ring(rnd, ring, relation, sum(r == relation for r, _, _ in rows))
        want[relation] = ("MULTIPOLYGON" if relation % 3 == 0 else "POLYGON", area(outer) - (area(hole) if relation % 2 else 0) + (area(apart) if relation % 3 == 0 else 0))
    long = circle(0, 0, 1000, 3000)
    rows += [(99, i, pts) for i, pts in enumerate(zip(long, long[1:], strict=False))]
    want[99] = ("POLYGON", area(long))
    got = assembly.assemble_areas(lines_frame(spark, rows)).select("relation_id", "geom.gtype", G.st_area(F.col("geom")).alias("a"), G.st_is_valid(F.col("geom")).alias("ok")).collect()
    assert {r["relation_id"]: r["gtype"] for r in got} == {k: t for k, (t, _) in want.items()}
    assert all(r["ok"] and r["a"] == pytest.approx(want[r["relation_id"]][1], rel=1e-9) for r in got)


def test_rings_that_share_a_place_and_lines_that_stay_open(spark):
    rows = [
        (1, 0, [(0, 0), (10, 0), (10, 10)]), (1, 1, [(10, 10), (0, 10), (0, 0)]), (1, 2, [(10, 10), (20, 10), (20, 20)]), (1, 3, [(20, 20), (10, 20), (10, 10)]),
        (2, 0, [(0, 0), (10, 0), (10, 10)]),
        (3, 0, [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]), (3, 1, [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]), (3, 2, [(50, 50), (60, 60)]),
    ]
    got = {r["relation_id"]: (r["geom"]["gtype"] if r["geom"] else None, r["a"]) for r in assembly.assemble_areas(lines_frame(spark, rows)).withColumn("a", G.st_area(F.col("geom"))).collect()}
    assert got == {1: ("MULTIPOLYGON", 200.0), 2: (None, 0.0), 3: ("POLYGON", 100.0)}


def test_routes_merge_where_two_ends_meet(spark):
    rows = [
        (1, 0, [(0, 0), (1, 0)]), (1, 1, [(2, 0), (1, 0)]), (1, 2, [(2, 0), (3, 0)]), (1, 3, [(1, 0), (0, 0)]),
        (2, 0, [(0, 0), (5, 0)]), (2, 1, [(5, 0), (9, 0)]), (2, 2, [(5, 0), (5, 9)]),
        (3, 0, [(0, 0), (4, 0), (4, 4)]), (3, 1, [(4, 4), (0, 0)]),
        (4, 0, [(i := 0, 0), (1, 0)]),
    ]
    rows += [(5, k, [(k, 0), (k + 1, 0)] if k % 2 else [(k + 1, 0), (k, 0)]) for k in range(700)]
    got = {r["relation_id"]: sorted(len(p[0]) for p in r["geom"]["parts"]) for r in assembly.assemble_routes(lines_frame(spark, rows)).collect()}
    assert got == {1: [4], 2: [2, 2, 2], 3: [4], 4: [2], 5: [701]}


def test_statuses_follow_the_assembled_shapes(spark):
    square = [(1, [(0, 0), (10, 0), (10, 10)]), (2, [(10, 10), (0, 10), (0, 0)]), (3, [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)])]
    lines = lines_frame(spark, [(0, i, p) for i, p in square]).select(F.col("sequence").cast("long").alias("osm_id"), "geom")
    ways = lines.unionByName(spark.createDataFrame([(9,)], "osm_id long").withColumn("geom", F.lit(None).cast(G.GEOMETRY)))
    M = "relation_id long, sequence int, member_type string, member_id long, role string"
    members = spark.createDataFrame([
        (1, 0, "way", 1, "outer"), (1, 1, "way", 2, ""), (1, 2, "node", 5, "label"),
        (2, 0, "way", 1, ""), (2, 1, "way", 77, ""),
        (3, 0, "way", 1, ""), (3, 1, "way", 2, ""), (3, 2, "way", 9, "inner"),
        (4, 0, "way", 3, "outer"),
        (5, 0, "way", 1, ""), (5, 1, "way", 2, ""), (5, 2, "relation", 1, "outer"),
        (6, 0, "way", 1, ""), (6, 1, "way", 2, ""), (6, 2, "relation", 88, "subarea"),
        (7, 0, "node", 5, "label"),
    ], M)
    known = spark.createDataFrame([(i,) for i in range(1, 8)], "osm_id long")
    got = {r["relation_id"]: r for r in assembly.area_relations(members, ways, known).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "assembled", 2: "incomplete", 3: "partial", 4: "invalid", 5: "unsupported_nested", 6: "assembled", 7: "invalid"}
    r = got[6]
    assert (r["member_count"], r["way_members"], r["nested_relation_members"], r["geometry_relation_members"], r["missing_relation_members"], r["geometry_type"], r["is_valid"]) == (3, 2, 1, 0, 1, "POLYGON", True)
    assert (got[3]["null_way_geometries"], got[2]["missing_way_members"], got[4]["is_valid"], got[7]["is_valid"]) == (1, 1, False, None)

    nodes = spark.createDataFrame([(5,)], "osm_id long")
    routes = spark.createDataFrame([
        (1, 0, "way", 1, ""), (1, 1, "way", 2, "forward"), (1, 2, "node", 5, "stop"), (1, 3, "node", 6, "stop_exit_only"), (1, 4, "way", 3, "platform"), (1, 5, "relation", 99, "platform"),
        (2, 0, "node", 5, "stop"), (2, 1, "way", 1, "platform"), (3, 0, "way", 77, ""), (4, 0, "way", 1, None), (4, 1, "way", 9, ""), (5, 0, "way", 1, "stop"), (5, 1, "relation", 1, ""),
    ], M)
    got = {r["relation_id"]: r for r in assembly.route_relations(routes, nodes, ways, known).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "assembled", 2: "incomplete", 3: "incomplete", 4: "partial", 5: "assembled"}
    r = got[1]
    assert (r["path_members"], r["present_path_geometries"], r["stop_members"], r["unresolved_stop_members"], r["platform_members"], r["unresolved_platform_members"], r["nested_relation_members"]) == (2, 2, 2, 1, 2, 1, 1)
    assert got[5]["unresolved_stop_members"] == 1 and got[5]["nested_relation_members"] == 1 and r["geometry_type"] == "MULTILINESTRING"
