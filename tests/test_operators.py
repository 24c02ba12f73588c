import pytest
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import audits, catalog, entities, merge, metrics, scoring, search, spatial
from urbanspark.plans import synth
from urbanspark.sources import assembly, features, osm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def three_cells(spark):
    rows = [("a", 500000.0, 6650100.0), ("b", 500400.0, 6650100.0), ("c", 502000.0, 6650100.0)]
    return spark.createDataFrame(rows, "cell_id string, x double, y double")


@pytest.fixture(scope="module")
def three_targets(spark):
    base = spark.range(1)
    point = base.select(F.lit("p").alias("target_id"), G.point(500000.0, 6650100.0).alias("geom"))
    area = base.select(F.lit("f").alias("target_id"), G.rectangle(500300.0, 6650000.0, 500500.0, 6650200.0).alias("geom"))
    way = base.select(F.lit("w").alias("target_id"), G.line(F.array(G.xy(F.lit(501900.0), F.lit(6650500.0)), G.xy(F.lit(502100.0), F.lit(6650500.0)))).alias("geom"))
    return point.union(area).union(way).withColumn("category", F.lit("k")).withColumn("area", G.st_area(F.col("geom")))


def values(df):
    return [r["raw_value"] for r in df.orderBy("cell_id").collect()]


def test_metric_golden_values(three_cells, three_targets):
    assert values(metrics.nearest_distance(three_cells, three_targets)) == [0, 0, 400]
    assert values(metrics.count_within_radius(three_cells, three_targets, {"radius": 250})) == [1, 1, 0]
    assert values(metrics.count_within_radius(three_cells, three_targets, {"radius": 400})) == [2, 2, 1]
    assert values(metrics.smooth_influence(three_cells, three_targets, {"radius": 500})) == pytest.approx([1.4096, 1.1296, 0.1296])


def test_metric_config_is_checked(three_cells, three_targets):
    with pytest.raises(ValueError):
        metrics.count_within_radius(three_cells, three_targets, {"radius": 0})
    with pytest.raises(ValueError):
        metrics.primary_accessibility(three_cells, three_targets, {"half": 100, "cap": 0.5})


def test_nearest_equals_brute_force(spark):
    cells = synth.cells(spark, SF, 1000)
    targets = synth.targets(synth.areas(spark, SF)).where("target_id % 7 = 0")
    got = {r[0]: r[1] for r in spatial.nearest(cells, targets, "cell_id").collect()}
    brute = cells.crossJoin(targets).groupBy("cell_id").agg(F.min(G.st_distance(F.col("geom"), "x", "y")).alias("d"))
    want = {r[0]: r[1] for r in brute.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nearest_without_targets(spark, three_cells, three_targets):
    assert spatial.nearest(three_cells, three_targets.where("false"), "cell_id").count() == 0


def test_curve_and_weights(spark):
    xs, ys = F.array(*map(F.lit, (0.0, 10.0, 20.0))), F.array(*map(F.lit, (100.0, 50.0, 0.0)))
    df = spark.createDataFrame([(v,) for v in (-5.0, 5.0, 10.0, 15.0, 25.0)], "v double")
    assert [r[0] for r in df.select(scoring.curve_value(F.col("v"), xs, ys)).collect()] == [100, 75, 50, 25, 0]
    for bad in ([(0, 0)], [(0, 0), (0, 1)], [(0, 0), (1, 101)], [(0, 0), (1, 50), (2, 20)]):
        with pytest.raises(ValueError):
            scoring.check_curve(bad)
    for bad in ({"a": -1.0}, {"a": 101.0}, {"a": float("nan")}, {"a": 0.0}, {}):
        with pytest.raises(ValueError):
            scoring.check_weights(bad)


def test_composite_of_opposite_curves_is_even(spark):
    values_ = spark.createDataFrame([(m, c, v) for m in ("up", "down") for c, v in (("a", 0.0), ("b", 10.0), ("c", 20.0))], "metric_key string, cell_id string, raw_value double")
    scores = scoring.normalize(values_, scoring.curves_frame(spark, {"up": [(0, 0), (20, 100)], "down": [(0, 100), (20, 0)]}))
    out = scoring.composite(scores, scoring.weights_frame(spark, {"up": 1.0, "down": 1.0}))
    assert {r["composite"] for r in out.collect()} == {50.0}
    top = scoring.top_cells(scoring.composite(scores.where("metric_key = 'up'"), scoring.weights_frame(spark, {"up": 1.0})), 3).collect()
    assert [r["composite"] for r in top] == [100, 50, 0] and top[0]["mean_score"] == 50


def test_rule_operators(spark):
    rules = catalog.rules_frame(spark, [
        {"category": "a", "rule_id": "1", "conditions": [("k", "not_equals", ["x"])]},
        {"category": "b", "rule_id": "2", "conditions": [("k", "in", ["x", "y"]), ("m", "exists", [])]},
        {"category": "c", "rule_id": "3", "conditions": [("k", "equals", ["x"])], "families": ["line"]},
    ])
    objects = spark.createDataFrame([(1, "node", "point", "feature", {}), (2, "node", "point", "feature", {"k": "x", "m": "1", "z": "0"}), (3, "way", "line", "feature", {"k": "x"})], "binding_id int, source_type string, family string, kind string, tags map<string,string>")
    got = {(r["binding_id"], r["rule_id"], tuple(sorted(r["evidence"].items()))) for r in catalog.rule_matches(objects, rules).collect()}
    assert got == {(1, "1", ()), (2, "2", (("k", "x"), ("m", "1"))), (3, "3", (("k", "x"),))}


def test_link_evidence(spark):
    rows = [("1", "2", "", "", True), ("1", "1", "", "", False), ("", "", "n", "n", True), ("", "", "", "", True)]
    pairs = spark.createDataFrame(rows, "p_ref string, a_ref string, p_name string, a_name string, contained boolean").withColumn("a_role", F.lit("FACILITY_SITE"))
    out = entities.link_evidence(pairs, have=["ref", "name"]).collect()
    assert [(r["rejected"], r["methods"]) for r in out] == [("contradictory_ref", []), (None, ["exact_ref"]), (None, ["exact_name_site_contained"]), (None, [])]


def test_merge_is_idempotent_and_order_free(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    again = merge.merge_counts(merge.merge_snapshot(a, a.repartition(3), ["k"], ["v"])).first()
    assert tuple(again) == (3, 0, 0, 3)
    one, two = (merge.table_checksum(d, ["k", "v"]).first() for d in (a, a.orderBy(F.desc("k"))))
    assert one == two and one != merge.table_checksum(a.where("k > 1"), ["k", "v"]).first()


def test_publish_is_idempotent(spark, tmp_path):
    values_ = spark.createDataFrame([("c", 1.0)], "cell_id string, raw_value double")
    stats = {"metric_key": "m", "grid_version": "g", "run_id": "r", "signature": "s", "checksum": "c"}
    assert merge.publish(values_, stats, None, str(tmp_path)) == "CREATED"
    ledger = spark.read.parquet(f"{tmp_path}/ledger")
    assert merge.publish(values_, stats, ledger, str(tmp_path)) == "UNCHANGED"
    with pytest.raises(ValueError):
        merge.publish(values_, stats | {"checksum": "d"}, ledger, str(tmp_path))


def test_components_of_a_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in spatial.components(edges).groupBy("component").count().collect()} == {(0, 301)}
    assert spatial.components(edges.where("false")).count() == 0


def test_area_assembly_with_a_hole(spark):
    def way(rel, seq, *pts):
        return (rel, seq, [{"x": float(x), "y": float(y)} for x, y in pts])

    rows = [way(1, 0, (0, 0), (4, 0), (4, 4)), way(1, 1, (0, 0), (0, 4), (4, 4)), way(1, 2, (1, 1), (3, 1), (3, 3), (1, 3), (1, 1)), way(2, 0, (0, 0), (1, 1))]
    ways = spark.createDataFrame(rows, "relation_id long, sequence int, pts array<struct<x:double,y:double>>").select("relation_id", "sequence", G.line(F.col("pts")).alias("geom"))
    out = {r[0]: r[1] for r in assembly.assemble_areas(ways).select("relation_id", G.st_area(F.col("geom")).alias("a")).collect()}
    assert out[1] == 12.0
    routes = {r[0]: r[1] for r in assembly.assemble_routes(ways).select("relation_id", F.size("geom.parts")).collect()}
    assert routes == {1: 2, 2: 1}


def test_rings_to_polygon(spark):
    square, hole = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]
    far = [[x + 10, y] for x, y in square]
    bow, touching = [[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 2.0]], [[0.0, 0.0], [2.0, 1.0], [1.0, 2.0], [0.0, 0.0]]
    df = spark.createDataFrame([(1, [square, hole]), (2, [square, far]), (3, [[[0.0, 0.0], [1.0, 1.0]]]), (4, [[[0.0, 0.0], [200.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]), (5, None), (6, [square, hole[:3]]), (7, [bow]), (8, [square, touching])], "feature_id int, rings array<array<array<double>>>")
    out = {r["feature_id"]: (r["gtype"], r["problem"]) for r in features.rings_to_polygon(df).select("feature_id", "geom.gtype", "problem").collect()}
    assert out == {1: ("POLYGON", None), 2: ("MULTIPOLYGON", None), 3: (None, "short_ring"), 4: (None, "out_of_range"), 5: (None, "empty"), 6: (None, "short_ring"), 7: (None, "self_crossing"), 8: ("POLYGON", None)}


def test_limit_guard(spark):
    assert search.limit_guard(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        search.limit_guard(spark.range(4), 3)


def test_street_ids_keep_the_largest_claim(spark):
    groups = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13)], "component long, member long")
    old = spark.createDataFrame([("e", 10), ("e", 11), ("e", 12)], "entity_id string, member long")
    out = {r["component"]: (r["entity_id"] == "e", r["reused"]) for r in entities.resolve_street_ids(groups, old).collect()}
    assert out == {1: (True, True), 2: (False, False), 3: (False, False)}


def test_write_version(spark, tmp_path):
    path = merge.write_version(spark.range(3), str(tmp_path), "v1")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        merge.write_version(spark.range(3), str(tmp_path), "v1")


def test_districts_are_polygons_not_boxes(spark):
    ring = F.array(*(G.xy(F.lit(float(x)), F.lit(float(y))) for x, y in [(0, 0), (100, 0), (0, 100), (0, 0)]))
    district = spark.range(1).select(F.lit("d").alias("district_id"), G.polygon(F.array(ring)).alias("geom"))
    inside, outside = (G.point(F.lit(v), F.lit(v)) for v in (20.0, 90.0))
    objects = spark.range(2).select("id", F.lit("k").alias("category"), F.when(F.col("id") == 0, inside).otherwise(outside).alias("geom"))
    assert [(r["district_id"], r["n"]) for r in spatial.district_counts(objects, district, []).collect()] == [("d", 1)]
    assert [r["n"] for r in audits.category_totals(objects, district).collect()] == [1]
    members = objects.select(F.col("id").alias("object_id"), "category", "geom", F.lit(None).cast("string").alias("facility_id"), F.lit(None).cast(objects.schema["geom"].dataType).alias("display_geom"))
    assert [r[0] for r in search.features(members, (0, 0, 200, 200), ["k"], districts=district).collect()] == ["o:0"]


def test_nearest_reaches_any_distance(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 5e6, 0.0)], "cell_id long, x double, y double")
    target = spark.range(1).select(F.lit("t").alias("target_id"), G.point(F.lit(4e6), F.lit(0.0)).alias("geom"))
    got = {r["cell_id"]: r["distance"] for r in spatial.nearest(points, target, "cell_id").collect()}
    assert got == {1: 4e6, 3: 1e6}
    assert spatial.nearest(points, target.where("false"), "cell_id").count() == 0


def test_paths_are_ways_that_are_no_platform(spark):
    rows = [(1, 0, "way", 5, "stop_entry", "path", None, True), (1, 1, "way", 6, "platform", "platform", None, False), (1, 2, "node", 7, "stop", "stop_position", None, True), (2, 0, "way", 8, "", "path", None, False), (2, 1, "relation", 9, "", "relation", None, True)]
    members = spark.createDataFrame(rows, "relation_id long, sequence int, member_type string, member_id long, role string, kind string, name string, resolved boolean")
    got = {r["relation_id"]: r.asDict() for r in osm.route_status(members.withColumns({"has_geom": F.lit(True), "geom_ok": F.lit(True)})).collect()}
    assert [got[1][k] for k in ("paths", "stops", "unresolved_stops", "platforms", "unresolved_platforms", "status")] == [1, 2, 1, 1, 1, "assembled"]
    assert [got[2][k] for k in ("paths", "missing_paths", "nested", "status")] == [1, 1, 1, "partial"]


def test_categories_roll_up_by_object(spark):
    evidence = spark.createDataFrame([(1, "park", "r", "inactive", 1), (2, "park", "r", "active", 1), (3, "park", "r", "inactive", 1)], "binding_id long, category string, rule_id string, status string, first_run int")
    bindings = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "binding_id long, object_id long")
    assert {(r["object_id"], r["status"]) for r in catalog.object_categories(evidence, bindings).collect()} == {(10, "active"), (11, "inactive")}
