"""The refresh job: two runs, another profile, and a run that is lost in each stage."""

import pytest
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import catalog
from urbanspark.plans import refresh

TAGS = "map<string,string>"


def snapshot(spark, without=(), renamed=False):
    def shapes(rows):
        df = spark.createDataFrame(rows, f"osm_id long, tags {TAGS}, gtype string, pts array<struct<x:double,y:double>>")
        g = F.when(F.col("gtype") == "POINT", G.point(F.get("pts", 0)["x"], F.get("pts", 0)["y"])).when(F.col("gtype") == "LINESTRING", G.line(F.col("pts"))).when(F.col("gtype") == "POLYGON", G.polygon(F.array("pts")))
        return df.select("osm_id", "tags", g.alias("geom")).where(~F.col("osm_id").isin(*without) if without else F.lit(True))

    nodes = shapes([(1, {"amenity": "cafe", "name": "New" if renamed else "Old"}, "POINT", [(0.0, 0.0)]), (2, {"amenity": "bench"}, "POINT", [(1.0, 1.0)])])
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    ways = shapes([(10, {}, "LINESTRING", [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]), (11, {}, "LINESTRING", [(9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]), (12, {"building": "yes"}, "POLYGON", bow)])
    relations = spark.createDataFrame([(20, "multipolygon", {"leisure": "park", "type": "multipolygon"}), (21, "route", {"route": "bus", "ref": "7"}), (22, "route_master", {"ref": "7"})], f"osm_id long, relation_type string, tags {TAGS}")
    members = spark.createDataFrame([(20, 0, "way", 10, "outer"), (20, 1, "way", 11, "outer"), (21, 0, "way", 10, ""), (21, 1, "node", 1, "stop"), (22, 0, "relation", 21, "")], "relation_id long, sequence int, member_type string, member_id long, role string")
    return {"nodes": nodes, "ways": ways, "relations": relations, "members": members}


@pytest.fixture(scope="module")
def rules(spark):
    return catalog.rules_frame(spark, [{"category": "food", "rule_id": "cafe", "conditions": [("amenity", "in", ["cafe"])]}, {"category": "park", "rule_id": "park", "conditions": [("leisure", "equals", ["park"])], "families": ["polygon"]}, {"category": "seat", "rule_id": "bench", "conditions": [("amenity", "equals", ["bench"])]}])


def tables(spark, path, run):
    store = refresh.Store(spark, path)
    return {n: sorted(map(str, store.read(n, run).drop("tags").collect())) for n in refresh.STATE}


def test_refresh_counts_and_lifecycle(spark, rules, tmp_path):
    path = str(tmp_path)
    one = refresh.refresh(spark, path, 1, "city", lambda: snapshot(spark), rules)
    assert one["staged"] == {"nodes": 2, "ways": 3, "relations": 3, "members": 5}
    assert one["derived"] == {"assembled": 2, "route_variants": 1}
    # two nodes, two lines and the area: the bow tie isn't valid, route and master aren't objects
    assert one["canonical"] == {"created": 5, "requested": 8, "excluded": 3, "memberships": 8}
    assert one["categories"] == {"candidates": 5, "matches": 3, "evidence": 3, "active": 3, "categories": 3}
    assert one["finalized"] == {"missing_memberships": 0, "missing_bindings": 0, "affected_objects": 0, "active_objects": 5, "inactive_evidence": 0}

    two = refresh.refresh(spark, path, 2, "city", lambda: snapshot(spark, without=(2,), renamed=True), rules)
    assert two["canonical"]["changed"] == 1 and two["canonical"]["absent"] == 1 and two["canonical"]["unchanged"] == 3
    assert two["finalized"] == {"missing_memberships": 1, "missing_bindings": 1, "affected_objects": 1, "active_objects": 4, "inactive_evidence": 1}
    store = refresh.Store(spark, path)
    assert store.current() == 2
    status = {r["category"]: r["status"] for r in store.read("categories", 2).collect()}
    assert status == {"food": "active", "park": "active", "seat": "inactive"}
    assert {r["name"] for r in store.read("objects", 2).where("name IS NOT NULL").collect()} == {"New"}
    with pytest.raises(ValueError):
        refresh.refresh(spark, path, 1, "city", lambda: snapshot(spark), rules)
    back = refresh.refresh(spark, path, 3, "city", lambda: snapshot(spark), rules)
    assert back["finalized"]["active_objects"] == 5 and back["finalized"]["affected_objects"] == 1


def test_another_authoritative_profile_keeps_objects(spark, rules, tmp_path):
    path, both = str(tmp_path), ("city", "region")
    refresh.refresh(spark, path, 1, "region", lambda: snapshot(spark), rules, both)
    refresh.refresh(spark, path, 2, "city", lambda: snapshot(spark), rules, both)
    out = refresh.refresh(spark, path, 3, "city", lambda: snapshot(spark, without=(1,)), rules, both)
    assert out["finalized"]["missing_memberships"] == 1 and out["finalized"]["missing_bindings"] == 0 and out["finalized"]["active_objects"] == 5


def test_a_lost_run_resumes_to_the_same_tables(spark, rules, tmp_path):
    whole = str(tmp_path / "whole")
    refresh.refresh(spark, whole, 1, "city", lambda: snapshot(spark), rules)
    lost = str(tmp_path / "lost")
    asked = []

    def inputs():
        asked.append(1)
        return snapshot(spark)

    for stage in ("staged", "categories"):
        out = refresh.refresh(spark, lost, 1, "city", inputs, rules, stop_after=stage)
        assert list(out)[-1] == stage and refresh.Store(spark, lost).current() is None
    # a half-written table of the next stage is written anew
    spark.range(3).write.parquet(f"{lost}/memberships/run=1")
    refresh.refresh(spark, lost, 1, "city", inputs, rules)
    assert tables(spark, lost, 1) == tables(spark, whole, 1) and len(asked) == 1
    with pytest.raises(RuntimeError):
        refresh.refresh(spark, lost, 2, "city", lambda: (_ for _ in ()).throw(RuntimeError("no source")), rules)
    store = refresh.Store(spark, lost)
    assert store.current() == 1 and store.ledger().where("state = 'failed'").count() == 1
