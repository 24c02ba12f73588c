"""Raw map snapshots as tables: features, geometries, extracts, relation assembly and routes.

Inputs are nodes (osm_id, lon, lat, tags), ways (osm_id, refs, tags) and relations
(osm_id, members array of struct(type, ref, role), tags).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.functions.session import broadcast_if_small, checkpointed

SCHEMAS = {
    "nodes": "osm_id long, lon double, lat double, tags map<string,string>",
    "ways": "osm_id long, refs array<long>, tags map<string,string>",
    "relations": "osm_id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>",
}
#: Keys that make a closed way an area: fixed values.
AREA_KEYS = ("amenity", "building", "building:part", "landuse", "leisure", "natural", "water", "healthcare")
KINDS = {"n": "node", "w": "way", "r": "relation"}
CLOSURE_TYPES = ("multipolygon", "boundary", "route", "route_master")
#: Relation types that have derived geometries.
DERIVED_TYPES = ("multipolygon", "boundary", "route")


def read_osm(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()}


def tagged_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.size("tags") > 0).withColumn("geom", G.point("lon", "lat"))


def is_area(tags: Column) -> Column:
    value = F.try_element_at(tags, F.lit("area"))
    keyed = F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, AREA_KEYS)))
    return F.when(value == "yes", True).when(value == "no", False).otherwise(F.coalesce(keyed, F.lit(False)))


def way_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with geom: a closed, area-like way is a polygon, any other with two places a line.

    Each way's places are gathered by position; a way is as long as its references.
    """
    places = ways.select("osm_id", F.posexplode("refs").alias("pos", "ref"))
    at = places.join(nodes.select(F.col("osm_id").alias("ref"), "lon", "lat"), "ref").groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("ps"))
    points = F.transform("ps", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = (F.size("pts") >= 4) & (F.element_at("refs", 1) == F.element_at("refs", -1)) & (F.size("pts") == F.size("refs"))
    joined = ways.join(at.select("osm_id", points.alias("pts")), "osm_id", "left")
    shape = F.when(closed & is_area(F.col("tags")), G.polygon(F.array("pts"))).when(F.size("pts") >= 2, G.line(F.col("pts")))
    return joined.withColumn("geom", shape).drop("pts")


def member_ways(ways: DataFrame, members: DataFrame) -> DataFrame:
    """Ways with tags, and untagged ones that a relation has as members."""
    used = members.where("member_type = 'way'").select(F.col("member_id").alias("osm_id")).distinct().withColumn("__m", F.lit(True))
    return ways.join(used, "osm_id", "left").where((F.size("tags") > 0) | F.col("__m")).drop("__m")


def relation_members(relations: DataFrame) -> DataFrame:
    """(relation_id, sequence from 0, member_type, member_id, role); a null role is empty."""
    m = F.col("m")
    kind = F.col("m.type")
    for short, long in KINDS.items():
        kind = F.when(m["type"] == short, long).otherwise(kind)
    rows = relations.select(F.col("osm_id").alias("relation_id"), F.posexplode("members").alias("sequence", "m"))
    return rows.select("relation_id", "sequence", kind.alias("member_type"), m["ref"].alias("member_id"), F.coalesce(m["role"], F.lit("")).alias("role"))


def extract_bbox(nodes: DataFrame, way_refs: DataFrame, members: DataFrame, box: tuple[float, float, float, float], x: str = "lon", y: str = "lat") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Simple extract: nodes inside, ways with one of them, relations with any such member; nothing is completed."""
    x0, y0, x1, y1 = box
    inside = nodes.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return _extract(inside, way_refs, members)


def _extract(inside: DataFrame, way_refs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    ways = way_refs.join(inside.select(F.col("osm_id").alias("node_id")), "node_id", "left_semi").select("way_id").distinct()
    kept = inside.select(F.lit("node").alias("member_type"), F.col("osm_id").alias("member_id")).union(ways.select(F.lit("way"), "way_id"))
    relations = members.join(kept, ["member_type", "member_id"], "left_semi").select("relation_id").distinct()
    return inside, ways, relations


def extract_polygon(nodes: DataFrame, way_refs: DataFrame, members: DataFrame, polygon: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same inside one polygon: ``polygon`` must have one row (geom)."""
    if polygon.limit(2).count() != 1:
        raise ValueError("exactly one polygon is required")
    inside = nodes.join(broadcast_if_small(polygon.select(F.col("geom").alias("__g")), 1), G.st_covers(F.col("__g"), "lon", "lat"), "left_semi")
    return _extract(inside, way_refs, members)


def reference_closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id) of everything reachable from ``start`` (kind, id) over edges (kind, id, to_kind, to_id).

    A frontier join for each level of nesting; ends when a level adds nothing.
    """
    seen = checkpointed(start.select("kind", "id").distinct())
    frontier = seen
    while not frontier.isEmpty():
        step = edges.join(frontier, ["kind", "id"]).select(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")).distinct()
        frontier = checkpointed(step.join(seen, ["kind", "id"], "left_anti"))
        seen = checkpointed(seen.union(frontier))
    return seen


def reference_edges(members: DataFrame, way_refs: DataFrame) -> DataFrame:
    """(kind, id, to_kind, to_id) of relations to their members and ways to their nodes."""
    edges = members.select(F.lit("relation").alias("kind"), F.col("relation_id").alias("id"), F.col("member_type").alias("to_kind"), F.col("member_id").alias("to_id"))
    return edges.unionByName(way_refs.select(F.lit("way").alias("kind"), F.col("way_id").alias("id"), F.lit("node").alias("to_kind"), F.col("node_id").alias("to_id")))


def extract_relations(relation_ids: DataFrame, members: DataFrame, way_refs: DataFrame) -> DataFrame:
    """(kind, id) of the named relations (relation_id) and everything that they reference, down to the nodes of ways."""
    start = relation_ids.select(F.lit("relation").alias("kind"), F.col("relation_id").alias("id"))
    return reference_closure(start, reference_edges(members, way_refs))


def complete_references(selected: DataFrame, members: DataFrame, way_refs: DataFrame, relation_types: DataFrame, existing: DataFrame) -> DataFrame:
    """(kind, id, missing): selected ways and relations of closure types, their route masters, and all they reference."""
    typed = relation_types.where(F.col("relation_type").isin(*CLOSURE_TYPES)).select(F.col("relation_id").alias("id"))
    base = selected.where("kind = 'way'").unionByName(selected.where("kind = 'relation'").join(typed, "id", "left_semi").select("kind", "id"))
    masters = relation_types.where("relation_type = 'route_master'").select("relation_id")
    parents = members.join(masters, "relation_id", "left_semi").join(base.where("kind = 'relation'").select(F.col("id").alias("member_id")), "member_id", "left_semi").where("member_type = 'relation'")
    base = base.unionByName(parents.select(F.lit("relation").alias("kind"), F.col("relation_id").alias("id")))
    found = reference_closure(base, reference_edges(members, way_refs))
    return found.join(existing.select("kind", "id", F.lit(True).alias("__there")), ["kind", "id"], "left").select("kind", "id", F.col("__there").isNull().alias("missing"))


# Assembly


def nest(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons of rings by even-odd depth: even rings are outer, odd ones holes of the innermost outer around them.

    A ring is inside a larger one that holds a point of its inside, so rings may share points.
    """
    area = [abs(np.sum(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1])) for r in rings]
    inner = [G._representative("POLYGON" if a else "POINT", [[r]]) for r, a in zip(rings, area, strict=True)]
    around = [[j for j, o in enumerate(rings) if area[j] > area[i] and G._holds([o], p["x"], p["y"])] for i, p in enumerate(inner)]
    outers = [i for i in range(len(rings)) if len(around[i]) % 2 == 0]
    parts = {i: [rings[i]] for i in outers}
    for i, holders in enumerate(around):
        if len(holders) % 2:
            own = [j for j in holders if j in parts]
            parts[max(own, key=lambda j: len(around[j]))].append(rings[i])
    return list(parts.values())


def _struct(parts: list[list[np.ndarray]], gtype: str) -> dict:
    every = np.concatenate([r for p in parts for r in p])
    return {"gtype": gtype, "parts": [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in parts], "xmin": float(every[:, 0].min()), "ymin": float(every[:, 1].min()), "xmax": float(every[:, 0].max()), "ymax": float(every[:, 1].max())}


def area_status(members: DataFrame) -> DataFrame:
    """Status and counters of area relations.

    members: (relation_id, member_type, role, resolved, has_geom), with ``area_ok`` null for
    no assembled geometry, else its validity.
    """
    way = F.col("member_type") == "way"
    n = members.groupBy("relation_id").agg(
        F.count("*").alias("members"),
        F.count_if(way).alias("ways"),
        F.count_if(way & ~F.col("resolved")).alias("missing_ways"),
        F.count_if(way & F.col("resolved") & ~F.col("has_geom")).alias("null_ways"),
        F.count_if((F.col("member_type") == "relation") & F.col("role").isin("", "outer", "inner")).alias("nested"),
        F.count_if(way & (F.col("role") == "inner")).alias("inner_ways"),
        F.max("area_ok").alias("area_ok"),
    )
    lacking = F.col("missing_ways") + F.col("null_ways") > 0
    none = F.col("area_ok").isNull()
    status = F.when(F.col("nested") > 0, "unsupported_nested").when(lacking & none, "incomplete").when(lacking, "partial").when(none | ~F.col("area_ok"), "invalid").otherwise("assembled")
    return n.withColumn("status", status).drop("area_ok")


def member_kind(member_type: Column, role: Column) -> Column:
    return F.when(role.startswith("stop"), "stop_position").when(role.startswith("platform"), "platform").when(member_type == "way", "path").when(member_type == "relation", "relation").otherwise("other")


def route_members(members: DataFrame, objects: DataFrame) -> DataFrame:
    """Ordered route members with kind, tags and whether they are there. objects: (member_type, member_id, name)."""
    there = objects.withColumn("__there", F.lit(True))
    return members.join(there, ["member_type", "member_id"], "left").select("relation_id", "sequence", "member_type", "member_id", "role", member_kind(F.col("member_type"), F.col("role")).alias("kind"), "name", F.col("__there").isNotNull().alias("resolved"))


def route_status(members: DataFrame) -> DataFrame:
    """Status and counters of routes. members: route_members' columns with has_geom, geom_ok (null: no geometry).

    Every way whose role isn't a platform's is a path, those with a stop's role too; a stop
    is there only as a node.
    """
    way, role = F.col("member_type") == "way", F.coalesce("role", F.lit(""))
    stop, platform = role.startswith("stop"), role.startswith("platform")
    path = way & ~platform
    n = members.groupBy("relation_id").agg(
        F.count("*").alias("members"),
        F.count_if(path).alias("paths"),
        F.count_if(path & ~F.col("resolved")).alias("missing_paths"),
        F.count_if(path & F.col("resolved") & ~F.col("has_geom")).alias("null_paths"),
        F.count_if(stop).alias("stops"),
        F.count_if(platform).alias("platforms"),
        F.count_if(stop & ~((F.col("member_type") == "node") & F.col("resolved"))).alias("unresolved_stops"),
        F.count_if(platform & ~F.col("resolved")).alias("unresolved_platforms"),
        F.count_if(F.col("member_type") == "relation").alias("nested"),
        F.max("geom_ok").alias("geom_ok"),
    )
    none = F.col("geom_ok").isNull()
    lacking = F.col("missing_paths") + F.col("null_paths") > 0
    status = F.when(F.col("paths") == 0, "incomplete").when(lacking & none, "incomplete").when(lacking, "partial").when(none | ~F.col("geom_ok"), "invalid").otherwise("assembled")
    return n.withColumn("status", status).drop("geom_ok")


def route_variants(members: DataFrame, relations: DataFrame) -> DataFrame:
    """route_master to route: relations (relation_id, relation_type, mode, ref, name)."""
    masters = relations.where("relation_type = 'route_master'").select("relation_id", F.col("ref").alias("master_ref"))
    routes = relations.where("relation_type = 'route'").select(F.col("relation_id").alias("member_id"), "mode", "ref", "name")
    held = members.where("member_type = 'relation'").join(masters, "relation_id")
    return held.join(routes, "member_id", "left").select("relation_id", "sequence", "member_id", "master_ref", "mode", "ref", "name", F.col("ref").isNotNull().alias("resolved"))


def drop_unsupported(derived: DataFrame, relations: DataFrame, supported: Sequence[str] = DERIVED_TYPES) -> DataFrame:
    """Derived rows without those whose relation came again with a type that isn't supported; relations that didn't come stay."""
    gone = relations.where(~F.coalesce("relation_type", F.lit("")).isin(*supported)).select("relation_id").distinct()
    return derived.join(gone, "relation_id", "left_anti")


def staged_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(staged, n): rows of each staged table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("staged"), "n") for name, df in tables.items()]
    return reduce(DataFrame.union, counts)


def inspect(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, value, n): how often each value of each column occurs, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def assembly_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"))
