"""Queries over a raw map made of the given tables: assembly, refresh, tiles, all metrics, rules and links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.functions.session import checkpointed, ensure_checkpoint_dir
from urbanspark.operators import catalog, entities, metrics, scoring
from urbanspark.plans import metric_registry, refresh, synth
from urbanspark.plans.registry import query
from urbanspark.sources import assembly

FAR, INNER = 900_000_000, 1_000_000_000


def part_map(spark, sf) -> dict[str, DataFrame]:
    """Parts as area relations of two bent lines, some with a hole, a nested relation, or a way that is missing or has no shape."""
    a = synth.areas(spark, sf)
    k, g = F.col("id"), F.col("geom")
    x0, y0, x1, y1 = (g[c] for c in ("xmin", "ymin", "xmax", "ymax"))
    mx, my, q = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 4
    member = lambda kind, i, role: F.struct(F.lit(kind).alias("member_type"), i.cast("long").alias("member_id"), F.lit(role).alias("role"))
    held = F.array_compact(F.array(
        member("way", 2 * k, "outer"), member("way", 2 * k + 1, ""), F.when(k % 3 == 0, member("way", INNER + k, "inner")),
        F.when(k % 11 == 0, member("relation", k + 1, "outer")), F.when(k % 13 == 0, member("relation", FAR + k, "subarea")),
    ))
    members = a.select(k.alias("relation_id"), F.posexplode(held).alias("sequence", "m")).select("relation_id", "sequence", "m.*")
    one = F.array(G.xy(x0, y0), G.xy(x1, y0), G.xy(x1, y1))
    two = F.array(G.xy(x1, y1), G.xy(x0, y1), G.xy(x0, y0))
    two = F.when(k % 2 == 1, F.reverse(two)).otherwise(two)
    hole = F.array(G.xy(mx - q, my - q), G.xy(mx + q, my - q), G.xy(mx + q, my + q), G.xy(mx - q, my + q), G.xy(mx - q, my - q))
    way = lambda i, pts: F.struct(i.cast("long").alias("osm_id"), pts.alias("pts"))
    null = F.lit(None).cast("array<struct<x:double,y:double>>")
    rows = a.select(F.inline(F.array_compact(F.array(way(2 * k, one), F.when(k % 7 != 0, way(2 * k + 1, F.when(k % 7 == 1, null).otherwise(two))), F.when(k % 3 == 0, way(INNER + k, hole))))))
    none = F.create_map().cast("map<string,string>")
    ways = rows.select("osm_id", none.alias("tags"), F.when(F.col("pts").isNotNull(), G.line(F.col("pts"))).alias("geom"))
    relations = a.select(k.alias("osm_id"), F.lit("multipolygon").alias("relation_type"), F.create_map(F.lit("kind"), F.col("category"), F.lit("name"), F.col("name")).alias("tags"))
    nodes = synth.points(spark, sf).select(F.col("id").alias("osm_id"), F.create_map(F.lit("shop"), F.col("category"), F.lit("name"), F.col("name")).alias("tags"), "geom")
    return {"nodes": nodes, "ways": ways, "relations": relations, "members": members}


_AREAS = """WITH a AS (SELECT id AS k, hw, id % 3 = 0 AS hole, id % 7 IN (0, 1) AS lacking, category FROM areas), n AS (SELECT count(*) AS n, min(id) AS lo, max(id) AS hi FROM areas),
    s AS (SELECT k AS relation_id, 2 + CASE WHEN hole THEN 1 ELSE 0 END + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS member_count, 2 + CASE WHEN hole THEN 1 ELSE 0 END AS way_members,
      CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS missing_way_members, CASE WHEN k % 7 = 1 THEN 1 ELSE 0 END AS null_way_geometries, CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS nested_relation_members,
      CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS geometry_relation_members, CASE WHEN k % 11 = 0 AND k + 1 > n.hi THEN 1 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END AS missing_relation_members,
      CASE WHEN NOT lacking OR hole THEN 'POLYGON' END AS geometry_type, CASE WHEN NOT lacking OR hole THEN true END AS is_valid,
      CASE WHEN lacking AND hole THEN hw * hw WHEN lacking THEN 0.0 WHEN hole THEN 3 * hw * hw ELSE 4 * hw * hw END AS area,
      CASE WHEN k % 11 = 0 THEN 'unsupported_nested' WHEN lacking AND NOT hole THEN 'incomplete' WHEN lacking THEN 'partial' ELSE 'assembled' END AS status FROM a, n) """


@query(_AREAS + "SELECT * FROM s", "areas")
def area_relations(spark, sf):
    m = part_map(spark, sf)
    out = assembly.area_relations(m["members"], m["ways"], m["relations"])
    return out.withColumn("area", F.round(F.coalesce(G.st_area(F.col("geom")), F.lit(0.0)), 6)).drop("geom", "assembler")


@query("""WITH r AS (SELECT id, o_orderkey, x0, x1, y, slot, s FROM roads JOIN orders ON o_orderkey = id), d AS (SELECT DISTINCT s, slot, x0, x1, y FROM r),
    b AS (SELECT s, slot, CASE WHEN lag(slot) OVER (PARTITION BY s ORDER BY slot) = slot - 1 THEN 0 ELSE 1 END AS new FROM d)
    SELECT CAST(r.s AS BIGINT) AS relation_id, count(*) AS member_count, count(*) FILTER (id % 5 <> 0) AS path_members, count(*) FILTER (id % 5 <> 0) AS present_path_geometries, CAST(0 AS BIGINT) AS missing_path_members, CAST(0 AS BIGINT) AS null_path_geometries, CAST(0 AS BIGINT) AS stop_members,
      count(*) FILTER (id % 5 = 0) AS platform_members, CAST(0 AS BIGINT) AS unresolved_stop_members, CAST(0 AS BIGINT) AS unresolved_platform_members, CAST(0 AS BIGINT) AS nested_relation_members, 'MULTILINESTRING' AS geometry_type, true AS is_valid, 'assembled' AS status,
      any_value(l.lines) AS lines, any_value(l.points) AS points
    FROM r JOIN (SELECT s, sum(new) AS lines, count(*) + sum(new) AS points FROM (SELECT s, slot, CASE WHEN lag(slot) OVER (PARTITION BY s ORDER BY slot) = slot - 1 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT s, slot FROM r WHERE id % 5 <> 0)) GROUP BY s) l ON l.s = r.s GROUP BY r.s""", "roads")
def route_relations(spark, sf):
    """Streets as routes: slots side by side are lines that meet; every fifth road is a platform."""
    r = synth.roads(spark, sf).withColumn("s", F.regexp_extract("name", r"(\d+)", 1).cast("long"))
    # lines as wide as their slot, so that neighbours share an end, every second one turned round
    x, y = F.col("geom.xmin"), F.col("geom.ymin")
    ends = F.array(G.xy(x, y), G.xy(x + 40, y))
    ways = r.select(F.col("id").alias("osm_id"), G.line(F.when(F.col("slot") % 2 == 0, ends).otherwise(F.reverse(ends))).alias("geom"))
    role = F.when(F.col("id") % 5 == 0, "platform").otherwise("")
    members = r.select(F.col("s").alias("relation_id"), F.col("id").cast("int").alias("sequence"), F.lit("way").alias("member_type"), F.col("id").alias("member_id"), role.alias("role"))
    none = ways.select("osm_id").limit(0)
    out = assembly.route_relations(members, none, ways, none)
    points = F.aggregate("geom.parts", F.lit(0), lambda n, p: n + F.size(p[0]))
    return out.withColumns({"lines": F.size("geom.parts").cast("long"), "points": points.cast("long")}).drop("geom")


@query("""WITH c AS (SELECT count(*) AS nodes FROM pts), p AS (SELECT count(*) AS parts, count(*) FILTER (id % 7 <> 0) AS second, count(*) FILTER (id % 7 > 1) AS shaped, count(*) FILTER (id % 3 = 0) AS holes, count(*) FILTER (id % 11 = 0) AS nested, count(*) FILTER (id % 13 = 0) AS far,
      count(*) FILTER (id % 11 <> 0 AND id % 7 > 1) AS assembled, count(*) FILTER (id % 11 <> 0 AND id % 7 > 1 AND category LIKE 'PROMO%') AS promo FROM areas), b AS (SELECT count(*) AS building FROM pts WHERE category = 'BUILDING')
    SELECT unnest(['staged.nodes', 'staged.ways', 'staged.relations', 'staged.members', 'derived.assembled', 'derived.unsupported_nested', 'canonical.created', 'canonical.requested', 'canonical.excluded', 'categories.matches', 'categories.active', 'finalized.active_objects', 'finalized.missing_bindings']) AS counter,
      unnest([nodes, parts + second + holes, parts, 2 * parts + holes + nested + far, assembled, nested, nodes + parts + shaped + holes + assembled, nodes + parts + second + holes + parts, second - shaped + parts - assembled, building + promo, building + promo, nodes + parts + shaped + holes + assembled, 0]) AS n FROM c, p, b""", "pts", "areas")
def refresh_counts(spark, sf):
    """One run of the whole refresh over the given tables, its tables written below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/refresh-{uuid.uuid4()}"
    rules = catalog.rules_frame(spark, [
        {"category": "building", "rule_id": "shop", "conditions": [("shop", "equals", ["BUILDING"])]},
        {"category": "promo", "rule_id": "kind", "conditions": [("kind", "exists", []), ("shop", "not_in", ["BUILDING"]), ("kind", "in", ["PROMO"])], "families": ["polygon"]},
    ])
    counts = refresh.refresh(spark, path, 1, "city", lambda: part_map(spark, sf), rules)
    wanted = {"staged": ("nodes", "ways", "relations", "members"), "derived": ("assembled", "unsupported_nested"), "canonical": ("created", "requested", "excluded"), "categories": ("matches", "active"), "finalized": ("active_objects", "missing_bindings")}
    return spark.createDataFrame([(f"{s}.{k}", counts[s].get(k, 0)) for s, ks in wanted.items() for k in ks], "counter string, n long")


# All metrics and curves of the registry

CATEGORIES = {"AUTOMOBILE": "education.kindergarten", "BUILDING": "education.school", "FURNITURE": "healthcare.clinic", "HOUSEHOLD": "healthcare.hospital", "MACHINERY": "healthcare.pharmacy", "STANDARD": "nature.park", "PROMO": "nature.water", "SMALL": "transport.stop"}


def registry_targets(spark, sf) -> DataFrame:
    named = F.create_map(*(F.lit(v) for kv in CATEGORIES.items() for v in kv))
    both = synth.targets(synth.points(spark, sf)).unionByName(synth.targets(synth.areas(spark, sf)))
    return both.withColumn("category", F.try_element_at(named, F.col("category"))).where("category IS NOT NULL")


def registry_values(spark, sf) -> DataFrame:
    return metrics.run_metrics(synth.cells(spark, sf), registry_targets(spark, sf), metric_registry.definitions({"boxes": True}))


def _registry_sql() -> str:
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORIES.items())
    rows, segments = [], []
    for key, (provider, category, config, points) in metric_registry.METRICS.items():
        kind = {"count_within_radius": f"n{config.get('radius')}", "nearest_distance": "near"}.get(provider, "water" if provider == "water_accessibility" else "index")
        rows.append(f"('{key}', '{category}', '{kind}', {config.get('half', 1)}.0, {config.get('cap', 0)}, {config.get('saturation', 1.0)})")
        segments += [f"('{key}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in zip(points, points[1:], strict=False)]
    return f"""WITH t AS (SELECT CASE category {names} END AS category, x, y, 0.0::DOUBLE AS hw FROM pts UNION ALL SELECT CASE category {names} END, x, y, hw FROM areas),
    m(metric_key, category, kind, half, cap, saturation) AS (VALUES {", ".join(rows)}), halves AS (SELECT category, max(half) AS half FROM m GROUP BY 1),
    seg(metric_key, x0, y0, x1, y1) AS (VALUES {", ".join(segments)}), ends AS (SELECT metric_key, min(x0) AS lo, arg_min(y0, x0) AS ylo, max(x1) AS hi, arg_max(y1, x1) AS yhi FROM seg GROUP BY 1),
    d AS (SELECT cell_id, t.category, half, sqrt(greatest(abs(c.x - t.x) - hw, 0) ** 2 + greatest(abs(c.y - t.y) - hw, 0) ** 2) AS d,
        CASE t.category WHEN 'nature.park' THEN 0.2 + 0.8 * (1 - exp(-4 * hw * hw / 50000)) WHEN 'nature.water' THEN 0.25 + 0.75 * (1 - exp(-4 * hw * hw / 100000)) ELSE 1 END AS q FROM cells c, t JOIN halves USING (category)),
    g AS (SELECT cell_id, category, min(d) AS near, count(*) FILTER (d <= 1000) AS n1000, count(*) FILTER (d <= 500) AS n500, coalesce(max(k), 0) AS m, coalesce(sum(k), 0) AS s FROM (SELECT *, CASE WHEN d <= 4 * half THEN exp(-ln(2) * (d / half) ** 2) * q END AS k FROM d) GROUP BY 1, 2),
    v AS (SELECT metric_key, cell_id, CASE kind WHEN 'near' THEN near WHEN 'n1000' THEN n1000 WHEN 'n500' THEN n500 WHEN 'water' THEN least(m, 1) ELSE least(m + (1 - m) * cap * (1 - exp(-greatest(s - m, 0) / saturation)), 1) END AS v FROM g JOIN m USING (category)),
    r AS (SELECT v.metric_key, cell_id, v, CASE WHEN v <= lo THEN ylo WHEN v >= hi THEN yhi END AS flat FROM v JOIN ends USING (metric_key)) """


@query(_registry_sql() + "SELECT r.metric_key, cell_id, round(v, 6) AS raw_value, round(coalesce(flat, y0 + (y1 - y0) * (v - x0) / (x1 - x0)), 6) AS score FROM r LEFT JOIN seg ON seg.metric_key = r.metric_key AND flat IS NULL AND v >= x0 AND v < x1", "cells", "pts", "areas")
def registry_scores(spark, sf):
    values = registry_values(spark, sf)
    curves = scoring.curves_frame(spark, metric_registry.curves())
    # the score first: beside a rounded column of the same name, the curve's inner functions would take that one
    scored = values.join(F.broadcast(curves), "metric_key").withColumn("score", scoring.curve_value(F.col("raw_value"), F.col("xs"), F.col("ys")))
    return scored.select("metric_key", "cell_id", F.col("raw_value").alias("raw"), "score").select("metric_key", "cell_id", F.round("raw", 6).alias("raw_value"), F.round("score", 6).alias("score"))


# Tile rows over zooms

_ZOOMS = """b AS (SELECT c.*, z, 2 * pi() * 6378137.0 / 2 ** z AS side, pi() * 6378137.0 AS half FROM shown c JOIN (SELECT unnest(range({0}, {1})) AS z) ON (z >= 13) = (size = 50)),
    t1 AS (SELECT *, unnest(range(CAST(floor((x0 + half) / side) AS BIGINT), CAST(floor((x1 + half) / side) AS BIGINT) + 1)) AS tx FROM b),
    t2 AS (SELECT *, unnest(range(CAST(floor((half - y1) / side) AS BIGINT), CAST(floor((half - y0) / side) AS BIGINT) + 1)) AS ty FROM t1),
    u AS (SELECT *, CAST(least(greatest(round(((x0 + half) / side - tx) * 4096), -64), 4160) AS INTEGER) AS qx0, CAST(least(greatest(round(((half - y1) / side - ty) * 4096), -64), 4160) AS INTEGER) AS qy0, CAST(least(greatest(round(((x1 + half) / side - tx) * 4096), -64), 4160) AS INTEGER) AS qx1, CAST(least(greatest(round(((half - y0) / side - ty) * 4096), -64), 4160) AS INTEGER) AS qy1 FROM t2) """
_GRIDS = """grids AS (SELECT 'grid-' || size || 'm:' || i || ':' || j AS cell_id, size, (i + 0.5) * size::DOUBLE AS x, (j + 0.5) * size::DOUBLE AS y FROM (SELECT 50 AS size, range AS i FROM range(6800, 7200) UNION ALL SELECT 200, range FROM range(1700, 1800)) JOIN (SELECT 50 AS size, range AS j FROM range(132600, 133000) UNION ALL SELECT 200, range FROM range(33150, 33250)) USING (size)),
    shown AS (SELECT cell_id, size, district_id, x - size / 2 AS x0, y - size / 2 AS y0, x + size / 2 AS x1, y + size / 2 AS y1 FROM (SELECT g.cell_id, g.size, g.x, g.y, d.district_id FROM grids g JOIN districts d ON g.x BETWEEN d.x0 AND d.x1 AND g.y BETWEEN d.y0 AND d.y1)), """
MERCATOR = ("mx0", "my0", "mx1", "my1")


def bounded(cells: DataFrame) -> DataFrame:
    half = F.col("cell_size_m") / 2
    return cells.withColumns({"mx0": F.col("x") - half, "my0": F.col("y") - half, "mx1": F.col("x") + half, "my1": F.col("y") + half})


@query("WITH " + _GRIDS + _ZOOMS.format(8, 15) + "SELECT CAST(z AS INTEGER) AS z, tx, ty, cell_id, district_id, 'grid-' || size || 'm' AS grid_version, qx0, qy0, qx1, qy1 FROM u", "districts")
def grid_tile_rows(spark, sf):
    """The outlines of every tile of the zooms 8 to 14, both grids."""
    grids = {size: bounded(synth.cells(spark, sf, size)).select("cell_id", "district_id", "grid_version", *MERCATOR) for size in (50, 200)}
    return scoring.tile_rows(grids, 8, 14, MERCATOR)


@query("WITH shown AS (SELECT cell_id, 200 AS size, composite, x - 100 AS x0, y - 100 AS y0, x + 100 AS x1, y + 100 AS y1 FROM composites JOIN cells USING (cell_id)), " + _ZOOMS.format(8, 13) + "SELECT CAST(z AS INTEGER) AS z, tx, ty, cell_id, round(composite, 4) AS composite, qx0, qy0, qx1, qy1 FROM u", "composites")
def heatmap_tile_rows(spark, sf):
    """Composite scores by cell in every tile of the zooms 8 to 12."""
    from urbanspark.plans.spatial_queries import all_scores, weights

    scored = scoring.composite(all_scores(spark, sf), weights(spark)).withColumn("composite", F.round("composite", 4))
    cells = checkpointed(bounded(synth.cells(spark, sf)).join(scored, "cell_id").select("cell_id", "composite", *MERCATOR))
    return scoring.tile_rows({200: cells}, 8, 12, MERCATOR)


@query("""WITH p AS (SELECT id, 30 + (x - 340000) / 111320.0 * 0.2 AS lon, 60 + (y - 6630000) / 111320.0 * 0.2 AS lat FROM pts), a AS (SELECT id, 30 + (x - 340000) / 111320.0 * 0.2 AS lon, 60 + (y - 6630000) / 111320.0 * 0.2 AS lat FROM areas),
    e AS (SELECT 1 - 1 / 298.257223563 AS f), w AS (SELECT p.id AS point_id, a.id AS area_id, radians(p.lat) AS phi, radians(abs(p.lon - a.lon)) AS dl, radians(abs(p.lat - a.lat)) AS dp FROM p, a WHERE abs(p.lon - a.lon) <= 0.002 AND abs(p.lat - a.lat) <= 0.002 AND sqrt((p.lon - a.lon) ** 2 + (p.lat - a.lat) ** 2) <= 0.002 AND p.id % 5 = a.id % 5),
    d AS (SELECT point_id, area_id, sqrt((dl * cos(phi) * 6378137.0 / sqrt(1 - (1 - f * f) * sin(phi) ** 2)) ** 2 + (dp * 6378137.0 * f * f / (1 - (1 - f * f) * sin(phi) ** 2) ** 1.5) ** 2) AS distance FROM w, e)
    SELECT point_id, area_id, round(distance, 5) AS distance, point_id % 10 = area_id % 10 AS same_site FROM d WHERE distance <= 100""", "pts", "areas")
def geodesic_candidates(spark, sf):
    """Points and areas around 60 degrees north, at most 100 m apart on the ellipsoid, with the sites that hold both."""
    lon, lat = 30 + (F.col("x") - 340000) / 111320.0 * 0.2, 60 + (F.col("y") - 6630000) / 111320.0 * 0.2
    p = synth.points(spark, sf).select(F.col("id").alias("point_id"), lon.alias("lon"), lat.alias("lat"), (F.col("id") % 5).alias("ref"))
    a = synth.areas(spark, sf).select("id", ((F.col("geom.xmin") + F.col("geom.xmax")) / 2).alias("x"), ((F.col("geom.ymin") + F.col("geom.ymax")) / 2).alias("y"))
    a = a.select(F.col("id").alias("area_id"), G.point(lon, lat).alias("geom"), (F.col("id") % 5).alias("ref"))
    sites = p.select((F.col("point_id") % 10).alias("relation_id"), F.col("point_id").alias("node")).union(a.select(F.col("area_id") % 10, "area_id"))
    out = entities.geodesic_candidates(p, a, 100.0, "ref", sites)
    return out.select("point_id", "area_id", F.round("distance", 5).alias("distance"), "same_site")


@query("""SELECT p_partkey AS binding_id, p_type AS category, 'rule ' || p_type || ' ' || p_size AS rule_id FROM part WHERE p_size % 7 <> 3
    UNION ALL SELECT p_partkey, 'sized', 'sized' FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'not promo', 'negative' FROM part WHERE p_type <> 'PROMO'""")
def rule_index(spark, sf):
    """One rule for each type and size there is, one on a key alone and one of negations only."""
    part = synth.table(spark, sf, "part")
    even = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("even"), F.lit("yes"))).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(F.create_map(F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string")), even)
    objects = part.select(F.col("p_partkey").alias("binding_id"), F.lit("node").alias("source_type"), F.lit("point").alias("family"), F.lit("feature").alias("kind"), tags.alias("tags"))
    held = lambda k, op, *v: F.struct(F.lit(k).alias("key"), F.lit(op).alias("op"), F.array(*v).cast("array<string>").alias("values"))
    none = F.array().cast("array<string>")
    any_ = [none.alias("source_types"), none.alias("families"), none.alias("kinds")]
    each = part.where("p_size % 7 <> 3").select("p_type", "p_size").distinct().select(F.col("p_type").alias("category"), F.concat_ws(" ", F.lit("rule"), "p_type", F.col("p_size").cast("string")).alias("rule_id"), F.array(held("size", "in", F.col("p_size").cast("string")), held("type", "equals", F.col("p_type"))).alias("conditions"), *any_)
    one = spark.range(1).select(F.lit("sized").alias("category"), F.lit("sized").alias("rule_id"), F.array(held("even", "exists")).alias("conditions"), *any_)
    negative = spark.range(1).select(F.lit("not promo").alias("category"), F.lit("negative").alias("rule_id"), F.array(held("type", "not_equals", F.lit("PROMO")), held("colour", "not_in", F.lit("red"))).alias("conditions"), *any_)
    return catalog.rule_matches(objects, each.unionByName(one).unionByName(negative)).select("binding_id", "category", "rule_id")
