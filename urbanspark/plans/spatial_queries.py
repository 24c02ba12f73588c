"""Queries over the grid: metrics, scores, explanations, tiles, viewport, search and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import audits, grid, merge, metrics, scoring, search, spatial
from urbanspark.plans import synth
from urbanspark.plans.registry import query

R6 = lambda c: F.round(c, 6)
BOX = (345000.0, 6635000.0, 349000.0, 6638500.0)


def metric_values(spark: SparkSession, sf: str) -> DataFrame:
    cells = synth.cells(spark, sf)
    both = synth.targets(synth.points(spark, sf)).unionByName(synth.targets(synth.areas(spark, sf)))
    return metrics.run_metrics(cells, both, [
        {"key": "near", "provider": "nearest_distance", "category": "BUILDING", "config": {"boxes": True}},
        {"key": "count", "provider": "count_within_radius", "category": "AUTOMOBILE", "config": {"radius": 1000, "boxes": True}},
        {"key": "park", "provider": "park_accessibility", "category": "STANDARD", "config": {"boxes": True}},
    ])


def all_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.normalize(metric_values(spark, sf), scoring.curves_frame(spark, synth.CURVES))


def weights(spark: SparkSession) -> DataFrame:
    return scoring.weights_frame(spark, synth.WEIGHTS)


@query("SELECT 'grid-200m' AS grid_version, district_id, count(*) AS cells, min(x) AS xmin, max(x) AS xmax FROM cells GROUP BY 2", "cells")
def grid_cells_by_district(spark, sf):
    return grid.grid_summary(synth.cells(spark, sf))


@query("SELECT count(*) AS cells, count(DISTINCT district_id) AS districts, 0::BIGINT AS invalid, 0::BIGINT AS wrong_area, 0::BIGINT AS duplicates, min(x) - 100 AS xmin, min(y) - 100 AS ymin, max(x) + 100 AS xmax, max(y) + 100 AS ymax FROM cells", "cells")
def grid_quality(spark, sf):
    return grid.grid_quality(synth.cells(spark, sf))


@query("""SELECT CASE WHEN j % 50 = 0 THEN 'created' WHEN i % 40 = 0 THEN 'mismatched' ELSE 'unchanged' END AS state, count(*) AS n FROM cells GROUP BY 1""", "cells")
def grid_diff(spark, sf):
    cells = synth.cells(spark, sf)
    stored = cells.where(F.col("grid_j") % 50 != 0).withColumn("district_id", F.when(F.col("grid_i") % 40 == 0, "elsewhere").otherwise(F.col("district_id")))
    return grid.grid_diff(cells, stored)


@query("""SELECT p.id, arg_min(d.district_id, (d.display_order, d.district_id)) AS district_id FROM (SELECT id, 340000 + 1000 * (id % 21) AS x, 6630000 + 1000 * ((id * 7) % 21) AS y FROM pts) p
    JOIN districts d ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1 GROUP BY 1""", "districts", "pts")
def assign_polygon_tiebreak(spark, sf):
    k = F.col("id")
    on_lines = synth.points(spark, sf).select("id", (F.lit(synth.X0) + 1000 * (k % 21)).cast("double").alias("x"), (F.lit(synth.Y0) + 1000 * ((k * 7) % 21)).cast("double").alias("y"))
    return spatial.assign_polygon(on_lines, synth.districts(spark, sf), "id")


@query("""WITH fac AS (SELECT id // 4 AS f FROM areas WHERE id % 4 = 0)
    SELECT CASE WHEN f IS NULL THEN 'o:' || id ELSE 'f:' || f END AS target_id, category, round(CASE WHEN f IS NULL THEN any_value(4 * hw * hw) ELSE any_value((SELECT 4 * b.hw * b.hw FROM areas b WHERE b.id = f * 4)) END, 6) AS area, array_to_string(list_sort(list(id)), ',') AS source_ids
    FROM areas LEFT JOIN fac ON id // 4 = f AND id % 4 IN (0, 1) GROUP BY CASE WHEN f IS NULL THEN 'o:' || id ELSE 'f:' || f END, category, f""", "areas")
def logical_targets(spark, sf):
    a = synth.areas(spark, sf)
    members = a.select(F.col("id").alias("object_id"), "category", "geom")
    lead = a.where(F.col("id") % 4 == 0).select(F.floor(F.col("id") / 4).alias("facility_id"), F.col("geom").alias("analysis_geom"))
    held = a.where((F.col("id") % 4).isin(0, 1)).select(F.col("id").alias("object_id"), F.floor(F.col("id") / 4).alias("facility_id"))
    out = metrics.logical_targets(members, held.join(lead, "facility_id"))
    return out.select("target_id", "category", R6("area").alias("area"), F.array_join(F.col("source_ids").cast("array<string>"), ",").alias("source_ids"))


@query("SELECT category, count(*) AS targets, 0::BIGINT AS duplicates, 0::BIGINT AS invalid FROM areas GROUP BY 1", "areas")
def target_quality(spark, sf):
    return metrics.target_quality(synth.targets(synth.areas(spark, sf)))


def _one(spark, sf, provider: str, category: str, config: dict, of=synth.points) -> DataFrame:
    own = synth.targets(of(spark, sf)).where(F.col("category") == category)
    return metrics.PROVIDERS[provider](synth.cells(spark, sf), own, {"boxes": True} | config).select("cell_id", R6("raw_value").alias("raw_value"))


@query("SELECT cell_id, round(v, 6) AS raw_value FROM m_near", "m_near")
def nearest_distance(spark, sf):
    return _one(spark, sf, "nearest_distance", "BUILDING", {})


@query("SELECT cell_id, v AS raw_value FROM m_count", "m_count")
def count_within_radius(spark, sf):
    return _one(spark, sf, "count_within_radius", "AUTOMOBILE", {"radius": 1000})


@query("""SELECT c.cell_id, round(coalesce(sum(CASE WHEN d2 < 1000000 THEN (1 - d2 / 1000000) ** 2 ELSE 0 END), 0), 6) AS raw_value
    FROM cells c LEFT JOIN (SELECT cell_id, (c.x - p.x) ** 2 + (c.y - p.y) ** 2 AS d2 FROM cells c, pts p WHERE p.category = 'MACHINERY') USING (cell_id) GROUP BY 1""", "cells", "pts")
def smooth_influence(spark, sf):
    return _one(spark, sf, "smooth_influence", "MACHINERY", {"radius": 1000})


@query("""SELECT cell_id, round(least(m + (1 - m) * 0.18 * (1 - exp(-greatest(t - m, 0) / 1.0)), 1), 6) AS raw_value FROM (
    SELECT c.cell_id, coalesce(max(k), 0) AS m, coalesce(sum(k), 0) AS t FROM cells c LEFT JOIN (
      SELECT cell_id, exp(-ln(2) * ((c.x - p.x) ** 2 + (c.y - p.y) ** 2) / 490000) AS k FROM cells c, pts p WHERE p.category = 'HOUSEHOLD' AND (c.x - p.x) ** 2 + (c.y - p.y) ** 2 <= 7840000) USING (cell_id) GROUP BY 1)""", "cells", "pts")
def primary_accessibility(spark, sf):
    return _one(spark, sf, "primary_accessibility", "HOUSEHOLD", {"half": 700})


@query("SELECT cell_id, round(v, 6) AS raw_value FROM m_park", "m_park")
def park_accessibility(spark, sf):
    return _one(spark, sf, "park_accessibility", "STANDARD", {}, synth.areas)


@query("""WITH t AS (
      SELECT cell_id, sqrt(greatest(abs(c.x - a.x) - hw, 0) ** 2 + greatest(abs(c.y - a.y) - hw, 0) ** 2) AS d, 0.25 + 0.75 * (1 - exp(-4 * hw * hw / 100000)) AS q FROM cells c, areas a WHERE a.category = 'PROMO'
      UNION ALL SELECT cell_id, sqrt(greatest(r.x0 - c.x, c.x - r.x1, 0) ** 2 + (c.y - r.y) ** 2), 0.85 FROM cells c, (SELECT DISTINCT x0, x1, y FROM roads) r)
    SELECT c.cell_id, round(coalesce(max(exp(-ln(2) * (d / 1000) ** 2) * q), 0), 6) AS raw_value FROM cells c LEFT JOIN t ON t.cell_id = c.cell_id AND d <= 4000 GROUP BY 1""", "cells", "areas", "roads")
def water_accessibility(spark, sf):
    lines = synth.roads(spark, sf).select(F.col("id").alias("target_id"), F.lit("PROMO").alias("category"), "geom", F.lit(0.0).alias("area"))
    both = synth.targets(synth.areas(spark, sf)).where("category = 'PROMO'").unionByName(lines)
    return metrics.PROVIDERS["water_accessibility"](synth.cells(spark, sf), both, {"boxes": True}).select("cell_id", R6("raw_value").alias("raw_value"))


@query("""WITH v AS (SELECT 'near' AS metric_key, v FROM m_near UNION ALL SELECT 'count', v FROM m_count UNION ALL SELECT 'park', v FROM m_park)
    SELECT metric_key, count(*) AS n, 0::BIGINT AS non_finite, 0::BIGINT AS negative, CASE WHEN metric_key = 'count' THEN 0 ELSE count(*) FILTER (v <> floor(v)) END AS fractional, round(min(v), 6) AS min_value, round(max(v), 6) AS max_value, max(v) > min(v) AS sane FROM v GROUP BY 1""", "m_near", "m_count", "m_park")
def metric_sanity(spark, sf):
    out = metrics.metric_sanity(metric_values(spark, sf), {"near": "distance", "count": "count", "park": "index"})
    return out.withColumn("min_value", R6("min_value")).withColumn("max_value", R6("max_value"))


@query("SELECT count(*) FILTER (i % 10 = 0) AS missing, count(*) FILTER (j % 50 = 1 AND i % 10 <> 0) AS extra, count(*) FILTER (j % 25 = 3 AND i % 10 <> 0) AS duplicates, count(*) FILTER (i % 20 = 5) AS non_finite FROM cells", "cells")
def coverage_check(spark, sf):
    cells = synth.cells(spark, sf)
    good = cells.where(F.col("grid_i") % 10 != 0)
    value = F.when(F.col("grid_i") % 20 == 5, F.lit(float("nan"))).otherwise(F.lit(1.0)).alias("raw_value")
    own = good.select("cell_id", value)
    extra = good.where(F.col("grid_j") % 50 == 1).select(F.concat("cell_id", F.lit("x")).alias("cell_id"), F.lit(1.0).alias("raw_value"))
    again = good.where(F.col("grid_j") % 25 == 3).select("cell_id", F.lit(1.0).alias("raw_value"))
    return merge.coverage(own.union(extra).union(again), cells)


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 1 THEN 100 WHEN l_quantity < 10 THEN 100 - 20 * (l_quantity - 1) / 9 WHEN l_quantity < 40 THEN 80 - 80 * (l_quantity - 10) / 30 ELSE 0 END, 6) AS score FROM lineitem")
def normalize_piecewise(spark, sf):
    xs, ys = F.array(*map(F.lit, (1.0, 10.0, 40.0))), F.array(*map(F.lit, (100.0, 80.0, 0.0)))
    return synth.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R6(scoring.curve_value(F.col("l_quantity"), xs, ys)).alias("score"))


@query("SELECT metric_key, cell_id, round(score, 6) AS score FROM scores", "scores")
def normalize_all(spark, sf):
    return all_scores(spark, sf).withColumn("score", R6("score"))


@query("""SELECT cell_id, round(composite, 6) AS composite, s.* FROM (SELECT * FROM composites ORDER BY round(composite, 9) DESC, cell_id LIMIT 20),
    (SELECT count(*) AS cells, round(min(composite), 6) AS min_score, round(max(composite), 6) AS max_score, round(avg(composite), 6) AS mean_score FROM composites) s""", "composites")
def composite_topk(spark, sf):
    rounded = scoring.composite(all_scores(spark, sf), weights(spark)).withColumn("composite", F.round("composite", 9))
    out = scoring.top_cells(rounded, 20)
    return out.select("cell_id", "cells", *(R6(c).alias(c) for c in ("composite", "min_score", "max_score", "mean_score")))


@query("""SELECT district_id, count(*) AS cells, round(quantile_cont(composite, 0.1), 6) AS p10, round(quantile_cont(composite, 0.25), 6) AS p25, round(quantile_cont(composite, 0.5), 6) AS p50, round(quantile_cont(composite, 0.75), 6) AS p75, round(quantile_cont(composite, 0.9), 6) AS p90
    FROM composites JOIN cells USING (cell_id) GROUP BY 1""", "composites")
def district_distribution(spark, sf):
    out = scoring.distribution(all_scores(spark, sf), weights(spark), synth.cells(spark, sf), 3)
    return out.select("district_id", "cells", *(R6(c).alias(c) for c in ("p10", "p25", "p50", "p75", "p90")))


@query("""SELECT round(sum(lo * weight) / sum(weight), 6) AS lower, round(sum(hi * weight) / sum(weight), 6) AS upper, round(sum(av * weight) / sum(weight), 6) AS mean
    FROM (SELECT metric_key, min(score) AS lo, max(score) AS hi, avg(score) AS av FROM scores GROUP BY 1) JOIN weights USING (metric_key)""", "scores", "weights")
def run_stat_summary(spark, sf):
    return scoring.summarize(merge.run_stats(all_scores(spark, sf)), weights(spark)).select(*(R6(c).alias(c) for c in ("lower", "upper", "mean")))


@query("""WITH w(scenario, metric_key, weight) AS (VALUES ('walk', 'near', 3.0), ('walk', 'park', 1.0), ('family', 'count', 2.0), ('family', 'park', 2.0), ('family', 'near', 1.0))
    SELECT scenario, cell_id, round(sum(score * weight) / sum(weight), 6) AS composite FROM scores JOIN w USING (metric_key) GROUP BY 1, 2""", "scores")
def scenario_batch(spark, sf):
    w = spark.createDataFrame([("walk", "near", 3.0), ("walk", "park", 1.0), ("family", "count", 2.0), ("family", "park", 2.0), ("family", "near", 1.0)], "scenario string, metric_key string, weight double")
    return scoring.evaluate_scenarios(all_scores(spark, sf), w).withColumn("composite", R6("composite"))


@query("SELECT cell_id, metric_key, round(score * weight / 6.0, 6) AS contribution FROM scores JOIN weights USING (metric_key)", "scores", "weights")
def contributions(spark, sf):
    return scoring.contributions(all_scores(spark, sf), weights(spark)).withColumn("contribution", R6("contribution"))


@query("""SELECT cell_id, arg_min(id, (-l, id)) AS target_id, round(max(l), 6) + 0.0 AS log_score FROM (
    SELECT cell_id, id, ln(0.2 + 0.8 * (1 - exp(-area / 50000))) + greatest(-ln(2) * (d / 900) ** 2, -700) AS l FROM park_pairs) GROUP BY 1""", "park_pairs")
def explain_target(spark, sf):
    own = synth.targets(synth.areas(spark, sf)).where("category = 'STANDARD'")
    return scoring.explain_targets(synth.cells(spark, sf), own, 900.0, G.size_quality("area", 50_000, 0.2), boxes=True).withColumn("log_score", R6("log_score") + 0.0)


@query("SELECT metric_key, count(*) AS cells, round(sum(v), 4) AS total FROM (SELECT 'near' AS metric_key, v FROM m_near UNION ALL SELECT 'count', v FROM m_count UNION ALL SELECT 'park', v FROM m_park) GROUP BY 1", "m_near", "m_count", "m_park")
def all_metrics_one_plan(spark, sf):
    return metric_values(spark, sf).groupBy("metric_key").agg(F.count("*").alias("cells"), F.round(F.sum("raw_value"), 4).alias("total"))


# Tiles: cell corners are taken as mercator metres of the same plane.

_TILED = """WITH b AS (SELECT cell_id, x - 100 AS mx0, y - 100 AS my0, x + 100 AS mx1, y + 100 AS my1 FROM cells),
    c AS (SELECT *, 13 AS z, 2 * pi() * 6378137.0 / 8192 AS side, pi() * 6378137.0 AS half FROM b),
    tiles AS (SELECT *, unnest(range(CAST(floor((mx0 + half) / side) AS BIGINT), CAST(floor((mx1 + half) / side) AS BIGINT) + 1)) AS tx FROM c),
    tiled AS (SELECT *, unnest(range(CAST(floor((half - my1) / side) AS BIGINT), CAST(floor((half - my0) / side) AS BIGINT) + 1)) AS ty FROM tiles) """
MERCATOR = ("mx0", "my0", "mx1", "my1")


def tiled(spark, sf, zoom: int = 13) -> DataFrame:
    c = synth.cells(spark, sf).withColumns({"mx0": F.col("x") - 100, "my0": F.col("y") - 100, "mx1": F.col("x") + 100, "my1": F.col("y") + 100})
    return scoring.tile_cells(c, zoom, MERCATOR)


@query(_TILED + "SELECT z, tx, ty, count(*) AS cells, 50 AS grid_size FROM tiled GROUP BY 1, 2, 3", "cells")
def tile_pyramid(spark, sf):
    return tiled(spark, sf).groupBy("z", "tx", "ty").agg(F.count("*").alias("cells")).withColumn("grid_size", scoring.grid_for_zoom(F.col("z")))


@query(_TILED + "SELECT cell_id, tx, ty, CAST(least(greatest(round(((mx0 + half) / side - tx) * 4096), -64), 4160) AS INTEGER) AS qx0, CAST(least(greatest(round(((half - my1) / side - ty) * 4096), -64), 4160) AS INTEGER) AS qy0, CAST(least(greatest(round(((mx1 + half) / side - tx) * 4096), -64), 4160) AS INTEGER) AS qx1, CAST(least(greatest(round(((half - my0) / side - ty) * 4096), -64), 4160) AS INTEGER) AS qy1 FROM tiled", "cells")
def tile_geometry(spark, sf):
    return tiled(spark, sf).select("cell_id", "tx", "ty", *scoring.tile_geometry(MERCATOR))


@query(_TILED + "SELECT z, tx, ty, district_id, count(*) AS outlines FROM tiled JOIN cells USING (cell_id) GROUP BY 1, 2, 3, 4", "cells")
def grid_tiles(spark, sf):
    return tiled(spark, sf).groupBy("z", "tx", "ty", "district_id").agg(F.count("*").alias("outlines"))


@query(_TILED + "SELECT z, tx, ty, count(*) AS cells, round(avg(composite), 3) AS mean FROM tiled JOIN composites USING (cell_id) GROUP BY 1, 2, 3", "composites")
def heatmap_tiles(spark, sf):
    out = scoring.heatmap_tiles(tiled(spark, sf), all_scores(spark, sf), weights(spark))
    return out.select("z", "tx", "ty", "cells", F.round(F.col("total").cast("double") / F.col("cells"), 3).alias("mean"))


@query(_TILED + "SELECT DISTINCT z, tx, ty, sha256('v1:sig:' || z || ':' || tx || ':' || ty) AS etag FROM tiled", "cells")
def tile_etag(spark, sf):
    return tiled(spark, sf).select("z", "tx", "ty").distinct().withColumn("etag", scoring.tile_etag("v1", "sig"))


@query("SELECT CAST(least(greatest(floor(round(composite, 6) / 20), 0), 4) AS INTEGER) AS class, count(*) AS cells FROM composites GROUP BY 1", "composites")
def legend_histogram(spark, sf):
    c = scoring.composite(all_scores(spark, sf), weights(spark)).select(R6("composite").alias("composite"))
    return c.groupBy(scoring.legend_bucket(F.col("composite"), 0, 100).alias("class")).agg(F.count("*").alias("cells"))


# Viewport and search


def members(spark, sf) -> DataFrame:
    """Points and areas as category members; areas with id % 4 in 0, 1 belong to a facility shown by its first area."""
    p = synth.points(spark, sf).select((F.col("id") + 1_000_000).alias("object_id"), "category", "geom", F.lit(None).cast("long").alias("facility_id"))
    a = synth.areas(spark, sf)
    fid = F.when((F.col("id") % 4).isin(0, 1), F.floor(F.col("id") / 4))
    q = a.select(F.col("id").alias("object_id"), "category", "geom", fid.alias("facility_id"))
    shown = a.where(F.col("id") % 4 == 0).select(F.floor(F.col("id") / 4).alias("facility_id"), F.col("geom").alias("display_geom"))
    return p.unionByName(q).join(shown, "facility_id", "left")


_MEMBERS = """WITH m AS (SELECT id + 1000000 AS object_id, category, x AS x0, y AS y0, x AS x1, y AS y1, NULL AS f FROM pts
      UNION ALL SELECT id, category, x - hw, y - hw, x + hw, y + hw, CASE WHEN id % 4 IN (0, 1) THEN id // 4 END FROM areas),
    s AS (SELECT m.*, CASE WHEN f IS NULL THEN 'o:' || object_id ELSE 'f:' || f END AS representation_id, coalesce(d.x - d.hw, m.x0) AS dx0, coalesce(d.y - d.hw, m.y0) AS dy0, coalesce(d.x + d.hw, m.x1) AS dx1, coalesce(d.y + d.hw, m.y1) AS dy1
      FROM m LEFT JOIN areas d ON d.id = f * 4 WHERE m.category IN ('BUILDING', 'STANDARD', 'LARGE')) """
_IN_BOX = "dx0 <= 349000 AND dx1 >= 345000 AND dy0 <= 6638500 AND dy1 >= 6635000"
SHOWN = ("BUILDING", "STANDARD", "LARGE")


@query(_MEMBERS + f"SELECT DISTINCT representation_id FROM s WHERE {_IN_BOX}", "pts", "areas")
def viewport_features(spark, sf):
    return search.features(members(spark, sf), BOX, SHOWN)


@query(_MEMBERS + f"SELECT DISTINCT representation_id FROM s WHERE {_IN_BOX} AND x0 <= 349000 AND x1 >= 345000 AND y0 <= 6638500 AND y1 >= 6635000", "pts", "areas")
def viewport_spatial_first(spark, sf):
    return search.features(members(spark, sf), BOX, SHOWN, spatial_first=True)


@query(_MEMBERS + f"SELECT DISTINCT representation_id FROM s JOIN districts d ON d.district_id IN ('NATION_6', 'NATION_7') AND dx0 <= d.x1 AND dx1 >= d.x0 AND dy0 <= d.y1 AND dy1 >= d.y0 WHERE {_IN_BOX}", "pts", "areas", "districts")
def viewport_districts(spark, sf):
    some = synth.districts(spark, sf).where(F.col("district_id").isin("NATION_6", "NATION_7"))
    return search.features(members(spark, sf), BOX, SHOWN, districts=some)


@query(_MEMBERS + f"""SELECT representation_id, array_to_string(list_sort(list(DISTINCT m.object_id)), ',') AS members, array_to_string(list_sort(list(DISTINCT m.category)), ',') AS categories
    FROM (SELECT *, CASE WHEN f IS NULL THEN 'o:' || object_id ELSE 'f:' || f END AS representation_id FROM m) m WHERE representation_id IN (SELECT representation_id FROM s WHERE {_IN_BOX}) GROUP BY 1""", "pts", "areas")
def feature_payload(spark, sf):
    m = members(spark, sf)
    out = search.feature_payload(m, search.features(m, BOX, SHOWN))
    return out.select("representation_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), F.array_join("categories", ",").alias("categories"))


@query("SELECT id, category FROM pts WHERE x BETWEEN 345000 AND 349000 AND y BETWEEN 6635000 AND 6638500", "pts")
def limit_guard(spark, sf):
    found = spatial.in_viewport(synth.points(spark, sf), BOX).select("id", "category")
    return search.limit_guard(found, synth.table(spark, sf, "customer").count())


_RANK = """g AS (SELECT *, CASE WHEN name = query THEN 0 WHEN starts_with(name, query) THEN 1 WHEN contains(' ' || name, ' ' || query) THEN 2 ELSE 3 END AS match_class FROM found),
    w AS (SELECT DISTINCT t, unnest(string_split_regex(lower(t), '[^\\p{L}\\p{N}]+')) AS word FROM (SELECT name AS t FROM found UNION SELECT query FROM found)),
    tri AS (SELECT DISTINCT t, substr('  ' || word || ' ', i, 3) AS gram FROM (SELECT t, word, unnest(range(1, length(word) + 2)) AS i FROM w WHERE word <> '')),
    tn AS (SELECT t, count(*) AS n FROM tri GROUP BY 1),
    sh AS (SELECT x.t AS name, y.t AS query, count(*) AS k FROM tri x JOIN tri y USING (gram) JOIN (SELECT DISTINCT name, query FROM found) f ON f.name = x.t AND f.query = y.t GROUP BY 1, 2),
    r AS (SELECT g.*, round(coalesce(k, 0) / (a.n + b.n - coalesce(k, 0))::DOUBLE, 6) AS similarity, row_number() OVER (PARTITION BY g.query, g.name ORDER BY CASE kind WHEN 'facility' THEN 0 WHEN 'street' THEN 1 ELSE 2 END, id) AS duplicate
      FROM g LEFT JOIN sh USING (name, query) JOIN tn a ON a.t = g.name JOIN tn b ON b.t = g.query),
    o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY duplicate, match_class, similarity DESC, length(name), name, CASE kind WHEN 'facility' THEN 0 WHEN 'street' THEN 1 ELSE 2 END, id) AS place FROM r) """


@query("""WITH found AS (SELECT 'widget' AS query, 'object' AS kind, p_partkey AS id, p_name AS name FROM part WHERE p_name LIKE '%widget%'
      UNION ALL SELECT 'widget', 'facility', s_suppkey, p_name FROM supplier JOIN part ON p_partkey = s_suppkey WHERE p_name LIKE '%widget%'),
    """ + _RANK + "SELECT kind, id, name, match_class, similarity, CAST(duplicate AS INTEGER) AS duplicate FROM o WHERE place <= 20")
def search_ranked(spark, sf):
    part, supplier = synth.table(spark, sf, "part"), synth.table(spark, sf, "supplier")
    objects = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.lit(None).cast("long").alias("entity"))
    facilities = supplier.join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"))
    streets = synth.roads(spark, sf).select("id", "name")
    return search.rank(search.search_branches(objects, facilities, streets, "widget"), F.lit("widget"), 20)


_SHAPES = """shape AS (SELECT 'object' AS kind, id, 'POLYGON' AS geometry_type, x, y, x - hw AS xmin, y - hw AS ymin, x + hw AS xmax, y + hw AS ymax FROM areas
      UNION ALL SELECT 'facility', id, 'POINT', x, y, x, y, x, y FROM pts), scope AS (SELECT * FROM districts WHERE district_id IN ('NATION_6', 'NATION_7', 'NATION_8')) """


@query(f"""WITH {_SHAPES}, found AS (SELECT 'widget' AS query, kind, id, name FROM (SELECT 'object' AS kind, p_partkey AS id, p_name AS name FROM part
      UNION ALL SELECT 'facility', s_suppkey, p_name FROM supplier JOIN part ON p_partkey = s_suppkey) n JOIN shape USING (kind, id)
      WHERE name LIKE '%widget%' AND EXISTS (SELECT 1 FROM scope d WHERE xmin <= d.x1 AND xmax >= d.x0 AND ymin <= d.y1 AND ymax >= d.y0)),
    """ + _RANK + "SELECT kind, id, name, match_class, similarity, CAST(duplicate AS INTEGER) AS duplicate, geometry_type, x, y, xmin, ymin, xmax, ymax FROM o JOIN shape USING (kind, id) WHERE place <= 20", "pts", "areas", "districts")
def search_shaped(spark, sf):
    areas, supplier = synth.areas(spark, sf), synth.table(spark, sf, "supplier")
    objects = areas.select("id", "name", "category", "geom", F.lit(None).cast("long").alias("entity"))
    shown = synth.points(spark, sf).select("id", "geom")
    facilities = supplier.select(F.col("s_suppkey").alias("id")).join(areas.select("id", "name", "category"), "id").join(shown, "id")
    streets = synth.roads(spark, sf).select("id", "name", "geom")
    some = synth.districts(spark, sf).where(F.col("district_id").isin("NATION_6", "NATION_7", "NATION_8"))
    top = search.rank(search.search_branches(objects, facilities, streets, "widget", districts=some), F.lit("widget"), 20)
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "geom")
    return search.shape_results(top, of(objects, "object").union(of(facilities, "facility")).union(of(streets, "street")))


@query("""WITH q AS (SELECT DISTINCT substr(s_name, 1, 15) AS query FROM supplier UNION SELECT DISTINCT string_split(p_name, ' ')[2] FROM part),
    n AS (SELECT 'object' AS kind, p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'facility', s_suppkey, s_name FROM supplier),
    found AS (SELECT query, kind, id, name FROM n JOIN q ON contains(name, query) WHERE length(query) BETWEEN 3 AND 100),
    """ + _RANK + "SELECT query, kind, id, name, match_class, similarity, CAST(duplicate AS INTEGER) AS duplicate, CAST(place AS INTEGER) AS place FROM o WHERE place <= 5")
def search_batch(spark, sf):
    part, supplier = synth.table(spark, sf, "part"), synth.table(spark, sf, "supplier")
    names = part.select(F.lit("object").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).unionByName(supplier.select(F.lit("facility").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    queries = supplier.select(F.substring("s_name", 1, 15).alias("query")).union(part.select(F.get(F.split("p_name", " "), F.lit(1))))
    return search.search_batch(names, queries, 5)


# Audits


@query("SELECT district_id, category, count(*) AS n FROM areas JOIN districts ON x - hw <= x1 AND x + hw >= x0 AND y - hw <= y1 AND y + hw >= y0 GROUP BY 1, 2", "areas", "districts")
def coverage_matrix(spark, sf):
    return spatial.district_counts(synth.areas(spark, sf), synth.districts(spark, sf), ["category"])


@query("""WITH c AS (SELECT district_id, count(*) AS n, count(*) FILTER (id % 2 = 0) AS current FROM pts JOIN districts ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1)
    SELECT district_id, current, n AS full_count, round(100.0 * current / n, 6) AS percent, round(n / 16.0, 6) AS per_km2 FROM c""", "pts", "districts")
def coverage_ratio(spark, sf):
    p, d = synth.points(spark, sf), synth.districts(spark, sf)
    return audits.coverage_ratio(spatial.district_counts(p.where(F.col("id") % 2 == 0), d, []), spatial.district_counts(p, d, []), d)


@query("SELECT category, count(*) AS n FROM areas WHERE x - hw <= 360000 AND x + hw >= 340000 AND y - hw <= 6650000 AND y + hw >= 6630000 GROUP BY 1", "areas")
def category_totals(spark, sf):
    return audits.category_totals(synth.areas(spark, sf), synth.districts(spark, sf))


@query("""SELECT category, count(*) FILTER (x BETWEEN 345000 AND 349000 AND y BETWEEN 6635000 AND 6638500) AS inside, count(*) FILTER (NOT (x BETWEEN 345000 AND 349000 AND y BETWEEN 6635000 AND 6638500)) AS outside,
    count(DISTINCT (floor(x / 1000), floor(y / 1000))) AS occupied FROM pts GROUP BY 1""", "pts")
def bbox_split(spark, sf):
    return audits.bbox_split(synth.points(spark, sf), BOX, "category")


@query("""WITH a AS (SELECT category, 'POINT' AS gtype FROM pts UNION ALL SELECT CASE WHEN id % 2 = 0 THEN 'BUILDING' ELSE category END, 'POLYGON' FROM areas)
    SELECT category, gtype, n, round(100.0 * n / sum(n) OVER (PARTITION BY category), 6) AS percent FROM (SELECT category, gtype, count(*) AS n FROM a GROUP BY 1, 2)""", "pts", "areas")
def geometry_distribution(spark, sf):
    a = synth.areas(spark, sf).select(F.when(F.col("id") % 2 == 0, "BUILDING").otherwise(F.col("category")).alias("category"), "geom")
    return audits.geometry_distribution(synth.points(spark, sf).select("category", "geom").unionByName(a), "category")


@query("SELECT category, count(*) AS n, count(*) FILTER (id % 10 = 0) AS null_geometry, 0::BIGINT AS empty, count(*) FILTER (id % 10 = 1) AS invalid FROM areas GROUP BY 1", "areas")
def validity_report(spark, sf):
    a, g = synth.areas(spark, sf), F.col("geom")
    broken = F.when(F.col("id") % 10 == 1, G.rectangle(g["xmin"], g["ymin"], g["xmin"], g["ymax"])).when(F.col("id") % 10 != 0, g)
    return audits.validity_report(a.withColumn("geom", broken), "category")


@query("SELECT id % 3 AS source_type, 'POLYGON' AS gtype, count(*) AS n FROM areas GROUP BY 1", "areas")
def source_geometry(spark, sf):
    return audits.source_geometry(synth.areas(spark, sf).withColumn("source_type", F.col("id") % 3))


@query("""WITH b AS (SELECT *, id % 3 = 0 AS building FROM areas)
    SELECT count(*) FILTER (building) AS buildings, count(*) FILTER (NOT building) AS sites, (SELECT count(DISTINCT p.id) FROM pts p JOIN b ON building AND p.x BETWEEN b.x - hw AND b.x + hw AND p.y BETWEEN b.y - hw AND b.y + hw) AS contained FROM b""", "areas", "pts")
def building_split(spark, sf):
    return audits.building_split(synth.points(spark, sf), synth.areas(spark, sf).withColumn("building", F.col("id") % 3 == 0))


@query("""SELECT CASE WHEN p_ref = a_ref AND distance = 0 THEN 'STRONG' WHEN p_ref = a_ref OR distance = 0 THEN 'POSSIBLE' ELSE 'NOT ENOUGH' END AS tier, count(*) AS pairs, count(DISTINCT point_id) AS points FROM pairs GROUP BY 1""", "pairs")
def evidence_tiers(spark, sf):
    from urbanspark.plans.table_queries import facility_pairs

    return audits.evidence_tiers(facility_pairs(spark, sf), F.col("p_ref") == F.col("a_ref"))


@query("""WITH b AS (SELECT cell_id, sum(score * CASE metric_key WHEN 'near' THEN 1.0 WHEN 'count' THEN 1.0 ELSE 2.0 END) / 4.0 AS composite FROM scores GROUP BY 1)
    SELECT phase, count(*) AS cells, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS deviation, round(quantile_cont(c, 0.5), 6) AS median FROM (SELECT 'before' AS phase, composite AS c FROM composites UNION ALL SELECT 'after', composite FROM b) GROUP BY 1""", "composites")
def score_distribution_compare(spark, sf):
    scores = all_scores(spark, sf)
    after = scoring.weights_frame(spark, {"near": 1.0, "count": 1.0, "park": 2.0})
    out = audits.score_distribution_compare(scoring.composite(scores, weights(spark)), scoring.composite(scores, after))
    return out.select("phase", "cells", *(R6(c).alias(c) for c in ("mean", "deviation", "median")))


@query("SELECT metric_key, count(*) AS cells, count(*) FILTER (score = 100) AS full_score, round(100.0 * count(*) FILTER (score = 100) / count(*), 6) AS percent FROM scores GROUP BY 1", "scores")
def saturation(spark, sf):
    return audits.saturation(all_scores(spark, sf))
