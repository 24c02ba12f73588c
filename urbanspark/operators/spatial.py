"""Spatial joins as bin equi-joins with exact Column predicates.

The extended side's bounds are grown by the radius and exploded into square bins, larger
ones for larger shapes; a point owns exactly one bin of each side there is, so each pair is
met once and needs no dedupe. The exploded side is many times what Spark takes it for, so
these joins are always merged and never broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.functions.session import broadcast_if_small, checkpointed
from urbanspark.operators import cover, pyramid

#: Polygons up to this many are sent whole to the exact tests of pairs found by cells; more are joined by shuffle.
BROADCAST_POLYGONS = 5_000
MIN_BIN = 50.0
#: The square root of the bins that a target is cut into at most, but for those of its rim.
BINS_ACROSS = 4


def _bin(v: Column, size: float) -> Column:
    return F.floor(v / size)


def _span(low: Column, high: Column, grow: Column | float, size: Column | float) -> Column:
    return F.sequence(_bin(low - grow, size), _bin(high + grow, size))


def _bins(across: Column, along: Column) -> Column:
    """Each pair of both spans as rows of struct(i, j)."""
    return F.explode(F.flatten(F.transform(across, lambda i: F.transform(along, lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def _side(size: float) -> Column:
    """The side of the bins of level ``__bl``: doubled as often."""
    return F.lit(float(size)) * F.pow(F.lit(2.0), F.col("__bl"))


def _levels(targets: DataFrame, geom: str, grow: tuple[Column | float, ...], size: tuple[float, ...]) -> DataFrame:
    """``targets`` with ``__bl``, the level whose bins are large enough for their grown bounds."""
    g = F.col(geom)
    box = ((g["xmax"] - g["xmin"] + 2 * grow[0]) / size[0]) * ((g["ymax"] - g["ymin"] + 2 * grow[1]) / size[1])
    return targets.withColumn("__bl", F.greatest(F.ceil(F.log2(F.sqrt(box) / BINS_ACROSS)), F.lit(0)))


def binned_points(points: DataFrame, x: str, y: str, size: Column | float, size_y: Column | float | None = None) -> DataFrame:
    return points.withColumn("__bx", _bin(F.col(x), size)).withColumn("__by", _bin(F.col(y), size if size_y is None else size_y))


def _binned(points: DataFrame, targets: DataFrame, x: str, y: str, geom: str, grow: tuple[Column | float, ...], size: tuple[float, ...]) -> tuple[DataFrame, DataFrame]:
    """Both sides with their bins (``BINS``): the points under each level that targets have.

    ``grow`` and ``size`` are across and along: how far bounds are grown, and the least bins.
    """
    g, right = F.col(geom), _levels(targets, geom, grow, size)
    levels = right.where(g.isNotNull()).select("__bl").distinct()
    across, along = (_side(s) for s in size)
    left = binned_points(points.crossJoin(F.broadcast(levels)), x, y, across, along)
    rows = right.withColumn("__b", _bins(_span(g["xmin"], g["xmax"], grow[0], across), _span(g["ymin"], g["ymax"], grow[1], along)))
    return left, rows.withColumn("__bx", F.col("__b.i")).withColumn("__by", F.col("__b.j")).drop("__b")


BINS = ("__bl", "__bx", "__by")


def distance_join(points: DataFrame, targets: DataFrame, radius: float, *, x: str = "x", y: str = "y", geom: str = "geom", keys: tuple[str, ...] = (), boxes: bool = False) -> DataFrame:
    """Every pair of a point and a target at most ``radius`` apart, with ``distance``.

    ``keys`` are columns that both sides must share. ``boxes`` says that all targets are
    points or axis-parallel rectangles, whose distance needs their bounds only.
    """
    left, right = _binned(points, targets, x, y, geom, (radius,) * 2, (max(radius, MIN_BIN),) * 2)
    met = left.join(right.hint("merge"), [*BINS, *keys])
    apart = G.box_distance(F.col(geom), x, y)
    near = met.where(apart <= radius)
    near = near.withColumn("distance", apart if boxes else G.st_distance(F.col(geom), x, y))
    return near.where(F.col("distance") <= radius).drop(*BINS)


def reached(points: DataFrame, targets: DataFrame, radius: float, point_id: str, *, x: str = "x", y: str = "y", geom: str = "geom") -> DataFrame:
    """(point_id): the points that any target is at most ``radius`` from, each once; a point's search ends with its first."""
    left, right = _binned(points.select(point_id, x, y), targets.select(F.col(geom).alias("__g")), x, y, "__g", (radius,) * 2, (max(radius, MIN_BIN),) * 2)
    right = right.select("__g", *(F.col(c).alias(f"{c}_") for c in BINS))
    same = [F.col(c) == F.col(f"{c}_") for c in BINS]
    near = [G.box_distance(F.col("__g"), x, y) <= radius, G.st_distance(F.col("__g"), x, y) <= radius]
    return left.join(right.hint("merge"), [*same, *near], "left_semi").select(point_id).distinct()


#: Metres that a degree of latitude has at least on WGS84, at the equator; bounds in degrees are this much wider than computed.
LEAST_NORTH = math.radians(1) * G.A * (1 - G.E2)
ROUNDING = 1 + 1e-9


def geodesic_join(points: DataFrame, targets: DataFrame, radius: float, *, degrees: float = 0.002, lon: str = "lon", lat: str = "lat", geom: str = "geom", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a point and a shape in degrees at most ``radius`` metres apart on the ellipsoid, with ``distance``.

    Both must be within ``degrees`` first, in degrees as they are, as the rules ask; then the
    shape is laid out in metres around the point by the local radii of curvature. Bounds are
    grown by no more degrees than the radius has where it has most.
    """
    g, x, y = F.col(geom), F.col(lon), F.col(lat)
    up = min(degrees, max(radius, MIN_BIN) / LEAST_NORTH * ROUNDING)
    far = F.least(F.greatest(F.abs(g["ymin"]), F.abs(g["ymax"])) + up, F.lit(90.0))
    aside = F.least(radius / G.metres_per_degree(far)[0] * ROUNDING, F.lit(degrees))
    east, north = G.metres_per_degree(y)
    left, right = _binned(points.withColumns({"__east": east, "__north": north}), targets, lon, lat, geom, (aside, F.lit(up)), (degrees, up))
    met = left.join(right.hint("merge"), [*BINS, *keys])
    east, north, point = F.col("__east"), F.col("__north"), g["gtype"] == "POINT"
    across, along = (F.greatest(g[f"{k}min"] - v, v - g[f"{k}max"], F.lit(0.0)) * m for k, v, m in (("x", x, east), ("y", y, north)))
    least = F.sqrt(across * across + along * along)
    near = met.where(G.box_distance(g, lon, lat) <= degrees).where(least <= radius * ROUNDING).where(point | (G.st_distance(g, lon, lat) <= degrees))
    local = G.map_coordinates(g, lambda px, py: ((px - x) * east, (py - y) * north))
    near = near.withColumn("distance", F.when(point, least).otherwise(G.st_distance(local, 0.0, 0.0)))
    return near.where(F.col("distance") <= radius).drop(*BINS, "__east", "__north")


def nearest(points: DataFrame, targets: DataFrame, point_id: str, *, x: str = "x", y: str = "y", geom: str = "geom", boxes: bool = False) -> DataFrame:
    """(point_id, distance) to the nearest target of every point, however far it is.

    Without targets, and for points without finite coordinates, there is no row. Points of
    one id, null too, are one point with several places.
    """
    numbered = targets.select(F.col(geom).alias("geom"), F.lit(0).alias("target_id"))
    found = pyramid.strongest(points, numbered, point_id, lambda d, w: -d * w, x=x, y=y, boxes=boxes)
    return found.select(point_id, "distance")


def assign_polygon(points: DataFrame, polygons: DataFrame, point_id: str, *, x: str = "x", y: str = "y", geom: str = "geom", polygon_id: str = "district_id", order: str = "display_order") -> DataFrame:
    """(point_id, polygon_id) of the covering polygon of lowest order, then id."""
    cells = cover.covering(polygons, [polygon_id, order], geom)
    met = cover.points_in(points.select(point_id, x, y), cells, x, y)
    return met.groupBy(point_id).agg(F.min_by(polygon_id, F.struct(order, polygon_id)).alias(polygon_id))


def in_viewport(df: DataFrame, box: tuple[float, float, float, float], geom: str = "geom") -> DataFrame:
    """Rows whose geometry meets the box; the bounds are range predicates that a scan can push down."""
    x0, y0, x1, y1 = box
    g = F.col(geom)
    near = df.where((F.col(f"{geom}.xmin") <= x1) & (F.col(f"{geom}.xmax") >= x0) & (F.col(f"{geom}.ymin") <= y1) & (F.col(f"{geom}.ymax") >= y0))
    return near.where(G.intersects_box(g, x0, y0, x1, y1))


def polygon_pairs(df: DataFrame, polygons: DataFrame, key: str, polygon_key: str, *, geom: str = "geom", polygon_geom: str = "geom", boxes: bool = False) -> DataFrame:
    """(key, polygon_key) of shapes that meet polygons: by shared cells, then by the exact shapes.

    ``boxes`` says that the polygons are axis-parallel rectangles. Keys must be unique.
    """
    cells = cover.covering(polygons, [polygon_key], polygon_geom)
    shapes, areas = df.select(key, F.col(geom).alias("__g")), polygons.select(polygon_key, F.col(polygon_geom).alias("__d"))
    met = cover.candidates(shapes, cells, key, polygon_key, "__g").join(shapes, key).join(broadcast_if_small(areas, BROADCAST_POLYGONS), polygon_key)
    g, d = F.col("__g"), F.col("__d")
    exact = G.intersects_box(g, d["xmin"], d["ymin"], d["xmax"], d["ymax"]) if boxes else G.st_intersects(g, d)
    return met.where(G.bbox_overlaps(g, d)).where(exact).select(key, polygon_key)


def within_districts(df: DataFrame, districts: DataFrame, geom: str = "geom", district_geom: str = "district_geom", boxes: bool = False) -> DataFrame:
    """Rows whose geometry meets any of the districts: their union needs no dissolving."""
    rows = checkpointed(df.withColumn("__row", F.monotonically_increasing_id()))
    areas = checkpointed(districts.select(F.col(district_geom).alias("__area")).withColumn("__district", F.monotonically_increasing_id()))
    hit = polygon_pairs(rows, areas, "__row", "__district", geom=geom, polygon_geom="__area", boxes=boxes)
    return rows.join(hit, "__row", "left_semi").select(*df.columns)


def district_counts(df: DataFrame, districts: DataFrame, by: list[str], *, geom: str = "geom", district_id: str = "district_id") -> DataFrame:
    """Objects per district and ``by``; an object counts in every district that it touches."""
    rows = checkpointed(df.select(*by, F.col(geom).alias("__shape")).withColumn("__row", F.monotonically_increasing_id()))
    met = polygon_pairs(rows, districts, "__row", district_id, geom="__shape")
    return met.join(rows.drop("__shape"), "__row").groupBy(district_id, *by).agg(F.count("*").alias("n"))


#: Cells of line clusters are this little smaller than the gap allows, so that rounding links nothing apart.
SHRINK = 0.999


def line_segments(lines: DataFrame, line_id: str, key: str, geom: str = "geom") -> DataFrame:
    """(line_id, key, s: struct(a, b)) of each side of each line; a single point is a side without length."""
    ring = F.explode(F.flatten(F.col(geom)["parts"])).alias("__r")
    sides = F.when(F.size("__r") == 1, F.array(F.struct(F.col("__r")[0].alias("a"), F.col("__r")[0].alias("b")))).otherwise(G.segments(F.col("__r")))
    return lines.select(line_id, key, ring).select(line_id, key, F.explode(sides).alias("s"))


def _segment_cells(s: Column, side: float) -> Column:
    """The cells that a segment passes, clipped column by column."""
    ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
    left, right = F.least(ax, bx), F.greatest(ax, bx)

    def column(i: Column) -> Column:
        at = lambda x: F.when(ax == bx, F.lit(None)).otherwise(ay + (F.least(F.greatest(x, left), right) - ax) / F.nullif(bx - ax, F.lit(0.0)) * (by - ay))
        u, v = F.coalesce(at(i * side), ay), F.coalesce(at((i + 1) * side), by)
        return F.transform(F.sequence(_bin(F.least(u, v), side), _bin(F.greatest(u, v), side)), lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.flatten(F.transform(F.sequence(_bin(left, side), _bin(right, side)), column))


def proximity_edges(lines: DataFrame, line_id: str, key: str, gap: float, geom: str = "geom") -> DataFrame:
    """(a, b, key): links that hold lines of one key at most ``gap`` apart together, a < b.

    Cells have a diagonal of the gap, so lines in one cell are linked through its least line.
    What that connects isn't compared again: only segments of different components in cells
    at most two apart are, by their exact distance. A line has as many cells as its length
    asks for, so the work grows with the lines, not with their pairs.
    """
    side = gap / 2**0.5 * SHRINK if gap > 0 else MIN_BIN
    cells = line_segments(lines, line_id, key, geom).withColumn("__c", F.explode(_segment_cells(F.col("s"), side)))
    cells = checkpointed(cells.select(line_id, key, "s", F.col("__c.i").alias("i"), F.col("__c.j").alias("j")))
    links = None
    if gap > 0:
        lead = cells.groupBy(key, "i", "j").agg(F.min(line_id).alias("a"))
        held = cells.select(line_id, key, "i", "j").distinct().join(lead, [key, "i", "j"])
        links = checkpointed(held.where(F.col(line_id) != F.col("a")).select("a", F.col(line_id).alias("b"), key).distinct())
        comps = components(links.select("a", "b")).withColumnRenamed("node", line_id)
        cells = cells.join(comps, line_id, "left").withColumn("component", F.coalesce("component", line_id))
        reach = 2
    else:
        cells, reach = cells.withColumn("component", F.col(line_id)), 0
    # Cells whose surroundings hold one component only have nothing to compare.
    around = F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))
    spread = cells.groupBy(key, "i", "j").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).withColumn("__d", F.explode(around))
    mixed = spread.select(key, (F.col("i") + F.col("__d.di")).alias("i"), (F.col("j") + F.col("__d.dj")).alias("j"), "lo", "hi").groupBy(key, "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    open_ = checkpointed(cells.join(mixed.select(key, "i", "j"), [key, "i", "j"], "left_semi").select(key, "i", "j", line_id, "component", "s"))
    left = open_.select(key, "i", "j", F.col(line_id).alias("a"), F.col("component").alias("ca"), F.col("s").alias("sa")).withColumn("__d", F.explode(around))
    left = left.select(key, (F.col("i") + F.col("__d.di")).alias("i"), (F.col("j") + F.col("__d.dj")).alias("j"), "a", "ca", "sa")
    right = open_.select(key, "i", "j", F.col(line_id).alias("b"), F.col("component").alias("cb"), F.col("s").alias("sb"))
    met = left.join(right, [key, "i", "j"]).where(F.col("ca") < F.col("cb")).select(key, "a", "b", "sa", "sb").distinct()
    close = met.where(G.segment_distance(F.col("sa"), F.col("sb")) <= gap).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), key).distinct()
    return close if links is None else links.unionByName(close).distinct()


def line_distance(a: Column, b: Column) -> Column:
    """Distance of two lines: 0 where they cross, else the least from any vertex of one to the other."""
    sides = lambda g: F.flatten(F.transform(F.flatten(g["parts"]), lambda r: F.when(F.size(r) == 1, F.array(F.struct(r[0].alias("a"), r[0].alias("b")))).otherwise(G.segments(r))))
    return F.array_min(F.transform(sides(a), lambda s: F.array_min(F.transform(sides(b), lambda t: G.segment_distance(s, t)))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node id reachable over ``edges`` (a, b).

    Alternates large-star and small-star rounds, so long chains shrink in a logarithmic
    number of rounds; each round is a reliable checkpoint.
    """
    pairs = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while not _is_star_forest(pairs):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        pairs = checkpointed(small.where("a != b").distinct())
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _is_star_forest(pairs: DataFrame) -> bool:
    """Whether every a has one b, and no b is an a itself."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b").distinct())
    return ends.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
