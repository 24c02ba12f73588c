"""Areas and routes from member lines: ends paired by their places, trails by pointer doubling.

Every line of a relation can be walked in two directions; at a place where lines end, ends
are paired, so each walk has one successor. Doubling the pointers gives every walk its
trail and its place in it after a logarithmic number of joins, whatever the size of a
relation; only a finished ring or line is gathered into a row.

Areas pair all ends at a place in their order around it, and a ring that comes back to a place is
cut there into rings of its own; routes pair ends where exactly two meet, as line merging does.
Lines of one shape count once in a relation. Closed lines are rings by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions import geometry as G
from urbanspark.functions.session import checkpointed
from urbanspark.sources import osm


def distinct_lines(member_lines: DataFrame) -> DataFrame:
    """(relation_id, line, pts, x0, y0, x1, y1): each shape of a relation once, under its least sequence.

    Lines come as geom; an area's boundary counts as its rings, each a line of its own.
    """
    rings = member_lines.where(F.col("geom").isNotNull()).select("relation_id", "sequence", F.posexplode(F.flatten(F.col("geom.parts"))).alias("ring", "pts"))
    rings = rings.where(F.size("pts") > 1)
    back = F.reverse("pts")
    shape = F.when(F.col("pts") <= back, F.col("pts")).otherwise(back)
    first = F.min_by("pts", F.struct("sequence", "ring"))
    once = rings.groupBy("relation_id", F.xxhash64(shape).alias("h1"), F.md5(F.to_json(F.struct(shape.alias("s")))).alias("h2")).agg(F.min(F.struct("sequence", "ring")).alias("at"), first.alias("pts"))
    # a line's number orders like its sequence; ring numbers beyond 2**20 in one member would repeat it
    line = F.shiftleft(F.col("at.sequence").cast("long"), 20) + F.col("at.ring")
    ends = [F.col("pts")[0]["x"], F.col("pts")[0]["y"], F.element_at("pts", -1)["x"], F.element_at("pts", -1)["y"]]
    return checkpointed(once.select("relation_id", line.alias("line"), "pts", *(e.alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"), strict=True))))


def _walks(lines: DataFrame, two_only: bool) -> DataFrame:
    """(relation_id, walk, next): walk = 2 * line + direction; next is null where a trail ends."""
    open_ = lines.where("x0 <> x1 OR y0 <> y1")
    # at end 0 a line is entered forwards (0) and left backwards (1); at end 1 the other way round
    n = F.size("pts")
    angle = lambda at, to: F.atan2(F.get("pts", to)["y"] - F.get("pts", at)["y"], F.get("pts", to)["x"] - F.get("pts", at)["x"]).alias("angle")
    one = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), angle(F.lit(0), F.lit(1)), F.lit(0).alias("end"))
    two = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), angle(n - 1, n - 2), F.lit(1).alias("end"))
    ends = open_.select("relation_id", "line", F.inline(F.array(one, two)))
    around = W.partitionBy("relation_id", "x", "y").orderBy("angle", "line", "end")
    every = W.partitionBy("relation_id", "x", "y")
    placed = ends.withColumns({"k": F.row_number().over(around) - 1, "n": F.count("*").over(every)})
    kept = placed.where("n = 2") if two_only else placed.where("k < n - n % 2")
    pair = kept.withColumn("pair", F.floor(F.col("k") / 2))
    other = pair.select("relation_id", "x", "y", "pair", F.col("k").alias("k2"), F.col("line").alias("l2"), F.col("end").alias("e2"))
    met = pair.join(other, ["relation_id", "x", "y", "pair"]).where(F.col("k") != F.col("k2"))
    # leaving a line by its end 1 is walking it forwards; entering the other by its end 0 is walking it forwards
    step = met.select("relation_id", (F.col("line") * 2 + (F.col("end") == 0).cast("int")).alias("walk"), (F.col("l2") * 2 + (F.col("e2") == 1).cast("int")).alias("next"))
    walks = open_.select("relation_id", F.explode(F.array(F.col("line") * 2, F.col("line") * 2 + 1)).alias("walk"))
    return walks.join(step, ["relation_id", "walk"], "left")


def _doubled(walks: DataFrame, rounds: int) -> DataFrame:
    """(relation_id, walk, to, least, near, end, far) after 2**rounds steps.

    ``to`` is where the walk is then, null if its trail ended: ``end`` is its last walk and
    ``far`` the steps to it. ``least`` is the least walk passed and ``near`` the steps to it.
    """
    none = F.lit(0).cast("long")
    state = walks.select("relation_id", "walk", F.col("next").alias("to"), F.col("walk").alias("least"), none.alias("near"), F.col("walk").alias("end"), F.col("next").isNotNull().cast("long").alias("far"))
    for k in range(rounds):
        ahead = state.select("relation_id", F.col("walk").alias("to"), *(F.col(c).alias(f"__{c}") for c in ("to", "least", "near", "end", "far")))
        on, less = F.col("to").isNotNull(), F.col("__least") < F.col("least")
        step = state.join(ahead, ["relation_id", "to"], "left")
        state = checkpointed(
            step.select(
                "relation_id",
                "walk",
                F.col("__to").alias("to"),
                F.least("least", "__least").alias("least"),
                F.when(less, F.col("__near") + (1 << k)).otherwise(F.col("near")).alias("near"),
                F.when(on, F.col("__end")).otherwise(F.col("end")).alias("end"),
                (F.col("far") + F.when(on, F.col("__far")).otherwise(0)).alias("far"),
            )
        )
    return state


def trails(member_lines: DataFrame, two_only: bool) -> DataFrame:
    """(relation_id, first, closed, pts): the rings and open lines of each relation; first: least line of it."""
    lines = distinct_lines(member_lines)
    most = lines.groupBy("relation_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    rounds = math.ceil(math.log2(most)) + 1 if most else 0
    walks = checkpointed(_walks(lines, two_only))
    state = _doubled(walks, rounds)
    # Two walks go round each ring; the one that passes its least line forwards stays and begins there.
    after = F.when(F.col("near") == 0, F.lit(1 << 62)).otherwise(F.col("near"))
    rings = state.where("to IS NOT NULL AND least % 2 = 0").select("relation_id", "walk", F.col("least").alias("end"), after.alias("far"), F.lit(True).alias("closed"))
    open_ = state.where("to IS NULL").select("relation_id", "walk", "end", "far")
    heads = open_.groupBy("relation_id", "end").agg(F.max_by("walk", "far").alias("start")).where(F.col("start") < F.col("end").bitwiseXOR(1)).select("relation_id", "end")
    placed = rings.unionByName(open_.join(heads, ["relation_id", "end"], "left_semi").withColumn("closed", F.lit(False)))
    pts = F.when(F.col("walk") % 2 == 0, F.col("pts")).otherwise(F.reverse("pts"))
    held = placed.withColumn("line", F.floor(F.col("walk") / 2)).join(lines.select("relation_id", "line", "pts"), ["relation_id", "line"])
    steps = held.groupBy("relation_id", "end", "closed").agg(F.min("line").alias("first"), F.sort_array(F.collect_list(F.struct((-F.col("far")).alias("k"), pts.alias("pts")))).alias("steps"))
    joined = F.concat(F.get("steps", 0)["pts"], F.flatten(F.transform(F.slice("steps", 2, F.size("steps")), lambda s: F.slice(s["pts"], 2, F.size(s["pts"])))))
    own = lines.where("x0 = x1 AND y0 = y1").select("relation_id", F.col("line").alias("first"), F.lit(True).alias("closed"), "pts")
    return steps.select("relation_id", "first", "closed", joined.alias("pts")).unionByName(own)


def split_ring(ring: np.ndarray) -> list[np.ndarray]:
    """The simple rings of one that comes back to places: cut wherever a place is met again."""
    out, path, at = [], [], {}
    for p in map(tuple, ring.tolist()):
        if p in at:
            k = at[p]
            loop = [*path[k:], p]
            if len(loop) >= 4:
                out.append(np.array(loop))
            for q in path[k + 1 :]:
                del at[q]
            del path[k + 1 :]
        else:
            at[p] = len(path)
            path.append(p)
    return out


_XY = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_SHAPE = pa.struct([("gtype", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(_XY)))), *((c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax"))])


def _areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for parts in G.arrow_rings(batch.column("parts")):
            rings = [r for part in parts for ring in part for r in split_ring(ring)]
            nested = osm.nest(rings) if rings else []
            out.append(osm._struct(nested, "POLYGON" if len(nested) == 1 else "MULTIPOLYGON") if nested else None)
        yield pa.RecordBatch.from_arrays([batch.column("relation_id"), pa.array(out, _SHAPE)], ["relation_id", "geom"])


def assemble_areas(member_lines: DataFrame) -> DataFrame:
    """(relation_id, geom) of member ways (relation_id, sequence, geom): rings nested by depth; null if none closes."""
    found = trails(member_lines, two_only=False)
    rings = found.where("closed AND size(pts) >= 4").groupBy("relation_id").agg(F.sort_array(F.collect_list(F.struct("first", "pts"))).alias("rs"))
    shaped = rings.select("relation_id", F.array(F.transform("rs", lambda r: r["pts"])).alias("parts")).mapInArrow(_areas, f"relation_id long, geom {G.GEOMETRY}")
    return member_lines.select("relation_id").distinct().join(shaped, "relation_id", "left")


def assemble_routes(member_lines: DataFrame) -> DataFrame:
    """(relation_id, geom): path members merged where two ends meet, as one MULTILINESTRING; null if there is no line."""
    found = trails(member_lines, two_only=True)
    lines = found.groupBy("relation_id").agg(F.sort_array(F.collect_list(F.struct("first", "pts"))).alias("ls"))
    shaped = lines.select("relation_id", G.multi("MULTILINESTRING", F.transform("ls", lambda r: F.array(r["pts"]))).alias("geom"))
    return member_lines.select("relation_id").distinct().join(shaped, "relation_id", "left")


# Statuses from what was assembled


def _resolved(members: DataFrame, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Members with ``there`` and ``way_geom``; nodes and relations: (osm_id), ways: (osm_id, geom)."""
    known = nodes.select(F.lit("node").alias("member_type"), F.col("osm_id").alias("member_id"), F.lit(None).cast(G.GEOMETRY).alias("way_geom"))
    known = known.unionByName(ways.select(F.lit("way").alias("member_type"), F.col("osm_id").alias("member_id"), F.col("geom").alias("way_geom")))
    known = known.unionByName(relations.select(F.lit("relation").alias("member_type"), F.col("osm_id").alias("member_id"), F.lit(None).cast(G.GEOMETRY).alias("way_geom")))
    return members.join(known.withColumn("there", F.lit(True)), ["member_type", "member_id"], "left").withColumn("there", F.col("there").isNotNull())


def _with_status(counts: DataFrame, shapes: DataFrame, status) -> DataFrame:
    g = F.col("geom")
    joined = checkpointed(counts.join(shapes, "relation_id", "left").withColumn("is_valid", F.when(g.isNotNull(), G.st_is_valid(g))))
    return joined.withColumn("geometry_type", F.col("geom.gtype")).withColumn("status", status)


def area_relations(members: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Every multipolygon or boundary relation with its ten diagnostics, its assembled geom and the status that follows.

    members: (relation_id, sequence, member_type, member_id, role) of those relations; ways:
    (osm_id, geom); relations: (osm_id) of all relations there are.
    """
    none = ways.select("osm_id").limit(0)
    held = checkpointed(_resolved(members, none, ways, relations))
    kind, there = F.col("member_type"), F.col("there")
    way, child = kind == "way", kind == "relation"
    counts = held.groupBy("relation_id").agg(
        F.count("*").alias("member_count"),
        F.count_if(way).alias("way_members"),
        F.count_if(way & ~there).alias("missing_way_members"),
        F.count_if(way & there & F.col("way_geom").isNull()).alias("null_way_geometries"),
        F.count_if(child).alias("nested_relation_members"),
        F.count_if(child & F.col("role").isin("", "outer", "inner")).alias("geometry_relation_members"),
        F.count_if(child & ~there).alias("missing_relation_members"),
    )
    shapes = assemble_areas(held.where(way & F.col("way_geom").isNotNull()).select("relation_id", "sequence", F.col("way_geom").alias("geom")))
    lacking, empty = F.col("missing_way_members") + F.col("null_way_geometries") > 0, F.col("geom").isNull()
    status = F.when(F.col("geometry_relation_members") > 0, "unsupported_nested").when(lacking & empty, "incomplete").when(lacking, "partial").when(empty | ~F.col("is_valid"), "invalid").otherwise("assembled")
    return _with_status(counts, shapes, status).withColumn("assembler", F.lit("paired ends"))


def route_relations(members: DataFrame, nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Every route relation with its twelve diagnostics, its merged geom and the status that follows.

    A way whose role isn't a platform's is a path, an areal one by its border; a stop is there only as a
    node, a platform as whatever it is.
    """
    held = checkpointed(_resolved(members, nodes, ways, relations).withColumn("role", F.coalesce("role", F.lit(""))))
    kind, there, role = F.col("member_type"), F.col("there"), F.col("role")
    stop, platform = role.startswith("stop"), role.startswith("platform")
    path, geom = (kind == "way") & ~platform, F.col("way_geom")
    counts = held.groupBy("relation_id").agg(
        F.count("*").alias("member_count"),
        F.count_if(path).alias("path_members"),
        F.count_if(path & geom.isNotNull()).alias("present_path_geometries"),
        F.count_if(path & ~there).alias("missing_path_members"),
        F.count_if(path & there & geom.isNull()).alias("null_path_geometries"),
        F.count_if(stop).alias("stop_members"),
        F.count_if(platform).alias("platform_members"),
        F.count_if(stop & ~((kind == "node") & there)).alias("unresolved_stop_members"),
        F.count_if(platform & ~there).alias("unresolved_platform_members"),
        F.count_if(kind == "relation").alias("nested_relation_members"),
    )
    shapes = assemble_routes(held.where(path & geom.isNotNull()).select("relation_id", "sequence", F.col("way_geom").alias("geom")))
    lacking, empty = F.col("missing_path_members") + F.col("null_path_geometries") > 0, F.col("geom").isNull()
    status = F.when(F.col("path_members") == 0, "incomplete").when(lacking & empty, "incomplete").when(lacking, "partial").when(empty | ~F.col("is_valid"), "invalid").otherwise("assembled")
    return _with_status(counts, shapes, status)
