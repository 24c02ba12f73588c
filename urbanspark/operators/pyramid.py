"""The best target of every point at any distance, by a bounded search over a pyramid of bins.

A target stands in the bin of its middle; a bin knows the bounds of its targets and the
greatest weight among them. A target's value falls with its distance and rises with its
weight, so the nearest and the farthest a bin's targets can be bound the values in it. The
search goes down level by level from a single root: a bin is kept only while its upper
bound isn't beaten by what another bin surely holds. What is left at the bottom are a few
small bins a point, whatever the distance, and one join decides. Points of one small bin
search together.

No radius, no repeated passes over the targets, no pairs that grow with a radius. Values that
tie go to the least target id, also in the bounds, so that targets all too far to tell apart
don't keep every bin open.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions import geometry as G
from urbanspark.functions.session import broadcast_if_small, checkpointed

#: A level's bins are this many times as wide as those of the level below.
WIDER = 4
#: Targets that a bottom bin holds on average, where they are spread evenly.
FILL = 4
#: Bins up to this many (some 70 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_BINS = 100_000
#: Bounds give way by this much, in the unit of the coordinates, so that rounding never drops a target.
SLACK = 1e-6


def _finite(*columns: Column) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & c.isNotNull() & (F.abs(c) < 1e15)
    return ok


def _bin(v: Column, side: float) -> Column:
    return F.floor(v / side).cast("long")


def _gap(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    return F.greatest(low1 - high2, low2 - high1, F.lit(0.0))


def _bounds(box: Column, own: Column, value: Callable[[Column, Column], Column]) -> tuple[Column, Column]:
    """(sure, hope): what a bin of targets holds at least and at most for all points of a bin, least first."""
    near = F.sqrt(F.pow(_gap(box["xmin"], box["xmax"], own["xmin"], own["xmax"]), 2.0) + F.pow(_gap(box["ymin"], box["ymax"], own["ymin"], own["ymax"]), 2.0))
    far = F.sqrt(F.pow(F.greatest(box["xmax"] - own["xmin"], own["xmax"] - box["xmin"]), 2.0) + F.pow(F.greatest(box["ymax"] - own["ymin"], own["ymax"] - box["ymin"]), 2.0))
    of = lambda d: F.struct((-value(d, -box["best"]["w"])).alias("cost"), box["best"]["id"].alias("id"))
    return of(far + SLACK), of(F.greatest(near - SLACK, F.lit(0.0)))


def strongest(points: DataFrame, targets: DataFrame, point_id: str, value: Callable[[Column, Column], Column], *, weight: Column | float = 1.0, x: str = "x", y: str = "y", geom: str = "geom", target_id: str = "target_id", boxes: bool = False) -> DataFrame:
    """(point_id, target_id, distance, value): of each point's targets the one of greatest value, then least id.

    ``value(distance, weight)`` must not rise with the distance and must rise with the weight.
    Points and targets without finite coordinates or weight take no part; without targets there
    are no rows. Rows of one point_id, null too, are one point with several places.
    """
    g = F.col(geom)
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    kept = targets.where(_finite(g["xmin"], g["ymin"], g["xmax"], g["ymax"])).select(F.col(target_id).alias("__id"), g.alias("__g"), w.cast("double").alias("__w"))
    kept = kept.where(F.col("__w").isNotNull() & ~F.isnan("__w"))
    kept = kept.withColumns({"__mx": (F.col("__g.xmin") + F.col("__g.xmax")) / 2, "__my": (F.col("__g.ymin") + F.col("__g.ymax")) / 2})
    size = kept.agg(F.count("*").alias("n"), F.min("__mx").alias("x0"), F.min("__my").alias("y0"), F.max("__mx").alias("x1"), F.max("__my").alias("y1")).first()
    asked = points.where(_finite(F.col(x), F.col(y))).select(F.col(point_id).alias("__p"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    out = ["__p", "__id", "distance", "value"]
    if not size["n"]:
        none = asked.select("__p").limit(0).join(kept.select("__id"), F.lit(False)).select("__p", "__id", F.lit(0.0).alias("distance"), F.lit(0.0).alias("value"))
        return none.select(*out).withColumnsRenamed({"__p": point_id, "__id": target_id})
    extent = max(size["x1"] - size["x0"], size["y1"] - size["y0"])
    side = max(math.sqrt(extent * extent * FILL / size["n"]), extent / 2**40, 1e-9)
    depth = max(0, math.ceil(math.log(max(extent / side, 1), WIDER)))

    inside = [F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.min("best").alias("best")]
    corners = [F.col(f"__g.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    bins = kept.select(_bin(F.col("__mx"), side).alias("i"), _bin(F.col("__my"), side).alias("j"), *corners, F.struct((-F.col("__w")).alias("w"), F.col("__id").alias("id")).alias("best"))
    pyramid = [checkpointed(bins.groupBy("i", "j").agg(*inside))]
    wider = lambda c: F.floor(F.col(c) / WIDER).cast("long").alias(c)
    for _ in range(depth):
        pyramid.append(checkpointed(pyramid[-1].select(wider("i"), wider("j"), "xmin", "ymin", "xmax", "ymax", "best").groupBy("i", "j").agg(*inside)))

    together = asked.withColumns({"__bi": _bin(F.col("__x"), side), "__bj": _bin(F.col("__y"), side)})
    front = together.groupBy("__bi", "__bj").agg(F.struct(F.min("__x").alias("xmin"), F.min("__y").alias("ymin"), F.max("__x").alias("xmax"), F.max("__y").alias("ymax")).alias("own"))
    box = F.struct("xmin", "ymin", "xmax", "ymax", "best")
    by = W.partitionBy("__bi", "__bj")
    up: list[str] | None = None
    for level in reversed(pyramid):
        # the top bins, at most a few, hang on one root; the others on the bin around them
        own = level.select(F.lit(0).alias("__root"), "i", "j", wider("i").alias("__ui"), wider("j").alias("__uj"), box.alias("box"))
        own = broadcast_if_small(own, BROADCAST_BINS)
        met = front.withColumn("__root", F.lit(0)).join(own.drop("__ui", "__uj"), "__root") if up is None else front.join(own.drop("__root"), up)
        sure, hope = _bounds(F.col("box"), F.col("own"), value)
        held = met.withColumns({"sure": F.min(sure).over(by), "hope": hope}).where(F.col("hope") <= F.col("sure"))
        front = held.select("__bi", "__bj", "own", F.col("i").alias("__ui"), F.col("j").alias("__uj"))
        up = ["__ui", "__uj"]
    leaves = front.drop("own").withColumnsRenamed({"__ui": "i", "__uj": "j"})
    placed = kept.select(_bin(F.col("__mx"), side).alias("i"), _bin(F.col("__my"), side).alias("j"), "__id", "__g", "__w")
    tried = leaves.join(broadcast_if_small(placed, BROADCAST_BINS) if boxes else placed, ["i", "j"]).drop("i", "j").join(together, ["__bi", "__bj"])
    apart = G.box_distance(F.col("__g"), "__x", "__y") if boxes else G.st_distance(F.col("__g"), "__x", "__y")
    each = tried.select("__p", "__id", "__w", apart.alias("distance")).withColumn("cost", -value(F.col("distance"), F.col("__w")))
    best = each.groupBy("__p").agg(F.min(F.struct("cost", "__id", "distance")).alias("b"))
    return best.select("__p", "b.__id", "b.distance", (-F.col("b.cost")).alias("value")).withColumnsRenamed({"__p": point_id, "__id": target_id})
