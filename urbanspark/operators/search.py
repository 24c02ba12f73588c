"""Viewport features and ranked search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions import geometry as G
from urbanspark.functions.session import broadcast_if_small
from urbanspark.functions.text import trgm_similarity
from urbanspark.operators import spatial


#: Names under one salt of a trigram; trigrams up to this many with more are broadcast.
HOT, BROADCAST_HOT = 100_000, 100_000


def features(members: DataFrame, box: tuple[float, float, float, float], categories: Sequence[str], *, districts: DataFrame | None = None, spatial_first: bool = False) -> DataFrame:
    """(representation_id) of the categories in the viewport and, if given, in any of the districts.

    members: (object_id, category, geom, facility_id, display_geom): a facility stands for
    its members. ``spatial_first`` also asks that the member's own geometry meets the box.
    """
    shown = members.where(F.col("category").isin(*categories))
    if spatial_first:
        shown = spatial.in_viewport(shown, box)
    shown = shown.select(F.coalesce(F.concat(F.lit("f:"), F.col("facility_id").cast("string")), F.concat(F.lit("o:"), F.col("object_id").cast("string"))).alias("representation_id"), F.coalesce("display_geom", "geom").alias("geom"))
    shown = spatial.in_viewport(shown, box)
    if districts is not None:
        shown = spatial.within_districts(shown, districts.select(F.col("geom").alias("district_geom")))
    return shown.select("representation_id").distinct()


def feature_payload(members: DataFrame, ids: DataFrame) -> DataFrame:
    """Representation with its sorted members and categories and its GeoJSON."""
    rid = F.coalesce(F.concat(F.lit("f:"), F.col("facility_id").cast("string")), F.concat(F.lit("o:"), F.col("object_id").cast("string")))
    shown = members.withColumn("representation_id", rid).join(ids, "representation_id", "left_semi")
    return shown.groupBy("representation_id").agg(
        F.array_sort(F.collect_set("object_id")).alias("members"),
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.min(G.to_geojson(F.coalesce("display_geom", "geom"))).alias("geojson"),
    )


def limit_guard(df: DataFrame, limit: int) -> DataFrame:
    """The rows, if there are ``limit`` at most; only limit + 1 are looked at."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    return df


def match_class(name: Column, query: Column) -> Column:
    """0 exact, 1 prefix, 2 prefix of a word, 3 anywhere."""
    return F.when(name == query, 0).when(F.startswith(name, query), 1).when(F.contains(F.concat(F.lit(" "), name), F.concat(F.lit(" "), query)), 2).otherwise(3)


def search_branches(objects: DataFrame, facilities: DataFrame, streets: DataFrame, query: str, *, categories: Sequence[str] | None = None, include_objects: bool = True, districts: DataFrame | None = None) -> DataFrame:
    """(kind, id, name) of objects, facilities and streets whose name contains the query.

    objects: (id, name, category, entity), entity null for those that no facility or street
    collapses; facilities: (id, name, category), one row for each member name; streets: (id,
    name). ``%`` and ``_`` in the query stay wildcards. Streets ignore the category filter
    and ``include_objects``. With ``districts`` (geom) all three must have a geom that meets
    one of them.
    """
    if districts is not None:
        scope = districts.select(F.col("geom").alias("district_geom"))
        objects, facilities, streets = (spatial.within_districts(df, scope) for df in (objects, facilities, streets))
    like = F.col("name").like(f"%{query}%")
    wanted = F.lit(True) if categories is None else F.col("category").isin(*categories)
    found = streets.where(like).select(F.lit("street").alias("kind"), "id", "name")
    best = F.min_by("name", F.struct(match_class(F.col("name"), F.lit(query)), -trgm_similarity(F.col("name"), F.lit(query)), "name"))
    found = found.unionByName(facilities.where(like & wanted).groupBy("id").agg(best.alias("name")).select(F.lit("facility").alias("kind"), "id", "name"))
    if include_objects:
        found = found.unionByName(objects.where(like & wanted & F.col("entity").isNull()).select(F.lit("object").alias("kind"), "id", "name"))
    return found


def rank(found: DataFrame, query: Column, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The first k hits (of each ``by``): duplicates of a name last, then class, similarity, length, name, kind and id."""
    kind = F.when(F.col("kind") == "facility", 0).when(F.col("kind") == "street", 1).otherwise(2)
    scored = found.withColumn("match_class", match_class(F.col("name"), query)).withColumn("similarity", F.round(trgm_similarity(F.col("name"), query), 6))
    scored = scored.withColumn("duplicate", F.row_number().over(W.partitionBy(*by, "name").orderBy(kind, "id")))
    order = [F.asc("duplicate"), F.asc("match_class"), F.desc("similarity"), F.length("name").asc(), F.asc("name"), kind.asc(), F.asc("id")]
    if not by:
        return scored.orderBy(*order).limit(k).select("kind", "id", "name", "match_class", "similarity", "duplicate")
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return scored.withColumn("place", place).where(F.col("place") <= k).select(*by, "kind", "id", "name", "match_class", "similarity", "duplicate", "place")


def shape_results(top: DataFrame, geometries: DataFrame) -> DataFrame:
    """``top`` (kind, id, ...) with geometry_type, a representative point x, y and the bounds of its geometry (kind, id, geom)."""
    shaped = top.join(geometries.select("kind", "id", "geom"), ["kind", "id"]).withColumn("__p", G.representative_point(F.col("geom")))
    return shaped.select(*top.columns, F.col("geom.gtype").alias("geometry_type"), "__p.x", "__p.y", *(F.col(f"geom.{c}").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


def search_batch(names: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Many queries at once: names (kind, id, name) against queries (query), 3 to 100 characters.

    A name that contains the query has all of the query's inner trigrams, so names and
    queries meet by an equi-join on the query's rarest one, counted over all names, then are
    compared in full; a query with a trigram that no name has is done. Names under a
    trigram of more than ``HOT`` are dealt over several salts. Distinct names are posted once,
    whatever the number of rows that bear them.
    """
    gram = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    posted = names.select("name").distinct().where(F.length("name") >= 3).select("name", F.explode(gram(F.col("name"))).alias("gram"))
    often = posted.groupBy("gram").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / HOT).cast("int"))
    asked = queries.select("query").distinct().where(F.length("query").between(3, 100)).select("query", F.size(gram(F.col("query"))).alias("grams"), F.explode(gram(F.col("query"))).alias("gram"))
    rarest = asked.join(often, "gram").groupBy("query", "grams").agg(F.count("*").alias("known"), F.min(F.struct("n", "gram", "salts")).alias("r")).where("known = grams")
    asked = rarest.select("query", "r.gram", F.explode(F.sequence(F.lit(0), F.col("r.salts") - 1)).alias("salt"))
    hot = broadcast_if_small(often.where("salts > 1").select("gram", "salts"), BROADCAST_HOT)
    dealt = posted.join(hot, "gram", "left").select("name", "gram", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("name"), F.col("salts"))).cast("int").alias("salt"))
    met = dealt.join(asked, ["gram", "salt"]).where(F.contains("name", "query")).select("query", "name")
    return rank(met.join(names, "name"), F.col("query"), k, by=["query"])
