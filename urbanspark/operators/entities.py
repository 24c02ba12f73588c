"""Domain entities: districts, facilities (a point with its site and buildings) and streets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions import geometry as G
from urbanspark.functions.session import checkpointed
from urbanspark.functions.text import normalize_search, uuid5
from urbanspark.operators import merge, spatial


def bind_districts(parent_members: DataFrame, definitions: DataFrame) -> DataFrame:
    """(district, problem) where the accepted set and the parent's subarea members differ, or a binding is unusable.

    parent_members: (name, level, status, valid); definitions: (name). No rows: accepted.
    """
    m = parent_members.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("level", "status", "valid")).alias("m"))
    d = definitions.select("name", F.lit(True).alias("__d"))
    problem = F.when(F.col("__d").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("m.level") != 5, "level").when(F.col("m.status") != "active", "inactive").when(~F.col("m.valid"), "invalid")
    return m.join(d, "name", "full_outer").select(F.col("name").alias("district"), problem.alias("problem")).where("problem IS NOT NULL")


def district_listing(districts: DataFrame) -> DataFrame:
    g = F.col("geom")
    return districts.select("district_id", "display_order", g["xmin"].alias("xmin"), g["ymin"].alias("ymin"), g["xmax"].alias("xmax"), g["ymax"].alias("ymax"))


# Facilities


def candidate_pairs(points: DataFrame, areas: DataFrame, radius: float, key: str, *, boxes: bool = False) -> DataFrame:
    """Point and area pairs of one category at most ``radius`` apart, with ``contained``."""
    met = spatial.distance_join(points, areas, radius, keys=(key,), boxes=boxes)
    return met.withColumn("contained", F.col("distance") == 0)


def geodesic_candidates(points: DataFrame, areas: DataFrame, radius: float, key: str, sites: DataFrame) -> DataFrame:
    """The same over degrees, with ``same_site`` from site relations.

    points: (point_id, lon, lat, key); areas: (area_id, geom, key); sites: members of site relations
    (relation_id, node): a pair shares a site when one relation holds both. Both sides bring their
    relations along, so that pairs aren't shuffled again.
    """
    held = sites.groupBy("node").agg(F.collect_set("relation_id").alias("__held"))
    of = lambda df, k, name: df.join(held.select(F.col("node").alias(k), F.col("__held").alias(name)).hint("merge"), k, "left")
    met = spatial.geodesic_join(of(points, "point_id", "__p"), of(areas, "area_id", "__a"), radius, keys=(key,)).withColumn("contained", F.col("distance") == 0)
    return met.withColumn("same_site", F.coalesce(F.arrays_overlap("__p", "__a"), F.lit(False))).drop("__p", "__a")


def geometry_role(tags: Column, geom: Column, direct: Column) -> Column:
    building = F.array_contains(F.map_keys(tags), "building") | F.array_contains(F.map_keys(tags), "building:part")
    return F.when(geom["gtype"] == "POINT", "POINT").when(building, "BUILDING").when(direct, "FACILITY_SITE").when(G.is_areal(geom), "OTHER_AREA").otherwise("UNKNOWN")


#: Comparisons of a pair, in order: method, columns that must be equal, needs containment.
METHODS = (
    ("exact_ref", ("ref",), False),
    ("exact_wikidata", ("wikidata",), False),
    ("exact_phone_contained", ("phone",), True),
    ("exact_website_contained", ("website",), True),
    ("exact_name_operator_contained", ("name", "operator"), True),
)


def link_evidence(pairs: DataFrame, *, have: Sequence[str]) -> DataFrame:
    """Adds ``rejected`` (a contradiction), ``methods`` (sorted) and ``strong``.

    Compares p_<column> with a_<column> for the columns in ``have``; also uses
    ``same_site``, a_role, street, house and the sides' direct flags where present.
    """
    have_set = set(have)
    both = lambda c: (F.col(f"p_{c}") != "") & (F.col(f"a_{c}") != "")
    same = lambda c: both(c) & (F.col(f"p_{c}") == F.col(f"a_{c}"))
    columns = set(pairs.columns)
    rejected = F.lit(None).cast("string")
    for c in ("wikidata", "ref"):
        if c in have_set:
            rejected = F.when(both(c) & (F.col(f"p_{c}") != F.col(f"a_{c}")), f"contradictory_{c}").otherwise(rejected)
    found = []
    if "same_site" in columns:
        found.append(F.when(F.col("same_site"), "explicit_site_relation"))
    for method, cs, contained in METHODS:
        if set(cs) <= have_set:
            ok = F.lit(True)
            for c in cs:
                ok = ok & same(c)
            found.append(F.when(ok & F.col("contained") if contained else ok, method))
    if "name" in have_set and "a_role" in columns:
        found.append(F.when(same("name") & F.col("contained") & (F.col("a_role") == "FACILITY_SITE"), "exact_name_site_contained"))
    if {"name", "street", "house"} <= have_set:
        open_name = ~F.coalesce(both("name"), F.lit(False)) & F.col("p_direct") & F.col("a_direct")
        also = same("name") | open_name | (same("operator") if "operator" in have_set else F.lit(False))
        found.append(F.when(same("street") & same("house") & F.col("contained") & also, "exact_address_contained_facility"))
    methods = F.when(rejected.isNotNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_compact(F.array(*found))))
    return pairs.withColumn("rejected", rejected).withColumn("methods", methods).withColumn("strong", F.size("methods") > 0)


def facility_groups(strong: DataFrame, roles: DataFrame) -> DataFrame:
    """(component, node, role, conflict) of the strong pairs' components.

    strong: (point_id, area_id); roles: (node, role, category). Conflict: more than one
    category, point, or area of one role.
    """
    comps = spatial.components(strong.select(F.col("point_id").alias("a"), F.col("area_id").alias("b"))).join(roles, "node")
    per_role = comps.groupBy("component", "role").agg(F.count("*").alias("n"))
    several = per_role.groupBy("component").agg(F.max("n").alias("most"))
    cats = comps.groupBy("component").agg(F.count_distinct("category").alias("cats"))
    return comps.join(several, "component").join(cats, "component").select("component", "node", "role", "category", ((F.col("most") > 1) | (F.col("cats") > 1)).alias("conflict"))


def facility_roles(groups: DataFrame) -> DataFrame:
    """Representative, display and analysis member of each group without conflict.

    Representative: metadata score down, role order, id; display: site, building, else the
    representative; analysis: site, point, else the representative.
    """
    rank = F.when(F.col("role") == "FACILITY_SITE", 0).when(F.col("role") == "POINT", 1).when(F.col("role") == "BUILDING", 2).otherwise(3)
    pick = lambda role: F.min(F.when(F.col("role") == role, F.col("node")))
    per = groups.where(~F.col("conflict")).groupBy("component").agg(
        F.count("*").alias("members"),
        F.min_by("node", F.struct(-F.col("score"), rank, "node")).alias("representative"),
        pick("FACILITY_SITE").alias("site"),
        pick("BUILDING").alias("building"),
        pick("POINT").alias("point"),
    )
    return per.select("component", "members", "representative", F.coalesce("site", "building", "representative").alias("display"), F.coalesce("site", "point", "representative").alias("analysis"))


def resolve_facility_ids(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """(component, entity_id, outcome): reuse the one existing entity of any member, else a new name-based id."""
    named = groups.join(existing.select("node", "entity_id"), "node", "left").groupBy("component").agg(
        F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("old"), F.min("category").alias("category"), F.array_sort(F.collect_set(F.col("node").cast("string"))).alias("ids")
    )
    fresh = uuid5(F.concat(F.col("category"), F.lit("|"), F.array_join("ids", ",")))
    outcome = F.when(F.col("n") > 1, "conflict").when(F.col("n") == 1, "reused").otherwise("created")
    return named.select("component", F.when(F.col("n") <= 1, F.coalesce("old", fresh)).alias("entity_id"), outcome.alias("outcome"))


def reconcile_facilities(entities: DataFrame, planned: DataFrame, members: DataFrame) -> DataFrame:
    """Entities that no plan names: their one usable member stands in, or they go inactive."""
    loose = entities.join(planned.select("entity_id"), "entity_id", "left_anti")
    usable = members.where("usable").groupBy("entity_id").agg(F.count("*").alias("n"), F.min("node").alias("only"))
    one = F.col("n") == 1
    return loose.join(usable, "entity_id", "left").select("entity_id", F.when(one, "active").otherwise("inactive").alias("status"), F.when(one, F.col("only")).alias("representative"))


def facility_report(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.count_if("strong").alias("strong"), F.count_if(F.col("rejected").isNotNull()).alias("rejected"), F.count_if(F.size("methods") > 1).alias("several_methods"))


# Streets


def street_candidates(roads: DataFrame, members: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, name, search_name, geom, relation_keys) of active roads that are lines and have a search name.

    roads: (id, name, status, geom, source_id, source_type, source_object_id); members:
    (source_id, relation_id, member_type, member_id); relations: (source_id, relation_id,
    relation_type, name). A street relation counts for a road of its own name, a dual
    carriageway for each of its ways.
    """
    lines = F.col("geom.gtype").isin("LINESTRING", "MULTILINESTRING")
    named = roads.where((F.col("status") == "active") & lines).withColumn("search_name", normalize_search(F.col("name"))).where("search_name <> ''")
    dual = F.col("relation_type") == "dual_carriageway"
    kinds = relations.where(F.col("relation_type").isin("street", "associatedStreet") | dual).select("source_id", "relation_id", "relation_type", normalize_search(F.col("name")).alias("__name"))
    held = members.where("member_type = 'way'").select("source_id", "relation_id", "member_id").join(kinds, ["source_id", "relation_id"])
    ways = named.where("source_type = 'way'").select("id", "source_id", F.col("source_object_id").alias("member_id"), "search_name")
    of = ways.join(held, ["source_id", "member_id"]).where(dual | (F.col("__name") == F.col("search_name")))
    key = F.concat_ws(":", F.col("source_id").cast("string"), "relation_type", F.col("relation_id").cast("string"))
    keys = of.groupBy("id").agg(F.array_sort(F.collect_set(key)).alias("relation_keys"))
    return named.join(keys, "id", "left").select("id", "name", "search_name", "geom", F.coalesce("relation_keys", F.array().cast("array<string>")).alias("relation_keys"))


def cluster_lines(lines: DataFrame, line_id: str, key: str, gap: float) -> DataFrame:
    """(line_id, key, component) of the graph of lines at most ``gap`` apart; a lone line is its own."""
    # Equal lines are linked through the one of least id, so that only distinct ones are compared.
    held = lines.select(line_id, key, "geom").where(F.col(key).isNotNull() & F.col("geom").isNotNull())
    lead = checkpointed(held.groupBy(key, "geom").agg(F.min(line_id).alias("__lead")))
    of = held.join(lead, [key, "geom"]).select(line_id, "__lead")
    edges = spatial.proximity_edges(lead.select(F.col("__lead").alias(line_id), key, "geom"), line_id, key, gap)
    comps = spatial.components(edges.select("a", "b")).withColumnRenamed("node", "__lead")
    found = lines.select(line_id, key).join(of, line_id, "left").join(comps, "__lead", "left")
    return found.select(line_id, key, F.coalesce("component", "__lead", line_id).alias("component"))


def merge_by_relation(clusters: DataFrame, relation: DataFrame, line_id: str, key: str) -> DataFrame:
    """Components of one name that share a relation become one; ``joined`` marks them."""
    held = clusters.join(relation.select(line_id, "relation_id"), line_id).select(key, "component", "relation_id").distinct()
    least = held.groupBy(key, "relation_id").agg(F.min("component").alias("b"))
    merged = spatial.components(held.join(least, [key, "relation_id"]).select(F.col("component").alias("a"), "b")).select(F.col("node").alias("component"), F.col("component").alias("__to"))
    out = clusters.join(merged, "component", "left").select(line_id, key, F.coalesce("__to", "component").alias("component"), F.col("__to").isNotNull().alias("joined"))
    return out


def street_groups(clusters: DataFrame, key: str, raw_name: str) -> DataFrame:
    """(component, name, members): the most frequent name, then the shortest, then by lower case and raw text."""
    counted = clusters.groupBy("component", raw_name).agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), F.length(raw_name), F.lower(raw_name), F.col(raw_name))
    return counted.groupBy("component").agg(F.min_by(raw_name, order).alias("name"), F.sum("n").alias("members"))


def resolve_street_ids(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """(component, entity_id): the existing entity of largest overlap; of several claims the largest keeps it.

    groups: (component, member); existing: (entity_id, member).
    """
    overlap = groups.join(existing, "member").groupBy("component", "entity_id").agg(F.count("*").alias("n"))
    choice = overlap.withColumn("rn", F.row_number().over(W.partitionBy("component").orderBy(F.desc("n"), "entity_id"))).where("rn = 1")
    kept = choice.withColumn("rn", F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("n"), "component"))).where("rn = 1").select("component", "entity_id")
    names = groups.groupBy("component").agg(F.array_join(F.array_sort(F.collect_set(F.col("member").cast("string"))), ",").alias("ids"))
    return names.join(kept, "component", "left").select("component", F.coalesce("entity_id", uuid5(F.concat(F.lit("street|"), "ids"))).alias("entity_id"), F.col("entity_id").isNotNull().alias("reused"))


def assemble_streets(lines: DataFrame, clusters: DataFrame, line_id: str) -> DataFrame:
    """(component, geom): all lines of a component as one MULTILINESTRING."""
    held = lines.select(line_id, "geom").join(clusters.select(line_id, "component"), line_id)
    return held.groupBy("component").agg(F.array_sort(F.flatten(F.collect_list("geom.parts"))).alias("parts")).select("component", G.multi("MULTILINESTRING", F.col("parts")).alias("geom"))


def merge_entities(current: DataFrame, incoming: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Entity versions with change detection; absent ones go inactive."""
    merged = merge.merge_snapshot(current, incoming, ["entity_id"], payload)
    return merged.withColumn("status", F.when(F.col("change") == "absent", "inactive").otherwise("active"))


def street_report(clusters: DataFrame, key: str) -> DataFrame:
    per = clusters.groupBy(key, "component").agg(F.count("*").alias("n"))
    names = per.groupBy(key).agg(F.count("*").alias("c"))
    sizes = per.agg(F.sum("n").alias("members"), F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("multi_member"), F.max("n").alias("largest"))
    return sizes.crossJoin(names.agg(F.count_if(F.col("c") > 1).alias("separated_names")))
