"""The canonical catalog: identity merge, winners, lifecycle, tag rules and their evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.functions.session import broadcast_if_small
from urbanspark.functions.text import any_distinct, row_sha256, uuid5
from urbanspark.operators import merge

#: Rules up to this many (some hundred bytes each) are broadcast; more are joined by shuffle.
BROADCAST_RULES = 20_000
IDENTITY = ("source_id", "source_type", "source_object_id")


def canonical_candidates(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """Eligible objects of staged rows (source_id, osm_id, tags, geom; relations also kind and status).

    Nodes, ways as lines or polygons, and assembled multipolygon or boundary relations;
    only valid geometries that aren't empty.
    """

    def rows(df: DataFrame, kind: str, object_kind: Column, quality: str) -> DataFrame:
        return df.select("source_id", F.lit(kind).alias("source_type"), F.col("osm_id").alias("source_object_id"), F.try_element_at("tags", F.lit("name")).alias("name"), "tags", "geom", object_kind.alias("object_kind"), F.lit(quality).alias("quality"))

    n = rows(nodes, "node", F.lit("feature"), "raw")
    w = rows(ways.where(F.col("geom.gtype").isin("LINESTRING", "POLYGON")), "way", F.lit("feature"), "raw")
    good = relations.where((F.col("status") == "assembled") & F.col("kind").isin("multipolygon", "boundary"))
    r = rows(good, "relation", F.when(F.col("kind") == "boundary", "boundary").otherwise("feature"), "assembled")
    g = F.col("geom")
    return n.unionByName(w).unionByName(r).where(g.isNotNull() & ~G.is_empty(g) & G.st_is_valid(g))


def payload_hash(*columns: str) -> Column:
    return row_sha256(*columns)


def canonicalize(candidates: DataFrame, bindings: DataFrame, run: int, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """The next bindings: new, changed (other payload hash) or unchanged; absent ones stay as they are.

    candidates: keys, payload_hash; bindings: keys, object_id, payload_hash, revision,
    first_run, last_run, changed_run. A new object's id follows from its identity.
    """
    c = candidates.select(*keys, F.col("payload_hash").alias("__new"))
    joined = bindings.join(c, list(keys), "full_outer")
    is_new, seen = F.col("object_id").isNull(), F.col("__new").isNotNull()
    changed = seen & ~is_new & (F.col("__new") != F.col("payload_hash"))
    outcome = F.when(~seen, "absent").when(is_new, "created").when(changed, "changed").otherwise("unchanged")
    return joined.select(
        *keys,
        F.coalesce("object_id", uuid5(F.concat_ws("\x1f", *keys))).alias("object_id"),
        F.coalesce("__new", "payload_hash").alias("payload_hash"),
        F.when(is_new, 1).otherwise(F.col("revision") + F.when(changed, 1).otherwise(0)).cast("long").alias("revision"),
        F.coalesce("first_run", F.lit(run)).cast("int").alias("first_run"),
        F.when(seen, run).otherwise(F.col("last_run")).cast("int").alias("last_run"),
        F.when(is_new | changed, run).otherwise(F.col("changed_run")).cast("int").alias("changed_run"),
        outcome.alias("outcome"),
    )


def create_missing(candidates: DataFrame, bindings: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    return candidates.join(bindings.select(*keys), list(keys), "left_anti")


def geometry_winner(bindings: DataFrame) -> DataFrame:
    """Per object: priority, then assembled before raw, then last seen run, then least binding id; locked ones are skipped."""
    rank = F.when(F.col("quality") == "assembled", 2).when(F.col("quality") == "raw", 1).otherwise(0)
    free = bindings.where(~F.coalesce("locked", F.lit(False)))
    return merge.winners(free, ["object_id"], [F.desc("priority"), rank.desc(), F.desc("last_run"), F.asc("binding_id")])


def name_winner(bindings: DataFrame) -> DataFrame:
    return merge.winners(bindings.where(F.col("name").isNotNull()), ["object_id"], [F.desc("priority"), F.desc("last_run"), F.asc("binding_id")])


def apply_winners(objects: DataFrame, geometry: DataFrame, names: DataFrame) -> DataFrame:
    """Objects with the winning name and geometry source; the revision grows only by a difference."""
    g = geometry.select("object_id", F.col("binding_id").alias("__g"))
    n = names.select("object_id", F.col("name").alias("__n"))
    new_g, new_n = F.coalesce("__g", "geometry_binding"), F.coalesce("__n", "name")
    differs = any_distinct([(F.col("geometry_binding"), new_g), (F.col("name"), new_n)])
    joined = objects.join(g, "object_id", "left").join(n, "object_id", "left")
    return joined.select("object_id", new_n.alias("name"), new_g.alias("geometry_binding"), (F.col("revision") + F.when(differs, 1).otherwise(0)).alias("revision"), F.when(F.col("__g").isNotNull(), "active").otherwise(F.col("status")).alias("status"))


def finalize_snapshot(memberships: DataFrame, bindings: DataFrame, evidence: DataFrame, run: int, profile: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The five steps of an authoritative snapshot: next memberships, bindings, evidence, categories, objects.

    memberships: (profile, source_object_id, status, last_run); bindings: (source_object_id,
    object_id, status); evidence: (source_object_id, category, status).
    """
    lost = (F.col("profile") == profile) & (F.col("last_run") < run)
    members = memberships.withColumn("status", F.when(lost, "missing").otherwise(F.col("status")))
    gone = members.where((F.col("profile") == profile) & (F.col("status") == "missing")).select("source_object_id").distinct()
    there = members.where(F.col("status") == "present").select("source_object_id").distinct()
    missing = gone.join(there, "source_object_id", "left_anti").withColumn("__m", F.lit(True))
    bound = bindings.join(missing, "source_object_id", "left").withColumn("status", F.when(F.col("__m"), "missing").otherwise(F.col("status"))).drop("__m")
    proof = evidence.join(missing, "source_object_id", "left").withColumn("status", F.when(F.col("__m"), "inactive").otherwise(F.col("status"))).drop("__m")
    categories = proof.join(bound.select("source_object_id", "object_id"), "source_object_id").groupBy("object_id", "category").agg(F.when(F.bool_or(F.col("status") == "active"), "active").otherwise("inactive").alias("status"))
    objects = bound.groupBy("object_id").agg(F.when(F.bool_or(F.col("status") == "present"), "active").otherwise("inactive").alias("status"))
    return members, bound, proof, categories, objects


def object_detail(objects: DataFrame, categories: DataFrame, sources: DataFrame) -> DataFrame:
    """Objects with sorted active categories and sorted present sources, for many ids at once."""
    cats = categories.where("status = 'active'").groupBy("object_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    srcs = sources.where("status = 'present'").groupBy("object_id").agg(F.array_sort(F.collect_list(F.concat_ws("@", "source", F.coalesce("native_version", "dataset_version")))).alias("sources"))
    none = F.array().cast("array<string>")
    return objects.join(cats, "object_id", "left").join(srcs, "object_id", "left").select("object_id", "name", F.coalesce("categories", none).alias("categories"), F.coalesce("sources", none).alias("sources"))


# Tag rules


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as rows: {category, rule_id, conditions: [(key, op, [values])], source_types, families, kinds}; empty lists mean any."""
    ops = {"equals", "in", "exists", "not_equals", "not_in"}
    for r in rules:
        if not r["conditions"] or any(op not in ops for _, op, _ in r["conditions"]):
            raise ValueError(f"rule {r['rule_id']} has no or unknown conditions")
    rows = [(r["category"], r["rule_id"], [(k, op, list(v)) for k, op, v in r["conditions"]], r.get("source_types", []), r.get("families", []), r.get("kinds", [])) for r in rules]
    return spark.createDataFrame(rows, "category string, rule_id string, conditions array<struct<key:string,op:string,values:array<string>>>, source_types array<string>, families array<string>, kinds array<string>")


def _holds(tags: Column, c: Column) -> Column:
    value = F.try_element_at(tags, c["key"])
    listed = F.coalesce(F.array_contains(c["values"], value), F.lit(False))
    # An absent tag satisfies not_equals and not_in.
    return F.when(c["op"] == "exists", value.isNotNull()).when(c["op"].isin("equals", "in"), listed).otherwise(~listed)


def posted_rules(rules: DataFrame) -> DataFrame:
    """Rules with ``tag`` (key, value) under which each is posted.

    A rule needs any one of its positive conditions: the first on values, posted once for each
    value, else the first on a key alone, its value null. A rule of negations only has a null key.
    """
    positive = lambda *ops: F.get(F.filter("conditions", lambda c: c["op"].isin(*ops)), 0)
    by_value, by_key = positive("equals", "in"), positive("exists")
    tag = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    none = F.lit(None).cast("string")
    tags = F.when(by_value.isNotNull(), F.transform(F.array_distinct(by_value["values"]), lambda v: tag(by_value["key"], v))).otherwise(F.array(tag(by_key["key"], none)))
    return rules.withColumn("tag", F.explode(tags))


def rule_matches(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """(binding_id, category, rule_id, evidence): all conditions of a rule hold.

    objects: (binding_id, source_type, family, kind, tags). Evidence maps the tags of the
    rule's conditions that are present to their values. Objects and rules meet by an
    equal tag or key, then the other conditions are looked at; only rules of nothing but
    negations are held against every object, as nearly all match them.
    """
    posted = posted_rules(rules)
    own = objects.select("binding_id", "source_type", "family", "kind", "tags")
    value, key = F.col("tag.value"), F.col("tag.key")
    both = broadcast_if_small(posted.where(value.isNotNull()).withColumns({"__k": key, "__v": value}), BROADCAST_RULES)
    alone = broadcast_if_small(posted.where(value.isNull() & key.isNotNull()).withColumn("__k", key), BROADCAST_RULES)
    tagged = own.select("*", F.explode("tags").alias("__k", "__v"))
    met = tagged.join(both, ["__k", "__v"]).unionByName(tagged.join(alone, "__k")).drop("__k", "__v")
    negative = posted.where(key.isNull())
    if not negative.isEmpty():
        met = met.unionByName(own.join(broadcast_if_small(negative, BROADCAST_RULES)))
    any_or = lambda allowed, v: (F.size(allowed) == 0) | F.array_contains(allowed, v)
    tags = F.col("tags")
    matches = F.forall("conditions", lambda c: _holds(tags, c)) & any_or(F.col("source_types"), F.col("source_type")) & any_or(F.col("families"), F.col("family")) & any_or(F.col("kinds"), F.col("kind"))
    keys = F.transform("conditions", lambda c: c["key"])
    evidence = F.map_filter(tags, lambda k, v: F.array_contains(keys, k))
    return met.where(matches).select("binding_id", "category", "rule_id", evidence.alias("evidence"))


def discover(objects: DataFrame, rule_keys: list[str], memberships: DataFrame | None = None) -> DataFrame:
    """Objects with any tag that some rule looks at, of the given memberships only if there are any."""
    found = objects.where(F.arrays_overlap(F.map_keys("tags"), F.array(*map(F.lit, rule_keys))))
    return found if memberships is None else found.join(memberships.select("binding_id"), "binding_id", "left_semi")


def merge_evidence(current: DataFrame, matches: DataFrame, run: int, scope: DataFrame | None = None) -> DataFrame:
    """Next evidence: produced rows active, no longer produced ones inactive, first run kept; rows out of scope stay."""
    keys = ["binding_id", "category", "rule_id"]
    now = matches.select(*keys, F.lit(True).alias("__now"))
    if scope is not None:
        current = current.join(scope.select("binding_id", F.lit(True).alias("__in")), "binding_id", "left")
    else:
        current = current.withColumn("__in", F.lit(True))
    joined = current.join(now, keys, "full_outer")
    status = F.when(F.col("__now"), "active").when(F.col("__in"), "inactive").otherwise(F.col("status"))
    return joined.select(*keys, status.alias("status"), F.coalesce("first_run", F.lit(run)).cast("int").alias("first_run"))


def object_categories(evidence: DataFrame, bindings: DataFrame) -> DataFrame:
    """(object_id, category, status): active while any binding of the object has active evidence. bindings: (binding_id, object_id)."""
    return evidence.join(bindings.select("binding_id", "object_id"), "binding_id").groupBy("object_id", "category").agg(F.when(F.bool_or(F.col("status") == "active"), "active").otherwise("inactive").alias("status"))


def category_report(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("category").agg(F.count("*").alias("matches"), F.count_distinct("binding_id").alias("objects"), F.count_if(F.col("status") == "active").alias("active"))
