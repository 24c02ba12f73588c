"""The whole refresh of an authoritative map profile as one resumable job of versioned stages.

A run goes through staging, derived geometries, the canonical catalog, categories and
finalisation. A stage writes each of its tables as one immutable version named after the run
and then one ledger row; a table that was half written by a lost driver is overwritten when
its stage runs again, as only the ledger row makes a stage count. A rerun of the same run id
starts after its last finished stage. The pointer to the current run moves in the last row,
so readers of ``current`` see the old run whole or the new one whole.

Inputs, per profile: nodes (osm_id, tags, geom), ways (osm_id, tags, geom), relations (osm_id,
relation_type, tags), members (relation_id, sequence, member_type, member_id, role); rules as
``catalog.rules_frame``. State carried from run to run: memberships, bindings, evidence,
categories and objects.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.operators import catalog, merge
from urbanspark.sources import assembly, osm

STAGES = ("staged", "derived", "canonical", "categories", "finalized")
STATE = ("memberships", "bindings", "evidence", "categories", "objects")
KEYS = ["source_type", "source_object_id"]
LEDGER = "profile string, run_id int, seq int, stage string, state string, details string"
_EMPTY = {
    "memberships": "profile string, source_type string, source_object_id long, status string, first_run int, last_run int",
    "bindings": "source_type string, source_object_id long, object_id string, payload_hash string, revision long, first_run int, last_run int, changed_run int, status string, name string, quality string, object_kind string, family string, tags map<string,string>",
    "evidence": "binding_id string, category string, rule_id string, status string, first_run int",
    "categories": "object_id string, category string, status string",
    "objects": "object_id string, name string, status string, revision long",
}


def _key(*columns: str) -> Column:
    return F.concat_ws(":", *(F.col(c).cast("string") for c in columns))


class Store:
    """Versioned tables and the ledger of runs below one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, run: int, stage: str, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/run={run}")
        return self.read(name, run)

    def read(self, name: str, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/run={run}")

    def ledger(self) -> DataFrame:
        empty = self.spark.createDataFrame([], LEDGER)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/ledger")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger") if there else empty

    def log(self, profile: str, run: int, stage: str, state: str, details: dict) -> None:
        """One row, written as a file of its own; a stage that is logged twice counts once."""
        seq = STAGES.index(stage)
        row = [(profile, run, seq, stage, state, json.dumps(details, sort_keys=True))]
        self.spark.createDataFrame(row, LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def finished(self, run: int) -> dict[str, dict]:
        rows = self.ledger().where((F.col("run_id") == run) & (F.col("state") == "done")).select("stage", "details").collect()
        return {r["stage"]: json.loads(r["details"]) for r in rows}

    def current(self) -> int | None:
        """The newest finalised run: its last row is the pointer."""
        return self.ledger().where("stage = 'finalized' AND state = 'done'").agg(F.max("run_id").alias("r")).first()["r"]

    def state(self, name: str, run: int | None) -> DataFrame:
        return self.spark.createDataFrame([], _EMPTY[name]) if run is None else self.read(name, run)


def _counts(df: DataFrame, column: str) -> dict[str, int]:
    return {str(r[column]): r["n"] for r in df.groupBy(column).agg(F.count("*").alias("n")).collect()}


def _stage_inputs(store: Store, run: int, inputs: dict[str, DataFrame]) -> dict:
    """Raw rows as they come, and the identities that this snapshot holds."""
    kept = {name: store.write(run, "staged", f"staged_{name}", inputs[name]) for name in ("nodes", "ways", "relations", "members")}
    return {r["staged"]: r["n"] for r in osm.staged_counts(kept).collect()}


def _derive(store: Store, run: int) -> dict:
    """Areas and routes of the staged relations, their statuses from the assembled shapes."""
    nodes, ways, relations, members = (store.read(f"staged_{n}", run) for n in ("nodes", "ways", "relations", "members"))
    of = lambda *kinds: members.join(relations.where(F.col("relation_type").isin(*kinds)).select(F.col("osm_id").alias("relation_id")), "relation_id", "left_semi")
    kind = relations.select(F.col("osm_id").alias("relation_id"), "relation_type", "tags")
    areas = assembly.area_relations(of("multipolygon", "boundary"), ways, relations.select("osm_id")).select("relation_id", "geom", "status")
    routes = assembly.route_relations(of("route"), nodes, ways, relations.select("osm_id")).select("relation_id", "geom", "status")
    derived = store.write(run, "derived", "derived", areas.unionByName(routes).join(kind, "relation_id"))
    variants = osm.route_variants(members, relations.select(F.col("osm_id").alias("relation_id"), "relation_type", *(F.try_element_at("tags", F.lit(k)).alias(a) for k, a in (("route", "mode"), ("ref", "ref"), ("name", "name")))))
    masters = store.write(run, "derived", "route_variants", variants)
    return _counts(derived, "status") | {"route_variants": masters.count()}


def _canonical(store: Store, run: int, before: int | None, profile: str) -> dict:
    """Identity merge of the eligible objects, and the memberships of what was seen."""
    source = F.lit(1).alias("source_id")
    nodes, ways = (store.read(f"staged_{n}", run).select(source, "osm_id", "tags", "geom") for n in ("nodes", "ways"))
    derived = store.read("derived", run).select(source, F.col("relation_id").alias("osm_id"), "tags", "geom", "status", F.col("relation_type").alias("kind"))
    found = catalog.canonical_candidates(nodes, ways, derived)
    hashed = found.withColumn("payload_hash", catalog.payload_hash("object_kind", "name", "geom", "tags", "quality")).withColumn("family", G.family(F.col("geom")))
    candidates = store.write(run, "canonical", "candidates", hashed)
    old = store.state("bindings", before)
    merged = catalog.canonicalize(candidates, old, run, KEYS)
    fresh = candidates.select(*KEYS, *(F.col(c).alias(f"__{c}") for c in ("name", "quality", "object_kind", "family", "tags")), F.lit(True).alias("__seen"))
    carried = old.select(*KEYS, "status", "name", "quality", "object_kind", "family", "tags")
    joined = merged.join(carried, KEYS, "left").join(fresh, KEYS, "left")
    picked = [F.when(F.col("__seen"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "quality", "object_kind", "family", "tags")]
    status = F.when(F.col("__seen"), "present").otherwise(F.col("status")).alias("status")
    bound = store.write(run, "canonical", "bindings_seen", joined.select(*KEYS, "object_id", "payload_hash", "revision", "first_run", "last_run", "changed_run", "outcome", status, *picked))
    # Everything staged was seen, whether it is eligible or not: only what a snapshot no longer holds goes missing.
    seen = [store.read(f"staged_{n}", run).select(F.lit(kind).alias("source_type"), F.col("osm_id").alias("source_object_id")) for n, kind in (("nodes", "node"), ("ways", "way"), ("relations", "relation"))]
    now = reduce(DataFrame.union, seen).withColumn("profile", F.lit(profile))
    members = merge.upsert_membership(store.state("memberships", before), now, ["profile", *KEYS], run)
    held = store.write(run, "canonical", "memberships_seen", members)
    requested = now.count()
    counts = _counts(bound, "outcome")
    eligible = sum(n for k, n in counts.items() if k != "absent")
    return counts | {"requested": requested, "excluded": requested - eligible, "memberships": held.count()}


def _categories(store: Store, run: int, before: int | None, rules: DataFrame) -> dict:
    """Rules over the objects of this run; evidence that they no longer give goes inactive."""
    bound = store.read("bindings_seen", run)
    now = bound.where("outcome <> 'absent'").select(_key(*KEYS).alias("binding_id"), "source_type", "family", F.col("object_kind").alias("kind"), "tags")
    matches = store.write(run, "categories", "matches", catalog.rule_matches(now, rules))
    evidence = store.write(run, "categories", "evidence_seen", catalog.merge_evidence(store.state("evidence", before), matches, run, now.select("binding_id")))
    report = catalog.category_report(evidence).agg(F.sum("matches").alias("evidence"), F.sum("active").alias("active"), F.count("*").alias("categories")).first()
    return {"candidates": now.count(), "matches": matches.count(), "evidence": report["evidence"] or 0, "active": report["active"] or 0, "categories": report["categories"]}


def _finalize(store: Store, run: int, before: int | None, profile: str, authoritative: tuple[str, ...]) -> dict:
    """Lifecycle in five steps; what another authoritative profile still holds stays present."""
    members, bound, evidence = (store.read(f"{n}_seen", run) for n in ("memberships", "bindings", "evidence"))
    lost = (F.col("profile") == profile) & (F.col("status") == "present") & (F.col("last_run") < run)
    memberships = store.write(run, "finalized", "memberships", members.withColumn("status", F.when(lost, "missing").otherwise(F.col("status"))))
    gone = memberships.where((F.col("profile") == profile) & (F.col("status") == "missing")).select(*KEYS).distinct()
    there = memberships.where(F.col("profile").isin(*authoritative) & (F.col("status") == "present")).select(*KEYS)
    missing = gone.join(there, KEYS, "left_anti").withColumn("__m", F.lit(True))
    bindings = store.write(run, "finalized", "bindings", bound.join(missing, KEYS, "left").withColumn("status", F.when(F.col("__m") & (F.col("outcome") == "absent"), "missing").otherwise(F.col("status"))).drop("__m", "outcome"))
    ids = bindings.select(_key(*KEYS).alias("binding_id"), "object_id", F.col("status").alias("__status"))
    proof = evidence.join(ids, "binding_id", "left")
    kept = store.write(run, "finalized", "evidence", proof.withColumn("status", F.when(F.col("__status") == "missing", "inactive").otherwise(F.col("status"))).drop("__status", "object_id"))
    categories = store.write(run, "finalized", "categories", catalog.object_categories(kept, ids))
    old = store.state("objects", before).select("object_id", F.col("name").alias("__name"), F.col("status").alias("__status"), F.col("revision").alias("__revision"))
    named = bindings.groupBy("object_id").agg(F.min_by("name", F.struct(-F.col("last_run"), *KEYS)).alias("name"), F.when(F.bool_or(F.col("status") == "present"), "active").otherwise("inactive").alias("status"), F.max("revision").alias("revision"))
    objects = store.write(run, "finalized", "objects", named.join(old, "object_id", "left"))
    changed = objects.where("__status IS NOT NULL AND __status <> status")
    lifecycle = {
        "missing_memberships": memberships.join(members.where(F.col("status") == "present").select("profile", *KEYS), ["profile", *KEYS], "left_semi").where("status = 'missing'").count(),
        "missing_bindings": bindings.where("status = 'missing'").join(bound.where("status = 'present'").select(*KEYS), KEYS, "left_semi").count(),
        "affected_objects": changed.count(),
        "active_objects": objects.where("status = 'active'").count(),
        "inactive_evidence": kept.where("status = 'inactive'").count(),
    }
    return lifecycle


def refresh(spark: SparkSession, path: str, run: int, profile: str, inputs: Callable[[], dict[str, DataFrame]], rules: DataFrame, authoritative: tuple[str, ...] = (), stop_after: str | None = None) -> dict[str, dict]:
    """Runs or resumes ``run`` of ``profile`` and returns each stage's counts.

    ``inputs`` is asked only if staging hasn't finished. A failed stage is logged and raised;
    ``stop_after`` ends the job after a stage, as a lost driver would. A run older than the
    current one is refused.
    """
    store = Store(spark, path)
    done, before = store.finished(run), store.current()
    if before is not None and run < before:
        raise ValueError(f"run {run} is older than the current run {before}")
    if before == run:
        return done
    steps: dict[str, Callable[[], dict]] = {
        "staged": lambda: _stage_inputs(store, run, inputs()),
        "derived": lambda: _derive(store, run),
        "canonical": lambda: _canonical(store, run, before, profile),
        "categories": lambda: _categories(store, run, before, rules),
        "finalized": lambda: _finalize(store, run, before, profile, tuple({*authoritative, profile})),
    }
    for stage in STAGES:
        if stage in done:
            continue
        try:
            done[stage] = steps[stage]()
        except Exception as error:
            store.log(profile, run, stage, "failed", {"error_type": type(error).__name__, "error": str(error)[:2000]})
            raise
        store.log(profile, run, stage, "done", done[stage])
        if stage == stop_after:
            break
    return done
