"""Queries over merges, ledgers, the catalog, entities and raw sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.functions import text as T
from urbanspark.functions.session import checkpointed
from urbanspark.operators import catalog, entities, grid, merge, scoring, spatial
from urbanspark.plans import synth
from urbanspark.plans.registry import query
from urbanspark.sources import features, osm

DAY, NEXT = 5, 6
_DAYS = "WITH cur AS (SELECT * FROM obs WHERE run = 5), inc AS (SELECT * FROM obs WHERE run = 6) "


def day(spark, sf, run: int) -> DataFrame:
    return synth.observations(spark, sf).where(F.col("run") == run)


def csv(c) -> F.Column:
    return F.array_join(F.array_sort(c).cast("array<string>"), ",")


# Merge and ledger


@query(_DAYS + """SELECT coalesce(c.user_id, i.user_id) AS user_id, CASE WHEN i.user_id IS NULL THEN c.kind ELSE i.kind END AS kind,
    CASE WHEN i.user_id IS NULL THEN 'absent' WHEN c.user_id IS NULL THEN 'inserted' WHEN c.kind IS DISTINCT FROM i.kind THEN 'updated' ELSE 'unchanged' END AS change
    FROM cur c FULL JOIN inc i ON c.user_id = i.user_id""", "obs")
def snapshot_merge(spark, sf):
    return merge.merge_snapshot(day(spark, sf, DAY), day(spark, sf, NEXT), ["user_id"], ["kind"])


@query(_DAYS + """SELECT count(i.user_id) AS processed, count(*) FILTER (c.user_id IS NULL) AS inserted, count(*) FILTER (c.kind <> i.kind) AS updated, count(*) FILTER (c.kind = i.kind) AS skipped
    FROM cur c FULL JOIN inc i ON c.user_id = i.user_id""", "obs")
def snapshot_merge_counts(spark, sf):
    return merge.merge_counts(merge.merge_snapshot(day(spark, sf, DAY), day(spark, sf, NEXT), ["user_id"], ["kind"]))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 3 <> 0
    UNION ALL SELECT l_orderkey, l_linenumber + 100, l_partkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 2""")
def replace_children(spark, sf):
    cur = synth.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    observed = cur.where(F.col("l_orderkey") % 3 == 0)
    inc = observed.where("l_linenumber <= 2").withColumn("l_linenumber", F.col("l_linenumber") + 100)
    return merge.replace_children(cur, inc, ["l_orderkey"], observed)


def memberships(spark, sf, run: int) -> DataFrame:
    """Memberships of all users seen until ``run``."""
    seen = synth.observations(spark, sf).where(F.col("run") <= run)
    return seen.groupBy("user_id").agg(F.lit("present").alias("status"), F.min("run").alias("first_run"), F.max("run").alias("last_run"))


@query("""WITH cur AS (SELECT user_id, min(run) AS f, max(run) AS l FROM obs WHERE run <= 5 GROUP BY 1), seen AS (SELECT DISTINCT user_id FROM obs WHERE run = 6)
    SELECT coalesce(c.user_id, s.user_id) AS user_id, 'present' AS status, CAST(coalesce(f, 6) AS INTEGER) AS first_run, CAST(CASE WHEN s.user_id IS NOT NULL THEN 6 ELSE l END AS INTEGER) AS last_run FROM cur c FULL JOIN seen s ON c.user_id = s.user_id""", "obs")
def membership_upsert(spark, sf):
    return merge.upsert_membership(memberships(spark, sf, DAY), day(spark, sf, NEXT), ["user_id"], NEXT)


@query("""WITH m AS (SELECT user_id, max(run) AS last FROM obs WHERE run <= 6 GROUP BY 1), o AS (SELECT user_id // 2 AS object_id, bool_or(last = 6) AS there FROM m GROUP BY 1)
    SELECT object_id, CASE WHEN there THEN 'active' ELSE 'inactive' END AS status FROM o""", "obs")
def finalize_snapshot(spark, sf):
    m = memberships(spark, sf, NEXT).select(F.lit("city").alias("profile"), F.col("user_id").alias("source_object_id"), "status", "last_run")
    bindings = m.select("source_object_id", F.floor(F.col("source_object_id") / 2).alias("object_id"), F.lit("present").alias("status"))
    evidence = m.select("source_object_id", F.lit("stop").alias("category"), F.lit("active").alias("status"))
    return catalog.finalize_snapshot(m, bindings, evidence, NEXT, "city")[4]


@query("SELECT metric_key, grid_version, arg_max(run_id, (seq, run_id)) AS run_id FROM (SELECT event_type AS metric_key, user_id % 5 AS grid_version, event_id AS run_id, epoch_us(ts) AS seq FROM events) GROUP BY 1, 2")
def current_pointer(spark, sf):
    e = synth.table(spark, sf, "events")
    return merge.current_pointer(e.select(F.col("event_type").alias("metric_key"), (F.col("user_id") % 5).alias("grid_version"), F.col("event_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("seq")))


@query("""WITH led AS (SELECT user_id AS signature, min(kind) AS checksum FROM obs WHERE run = 5 GROUP BY 1), c AS (SELECT user_id AS signature, kind AS checksum, 'm' AS metric_key FROM obs WHERE run = 6)
    SELECT metric_key, c.signature, CASE WHEN l.signature IS NULL THEN 'CREATED' WHEN l.checksum = c.checksum THEN 'UNCHANGED' ELSE 'CONFLICT' END AS outcome FROM c LEFT JOIN led l USING (signature)""", "obs")
def publish_plan(spark, sf):
    own = lambda run: day(spark, sf, run).select(F.col("user_id").alias("signature"), F.col("kind").alias("checksum"), F.lit("m").alias("metric_key"))
    return merge.publish_plan(own(NEXT), own(DAY))


@query("SELECT run_id, seq, state, previous FROM (SELECT run_id, seq, state, lag(state) OVER (PARTITION BY run_id ORDER BY seq) AS previous FROM (SELECT user_id AS run_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'staged' WHEN 'purchase' THEN 'success' ELSE 'failed' END AS state FROM events)) WHERE NOT coalesce((previous IS NULL AND state = 'pending') OR (previous = 'pending' AND state IN ('running', 'failed')) OR (previous = 'running' AND state IN ('staged', 'success', 'failed')) OR (previous = 'staged' AND state IN ('success', 'failed')), false)")
def illegal_transitions(spark, sf):
    return merge.illegal_transitions(run_events(spark, sf))


_RUNS = """WITH e AS (SELECT user_id AS run_id, event_id AS seq, day(ts) AS d, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'staged' WHEN 'purchase' THEN 'success' ELSE 'failed' END AS state FROM events) """


def run_events(spark, sf, days: str = "true") -> DataFrame:
    """Events as states of their user's run."""
    state = F.lit("failed")
    for event, name in (("view", "pending"), ("click", "running"), ("signup", "staged"), ("purchase", "success")):
        state = F.when(F.col("event_type") == event, name).otherwise(state)
    e = synth.table(spark, sf, "events").withColumn("d", F.dayofmonth("ts")).where(days)
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), state.alias("state"))


@query(_RUNS + """, b AS (SELECT run_id, arg_max(state, seq) AS was FROM e WHERE d <= 5 GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM e WHERE d > 5)
    SELECT run_id, seq, state, rn = 1 AND coalesce((was IS NULL AND state = 'pending') OR (was = 'pending' AND state IN ('running', 'failed')) OR (was = 'running' AND state IN ('staged', 'success', 'failed')) OR (was = 'staged' AND state IN ('success', 'failed')), false) AS accepted FROM n LEFT JOIN b USING (run_id)""")
def ledger_append(spark, sf):
    return merge.ledger_append(run_events(spark, sf, f"d <= {DAY}"), run_events(spark, sf, f"d > {DAY}"))


@query(_RUNS + "SELECT run_id, arg_max(state, seq) AS state, min(seq) AS started, max(seq) AS seq, count(*) AS events FROM e GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 20")
def latest_runs(spark, sf):
    return merge.latest_runs(run_events(spark, sf), 20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 9 IN (0, 1)")
def append_only_audit(spark, sf):
    old = synth.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    new = old.where(F.col("o_orderkey") % 9 != 0).withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 9 == 1, 1).otherwise(0))
    return merge.append_only_audit(old, new, ["o_orderkey", "o_totalprice"])


@query("""SELECT 'quantity_range' AS rule, count(*) FILTER (l_quantity NOT BETWEEN 1 AND 45) AS violations FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem
    UNION ALL SELECT 'unique_part', count(*) FROM (SELECT l_orderkey, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'part_reference', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0)""")
def constraint_audit(spark, sf):
    li, part = synth.table(spark, sf, "lineitem"), synth.table(spark, sf, "part")
    rows = merge.violations(li, {"quantity_range": F.col("l_quantity").between(1, 45), "flag": F.col("l_returnflag").isin("A", "N")})
    rows = rows.unionByName(merge.unique_violations(li, ["l_orderkey", "l_partkey"], "unique_part"))
    return rows.unionByName(merge.reference_violations(li, "l_partkey", part.where(F.col("p_partkey") % 5 != 0), "p_partkey", "part_reference"))


_DIGEST = """WITH r AS (SELECT sha256(concat_ws(chr(31), {0})) AS r FROM {1}),
    p AS (SELECT count(*) AS n, {2} FROM r) SELECT n, sha256(concat_ws(',', n::VARCHAR, {3})) AS digest FROM p"""


def _digest_sql(columns: list[str], source: str) -> str:
    sums = ", ".join(f"sum(('0x' || substr(r, {1 + 8 * i}, 8))::BIGINT::HUGEINT) AS p{i}" for i in range(8))
    return _DIGEST.format(", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in columns), source, sums, ", ".join(f"coalesce(p{i}::VARCHAR, '0')" for i in range(8)))


@query(_digest_sql(["p_partkey", "p_name", "p_brand", "p_size"], "part"))
def table_checksum(spark, sf):
    return merge.table_checksum(synth.table(spark, sf, "part"), ["p_partkey", "p_name", "p_brand", "p_size"])


@query(_digest_sql(["'grid-200m'", "category", "id", *(f"CAST({c} AS BIGINT)" for c in ("x - hw", "y - hw", "x + hw", "y + hw"))], "areas"), "areas")
def input_fingerprint(spark, sf):
    """Digest of the grid and each target's category, id and corners, so that a moved target changes it."""
    corners = [F.col(f"geom.{c}").cast("long").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")]
    own = synth.areas(spark, sf).select(F.lit(grid.grid_version(200)).alias("grid"), "category", "id", *corners)
    return merge.table_checksum(own, own.columns)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name || '!' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, 'new' FROM supplier WHERE s_suppkey % 10 = 0")
def upsert_dim(spark, sf):
    cur = synth.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    inc = cur.where(F.col("s_suppkey") % 4 == 0).withColumn("s_name", F.concat("s_name", F.lit("!")))
    inc = inc.union(cur.where(F.col("s_suppkey") % 10 == 0).select(F.col("s_suppkey") + 1_000_000, F.lit("new")))
    return merge.upsert_dim(cur, inc, "s_suppkey", ["s_name"])


# Scoring plans over run events


def runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Each event is a published run of its user's metric; pointers name the last."""
    e = synth.table(spark, sf, "events").select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("metric_key"), F.col("event_id").alias("run_id"), (F.col("event_id") % 3).alias("curve_checksum"), F.lit(10000).alias("cell_count"))
    return e, e.groupBy("metric_key").agg(F.max("run_id").alias("run_id"))


@query("""WITH r AS (SELECT 'm' || user_id AS metric_key, event_id AS run_id FROM events), p AS (SELECT metric_key, max(run_id) AS run_id FROM r GROUP BY 1), w AS (SELECT 'm' || c_custkey AS metric_key, CAST(1 + c_custkey % 5 AS DOUBLE) AS weight FROM customer)
    SELECT w.metric_key, weight, run_id, CASE WHEN run_id IS NULL THEN 'missing' WHEN run_id % 3 <> 0 THEN 'stale' END AS problem FROM w LEFT JOIN p USING (metric_key)""")
def scoring_plan(spark, sf):
    e, pointers = runs(spark, sf)
    w = synth.table(spark, sf, "customer").select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("metric_key"), (1 + F.col("c_custkey") % 5).cast("double").alias("weight"))
    curves = e.select("metric_key").distinct().withColumn("curve_checksum", F.lit(0).cast("long"))
    return scoring.plan_current(w, pointers, e, curves)


@query("""WITH w AS (SELECT 'm' || user_id AS metric_key, 1.0::DOUBLE AS weight, min(event_id) AS lo FROM events GROUP BY 1)
    SELECT metric_key, weight, CASE WHEN lo % 4 = 0 THEN 999999999 ELSE lo END AS run_id, CASE WHEN lo % 4 = 0 THEN 'unknown_run' END AS problem FROM w""")
def pinned_plan(spark, sf):
    e, _ = runs(spark, sf)
    first = e.groupBy("metric_key").agg(F.min("run_id").alias("lo"))
    pinned = first.select("metric_key", F.when(F.col("lo") % 4 == 0, 999_999_999).otherwise(F.col("lo")).alias("run_id"))
    return scoring.plan_pinned(first.select("metric_key", F.lit(1.0).alias("weight")), pinned, e)


@query("SELECT 'm' || user_id AS metric_key, event_id AS run_id, event_id = max(event_id) OVER (PARTITION BY user_id) AS is_current FROM events")
def is_current(spark, sf):
    e, pointers = runs(spark, sf)
    return scoring.is_current(e.select("metric_key", "run_id"), pointers)


# Catalog


def candidates(spark, sf, run: int) -> DataFrame:
    return day(spark, sf, run).select(F.lit(1).alias("source_id"), F.lit("node").alias("source_type"), F.col("user_id").alias("source_object_id"), F.col("kind").alias("name"), F.sha2("kind", 256).alias("payload_hash"))


def bindings(spark, sf) -> DataFrame:
    c = candidates(spark, sf, DAY)
    none = spark.createDataFrame([], "source_id int, source_type string, source_object_id long, object_id string, payload_hash string, revision long, first_run int, last_run int, changed_run int")
    return catalog.canonicalize(c, none, DAY).drop("outcome")


@query(_DAYS + """SELECT coalesce(c.user_id, i.user_id) AS source_object_id, CAST(CASE WHEN c.user_id IS NOT NULL AND c.kind <> i.kind THEN 2 ELSE 1 END AS BIGINT) AS revision,
    CASE WHEN i.user_id IS NULL THEN 'absent' WHEN c.user_id IS NULL THEN 'created' WHEN c.kind <> i.kind THEN 'changed' ELSE 'unchanged' END AS outcome,
    CASE WHEN c.user_id IS NULL THEN 6 ELSE 5 END AS first_run, CASE WHEN i.user_id IS NULL THEN 5 ELSE 6 END AS last_run FROM cur c FULL JOIN inc i ON c.user_id = i.user_id""", "obs")
def canonicalize(spark, sf):
    out = catalog.canonicalize(candidates(spark, sf, NEXT), bindings(spark, sf), NEXT)
    return out.select("source_object_id", "revision", "outcome", "first_run", "last_run")


def bound(spark, sf) -> DataFrame:
    """Observations as bindings of objects: five users share one."""
    o = synth.observations(spark, sf)
    return o.select(F.floor(F.col("user_id") / 5).alias("object_id"), (F.col("user_id") * 100 + F.col("run")).alias("binding_id"), (F.col("user_id") % 3).alias("priority"), F.when(F.col("run") % 2 == 0, "assembled").otherwise("raw").alias("quality"), F.col("run").alias("last_run"), F.when(F.col("kind") != "error", F.col("kind")).alias("name"), F.lit(False).alias("locked"))


_BOUND = """WITH b AS (SELECT user_id // 5 AS object_id, user_id * 100 + run AS binding_id, user_id % 3 AS priority, CASE WHEN run % 2 = 0 THEN 2 ELSE 1 END AS q, run AS last_run, CASE WHEN kind <> 'error' THEN kind END AS name FROM obs),
    gw AS (SELECT object_id, binding_id FROM b QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY priority DESC, q DESC, last_run DESC, binding_id) = 1),
    nw AS (SELECT object_id, name FROM b WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY priority DESC, last_run DESC, binding_id) = 1) """


@query(_BOUND + "SELECT gw.object_id, gw.binding_id, nw.name FROM gw LEFT JOIN nw USING (object_id)", "obs")
def winner_selection(spark, sf):
    b = bound(spark, sf)
    return catalog.geometry_winner(b).select("object_id", "binding_id").join(catalog.name_winner(b).select("object_id", "name"), "object_id", "left")


@query(_BOUND + """, o AS (SELECT DISTINCT object_id, 'view' AS name FROM b)
    SELECT o.object_id, coalesce(nw.name, o.name) AS name, gw.binding_id AS geometry_binding, CAST(2 AS BIGINT) AS revision, 'active' AS status FROM o JOIN gw USING (object_id) LEFT JOIN nw USING (object_id)""", "obs")
def apply_winners(spark, sf):
    b = bound(spark, sf)
    objects = b.select("object_id").distinct().select("object_id", F.lit("view").alias("name"), F.lit(None).cast("long").alias("geometry_binding"), F.lit(1).cast("long").alias("revision"), F.lit("inactive").alias("status"))
    return catalog.apply_winners(objects, catalog.geometry_winner(b), catalog.name_winner(b))


@query("SELECT user_id AS source_object_id, kind AS name FROM obs i WHERE run = 6 AND NOT EXISTS (SELECT 1 FROM obs c WHERE c.run = 5 AND c.user_id = i.user_id)", "obs")
def create_missing(spark, sf):
    return catalog.create_missing(candidates(spark, sf, NEXT), bindings(spark, sf)).select("source_object_id", "name")


@query("""WITH b AS (SELECT user_id // 5 AS object_id, kind, 's' || (user_id % 3) || '@' || run AS src, run FROM obs)
    SELECT object_id, 'o' || object_id AS name, coalesce(array_to_string(list_sort(list(DISTINCT kind) FILTER (kind <> 'error')), ','), '') AS categories, coalesce(array_to_string(list_sort(list(src) FILTER (run > 20)), ','), '') AS sources FROM b GROUP BY 1""", "obs")
def object_detail(spark, sf):
    o = synth.observations(spark, sf).withColumn("object_id", F.floor(F.col("user_id") / 5))
    objects = o.select("object_id").distinct().withColumn("name", F.concat(F.lit("o"), F.col("object_id").cast("string")))
    cats = o.select("object_id", F.col("kind").alias("category"), F.when(F.col("kind") != "error", "active").otherwise("inactive").alias("status"))
    srcs = o.select("object_id", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"), F.lit(None).cast("string").alias("native_version"), F.col("run").cast("string").alias("dataset_version"), F.when(F.col("run") > 20, "present").otherwise("missing").alias("status"))
    out = catalog.object_detail(objects, cats, srcs)
    return out.select("object_id", "name", F.array_join("categories", ",").alias("categories"), F.array_join("sources", ",").alias("sources"))


# Category rules

RULES = [
    {"category": "engaged", "rule_id": "r1", "conditions": [("kind", "in", ["click", "purchase"])], "families": ["point"]},
    {"category": "quiet", "rule_id": "r2", "conditions": [("kind", "not_equals", ["error"]), ("rare", "not_in", ["yes"])]},
    {"category": "rare", "rule_id": "r3", "conditions": [("rare", "exists", []), ("kind", "not_in", ["view", "signup"])]},
    {"category": "engaged", "rule_id": "r4", "conditions": [("kind", "equals", ["signup"])], "source_types": ["node"]},
]


def tagged(spark, sf, days: str = "true") -> DataFrame:
    """Observations with tags: kind, and rare for values over 50."""
    o = synth.observations(spark, sf).where(days)
    tags = F.map_filter(F.create_map(F.lit("kind"), F.col("kind"), F.lit("rare"), F.when(F.col("value") > 50, "yes")), lambda k, v: v.isNotNull())
    return o.select((F.col("user_id") * 100 + F.col("run")).alias("binding_id"), F.when(F.col("run") % 2 == 0, "node").otherwise("way").alias("source_type"), F.when(F.col("run") % 3 == 0, "line").otherwise("point").alias("family"), F.lit("feature").alias("kind"), tags.alias("tags"))


_RULES = """WITH t AS (SELECT user_id * 100 + run AS binding_id, run, kind, value > 50 AS rare FROM obs),
    m AS (SELECT binding_id, 'engaged' AS category, 'r1' AS rule_id, '{"kind":"' || kind || '"}' AS evidence FROM t WHERE kind IN ('click', 'purchase') AND run % 3 <> 0
      UNION ALL SELECT binding_id, 'quiet', 'r2', '{"kind":"' || kind || '"}' FROM t WHERE kind <> 'error' AND NOT rare
      UNION ALL SELECT binding_id, 'rare', 'r3', '{"kind":"' || kind || '","rare":"yes"}' FROM t WHERE rare AND kind NOT IN ('view', 'signup')
      UNION ALL SELECT binding_id, 'engaged', 'r4', '{"kind":"' || kind || '"}' FROM t WHERE kind = 'signup' AND run % 2 = 0) """


@query(_RULES + "SELECT * FROM m", "obs")
def category_rules(spark, sf):
    out = catalog.rule_matches(catalog.discover(tagged(spark, sf), ["kind", "rare"]), catalog.rules_frame(spark, RULES))
    return out.withColumn("evidence", F.to_json("evidence"))


def evidence(spark, sf) -> DataFrame:
    """Evidence of all bindings up to DAY and of a rule since given up, merged with the matches of every later one.

    The scope is what was observed since DAY: the old rule's evidence ends there and stays elsewhere.
    """
    rules = catalog.rules_frame(spark, RULES)
    early = catalog.rule_matches(tagged(spark, sf, f"run <= {DAY}"), rules).select("binding_id", "category", "rule_id")
    since = tagged(spark, sf, f"run > {DAY}")
    late = catalog.rule_matches(since, rules).select("binding_id", "category", "rule_id")
    old = early.union(late).select("binding_id", F.lit("old").alias("category"), F.lit("r0").alias("rule_id")).distinct()
    before = early.union(old).withColumns({"status": F.lit("active"), "first_run": F.lit(1)})
    return catalog.merge_evidence(before, late, 2, since.select("binding_id").distinct())


_EVIDENCE = _RULES + """, e AS (SELECT DISTINCT binding_id, 'old' AS category, 'r0' AS rule_id, CASE WHEN binding_id % 100 > 5 THEN 'inactive' ELSE 'active' END AS status, 1 AS first_run FROM m
      UNION ALL SELECT binding_id, category, rule_id, 'active', CASE WHEN binding_id % 100 > 5 THEN 2 ELSE 1 END FROM m) """


@query(_EVIDENCE + "SELECT * FROM e", "obs")
def category_evidence(spark, sf):
    return evidence(spark, sf)


@query(_EVIDENCE + "SELECT binding_id // 100 AS object_id, category, CASE WHEN bool_or(status = 'active') THEN 'active' ELSE 'inactive' END AS status FROM e GROUP BY 1, 2", "obs")
def category_rollup(spark, sf):
    found = evidence(spark, sf)
    return catalog.object_categories(found, found.select("binding_id", F.expr("binding_id div 100").alias("object_id")).distinct())


@query(_EVIDENCE + "SELECT category, count(*) AS matches, count(DISTINCT binding_id) AS objects, count(*) FILTER (status = 'active') AS active FROM e GROUP BY 1", "obs")
def category_report(spark, sf):
    return catalog.category_report(evidence(spark, sf))


# Entities


@query("""SELECT coalesce(m.name, d.name) AS district, CASE WHEN d.name IS NULL THEN 'unexpected' WHEN m.name IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' WHEN level <> 5 THEN 'level' END AS problem FROM (
    SELECT n_name AS name, count(*) AS n, min(CASE WHEN n_nationkey % 7 = 3 THEN 6 ELSE 5 END) AS level FROM (SELECT * FROM nation WHERE n_regionkey <> 4 UNION ALL SELECT * FROM nation WHERE n_nationkey = 2) GROUP BY 1) m
    FULL JOIN (SELECT n_name AS name FROM nation WHERE n_nationkey <> 1) d ON d.name = m.name WHERE d.name IS NULL OR m.name IS NULL OR n > 1 OR level <> 5""")
def bind_districts(spark, sf):
    n = synth.table(spark, sf, "nation")
    held = n.where("n_regionkey <> 4").union(n.where("n_nationkey = 2"))
    held = held.select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 7 == 3, 6).otherwise(5).alias("level"), F.lit("active").alias("status"), F.lit(True).alias("valid"))
    return entities.bind_districts(held, n.where("n_nationkey <> 1").select(F.col("n_name").alias("name")))


@query("SELECT district_id, display_order, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM districts", "districts")
def district_listing(spark, sf):
    return entities.district_listing(synth.districts(spark, sf))


def facility_pairs(spark, sf) -> DataFrame:
    """Point and area pairs of one class (id modulo 5) at most 100 m apart."""
    p = synth.points(spark, sf).select(F.col("id").alias("point_id"), (F.col("id") % 5).alias("class"), F.col("ref").alias("p_ref"), F.col("name").alias("p_name"), "x", "y")
    a = synth.areas(spark, sf).select(F.col("id").alias("area_id"), (F.col("id") % 5).alias("class"), F.col("ref").alias("a_ref"), F.col("name").alias("a_name"), "geom")
    return entities.candidate_pairs(p, a, 100.0, "class", boxes=True)


def facility_links(spark, sf) -> DataFrame:
    """The evidence of the pairs: the reference agrees on both sides or contradicts."""
    p = facility_pairs(spark, sf).withColumns({"p_ref": F.col("p_ref").cast("string"), "a_ref": F.col("a_ref").cast("string"), "same_site": F.col("contained") & (F.col("point_id") % 3 == 0) & (F.col("area_id") % 3 == 0)})
    return entities.link_evidence(p, have=["ref"])


@query("SELECT point_id, area_id, round(distance, 6) AS distance, distance = 0 AS contained FROM pairs", "pairs")
def facility_candidates(spark, sf):
    return facility_pairs(spark, sf).select("point_id", "area_id", F.round("distance", 6).alias("distance"), "contained")


_LINKS = """WITH l AS (SELECT point_id, area_id, CASE WHEN p_ref <> a_ref THEN 'contradictory_ref' END AS rejected, CASE WHEN p_ref <> a_ref THEN '' WHEN distance = 0 AND point_id % 3 = 0 AND area_id % 3 = 0 THEN 'exact_ref,explicit_site_relation' ELSE 'exact_ref' END AS methods FROM pairs) """


@query(_LINKS + "SELECT point_id, area_id, rejected, methods FROM l", "pairs")
def facility_evidence(spark, sf):
    return facility_links(spark, sf).select("point_id", "area_id", "rejected", F.array_join("methods", ",").alias("methods"))


@query(_LINKS + "SELECT count(*) AS pairs, count(*) FILTER (methods <> '') AS strong, count(rejected) AS rejected, count(*) FILTER (methods LIKE '%,%') AS several_methods FROM l", "pairs")
def facility_report(spark, sf):
    return entities.facility_report(facility_links(spark, sf))


SITE = 10_000_000


def groups(spark, sf) -> DataFrame:
    """Groups of the strong pairs; areas are nodes from SITE on, even ones sites and odd ones buildings."""
    strong = checkpointed(facility_links(spark, sf).where("strong").select("point_id", (F.col("area_id") + SITE).alias("area_id")))
    nodes = strong.select(F.col("point_id").alias("node")).union(strong.select("area_id")).distinct()
    role = F.when(F.col("node") < SITE, "POINT").when(F.col("node") % 2 == 0, "FACILITY_SITE").otherwise("BUILDING")
    roles = nodes.select("node", role.alias("role"), F.pmod(F.when(F.col("node") < SITE, F.col("node")).otherwise(F.col("node") - SITE), F.lit(5)).alias("category"))
    return entities.facility_groups(strong, roles)


_GROUPS = """WITH RECURSIVE s AS (SELECT point_id AS a, area_id + 10000000 AS b FROM pairs WHERE p_ref = a_ref), e AS (SELECT a, b FROM s UNION SELECT b, a FROM s),
    reach AS (SELECT DISTINCT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.seen),
    c AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1),
    g AS (SELECT component, node, CASE WHEN node < 10000000 THEN 'POINT' WHEN node % 2 = 0 THEN 'FACILITY_SITE' ELSE 'BUILDING' END AS role FROM c),
    k AS (SELECT component, max(n) > 1 AS conflict FROM (SELECT component, role, count(*) AS n FROM g GROUP BY 1, 2) GROUP BY 1) """


@query(_GROUPS + "SELECT component, node, role, conflict FROM g JOIN k USING (component)", "pairs")
def facility_groups(spark, sf):
    return groups(spark, sf).select("component", "node", "role", "conflict")


@query(_GROUPS + """, r AS (SELECT component, count(*) AS members, arg_min(node, (-(node % 6), CASE role WHEN 'FACILITY_SITE' THEN 0 WHEN 'POINT' THEN 1 ELSE 2 END, node)) AS representative,
      min(node) FILTER (role = 'FACILITY_SITE') AS site, min(node) FILTER (role = 'BUILDING') AS building, min(node) FILTER (role = 'POINT') AS point FROM g JOIN k USING (component) WHERE NOT conflict GROUP BY 1)
    SELECT component, members, representative, coalesce(site, building, representative) AS display, coalesce(site, point, representative) AS analysis FROM r""", "pairs")
def facility_roles(spark, sf):
    return entities.facility_roles(groups(spark, sf).withColumn("score", F.col("node") % 6))


@query(_GROUPS + """, x AS (SELECT component, count(DISTINCT CASE WHEN node < 10000000 AND node % 4 = 0 THEN node % 50 END) AS n FROM g GROUP BY 1)
    SELECT component, CASE WHEN n > 1 THEN 'conflict' WHEN n = 1 THEN 'reused' ELSE 'created' END AS outcome FROM x""", "pairs")
def facility_ids(spark, sf):
    g = groups(spark, sf)
    existing = g.where((F.col("node") < SITE) & (F.col("node") % 4 == 0)).select("node", (F.col("node") % 50).cast("string").alias("entity_id"))
    return entities.resolve_facility_ids(g.withColumn("category", F.col("category").cast("string")), existing).select("component", "outcome")


@query("""WITH m AS (SELECT p_partkey // 3 AS entity_id, p_partkey AS node, p_size > 25 AS usable FROM part), l AS (SELECT DISTINCT entity_id FROM m WHERE entity_id % 2 = 0), u AS (SELECT entity_id, count(*) AS n, min(node) AS only_one FROM m WHERE usable GROUP BY 1)
    SELECT l.entity_id, CASE WHEN n = 1 THEN 'active' ELSE 'inactive' END AS status, CASE WHEN n = 1 THEN only_one END AS representative FROM l LEFT JOIN u USING (entity_id)""")
def facility_reconcile(spark, sf):
    m = synth.table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 3).alias("entity_id"), F.col("p_partkey").alias("node"), (F.col("p_size") > 25).alias("usable"))
    every = m.select("entity_id").distinct()
    return entities.reconcile_facilities(every, every.where(F.col("entity_id") % 2 == 1), m)


@query("""WITH k AS (SELECT l_orderkey AS id, array_to_string(list_sort(list(DISTINCT '1:' || t || ':' || s_suppkey)), ',') AS relation_keys FROM lineitem JOIN (
      SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'street' WHEN 1 THEN 'associatedStreet' ELSE 'dual_carriageway' END AS t, 'street ' || (s_suppkey % 200) AS own FROM supplier) ON s_suppkey = l_suppkey
      JOIN roads r ON r.id = l_orderkey WHERE t = 'dual_carriageway' OR own = lower(r.name) GROUP BY 1)
    SELECT r.id, lower(r.name) AS search_name, coalesce(relation_keys, '') AS relation_keys FROM roads r LEFT JOIN k USING (id)""", "roads")
def street_candidates(spark, sf):
    k = F.col("s_nationkey") % 3
    kind = F.when(k == 0, "street").when(k == 1, "associatedStreet").otherwise("dual_carriageway")
    relations = synth.table(spark, sf, "supplier").select(F.lit(1).alias("source_id"), F.col("s_suppkey").alias("relation_id"), kind.alias("relation_type"), F.concat(F.lit(" STREET  "), (F.col("s_suppkey") % 200).cast("string")).alias("name"))
    m = synth.table(spark, sf, "lineitem").select(F.lit(1).alias("source_id"), F.col("l_suppkey").alias("relation_id"), F.lit("way").alias("member_type"), F.col("l_orderkey").alias("member_id"))
    roads = synth.roads(spark, sf).select("id", "name", "geom", F.lit("active").alias("status"), F.lit(1).alias("source_id"), F.lit("way").alias("source_type"), F.col("id").alias("source_object_id"))
    return entities.street_candidates(roads, m, relations).select("id", "search_name", F.array_join("relation_keys", ",").alias("relation_keys"))


def clusters(spark, sf) -> DataFrame:
    r = synth.roads(spark, sf)
    return entities.cluster_lines(r, "id", "name", 30.0)


_STREETS = """WITH k AS (SELECT DISTINCT name, slot FROM roads), b AS (SELECT name, slot, CASE WHEN slot - lag(slot) OVER (PARTITION BY name ORDER BY slot) = 1 THEN 0 ELSE 1 END AS new FROM k),
    g AS (SELECT name, slot, sum(new) OVER (PARTITION BY name ORDER BY slot) AS part FROM b), c AS (SELECT r.id, r.name, min(r.id) OVER (PARTITION BY r.name, part) AS component FROM roads r JOIN g USING (name, slot)) """


@query(_STREETS + "SELECT id, name, component FROM c", "roads")
def street_components(spark, sf):
    return clusters(spark, sf)


@query(_STREETS + ", x AS (SELECT component, CASE WHEN id % 3 = 0 THEN upper(name) ELSE name END AS raw FROM c), n AS (SELECT component, raw, count(*) AS k FROM x GROUP BY 1, 2) SELECT component, arg_min(raw, (-k, length(raw), lower(raw), raw)) AS name, CAST(sum(k) AS BIGINT) AS members FROM n GROUP BY 1", "roads")
def street_groups(spark, sf):
    c = clusters(spark, sf).withColumn("raw", F.when(F.col("id") % 3 == 0, F.upper("name")).otherwise(F.col("name")))
    return entities.street_groups(c, "name", "raw")


@query(_STREETS + """, o AS (SELECT component, id // 40 AS entity_id, count(*) AS n FROM c WHERE id % 2 = 0 GROUP BY 1, 2), f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY component ORDER BY n DESC, entity_id) = 1),
    w AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, component) = 1) SELECT DISTINCT c.component, w.entity_id IS NOT NULL AS reused FROM c LEFT JOIN w USING (component)""", "roads")
def street_ids(spark, sf):
    c = clusters(spark, sf)
    existing = c.where(F.col("id") % 2 == 0).select(F.floor(F.col("id") / 40).cast("string").alias("entity_id"), F.col("id").alias("member"))
    # Entity ids are compared as text in the reference order of numbers of one length.
    existing = existing.withColumn("entity_id", F.lpad("entity_id", 12, "0"))
    return entities.resolve_street_ids(c.select("component", F.col("id").alias("member")), existing).select("component", "reused")


@query(_STREETS + ", p AS (SELECT name, component, count(*) AS n FROM c GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS members, count(*) AS entities, count(*) FILTER (n > 1) AS multi_member, max(n) AS largest, (SELECT count(*) FROM (SELECT name FROM p GROUP BY 1 HAVING count(*) > 1)) AS separated_names FROM p", "roads")
def street_report(spark, sf):
    return entities.street_report(clusters(spark, sf), "name")


# Raw sources: orders are relations, their lines members; parts and suppliers the objects.


def order_members(spark, sf) -> DataFrame:
    li = synth.table(spark, sf, "lineitem")
    kind = F.when(F.col("l_partkey") % 3 == 0, "n").when(F.col("l_partkey") % 3 == 1, "w").otherwise("r")
    member = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), kind.alias("type"), F.col("l_partkey").alias("ref"), F.when(F.col("l_returnflag") == "A", "outer").when(F.col("l_returnflag") == "R", "inner").alias("role"))
    gathered = li.groupBy(F.col("l_orderkey").alias("osm_id")).agg(F.array_sort(F.collect_list(member)).alias("ms"))
    rel = gathered.select("osm_id", F.transform("ms", lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role"))).alias("members"))
    return osm.relation_members(rel)


_MEMBERS = """WITH m AS (SELECT l_orderkey AS relation_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'w' ELSE 'r' END, CASE l_returnflag WHEN 'A' THEN 'outer' WHEN 'R' THEN 'inner' END NULLS FIRST) - 1 AS sequence,
    CASE l_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS member_type, l_partkey AS member_id, CASE l_returnflag WHEN 'A' THEN 'outer' WHEN 'R' THEN 'inner' ELSE '' END AS role FROM lineitem) """


@query(_MEMBERS + "SELECT relation_id, CAST(sequence AS INTEGER) AS sequence, member_type, member_id, role FROM m")
def relation_members(spark, sf):
    return order_members(spark, sf)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_partkey % 3 = 2 AND l_orderkey <> l_partkey), r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT e.b FROM r JOIN e ON e.a = r.id) SELECT id FROM r""")
def relation_closure(spark, sf):
    m = synth.table(spark, sf, "lineitem").where((F.col("l_partkey") % 3 == 2) & (F.col("l_orderkey") != F.col("l_partkey")))
    edges = m.select(F.lit("relation").alias("kind"), F.col("l_orderkey").alias("id"), F.lit("relation").alias("to_kind"), F.col("l_partkey").alias("to_id")).distinct()
    start = synth.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.lit("relation").alias("kind"), F.col("o_orderkey").alias("id"))
    return osm.reference_closure(start, edges).select("id")


@query("""WITH n AS (SELECT id FROM pts WHERE x BETWEEN 345000 AND 349000 AND y BETWEEN 6635000 AND 6638500), w AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM n)),
    r AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_orderkey IN (SELECT id FROM w)) SELECT 'node' AS kind, id FROM n UNION ALL SELECT 'way', id FROM w UNION ALL SELECT 'relation', id FROM r""", "pts")
def extract_bbox(spark, sf):
    nodes = synth.points(spark, sf).select(F.col("id").alias("osm_id"), "x", "y")
    refs = synth.table(spark, sf, "orders").select(F.col("o_orderkey").alias("way_id"), F.col("o_custkey").alias("node_id"))
    m = synth.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("relation_id"), F.lit("way").alias("member_type"), F.col("l_orderkey").alias("member_id"))
    n, w, r = osm.extract_bbox(nodes, refs, m, (345000.0, 6635000.0, 349000.0, 6638500.0), "x", "y")
    return n.select(F.lit("node").alias("kind"), F.col("osm_id").alias("id")).union(w.select(F.lit("way"), "way_id")).union(r.select(F.lit("relation"), "relation_id"))


@query("""WITH r AS (SELECT s_suppkey AS id FROM supplier WHERE s_acctbal < 2000), w AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_suppkey IN (SELECT id FROM r)), n AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey IN (SELECT id FROM w))
    SELECT 'relation' AS kind, id FROM r UNION ALL SELECT 'way', id FROM w UNION ALL SELECT 'node', id FROM n""")
def extract_relations(spark, sf):
    ids = synth.table(spark, sf, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("relation_id"))
    m = synth.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("relation_id"), F.lit("way").alias("member_type"), F.col("l_orderkey").alias("member_id"))
    refs = synth.table(spark, sf, "orders").select(F.col("o_orderkey").alias("way_id"), F.col("o_custkey").alias("node_id"))
    return osm.extract_relations(ids, m, refs)


@query("SELECT o_orderkey AS relation_id, o_totalprice FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def drop_unsupported(spark, sf):
    o = synth.table(spark, sf, "orders").withColumnRenamed("o_orderkey", "relation_id")
    p = F.col("o_orderpriority")
    kind = F.when(p == "1-URGENT", "multipolygon").when(p == "2-HIGH", "boundary").when(p == "3-MEDIUM", "route").when(p == "5-LOW", "site")
    return osm.drop_unsupported(o.select("relation_id", "o_totalprice"), o.where("o_orderstatus <> 'F'").select("relation_id", kind.alias("relation_type")))


@query("SELECT 'nodes' AS staged, count(*) AS n FROM customer UNION ALL SELECT 'ways', count(*) FROM orders UNION ALL SELECT 'relations', count(*) FROM supplier UNION ALL SELECT 'members', count(*) FROM lineitem")
def staged_counts(spark, sf):
    return osm.staged_counts({k: synth.table(spark, sf, t) for k, t in {"nodes": "customer", "ways": "orders", "relations": "supplier", "members": "lineitem"}.items()})


@query(_MEMBERS + "SELECT 'member_type' AS dimension, member_type AS value, count(*) AS n FROM m GROUP BY 2 UNION ALL SELECT 'role', role, count(*) FROM m GROUP BY 2")
def inspect_members(spark, sf):
    return osm.inspect(order_members(spark, sf), ["member_type", "role"])


def osm_nodes(spark, sf) -> DataFrame:
    tags = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("amenity"), F.col("category"))).otherwise(F.create_map().cast("map<string,string>"))
    return synth.points(spark, sf).select(F.col("id").alias("osm_id"), F.col("x").alias("lon"), F.col("y").alias("lat"), tags.alias("tags"))


@query("SELECT id AS osm_id, x, y FROM pts WHERE id % 3 = 0", "pts")
def tagged_nodes(spark, sf):
    out = osm.tagged_nodes(osm_nodes(spark, sf))
    return out.select("osm_id", F.col("geom.xmin").alias("x"), F.col("geom.ymax").alias("y"))


@query("""WITH w AS (SELECT o_orderkey AS id, o_custkey AS a, (o_custkey + 1) % (SELECT count(*) FROM customer) AS b, (o_custkey + 2) % (SELECT count(*) FROM customer) AS c, o_orderkey % 4 AS k FROM orders)
    SELECT w.id AS osm_id, CASE WHEN k = 0 THEN 'POLYGON' ELSE 'LINESTRING' END AS gtype, CASE WHEN k = 0 THEN round(abs((p.x * (q.y - r.y) + q.x * (r.y - p.y) + r.x * (p.y - q.y)) / 2), 3) ELSE 0 END AS area, least(p.x, q.x, r.x) AS xmin
    FROM w JOIN pts p ON p.id = a JOIN pts q ON q.id = b JOIN pts r ON r.id = c""", "pts")
def way_geometry(spark, sf):
    n = synth.table(spark, sf, "customer").agg(F.count("*").alias("n"))
    o = synth.table(spark, sf, "orders").crossJoin(F.broadcast(n))
    a, b, c = F.col("o_custkey"), (F.col("o_custkey") + 1) % F.col("n"), (F.col("o_custkey") + 2) % F.col("n")
    k = F.col("o_orderkey") % 4
    tags = F.when(k == 0, F.create_map(F.lit("building"), F.lit("yes"))).when(k == 1, F.create_map(F.lit("building"), F.lit("yes"), F.lit("area"), F.lit("no"))).otherwise(F.create_map(F.lit("highway"), F.lit("service")))
    ways = o.select(F.col("o_orderkey").alias("osm_id"), F.when(k <= 1, F.array(a, b, c, a)).otherwise(F.array(a, b, c)).alias("refs"), tags.alias("tags"))
    out = osm.way_geometry(ways, osm_nodes(spark, sf))
    return out.select("osm_id", "geom.gtype", F.round(G.st_area(F.col("geom")), 3).alias("area"), F.col("geom.xmin").alias("xmin"))


@query(_MEMBERS + """, s AS (SELECT relation_id, count(*) AS members, count(*) FILTER (member_type = 'way') AS ways, count(*) FILTER (member_type = 'way' AND member_id % 5 = 0) AS missing_ways, count(*) FILTER (member_type = 'way' AND member_id % 5 = 1) AS null_ways,
      count(*) FILTER (member_type = 'relation') AS nested, count(*) FILTER (member_type = 'way' AND role = 'inner') AS inner_ways FROM m GROUP BY 1)
    SELECT *, CASE WHEN nested > 0 THEN 'unsupported_nested' WHEN missing_ways + null_ways > 0 AND relation_id % 2 = 0 THEN 'incomplete' WHEN missing_ways + null_ways > 0 THEN 'partial' WHEN relation_id % 2 = 0 OR relation_id % 7 = 1 THEN 'invalid' ELSE 'assembled' END AS status FROM s""")
def area_status(spark, sf):
    m = order_members(spark, sf)
    known = m.withColumn("resolved", F.col("member_id") % 5 != 0).withColumn("has_geom", F.col("member_id") % 5 != 1).withColumn("area_ok", F.when(F.col("relation_id") % 2 != 0, F.col("relation_id") % 7 != 1))
    return osm.area_status(known)


def transit_members(spark, sf) -> DataFrame:
    role = F.when(F.col("member_id") % 7 == 0, "stop").when(F.col("member_id") % 7 == 1, "platform").otherwise("")
    return order_members(spark, sf).withColumn("role", role)


_TRANSIT = _MEMBERS + """, t AS (SELECT relation_id, sequence, member_type, member_id, CASE member_id % 7 WHEN 0 THEN 'stop' WHEN 1 THEN 'platform' ELSE '' END AS role FROM m),
    k AS (SELECT t.*, CASE WHEN role = 'stop' THEN 'stop_position' WHEN role = 'platform' THEN 'platform' WHEN member_type = 'way' THEN 'path' WHEN member_type = 'relation' THEN 'relation' ELSE 'other' END AS kind, p_name AS name, p_partkey IS NOT NULL AS resolved FROM t LEFT JOIN part ON p_partkey = member_id AND p_partkey % 4 <> 0) """


@query(_TRANSIT + "SELECT relation_id, CAST(sequence AS INTEGER) AS sequence, member_type, member_id, role, kind, name, resolved FROM k")
def route_members(spark, sf):
    return osm.route_members(transit_members(spark, sf), part_objects(spark, sf))


def part_objects(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "node").when(k % 3 == 1, "way").otherwise("relation")
    return synth.table(spark, sf, "part").where(k % 4 != 0).select(kind.alias("member_type"), k.alias("member_id"), F.col("p_name").alias("name"))


@query(_TRANSIT + """, s AS (SELECT relation_id, count(*) AS members, count(*) FILTER (member_type = 'way' AND role NOT LIKE 'platform%') AS paths, count(*) FILTER (member_type = 'way' AND role NOT LIKE 'platform%' AND NOT resolved) AS missing_paths, CAST(0 AS BIGINT) AS null_paths, count(*) FILTER (role LIKE 'stop%') AS stops, count(*) FILTER (role LIKE 'platform%') AS platforms,
      count(*) FILTER (role LIKE 'stop%' AND NOT (member_type = 'node' AND resolved)) AS unresolved_stops, count(*) FILTER (role LIKE 'platform%' AND NOT resolved) AS unresolved_platforms, count(*) FILTER (member_type = 'relation') AS nested FROM k GROUP BY 1)
    SELECT *, CASE WHEN paths = 0 THEN 'incomplete' WHEN missing_paths > 0 AND relation_id % 2 = 0 THEN 'incomplete' WHEN missing_paths > 0 THEN 'partial' WHEN relation_id % 2 = 0 THEN 'invalid' ELSE 'assembled' END AS status FROM s""")
def route_status(spark, sf):
    m = osm.route_members(transit_members(spark, sf), part_objects(spark, sf))
    return osm.route_status(m.withColumn("has_geom", F.lit(True)).withColumn("geom_ok", F.when(F.col("relation_id") % 2 != 0, True)))


@query(_TRANSIT + "SELECT status, count(*) AS n FROM (SELECT relation_id, CASE WHEN count(*) FILTER (member_type = 'way' AND role NOT LIKE 'platform%') = 0 THEN 'incomplete' WHEN count(*) FILTER (member_type = 'way' AND role NOT LIKE 'platform%' AND NOT resolved) > 0 AND relation_id % 2 = 0 THEN 'incomplete' WHEN count(*) FILTER (member_type = 'way' AND role NOT LIKE 'platform%' AND NOT resolved) > 0 THEN 'partial' WHEN relation_id % 2 = 0 THEN 'invalid' ELSE 'assembled' END AS status FROM k GROUP BY relation_id) GROUP BY 1")
def assembly_summary(spark, sf):
    return osm.assembly_summary(route_status(spark, sf))


@query(_MEMBERS + "SELECT m.relation_id, CAST(m.sequence AS INTEGER) AS sequence, m.member_id, a.o_orderpriority AS master_ref, b.o_orderstatus AS mode, b.o_orderpriority AS ref, b.o_orderkey IS NOT NULL AS resolved FROM m JOIN orders a ON a.o_orderkey = m.relation_id AND a.o_orderkey % 2 = 0 LEFT JOIN orders b ON b.o_orderkey = m.member_id AND b.o_orderkey % 2 = 1 WHERE m.member_type = 'relation'")
def route_variants(spark, sf):
    o = synth.table(spark, sf, "orders")
    rel = o.select(F.col("o_orderkey").alias("relation_id"), F.when(F.col("o_orderkey") % 2 == 0, "route_master").otherwise("route").alias("relation_type"), F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("ref"), F.lit("x").alias("name"))
    return osm.route_variants(order_members(spark, sf), rel).drop("name")


@query("SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS objects FROM events GROUP BY 1")
def source_status(spark, sf):
    return synth.table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("objects"))


@query("SELECT doc_id, lang, source FROM documents")
def retained_view(spark, sf):
    return features.retain(synth.table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), "metadata", ["text"])


@query("""WITH a AS (SELECT page_id AS id FROM pages WHERE page_id % 10 <> 3 UNION ALL SELECT page_id FROM pages WHERE page_id % 10 = 4), g AS (SELECT page_id AS id FROM pages WHERE page_id % 10 <> 5 UNION ALL SELECT page_id FROM pages WHERE page_id % 10 = 6)
    SELECT CAST(sum(CASE WHEN p % 10 = 4 THEN 1 ELSE 0 END) AS BIGINT) AS repeated_ids, count(*) FILTER (p % 10 = 5) AS missing_rows, count(*) FILTER (p % 10 = 3) AS unasked_rows, count(*) FILTER (p % 10 = 6) AS repeated_rows, (SELECT count(*) FROM g) - count(*) AS off_count, (SELECT count(*) FROM g) NOT BETWEEN 1 AND 10000000 AS out_of_range FROM (SELECT page_id AS p FROM pages)""")
def source_completeness(spark, sf):
    p = synth.table(spark, sf, "pages").select(F.col("page_id").alias("id"))
    some = lambda drop, twice: p.where(F.col("id") % 10 != drop).union(p.where(F.col("id") % 10 == twice))
    return features.audit_snapshot(some(3, 4), some(5, 6), p.count(), 1, 10_000_000)


@query("SELECT p_name AS name, CASE WHEN min(p_size) % 3 = 0 THEN 'missing' ELSE 'type' END AS problem FROM part GROUP BY 1 HAVING min(p_size) % 3 < 2")
def schema_drift(spark, sf):
    p = synth.table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg((F.min("p_size") % 3).alias("k"))
    contract = p.select("name", F.lit("string").alias("type"), F.lit(True).alias("required"))
    return features.schema_drift(p.where("k > 0").select("name", F.when(F.col("k") == 1, "double").otherwise("string").alias("type")), contract)


@query("SELECT page_id AS feature_id, url AS address, CASE WHEN page_id % 4 = 0 THEN 'active' WHEN page_id % 4 = 1 THEN 'retired' ELSE 'unknown' END AS status, page_id % 6 = 0 AS repeated FROM pages UNION ALL SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN 'active' WHEN page_id % 4 = 1 THEN 'retired' ELSE 'unknown' END, true FROM pages WHERE page_id % 6 = 0")
def normalize_features(spark, sf):
    p = synth.table(spark, sf, "pages").withColumn("state", (F.col("page_id") % 4).cast("string"))
    raw = p.union(p.where(F.col("page_id") % 6 == 0))
    out = features.normalize_features(raw, {"url": "address", "state": "state"}, "page_id", {"0": "active", "1": "retired"}, "state")
    return out.select("feature_id", "address", "status", "repeated")


@query("WITH r AS (SELECT doc_id AS feature_id, sha256(text) AS row_hash FROM documents) SELECT 'docs' AS source_key, 'v2' AS snapshot_id, CAST(2 AS INTEGER) AS seq, (SELECT count(*) FROM r) AS n, 'v1' AS previous, 'CHANGED' AS state")
def append_snapshot(spark, sf):
    n = synth.table(spark, sf, "documents").select(F.col("doc_id").alias("feature_id"), F.sha2("text", 256).alias("row_hash"))
    history = spark.createDataFrame([("docs", "v1", 1, "0" * 64)], "source_key string, snapshot_id string, seq int, checksum string")
    return features.snapshot_row(n, history, "v2", "docs").drop("checksum")


@query("SELECT user_id AS source_key, arg_max(CASE event_type WHEN 'error' THEN 'SOURCE_UNAVAILABLE' WHEN 'click' THEN 'SCHEMA_CHANGED' WHEN 'view' THEN 'PARTIALLY_UPDATED' WHEN 'signup' THEN 'IMPORT_FAILED' ELSE 'CURRENT' END, event_id) AS health FROM events GROUP BY 1")
def latest_health(spark, sf):
    error = F.lit(None).cast("string")
    for event, kind in (("error", "timeout"), ("click", "schema"), ("view", "partial"), ("signup", "other")):
        error = F.when(F.col("event_type") == event, kind).otherwise(error)
    log = synth.table(spark, sf, "events").select(F.col("user_id").alias("source_key"), features.health_of(error).alias("health"), F.col("event_id").alias("checked_at"))
    return features.latest_health(log).select("source_key", "health")


@query("SELECT p_partkey, lower(trim(p_name)) AS search_name FROM part")
def search_names(spark, sf):
    return synth.table(spark, sf, "part").select("p_partkey", T.normalize_search(F.concat(F.lit("  "), "p_name", F.lit("  "))).alias("search_name"))
