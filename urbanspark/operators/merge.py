"""Versioned merges, ledgers, publication and integrity audits.

Nothing is updated in place: a merge returns the next version of a table with a change
flag, and a ledger event makes a version current.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from urbanspark.functions.text import any_distinct

TRANSITIONS = {"pending": ("running", "failed"), "running": ("staged", "success", "failed"), "staged": ("success", "failed"), "success": (), "failed": ()}


def merge_snapshot(current: DataFrame, incoming: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """The next version: keys, payload and change (inserted, updated, unchanged, absent).

    An absent row keeps its payload. The payload of an unchanged row isn't rewritten.
    """
    cur = current.select(*keys, *(F.col(c).alias(f"__c_{c}") for c in payload), F.lit(True).alias("__c"))
    inc = incoming.select(*keys, *(F.col(c).alias(f"__i_{c}") for c in payload), F.lit(True).alias("__i"))
    changed = any_distinct([(F.col(f"__c_{c}"), F.col(f"__i_{c}")) for c in payload])
    change = F.when(F.col("__i").isNull(), "absent").when(F.col("__c").isNull(), "inserted").when(changed, "updated").otherwise("unchanged")
    picked = [F.when(F.col("__i").isNull(), F.col(f"__c_{c}")).otherwise(F.col(f"__i_{c}")).alias(c) for c in payload]
    return cur.join(inc, list(keys), "full_outer").select(*keys, *picked, change.alias("change"))


def merge_counts(merged: DataFrame) -> DataFrame:
    """One row: processed, inserted, updated, skipped; absent rows weren't processed."""
    n = lambda k: F.count_if(F.col("change") == k)
    return merged.agg(F.count_if(F.col("change") != "absent").alias("processed"), n("inserted").alias("inserted"), n("updated").alias("updated"), n("unchanged").alias("skipped"))


def replace_children(current: DataFrame, incoming: DataFrame, parent: Sequence[str], observed: DataFrame) -> DataFrame:
    """Children of every observed parent come from ``incoming``, all others stay."""
    return current.join(observed.select(*parent).distinct(), list(parent), "left_anti").unionByName(incoming)


def upsert_membership(current: DataFrame, seen: DataFrame, keys: Sequence[str], run: int) -> DataFrame:
    """Membership rows after a run: first and last seen run; present again, or as before."""
    cur = current.select(*keys, "status", "first_run", "last_run")
    now = seen.select(*keys).distinct().withColumn("__seen", F.lit(True))
    there = F.col("__seen").isNotNull()
    return cur.join(now, list(keys), "full_outer").select(
        *keys,
        F.when(there, "present").otherwise(F.col("status")).alias("status"),
        F.coalesce("first_run", F.lit(run)).cast("int").alias("first_run"),
        F.when(there, run).otherwise(F.col("last_run")).cast("int").alias("last_run"),
    )


def upsert_dim(current: DataFrame, incoming: DataFrame, key: str, payload: Sequence[str]) -> DataFrame:
    return merge_snapshot(current, incoming, [key], payload).drop("change")


def latest(events: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The value of the last event of each key."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def current_pointer(publications: DataFrame, keys: Sequence[str] = ("metric_key", "grid_version")) -> DataFrame:
    return latest(publications, keys, "run_id", ["seq", "run_id"])


def may_follow(before: Column, state: Column) -> Column:
    """Whether a run in state ``before`` (null: none yet) may enter ``state``."""
    ok = before.isNull() & (state == "pending")
    for source, targets in TRANSITIONS.items():
        if targets:
            ok = ok | ((before == source) & state.isin(*targets))
    return F.coalesce(ok, F.lit(False))


def ledger_append(ledger: DataFrame, incoming: DataFrame, run: str = "run_id", state: str = "state", order: str = "seq") -> DataFrame:
    """(run, order, state, accepted) of incoming events: the accepted ones are to be appended.

    Of the events of one run only the first is taken, and only if it may follow the run's
    last state in the ledger; the caller offers the others again after the append.
    """
    last = ledger.groupBy(run).agg(F.max_by(state, order).alias("__before"))
    first = incoming.groupBy(run).agg(F.min(order).alias("__first"))
    placed = incoming.join(first, run).join(last, run, "left")
    accepted = (F.col(order) == F.col("__first")) & may_follow(F.col("__before"), F.col(state))
    return placed.select(run, order, state, accepted.alias("accepted"))


def latest_runs(events: DataFrame, k: int, run: str = "run_id", state: str = "state", order: str = "seq") -> DataFrame:
    """The k runs of the newest events: (run, state, started, seq, events)."""
    per = events.groupBy(run).agg(F.max_by(state, order).alias("state"), F.min(order).alias("started"), F.max(order).alias("seq"), F.count("*").alias("events"))
    return per.orderBy(F.desc("seq"), run).limit(k)


def illegal_transitions(events: DataFrame, run: str = "run_id", state: str = "state", order: str = "seq") -> DataFrame:
    """Events whose state may not follow the one before; a run starts as pending."""
    before = F.lag(state).over(W.partitionBy(run).orderBy(order))
    return events.withColumn("previous", before).withColumn("ok", may_follow(F.col("previous"), F.col(state))).where(~F.col("ok")).drop("ok")


def coverage(values: DataFrame, grid: DataFrame, key: str = "cell_id", value: str = "raw_value") -> DataFrame:
    """One row: missing, extra, duplicate and non-finite counts of values against the grid."""
    v = values.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))).alias("bad"))
    g = grid.select(key, F.lit(1).alias("g"))
    return v.join(g, key, "full_outer").agg(
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("g").isNull()).alias("extra"),
        F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("non_finite"),
    )


def run_stats(values: DataFrame, key: str = "metric_key", value: str = "score") -> DataFrame:
    return values.groupBy(key).agg(F.count("*").alias("cells"), F.min(value).alias("min_score"), F.max(value).alias("max_score"), F.avg(value).alias("mean_score"))


def table_checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (n, digest): equal for equal multisets of rows, whatever their order.

    Row digests are summed in pieces of 32 bits as exact decimals, so tasks can add their
    parts in any order.
    """
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    piece = [F.sum(F.conv(F.substring(F.col("r"), 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string").alias(f"p{i}") for i in range(8)]
    total = df.select(row.alias("r")).agg(F.count("*").alias("n"), *piece)
    return total.select("n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *(F.coalesce(f"p{i}", F.lit("0")) for i in range(8))), 256).alias("digest"))


def publish_plan(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """(metric_key, signature, outcome) of candidate runs against the ledger.

    CREATED for a new signature, UNCHANGED for one with the same values, CONFLICT for one
    that was published with other values.
    """
    known = ledger.groupBy("signature").agg(F.min("checksum").alias("__checksum"))
    outcome = F.when(F.col("__checksum").isNull(), "CREATED").when(F.col("__checksum") == F.col("checksum"), "UNCHANGED").otherwise("CONFLICT")
    return candidates.join(known, "signature", "left").select("metric_key", "signature", outcome.alias("outcome"))


def publish(values: DataFrame, stats: dict, ledger: DataFrame | None, path: str) -> str:
    """Writes a run's values once: idempotent by signature. Returns the outcome.

    ``stats`` has metric_key, grid_version, run_id, signature and checksum.
    """
    spark = values.sparkSession
    row = spark.createDataFrame([stats])
    outcome = "CREATED" if ledger is None else publish_plan(row, ledger).first()["outcome"]
    if outcome == "CONFLICT":
        raise ValueError(f"signature {stats['signature']} was published with other values")
    if outcome == "CREATED":
        values.withColumn("run_id", F.lit(stats["run_id"])).write.partitionBy("run_id").mode("append").parquet(f"{path}/values")
        row.write.mode("append").parquet(f"{path}/ledger")
    return outcome


def append_only_audit(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Old rows that the new version lacks or has changed: must be none."""
    match = F.lit(True)
    a, b = old.select(*columns).alias("a"), new.select(*columns).alias("b")
    for c in columns:
        match = match & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, match, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows break each rule (a Column that should hold)."""
    counted = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "violations"))


def unique_violations(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def reference_violations(child: DataFrame, column: str, parent: DataFrame, key: str, rule: str) -> DataFrame:
    missing = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
    return missing.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def winners(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def write_version(df: DataFrame, path: str, version: str, partition_by: Sequence[str] = ()) -> str:
    """Writes one immutable version of a table and returns its path."""
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(target)
    return target
