"""Feature-page snapshots of external sources: completeness, drift, normalisation and history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanspark.functions import geometry as G
from urbanspark.functions import validity
from urbanspark.functions.text import row_sha256
from urbanspark.operators import merge
from urbanspark.sources import osm

UUID = r"^[0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{12}$"
HEALTH = ("CURRENT", "SOURCE_UNAVAILABLE", "SCHEMA_CHANGED", "PARTIALLY_UPDATED", "IMPORT_FAILED")


def audit_snapshot(ids: DataFrame, rows: DataFrame, expected: int, low: int, high: int) -> DataFrame:
    """One row of violations: count out of range or not as announced, repeated ids, ids without row or twice, rows nobody asked for."""
    asked = ids.groupBy("id").agg(F.count("*").alias("n"))
    got = rows.groupBy("id").agg(F.count("*").alias("m"))
    both = asked.join(got, "id", "full_outer")
    return both.agg(
        F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).cast("long").alias("repeated_ids"),
        F.count_if(F.col("m").isNull()).alias("missing_rows"),
        F.count_if(F.col("n").isNull()).alias("unasked_rows"),
        F.count_if(F.col("m") > 1).alias("repeated_rows"),
        (F.coalesce(F.sum("m"), F.lit(0)) - expected).cast("long").alias("off_count"),
        (~F.coalesce(F.sum("m"), F.lit(0)).between(low, high)).alias("out_of_range"),
    )


def schema_drift(fields: DataFrame, contract: DataFrame) -> DataFrame:
    """(name, problem) of approved fields that are missing or have another type."""
    f = fields.select("name", F.col("type").alias("__type"))
    problem = F.when(F.col("__type").isNull() & F.col("required"), "missing").when(F.col("__type") != F.col("type"), "type")
    return contract.join(f, "name", "left").select("name", problem.alias("problem")).where("problem IS NOT NULL")


def schema_fingerprint(fields: DataFrame, contract: DataFrame) -> DataFrame:
    """One row: digest over the approved fields alone, so that others may come and go."""
    own = fields.join(contract.select("name"), "name", "left_semi")
    return own.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "type"))), ","), 256).alias("fingerprint"))


def identity(c: Column) -> Column:
    """Trimmed upper-case UUID, null if it isn't one."""
    text = F.upper(F.translate(F.trim(c), "{}", ""))
    return F.when(text.rlike(UUID), text)


def normalize_features(raw: DataFrame, contract: dict[str, str], key: str, status: dict[str, str] | None = None, status_field: str | None = None) -> DataFrame:
    """Whitelisted and renamed properties with a row hash; repeated identities are flagged.

    contract: source field -> our name.
    """
    kept = [F.col(source).alias(name) for source, name in contract.items()]
    out = raw.select(F.col(key).alias("feature_id"), *kept)
    if status is not None and status_field:
        mapped = F.lit("unknown")
        for source, name in status.items():
            mapped = F.when(F.col(status_field) == source, name).otherwise(mapped)
        out = out.withColumn("status", mapped)
    repeated = out.groupBy("feature_id").agg(F.count("*").alias("__n"))
    hashed = out.withColumn("row_hash", row_sha256(*out.columns))
    return hashed.join(repeated, "feature_id").withColumn("repeated", F.col("__n") > 1).drop("__n")


def rings_to_polygon(features: DataFrame) -> DataFrame:
    """(feature_id, geom, problem) of (feature_id, rings array<array<array<double>>>): auto-closed, nested even-odd.

    A ring needs four points as it comes, and its sides may meet at their ends only.
    """

    def build(rings) -> tuple[dict | None, str | None]:
        found = []
        for ring in rings:
            r = np.array([tuple(p) for p in ring], float).reshape(-1, 2)
            if len(r) < 4:
                return None, "short_ring"
            if tuple(r[0]) != tuple(r[-1]):
                r = np.concatenate([r, r[:1]])
            if not np.isfinite(r).all() or (np.abs(r[:, 0]) > 180).any() or (np.abs(r[:, 1]) > 90).any():
                return None, "out_of_range"
            if abs(np.sum(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1])) == 0:
                return None, "zero_area"
            if validity.ring_crosses(r):
                return None, "self_crossing"
            found.append(r)
        if not found:
            return None, "empty"
        parts = osm.nest(found)
        return osm._struct(parts, "POLYGON" if len(parts) == 1 else "MULTIPOLYGON"), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            built = [build(r) if r is not None else (None, "empty") for r in batch["rings"]]
            yield pd.DataFrame({"feature_id": batch["feature_id"], "geom": [g for g, _ in built], "problem": [p for _, p in built]})

    id_type = features.schema["feature_id"].dataType.simpleString()
    return features.select("feature_id", "rings").mapInPandas(run, f"feature_id {id_type}, geom {G.GEOMETRY}, problem string")


def snapshot_row(normalized: DataFrame, history: DataFrame, snapshot_id: str, source: str) -> DataFrame:
    """One history row: checksum of the ordered (id, hash) digests, previous snapshot, CHANGED or UNCHANGED.

    history: (source_key, snapshot_id, seq, checksum). The checksum adds row digests, so
    no task gathers all rows.
    """
    own = merge.table_checksum(normalized, ["feature_id", "row_hash"]).select("n", F.col("digest").alias("checksum"))
    last = history.where(F.col("source_key") == source).agg(F.max_by(F.struct("snapshot_id", "checksum", "seq"), "seq").alias("p"))
    state = F.when(F.col("p.checksum") == F.col("checksum"), "UNCHANGED").otherwise("CHANGED")
    return own.crossJoin(last).select(F.lit(source).alias("source_key"), F.lit(snapshot_id).alias("snapshot_id"), (F.coalesce("p.seq", F.lit(0)) + 1).alias("seq"), "n", "checksum", F.col("p.snapshot_id").alias("previous"), state.alias("state"))


def geometry_counts(features: DataFrame) -> DataFrame:
    return features.groupBy(F.col("geom.gtype").alias("gtype")).agg(F.count("*").alias("n"))


def health_of(error: Column) -> Column:
    """Health of a run by its error kind; none means current."""
    return F.when(error.isNull(), "CURRENT").when(error.isin("timeout", "http", "network"), "SOURCE_UNAVAILABLE").when(error == "schema", "SCHEMA_CHANGED").when(error == "partial", "PARTIALLY_UPDATED").otherwise("IMPORT_FAILED")


def latest_health(log: DataFrame) -> DataFrame:
    return log.groupBy("source_key").agg(F.max_by(F.struct("health", "checked_at"), F.struct("checked_at", "health")).alias("h")).select("source_key", "h.health", "h.checked_at")


def retain(df: DataFrame, mode: str, payload: list[str]) -> DataFrame:
    """Full evidence, or its metadata only."""
    if mode not in ("full", "metadata"):
        raise ValueError(f"retention mode {mode!r}")
    return df if mode == "full" else df.drop(*payload)
