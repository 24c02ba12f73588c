"""Every geo query with SQL against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

from urbanspark.plans import map_queries, spatial_queries, table_queries  # noqa: F401
from urbanspark.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


#: One query of each family; the driver runs them all.
SAMPLE = "grid_diff assign_polygon_tiebreak count_within_radius park_accessibility composite_topk district_distribution explain_target heatmap_tiles snapshot_merge canonicalize search_shaped ledger_append latest_runs illegal_transitions street_candidates extract_relations drop_unsupported staged_counts inspect_members category_evidence category_rollup category_report input_fingerprint water_accessibility facility_groups street_components viewport_districts search_batch relation_closure way_geometry table_checksum source_completeness coverage_matrix".split()


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
