"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

SF = "/root/testdata/sf0.001"
SOME = ["read_manifest", "qc_cells", "normalize_log1p", "highly_variable_genes", "morans_i", "spatial_chunks", "stratified_quota",
        "sym_normalize", "block_null_mean", "leave_one_out", "smooth_domains", "sparsemax", "panel_validation",
        "entropy_pruning", "recon_loss", "usage_divergence", "trend_window"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert repr(canonical(got)) == repr(canonical(want))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
