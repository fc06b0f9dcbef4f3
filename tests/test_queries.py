"""Queries against their SQL over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from thicket import queries

DIR = "/root/testdata/sf0.001"
TABLES = ["customer", "supplier", "part", "events", "lineitem", "orders", "embeddings"]
CHECKED = [
    "mad_by_group", "dispersion_by_group", "pearson_pairs", "matrix_arithmetic", "draw_order", "mad_scan", "split_scores_mad_l1", "best_cuts", "best_split", "split_children", "forest_levels", "route_branch", "route_truncate", "route_abort", "route_branch_joined", "leaf_average_gain", "interval_stack",
    "node_gains", "node_cells", "node_correlations", "gain_pairs", "feature_cooccurrence", "node_jaccard", "gain_correlation", "node_requirements", "forest_roundtrip", "header_dedupe", "text_matrix",
    "median_by_feature", "root_mad_scan", "root_best_split", "sample_without_replacement", "sample_weighted", "sample_with_replacement", "sample_choice", "sample_pieces", "sample_error_cells", "sample_mask",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    got = queries.queries()[name](spark, DIR).toArrow()
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(got.column_names) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in got.column_names)
    db.register("got", got)
    assert got.num_rows == db.sql(f"select count(*) from ({queries.oracle_sql()[name]})").fetchall()[0][0]
    assert db.sql(f"select {columns} from got except all select {columns} from ({queries.oracle_sql()[name]})").fetchall() == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
