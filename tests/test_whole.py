"""Queries over ids that lie beyond those of the smallest tables: none may be left out."""

import duckdb
import pytest

from thicket import queries

SCANS = ["draw_order", "variance_scan", "mad_scan", "mad_gains", "split_scores_mad_l1", "split_scores_mad_l2", "split_scores_variance_l1", "best_cuts", "best_cuts_max", "best_split", "split_children", "split_routing"]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """Customers 2990 to 3109 and parts 150 to 269, and their tables in DuckDB."""
    at = str(tmp_path_factory.mktemp("far"))
    spark.createDataFrame([(i, i % 3, (i * 37 % 401) - 99.5) for i in range(2990, 3110)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(i, f"Brand#{i % 7}") for i in range(150, 270)], "p_partkey long, p_brand string").write.parquet(f"{at}/part.parquet")
    con = duckdb.connect()
    for t in ("customer", "part"):
        con.sql(f"create view {t} as select * from read_parquet('{at}/{t}.parquet/*.parquet')")
    return at, con


@pytest.mark.parametrize("name", [*SCANS, "header_dedupe"])
def test_all_ids_count(spark, far, name):
    at, con = far
    sql = queries.oracle_sql()[name]
    con.register("got", queries.queries()[name](spark, at).toArrow())
    columns = ", ".join(f'"{c}"' for c in con.sql(sql).columns)
    assert con.sql("select count(*) from got").fetchall() == con.sql(f"select count(*) from ({sql})").fetchall()
    assert con.sql(f"select {columns} from got except all select {columns} from ({sql})").fetchall() == []


def test_all_components_are_features(spark):
    assert queries.vectors(spark, "/root/testdata/sf0.001").select("feature").distinct().count() == 64


def test_forest_draws_among_all_components(spark):
    drawn = {r["split_feature"] for r in queries.queries()["forest_train"](spark, "/root/testdata/sf0.001").collect()} - {None}
    assert max(int(f[1:]) for f in drawn) >= 12
