"""Queries against their SQL over the smallest tables."""

import duckdb
import pytest

from thicket.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    sql = queries.oracle_sql()[name]
    con.register("got", queries.queries()[name](spark, DIR).toArrow())
    con.sql(f"create table want as {sql}")
    columns = ", ".join(f'"{c}"' for c in con.sql("from want").columns)
    assert sorted(con.sql("from got").columns) == sorted(con.sql("from want").columns)
    assert con.sql("select count(*) from got").fetchall() == con.sql("select count(*) from want").fetchall()
    assert con.sql(f"select {columns} from got except all select {columns} from want").fetchall() == []
