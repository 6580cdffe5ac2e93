"""Correlations of values that do not vary or are missing, against DuckDB."""

import math

import duckdb
import pytest

from tidemark.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def told_apart(v):
    """A value to compare, NaN and NULL being two."""
    return "NaN" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize(("name", "by"), [("pair_correlations", "l_suppkey % 10"), ("correlation_and_fit", "l_suppkey")])
def test_correlations_of_values_that_do_not_vary(spark, tmp_path, name, by):
    """One supplier has one price, one has none at all; so do the lines of one flag and of another."""
    duck = duckdb.connect()
    price = "CASE WHEN l_suppkey % 10 = 3 OR l_returnflag = 'A' THEN 0.0 WHEN l_suppkey % 10 <> 4 AND l_returnflag <> 'R' OR l_suppkey % 10 = 5 THEN l_extendedprice END"
    lines = f"SELECT * REPLACE ({by} AS l_suppkey, {price} AS l_extendedprice) FROM '{SF}/lineitem.parquet'"
    for table, rows in {"lineitem": lines, "orders": f"FROM '{SF}/orders.parquet'", "customer": f"FROM '{SF}/customer.parquet'"}.items():
        duck.execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet'")
        duck.execute(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet'")
    found = QUERIES[name](spark, str(tmp_path))
    wanted = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    rows = [tuple(map(told_apart, r)) for r in wanted.fetchall()]
    assert sorted(map(str, rows)) == sorted(str(tuple(told_apart(r[c]) for c in columns)) for r in found.collect())
    assert any("NaN" in r for r in rows)
