"""Queries with SQL against DuckDB; the others run and keep their contracts' columns."""

from pathlib import Path

import duckdb
import oracle
import pytest

from tidefold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    said = oracle.compare(spark, con, name, SF)
    assert "same" in said if name in queries.oracle_sql() else "rows" in said, said
