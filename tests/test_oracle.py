"""Every query of the engine's own operators against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import oracle
import pytest

from tidefold.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    said = oracle.compare(spark, con, name, SF)
    assert "same" in said if name in SQL else "rows" in said, said


def test_entry_works_without_the_training_data_operators(spark):
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['tidefold.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'flow_summary' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
