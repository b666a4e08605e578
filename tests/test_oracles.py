"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

from talusgrid.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, small, tmp_path, name):
    path = str(tmp_path / "out")
    registry.queries()[name](spark, small).coalesce(1).write.parquet(path)
    ours, theirs = f"SELECT * FROM '{path}/*.parquet'", registry.oracle_sql()[name]
    columns = sorted(r[0] for r in duck.sql(f"DESCRIBE {ours}").fetchall())
    assert columns == sorted(r[0] for r in duck.sql(f"DESCRIBE {theirs}").fetchall())
    named = ", ".join(f'"{c}"' for c in columns)
    for a, b in ((ours, theirs), (theirs, ours)):
        assert duck.sql(f"SELECT {named} FROM ({a}) EXCEPT ALL SELECT {named} FROM ({b})").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_names_match():
    assert set(registry.oracle_sql()) <= set(registry.queries())
