"""Every text query that has SQL, against DuckDB."""

import os

import duckdb
import pytest

from strandlake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    with duckdb.connect() as con:
        for f in os.listdir(sf_dir):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
        rel = con.sql(queries.oracle_sql()[name])
        columns = sorted(rel.columns)
        expected = sorted(map(str, rel.select(*columns).fetchall()))
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == expected
