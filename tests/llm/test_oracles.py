"""Every operator query with an SQL twin, compared by DuckDB."""

import os

import duckdb
import pytest

from lodestone.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    df = registry.QUERIES[name](spark, SF)
    r = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(df.columns) == sorted(cols)
    key = lambda row: tuple((v is None, v if v is not None else 0) for v in row)
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=key) == sorted(map(tuple, r.fetchall()), key=key)
