"""The queries that SQL expresses against DuckDB over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sunstack.llm.oracles import ORACLES
from sunstack.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())
