"""The registered queries of the subpackage against their SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from wordloom.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SMALL)
    wanted = connection.sql(queries.ORACLES[name])
    columns = sorted(found.columns)
    assert sorted(wanted.columns) == columns
    rows = lambda x: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in x)
    assert rows(found.select(columns).collect()) == rows(wanted.select(*columns).fetchall())
