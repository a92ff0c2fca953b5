"""Queries with SQL against DuckDB's rows over whole tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from tests.conftest import as_lines
from wavelane.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    assert as_lines(QUERIES[name](spark, folder).toPandas()) == as_lines(con.execute(ORACLES[name]).df())
