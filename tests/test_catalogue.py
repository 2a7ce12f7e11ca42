"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from gravelbed.plans import catalogue, reports  # noqa: F401


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{os.sep + '*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    cur = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted(repr([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect()) == want
