"""Every registered query of the library against its DuckDB SQL, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from chronolith.plans.registry import ORACLES, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value if value is None else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = QUERIES[name](spark, str(DATA))
    columns = sorted(rows.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in rows.collect())
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and "ma20" in found.columns
