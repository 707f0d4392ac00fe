"""Changes over prices of zero, and of values whose seventh digit is a 5, against DuckDB."""

import datetime as dt
import math
import random

import duckdb
import pytest

import __spark_entry__  # noqa: F401  it registers the queries
from chronolith.plans.registry import ORACLES, QUERIES, nearest


@pytest.fixture(scope="module")
def prices(spark, tmp_path_factory):
    """Bars of two weeks: 6.40 or zero in the first, odd cents or zero in the second (over 6.40 they end in a 5 after six digits)."""
    rng, folder = random.Random(4), tmp_path_factory.mktemp("prices")
    days = [dt.datetime(2024, 1, d, 10) for d in (1, 2, 3, 4, 5, 8, 9, 10, 11, 12)]
    rows = []
    for entity in range(1, 301):
        for n, day in enumerate(days):
            value = 6.4 if n < 5 else rng.randrange(1, 20001, 2) / 100
            rows.append((len(rows), day, entity, "view", 0.0 if entity % 50 == n % 2 else value))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["change_1", "change_5", "series_full"])
def test_changes_are_those_of_sql(spark, prices, name):
    got = QUERIES[name](spark, prices)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{prices}/events.parquet/*.parquet'")
    wanted = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: r[:2])
    assert order(got.collect()) == order(wanted)


def test_nearest_keeps_what_has_no_digits(spark):
    given = [None, 0.1234565, -0.1234565, 1e300, 1.7e308, math.inf, -math.inf]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate([*given, math.nan])], "n int, x double").select("n", nearest("x")).orderBy("n").collect()
    wanted = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in given]
    assert [r.x for r in rows[:-1]] == wanted and math.isnan(rows[-1].x)
