"""The stream's state lies by buckets: few values however many keys, and the same versions as the batch merge makes."""

import datetime as dt
import math
import random
from decimal import Decimal

import duckdb
import pyarrow as pa
import pytest

from chronolith.plans.q_identity import _DIFF
from chronolith.streaming import restate
from chronolith.streaming.restate import BUCKETS, alike, stream_restate, stream_restate_state

DAYS, AT, KEYS = [dt.date(2026, 9, 7), dt.date(2020, 1, 2)], "2026-09-20 12:00:00", ["entity_id", "trade_date"]


def delivered(spark, folder, schema, same, deliveries, run):
    for rows in deliveries:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{folder}/in")
        run(spark, f"{folder}/in", schema, f"{folder}/t", f"{folder}/c", KEYS, same, AT)
    return spark.read.parquet(f"{folder}/t")


@pytest.mark.parametrize("chunk", [restate.CHUNK, 1])
def test_many_keys_are_few_values_and_versions_are_those_of_the_merge(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(restate, "CHUNK", chunk)
    rng = random.Random(4)
    price = lambda: rng.choice([None, math.nan, math.inf, 0.0, 1.0, 1.0 + 1e-8, 2.0])
    deliveries = [[(n, DAYS[n % 2], price(), price()) for n in rng.sample(range(900), 600)] for _ in range(3)]
    read = {}
    for run in (stream_restate, stream_restate_state):
        table = delivered(spark, tmp_path / run.__name__, "entity_id long, trade_date date, open double, close double", dict.fromkeys(("open", "close"), "bar"), deliveries, run)
        read[run] = sorted(map(str, table.select(*KEYS, "open", "close", "knowledge_time", "version").collect()))
    assert read[stream_restate] == read[stream_restate_state]
    assert spark.read.format("statestore").option("stateVarName", "latest").load(f"{tmp_path}/stream_restate_state/c").count() <= 2 * BUCKETS


def test_any_type_of_value_comes_back_as_it_went(spark, tmp_path):
    schema = "entity_id long, trade_date date, a long, b string, c decimal(20,4), d timestamp_ntz, e boolean, f timestamp, g double"
    big, at = 2**53 + 1, dt.datetime(1600, 1, 2, 3, 4, 5, 678901)
    one = (1, DAYS[0], big, "x", Decimal("1.2345"), at, True, dt.datetime(2020, 1, 1), math.nan)
    none = (2, DAYS[0], *[None] * 7)
    late = (1, DAYS[0], big + 1, *one[3:])
    names = [part.split()[0] for part in schema.split(", ")[2:]]
    table = delivered(spark, tmp_path, schema, dict.fromkeys(names, "equal"), [[one, none], [one, none], [late, late]], stream_restate_state)
    rows = table.orderBy("entity_id", "version").collect()
    assert [(r.entity_id, r.version, r.a) for r in rows] == [(1, 1, big), (1, 2, big + 1), (2, 1, None)]
    assert [str(r[f]) for f in names[1:] for r in rows[:2]] == [str(one[3 + n]) for n in range(6) for _ in range(2)] and all(rows[2][f] is None for f in names)


def test_alike_is_the_test_of_the_sql():
    values = [None, math.nan, math.inf, -math.inf, 0.0, 1e-7, 2e-6, 1.0, 1.0 + 1e-6, 1.0 + 2e-6, 1e9, 1e9 + 0.5, 1e9 + 2]
    pairs = [(a, b) for a in values for b in values]
    table = pa.table({"n": range(len(pairs)), "a": pa.array([a for a, _ in pairs], pa.float64()), "b": pa.array([b for _, b in pairs], pa.float64())})
    test = _DIFF.split(" OR CASE")[0].replace("i.open", "table_.a").replace("c.open", "table_.b")
    connection = duckdb.connect()
    connection.register("table_", table)
    differs = [r[0] for r in connection.execute(f"SELECT {test} FROM table_ ORDER BY n").fetchall()]
    assert [not x for x in alike(table["a"].combine_chunks(), table["b"].combine_chunks(), "bar")] == differs
    whole = lambda *rows: pa.array(rows, pa.int64())
    assert alike(whole(2**53, 5, None), whole(2**53 + 1, 5, None), "factor").tolist() == [False, True, True]
