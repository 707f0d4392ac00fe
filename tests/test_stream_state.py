"""The stream that keeps versions in state: bootstrap from a table, late rows, batches that were killed."""

import datetime as dt

import pytest

from chronolith.streaming import restate
from chronolith.streaming.restate import stream_restate_state

DAY, OLD, AT = dt.date(2026, 9, 7), dt.date(2020, 1, 2), "2026-09-20 12:00:00"
SCHEMA = "entity_id long, trade_date date, close double"


@pytest.fixture
def run(spark, tmp_path):
    def deliver(*rows, check="a"):
        if rows:
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        return stream_restate_state(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/t", f"{tmp_path}/{check}", ["entity_id", "trade_date"], {"close": "bar"}, AT)

    return deliver


def kept(spark, tmp_path):
    return sorted((r.entity_id, str(r.trade_date), r.version, r.close) for r in spark.read.parquet(f"{tmp_path}/t").collect())


def test_versions_follow_state(spark, run, tmp_path):
    assert run((1, DAY, 1.0), (2, DAY, 2.0), (2, DAY, 1.5), (3, DAY, None)) == 1 and run() == 0
    # repeated keys of a delivery keep one row; a change within tolerance is none; a null becomes known, a known value null
    run((1, DAY, 1.0 + 1e-8), (2, DAY, None), (3, DAY, 7.0), (4, OLD, 4.0))
    run((4, OLD, 5.0), (2, DAY, 2.0))
    assert [r for r in kept(spark, tmp_path) if r[0] != 2] == [(1, "2026-09-07", 1, 1.0), (3, "2026-09-07", 1, None), (3, "2026-09-07", 2, 7.0), (4, "2020-01-02", 1, 4.0), (4, "2020-01-02", 2, 5.0)]
    assert sorted((r.version, r.close) for r in spark.read.parquet(f"{tmp_path}/t").where("entity_id = 2").collect()) == [(1, 1.5), (2, None), (3, 2.0)]
    assert not list(tmp_path.glob("t.*"))


def test_state_begins_with_the_table(spark, run, tmp_path):
    rows = [(1, DAY, 1.0, dt.datetime(2026, 9, 7, 7), 1), (1, DAY, 3.0, dt.datetime(2026, 9, 8), 2), (2, OLD, 2.0, dt.datetime(2020, 1, 2, 7), 1)]
    spark.createDataFrame(rows, SCHEMA + ", knowledge_time timestamp_ntz, version long").write.parquet(f"{tmp_path}/t")
    run((1, DAY, 3.0), (2, OLD, 9.0), (5, DAY, 5.0))
    assert kept(spark, tmp_path) == [(1, "2026-09-07", 1, 1.0), (1, "2026-09-07", 2, 3.0), (2, "2020-01-02", 1, 2.0), (2, "2020-01-02", 2, 9.0), (5, "2026-09-07", 1, 5.0)]


@pytest.mark.parametrize("written", [False, True])
def test_a_killed_batch_makes_the_same_rows_again(spark, run, tmp_path, monkeypatch, written):
    run((1, DAY, 1.0), (2, DAY, 2.0))

    def killed(batch, *more):
        if written:
            append(batch, *more)
        raise RuntimeError("killed")

    append = restate.append_rows
    with monkeypatch.context() as patch, pytest.raises(Exception, match="killed"):
        patch.setattr(restate, "append_rows", killed)
        run((1, DAY, 5.0), (3, DAY, 3.0))
    assert run() == 1
    run((1, DAY, 6.0))
    assert kept(spark, tmp_path) == [(1, "2026-09-07", n, c) for n, c in ((1, 1.0), (2, 5.0), (3, 6.0))] + [(2, "2026-09-07", 1, 2.0), (3, "2026-09-07", 1, 3.0)]
