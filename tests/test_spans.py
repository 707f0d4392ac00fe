"""Long entities: windows, fills and scans in chunks give what whole partitions give; completeness by sweep gives what days give."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronolith.operators import factors, joins, quality, series

FIRST = dt.date(2015, 1, 1)


@pytest.fixture(scope="module")
def bars(spark):
    """One entity of 900 days with gaps, which holds nine rows of ten, and some short ones."""
    rng = random.Random(3)
    rows = []
    for entity, n in [(1, 900), (2, 1), (3, 13), (4, 14), (5, 40), (6, 28)]:
        day, price = FIRST, 10.0
        for k in range(n):
            day += dt.timedelta(days=1 if rng.random() < 0.8 else rng.choice([2, 3, 40]))
            price = max(0.5, price + rng.uniform(-1, 1))
            rows.append((entity, day, price + rng.random(), price - rng.random(), price, None if k % 7 == 3 else price * 2))
    return spark.createDataFrame(rows, "entity_id long, trade_date date, high double, low double, close double, x double").cache()


def values(df, *columns):
    return {(r.entity_id, r.trade_date): tuple(r[c] for c in columns) for r in df.collect()}


def same(a, b, tolerance=0.0):
    assert a.keys() == b.keys() and a
    for key, left in a.items():
        for x, y in zip(left, b[key], strict=True):
            assert x == y if x is None or y is None or not tolerance else x == pytest.approx(y, rel=tolerance, abs=tolerance)


@pytest.mark.parametrize("span", [3, 60, 5000])
def test_split_windows_equal_whole_ones(bars, span):
    for op in ("mean", "sum", "min", "max", "last", "count"):
        same(values(series.rolling(bars, ["x"], 5, op, 3), f"x_roll5_{op}"), values(series.rolling(bars, ["x"], 5, op, 3, span=span), f"x_roll5_{op}"))
    same(values(series.ffill(bars, ["x"]), "x"), values(series.ffill(bars, ["x"], span=span), "x"))
    filled = series.ffill(bars, ["x"])
    same(values(series.change(filled, ["x"], 4), "x_chg4"), values(series.change(filled, ["x"], 4, span=span), "x_chg4"))
    same(values(factors.ma20({"close": bars.select("entity_id", "trade_date", "close")}, None), "ma20"), values(factors.ma20({"close": bars.select("entity_id", "trade_date", "close")}, None, span=span), "ma20"))
    same(values(factors.directional(bars), "tr", "plus_dm", "minus_dm"), values(factors.directional(bars, span), "tr", "plus_dm", "minus_dm"))


def test_split_windows_spread_a_hot_entity(spark, bars):
    """With spans, no task of the window holds more than some chunks and their halos of the hot entity; without, one holds it all."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(before, ("false", "64"), strict=True):
            spark.conf.set(key, value)
        most = lambda span: max(Counter(r.p for r in series.rolling(bars, ["x"], 5, "mean", span=span).select("x_roll5_mean", F.spark_partition_id().alias("p")).collect()).values())
        assert most(60) <= 4 * 64 and most(None) >= 900
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def wilder(values, period):
    out, state = [], None
    for n, x in enumerate(values, 1):
        if n == period:
            state = sum(values[:period]) / period
        elif n > period:
            state = state + (x - state) / period
        out.append(state)
    return out


@pytest.mark.parametrize("period", [1, 2, 14, 300])
@pytest.mark.parametrize("span", [None, 30, 100_000])
def test_scan_equals_recursion(bars, period, span):
    want = {}
    by = {}
    for r in bars.where("x IS NOT NULL").orderBy("entity_id", "trade_date").collect():
        by.setdefault(r.entity_id, []).append(r)
    for rows in by.values():
        want |= {(r.entity_id, r.trade_date): (s,) for r, s in zip(rows, wilder([r.x for r in rows], period), strict=True) if s is not None}
    got = factors.wilder(bars, "x", period, span)
    same(values(got, "wilder"), want, 1e-9)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString() and "Pandas" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("span", [None, 25])
def test_adx_equals_recursion(bars, span):
    by, want = {}, {}
    for r in factors.directional(bars).orderBy("entity_id", "trade_date").collect():
        by.setdefault(r.entity_id, []).append(r)
    for rows in by.values():
        parts = [wilder([r[c] for r in rows], 14) for c in ("tr", "plus_dm", "minus_dm")]
        known = [(r, 100 * abs(p - m) / (p + m) if t > 0 and p + m > 0 else 0.0) for r, t, p, m in zip(rows, *parts, strict=True) if t is not None]
        want |= {(r.entity_id, r.trade_date): (s,) for (r, _), s in zip(known, wilder([x for _, x in known], 14), strict=True) if s is not None}
    same(values(factors.adx(dict.fromkeys(("high", "low", "close"), bars), None, span=span), "adx"), want, 1e-9)


def test_scan_of_no_rows(bars):
    assert factors.wilder(bars.limit(0), "x", 14).count() == 0 and factors.wilder(bars.where("entity_id = 2"), "x", 14).count() == 0


def covers(r, d):
    return (r[2] or dt.date(1990, 1, 1)) <= d and (r[3] is None or d <= r[3])


def test_sweep_equals_days(spark):
    rng = random.Random(9)
    days = [FIRST + dt.timedelta(days=k) for k in range(120) if k % 7 < 5 and k % 31]
    day = lambda: FIRST + dt.timedelta(days=rng.randrange(-30, 150))
    intervals = []
    for entity in range(60):
        for version in range(rng.randrange(1, 7)):
            a, b = sorted((day(), day()))
            intervals.append((entity, rng.choice(["listed", "delisted", "suspended", None]), a if rng.random() < 0.9 else None, b if rng.random() < 0.7 else None, dt.datetime(2015, 1, 1 + version), version))
    intervals.append((99, "listed", dt.date(2014, 1, 1), dt.date(2014, 2, 1), dt.datetime(2015, 1, 1), 1))
    rows = [(e, d, rng.random() < 0.2) for e in range(62) for d in days + [FIRST] if rng.random() < 0.6]
    market = spark.createDataFrame(intervals, "entity_id long, status string, start_date date, end_date date, knowledge_time timestamp_ntz, version long")
    calendar = spark.createDataFrame([(d,) for d in days * 2], "trade_date date")
    status = spark.createDataFrame(rows, "entity_id long, trade_date date, is_suspended boolean")
    bars = status.where("NOT is_suspended").union(status.where("NOT is_suspended"))
    expected = set()
    for entity in {r[0] for r in intervals}:
        for d in days:
            over = [r for r in intervals if r[0] == entity and covers(r, d)]
            if over and max(over, key=lambda r: (r[2] or dt.date(1, 1, 1), r[5], r[4]))[1] != "delisted":
                expected.add((entity, d))
    have, halted = {(e, d) for e, d, s in rows if not s}, {(e, d) for e, d, s in rows if s}
    segments = quality.expected_segments(market, calendar)
    pairs = lambda runs: sorted((r.entity_id, r.trade_date) for r in quality.pairs_of(runs, calendar).collect())
    assert pairs(segments) == sorted(expected)
    for with_status, absent in ((None, expected - have), (status, expected - have - halted)):
        missing = quality.missing_runs(segments, calendar, bars, with_status)
        assert pairs(missing) == sorted(absent)
        assert tuple(quality.coverage(segments, missing).first()) == (len(expected), len(absent), pytest.approx(1 - len(absent) / len(expected)))
        broken = {(r.trade_date, r.expected, r.missing) for r in quality.break_days(segments, missing, calendar, 0.7).collect()}
        by_day = [(d, sum(x == d for _, x in expected), sum(x == d for _, x in absent)) for d in days]
        assert broken == {x for x in by_day if x[1] and 1 - x[2] / x[1] < 0.7}
    asked = spark.createDataFrame([(e,) for e in range(40, 70)], "entity_id long")
    uncovered = sorted((e, d) for e in range(40, 70) for d in days if not any(r[0] == e and covers(r, d) for r in intervals))
    assert pairs(quality.uncovered_runs(asked, market, calendar)) == uncovered
    none = calendar.limit(0)
    assert quality.expected_segments(market, none).count() == 0 and quality.uncovered_runs(asked, market, none).count() == 0


def test_cuts_of_hot_keys_change_no_match(spark):
    """One key holds nine rows of ten: it alone is cut, at percentiles of its own times, and every direction finds the same rows."""
    rng = random.Random(4)
    row = lambda n, hot: (1 if hot else rng.randrange(2, 40), FIRST + dt.timedelta(days=rng.randrange(4000)), n)
    left = spark.createDataFrame([row(n, n % 10) for n in range(3000)] + [(1, None, -1), (None, FIRST, -2)], "k long, day date, a long")
    right = spark.createDataFrame([row(n, n % 10) for n in range(2000)], "k long, day date, b long").dropDuplicates(["k", "day"])
    for direction in ("backward", "forward", "nearest"):
        plain, cut = (joins.asof_join(left, right, "day", "day", ["k"], direction, span=span, key_rows=500).collect() for span in (None, "auto"))
        assert sorted(map(str, plain)) == sorted(map(str, cut)) and len(cut) == 3002
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for key, value in zip(before, ("false", "4"), strict=True):
            spark.conf.set(key, value)
        sides = [d.select("k", F.unix_date("day").cast("long").alias("__p")) for d in (left, right)]
        spread = joins._spread(sides, ["k"], 500)
        sizes = sorted(Counter(r.p for side in spread for r in side.repartition(4, "k", "__span").select(F.spark_partition_id().alias("p")).collect()).values())
        assert len(sizes) == 4 and sizes[-1] <= 2 * sizes[1]
        assert spread[0].where("k > 1").agg(F.max("__span")).first()[0] == 0 and spread[0].select("__span").distinct().count() > 50
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
