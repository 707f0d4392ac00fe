"""Operators on small hand-made tables: values worked out by hand, guards, and point-in-time safety."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chronolith.functions import codes
from chronolith.operators import adjust, calendar, factors, ingest, joins, pit, quality, scd2, series
from chronolith.plans.spec import BAR, FACTOR, ORDERS, STATUS, Field, PitSpec
from chronolith.sources import sinks, vendor
from chronolith.streaming.restate import stream_restate

AT, LATER = "2026-09-20 12:00:00", "2026-09-26 00:00:00"
DAYS = [dt.date(2026, 9, d) for d in (7, 8, 9, 10, 11, 14, 15, 16, 17, 18)]
KNOWN, AFTER = dt.datetime(2026, 9, 18, 8), dt.datetime(2026, 9, 25, 8)


@pytest.fixture(scope="module")
def bars(spark):
    """Entity 1: close 1..10 on ten days, the fifth missing, the sixth suspended; a restatement of the first, known later."""
    row = lambda e, d, c, v, kt=KNOWN, version=1: (e, DAYS[d - 1], c - 0.2, c + 0.5, c - 0.5, c, v, c * v, kt, None, version, "t")
    rows = [row(1, d, float(d), 100.0) for d in range(1, 11) if d not in (5, 6)] + [row(2, d, float(d), 50.0) for d in (1, 2, 3)]
    return spark.createDataFrame([*rows, row(1, 1, 99.0, 100.0, AFTER, 2)], BAR.schema)


@pytest.fixture(scope="module")
def aligned(spark, bars):
    days = spark.createDataFrame([(d,) for d in DAYS], "trade_date date")
    status = spark.createDataFrame([(1, DAYS[5], True, False), (1, DAYS[4], None, None)], "entity_id long, trade_date date, is_suspended boolean, is_st boolean")
    return calendar.align(pit.as_of(bars, BAR, AT, ["open", "high", "low", "close", "volume"]), BAR, days, bars.where("entity_id = 1"), status)


def column(df, name, order="trade_date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_alignment_and_states(aligned):
    assert column(aligned, "status") == ["ok"] * 4 + ["missing", "suspended"] + ["ok"] * 4
    assert column(aligned, "close")[:6] == [1.0, 2.0, 3.0, 4.0, None, None]


def test_series_steps(aligned):
    weekly = series.resample(aligned, "1w", ["open", "high", "low", "close", "volume"])
    assert [(r.trade_date, r.open, r.high, r.low, r.close, r.volume, r.status) for r in weekly.orderBy("trade_date").collect()] == [(DAYS[4], 0.8, 4.5, 0.5, 4.0, 400.0, "ok"), (DAYS[9], 6.8, 10.5, 6.5, 10.0, 400.0, "ok")]
    filled = series.ffill(aligned, ["close"])
    assert column(filled, "close") == [1, 2, 3, 4, 4, 4, 7, 8, 9, 10]
    assert column(series.rolling(aligned, ["close"], 3, "mean"), "close_roll3_mean") == [None, None, 2, 3, None, None, None, None, 8, 9]
    assert column(series.change(filled, ["close"], 1), "close_chg1")[7] == pytest.approx(8 / 7 - 1)


def test_change_over_zero(spark):
    rows = spark.createDataFrame([(1, DAYS[n], v) for n, v in enumerate([0.0, 5.0, 0.0, 0.0, None, 1.0])], "entity_id long, trade_date date, x double")
    got = column(series.change(rows, ["x"], 1), "x_chg1")
    assert got[1] == math.inf and got[2] == -1 and math.isnan(got[3]) and got[0] is got[4] is got[5] is None


def test_restatements_are_invisible_before_they_are_known(bars):
    first = lambda at: pit.as_of(bars, BAR, at, ["close"], window=(DAYS[0], DAYS[0])).where("entity_id = 1").first().close
    assert first(AT) == 1.0 and first(LATER) == 99.0
    assert pit.versions(bars, BAR, ["close"], "vintage").where("entity_id = 1").orderBy("trade_date").first().close == 1.0


def test_what_is_known_only_grows(bars):
    counts = [pit.as_of(bars, BAR, at, ["close"]).count() for at in ("2026-09-01 00:00:00", AT, LATER)]
    assert counts == [0, 11, 11]


def test_read_guards(spark, bars):
    for bad in (
        lambda: pit.as_of(bars, BAR, AT, ["nothing"]), lambda: pit.rows(bars, BAR, "newest"), lambda: pit.rows(bars, STATUS, "as_of", AT, policy="publish"), lambda: pit.predicate("close", "like", 1), lambda: pit.predicate("close", "in", []),
        lambda: pit.as_of(bars, BAR, AT, window=(DAYS[3], DAYS[0])), lambda: pit.as_of(bars, ORDERS, AT, entities=[1]), lambda: pit.page(bars, BAR, (None, 1)), lambda: PitSpec("x", "market", ("a",), (Field("b", None),)).validate(),
        lambda: adjust.resolve_mode(STATUS, "hfq"), lambda: joins.asof_join(bars, bars, "trade_date", "trade_date", ["entity_id"], "sideways"), lambda: series.change(bars, ["close"], 0), lambda: series.resample(bars, "1d", ["close"], {"close": "sum"}),
        lambda: calendar.align(bars.withColumn("status", F.lit(1)), BAR, bars, bars),
    ):
        with pytest.raises(ValueError):
            bad()
    assert pit.as_of(bars, BAR, AT, ["close"], entities=[]).count() == 0
    assert pit.rows(bars, BAR, "as_of", AT, entities=[]).count() == 11
    assert adjust.resolve_mode(BAR, None) == "hfq" and adjust.resolve_mode(BAR, "raw") == "none"


def test_missing_factor_gives_null(spark, bars):
    some = spark.createDataFrame([(1, DAYS[0], 2.0, KNOWN, 1), (1, DAYS[2], 4.0, KNOWN, 1)], FACTOR.schema)
    got = adjust.read(bars, some, BAR, FACTOR, AT, ["close", "volume"], "qfq").where("entity_id = 1")
    assert column(got, "close")[:3] == [0.5, None, 3.0] and column(got, "volume")[1] == 100.0
    with pytest.raises(Exception, match="no factor"):
        adjust.adjust_strict(bars.select("entity_id", "trade_date", "close"), some, ["close"], "hfq").collect()


@pytest.mark.parametrize("span", [None, 2, 30])
def test_asof_directions(spark, span):
    left = spark.createDataFrame([(e, DAYS[d], float(d)) for e in (1, 2) for d in (0, 1, 2)] + [(None, DAYS[0], 9.0), (3, None, 9.0)], "entity_id long, trade_date date, close double")
    right = spark.createDataFrame([(1, DAYS[0], 10), (1, DAYS[2], 30), (2, DAYS[0], 20), (2, DAYS[2], 40), (2, DAYS[2], 41)], "entity_id long, trade_date date, factor long")
    get = lambda *a, **k: [r.factor for r in joins.asof_join(left, right, "trade_date", "trade_date", ["entity_id"], *a, tie=F.col("factor"), span=span, **k).orderBy("entity_id", "trade_date").collect()]
    assert get() == [None, 10, 10, 30, 20, 20, 41, None]
    assert get("forward") == [None, 10, 30, 30, 20, 40, 40, None]
    assert get("nearest") == [None, 10, 10, 30, 20, 20, 41, None]
    assert get(tolerance=0) == [None, 10, None, 30, 20, None, 41, None]


def test_wilder_by_hand_and_warm_up(spark):
    rows = spark.createDataFrame([(1, dt.date(2026, 1, 1) + dt.timedelta(n), float(n + 1)) for n in range(6)] + [(2, dt.date(2026, 1, 1), 5.0)], "entity_id long, trade_date date, x double")
    assert column(factors.wilder(rows, "x", 3), "wilder") == pytest.approx([2.0, 8 / 3, 8 / 3 + (5 - 8 / 3) / 3, 8 / 3 + (5 - 8 / 3) / 3 + (6 - (8 / 3 + (5 - 8 / 3) / 3)) / 3])


def test_adx_against_a_plain_loop(spark):
    price, rows = 100.0, []
    for i in range(40):
        price += 1.6 if i % 5 < 3 else -1.1
        rows.append((1, dt.date(2026, 1, 5) + dt.timedelta(i), price + 1.5 + 0.2 * (i % 3), price - 1.2 - 0.15 * (i % 4), price))
    frame = spark.createDataFrame(rows, "entity_id long, trade_date date, high double, low double, close double")
    got = column(factors.adx({c: frame.select("entity_id", "trade_date", c) for c in ("high", "low", "close")}, None), "adx")
    moves = []
    for n, (_, _, h, low, c) in enumerate(rows):
        _, _, ph, pl, pc = rows[n - 1] if n else (0, 0, h, low, c)
        up, down = (h - ph, pl - low) if n else (0, 0)
        moves.append((max(h - low, abs(h - pc), abs(low - pc)), up if up > down and up > 0 else 0, down if down > up and down > 0 else 0))
    smooth = lambda xs: [sum(xs[:14]) / 14] if len(xs) == 14 else (lambda s: [*s, s[-1] + (xs[-1] - s[-1]) / 14])(smooth(xs[:-1]))
    lines = [smooth([m[k] for m in moves]) for k in range(3)]
    dx = [100 * abs(p - m) / (p + m) for _, p, m in zip(*lines, strict=True)]
    assert len(got) == 14 and got == pytest.approx(smooth(dx))


def test_factor_registry(spark):
    registry = factors.Registry()
    with pytest.raises(ValueError):
        registry.register("bad", 1, "bad", [])(lambda inputs, as_of: None)

    @registry.register("loop", 1, "loop", ["loop"])
    def loop(inputs, as_of):
        """Formula: none.  PIT: none."""

    with pytest.raises(ValueError):
        registry.evaluate("loop", None, AT)
    assert factors.REGISTRY.fingerprint("ma20") != factors.REGISTRY.fingerprint("ma20_gap")


def test_projection_checks(spark, tmp_path):
    f = factors.REGISTRY.factors["ma20"]
    rows = spark.createDataFrame([(1, DAYS[0], 1.0), (1, DAYS[4], 2.0)], "entity_id long, trade_date date, ma20 double")
    path = str(tmp_path / "p")
    with pytest.raises(ValueError):
        factors.current_projection(spark, path)
    kept = factors.materialise(rows.limit(1), f, AT, AT, "print", path)
    kept = factors.materialise(rows, f, AT, AT, "print", path)
    assert {r.data_generation for r in kept.collect()} == {2} and kept.count() == 2
    kept.limit(1).write.parquet(f"{path}/generation=3")  # written, but never finished
    assert factors.current_projection(spark, path).count() == 2
    assert factors.read_projection(kept, f, "2026-09-20T14:30:00+02:00").count() == 2
    with pytest.raises(ValueError):
        factors.read_projection(kept, f, "2026-09-20T13:30:00+02:00")
    assert factors.read_projection(kept, f, LATER, (DAYS[0], DAYS[0])).count() == 1
    for bad in (dict(at="2026-01-01 00:00:00"), dict(at=LATER, window=(DAYS[0], DAYS[8])), dict(at=LATER, fingerprint="other")):
        with pytest.raises(ValueError):
            factors.read_projection(kept, f, **bad)
    assert factors.read_projection(kept.limit(0), f, LATER, (DAYS[0], DAYS[8])).count() == 0


def test_rerun_writes_nothing(spark, bars, tmp_path):
    path, key = str(tmp_path / "t"), list(BAR.physical_key)
    assert sinks.append_rows(bars.union(bars), path, key) == 12
    assert sinks.append_rows(bars, path, key) == 0 and spark.read.parquet(path).count() == 12


def test_restatement_tolerance(spark):
    schema = "entity_id long, trade_date date, close double"
    now = [(1, DAYS[0], 1.0), (2, DAYS[0], 1.0), (3, DAYS[0], None), (4, DAYS[0], None), (5, DAYS[0], 1.0), (6, DAYS[0], 1e12)]
    current = spark.createDataFrame([(*r, KNOWN, 4) for r in now], schema + ", knowledge_time timestamp_ntz, version long")
    incoming = spark.createDataFrame([(1, DAYS[0], 1.0 + 5e-7), (2, DAYS[0], 1.1), (3, DAYS[0], None), (4, DAYS[0], 2.0), (5, DAYS[0], None), (6, DAYS[0], 1e12 + 500), (7, DAYS[0], 1.0)], schema)
    got = {r.entity_id: (r.action, r.version) for r in ingest.restate(current, incoming, ["entity_id", "trade_date"], {"close": "bar"}, AT).collect()}
    assert got == {2: ("revised", 5), 4: ("revised", 5), 5: ("revised", 5), 7: ("new", 1)}


def test_stream_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, DAYS[0], 1.0), (2, DAYS[0], 2.0)], "entity_id long, trade_date date, close double")
    run = lambda check: stream_restate(spark, str(tmp_path / "in"), "entity_id long, trade_date date, close double", str(tmp_path / "t"), str(tmp_path / check), ["entity_id", "trade_date"], {"close": "bar"}, AT)
    rows.write.parquet(str(tmp_path / "in"))
    assert run("a") == 1 and run("a") == 0
    run("b")  # all files once more, as after a lost checkpoint
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    rows.withColumn("close", F.col("close") + 1).write.mode("append").parquet(str(tmp_path / "in"))
    run("a")
    assert sorted((r.entity_id, r.version, r.close) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 2.0), (2, 2, 3.0)]


def test_exports_keep_types(spark, bars, tmp_path):
    sinks.export_parquet(bars.limit(0), BAR, str(tmp_path / "e"), ["entity_id", "close"])
    assert spark.read.parquet(str(tmp_path / "e")).dtypes == [("entity_id", "bigint"), ("close", "double")]
    import pyarrow as pa

    rows = bars.select("entity_id", "close")
    streams = sinks.export_arrow(rows.repartition(1), 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        parts = streams.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) > 1 and sum(pa.ipc.open_stream(s.stream).read_all().num_rows for s in parts) == 12
    assert sinks.read_arrow(sinks.export_arrow(rows), "entity_id long, close double").count() == 12


def test_universe_judges_the_winner(spark):
    life = spark.createDataFrame([(1, "listed", DAYS[0], None, KNOWN, 1), (1, "delisted", DAYS[2], None, KNOWN, 1), (2, "listed", None, None, KNOWN, 1), (3, "listed", DAYS[0], None, KNOWN, 1)], "entity_id long, status string, start_date date, end_date date, knowledge_time timestamp_ntz, version long")
    who = spark.createDataFrame([(e, f"c{e}", f"n{e}", "equity", "cn", dt.date(2000, 1, 1), None, KNOWN, 1) for e in (1, 2)], "entity_id long, code string, name string, entity_type string, market string, valid_from date, valid_to date, knowledge_time timestamp_ntz, version long")
    at = lambda d: sorted(r.entity_id for r in scd2.universe(life, who, d).collect())
    assert at(DAYS[1]) == [1, 2] and at(DAYS[3]) == [2]


def test_quality_scan_goes_on_after_errors(spark, bars):
    checks = [quality.Check("bar", n, "rule", "error", bars, f) for n, f in (("bad", lambda: quality.expression(bars, "oops > 1")), ("range", lambda: quality.in_range(bars, "close", 0, 50)))]
    checks.append(quality.Check("bar", "none", "rule", "error", bars.limit(0), lambda: bars.limit(0)))
    checks.append(quality.Check("bar", "late", "rule", "warn", bars, lambda: quality.expression(bars, "1 / (close - close) > 0")))
    checks.append(quality.Check("bar", "row", "rule", "error", bars, lambda: F.col("close") > 50, ["entity_id", "close"], None))
    checks.append(quality.Check("bar", "off", "rule", "error", bars, None, skip="no target"))
    got = {r.check_id: r for r in quality.scan(spark, checks, ("2026-09-01", "2026-09-30")).collect()}
    assert {n: (r.status, r.violations) for n, r in got.items()} == {"bad": ("error", 0), "range": ("failed", 1), "none": ("passed", 0), "late": ("error", 0), "row": ("failed", 1), "off": ("skipped", 0)}
    assert got["late"].message == "DIVIDE_BY_ZERO" and got["row"].samples == '["entity_id=1, close=99.0"]' and got["row"].rows_checked == 12


def test_scan_shows_twenty_samples(spark):
    rows = spark.range(50).withColumnRenamed("id", "a")
    got = quality.scan(spark, [quality.Check("d", "c", "rule", "error", rows, lambda: F.col("a") >= 0, ["a"], lambda: rows.agg(F.count("a").alias("n")))], ("2026-09-01", "2026-09-30")).first()
    assert len(got.samples.split(",")) == 20 and got.violations == 50


def test_page_shows_what_follows_the_largest_page(spark):
    frame = spark.range(50_010).select(F.col("id").alias("entity_id"), F.lit(DAYS[0]).alias("trade_date"))
    assert pit.page(frame, BAR, (0, DAYS[0]), limit=50_000).count() == 50_001 and pit.ordered(frame, BAR, limit=60_000).count() == 50_000


def test_stale_projections_are_refused(spark, tmp_path):
    f = factors.REGISTRY.factors["ma20"]
    rows = spark.createDataFrame([(1, DAYS[0], 1.0), (1, DAYS[4], 2.0)], "entity_id long, trade_date date, ma20 double")
    close = rows.withColumnRenamed("ma20", "close")
    for n, (print_, good) in enumerate([(factors.REGISTRY.fingerprint("ma20"), True), ("old", False)]):
        kept = factors.materialise(rows, f, AT, AT, print_, str(tmp_path / str(n)))
        evaluate = lambda: factors.REGISTRY.evaluate("ma20_gap", lambda names: close, AT, {"ma20": kept})  # noqa: B023, E731
        if good:
            assert [r.ma20_gap for r in evaluate().orderBy("trade_date").collect()] == [0.0, 0.0]
        else:
            with pytest.raises(ValueError, match="stale"):
                evaluate()


def test_name_changes_chain(spark):
    day = dt.date
    who = spark.createDataFrame([(1, "C1", "base", day(2000, 1, 1), None, 3), (2, "C2", "late", day(2020, 1, 1), None, 1)], "entity_id long, code string, name string, valid_from date, valid_to date, version long")
    events = spark.createDataFrame([(1, "A", day(2010, 1, 1), day(2010, 12, 31)), (1, "B", day(2012, 1, 1), None), (1, "C", day(2013, 1, 1), day(2013, 1, 31)), (2, "D", day(2015, 1, 1), day(2015, 2, 1))], "entity_id long, new_name string, start date, end date")
    got = [tuple(r) for r in scd2.name_changes(who, events).orderBy("entity_id", "version").collect()]
    assert got == [
        (1, "close", "base", day(2000, 1, 1), day(2009, 12, 31), 4), (1, "name", "A", day(2010, 1, 1), day(2010, 12, 31), 5), (1, "resume", "base", day(2011, 1, 1), None, 6),
        (1, "close", "base", day(2011, 1, 1), day(2011, 12, 31), 7), (1, "name", "B", day(2012, 1, 1), None, 8),
        (1, "close", "B", day(2012, 1, 1), day(2012, 12, 31), 9), (1, "name", "C", day(2013, 1, 1), day(2013, 1, 31), 10), (1, "resume", "B", day(2013, 2, 1), None, 11),
        (2, "name", "D", day(2015, 1, 1), day(2015, 2, 1), 2), (2, "resume", "late", day(2015, 2, 2), None, 3),
    ]
    with pytest.raises(Exception, match="unknown entity"):
        scd2.name_changes(who, events.withColumn("entity_id", F.lit(9).cast("long"))).collect()


def test_sources_break_ties_by_order(spark):
    a = spark.createDataFrame([(1, DAYS[0], 5.0), (1, DAYS[0], 3.0)], "entity_id long, trade_date date, close double")
    keys = ["entity_id", "trade_date"]
    assert [r.close for r in vendor.merge_sources([a, a], keys).collect()] == [3.0]
    assert [r.close for r in vendor.merge_sources([a], keys, [F.desc("close")]).collect()] == [5.0]
    assert [r.close for r in vendor.fill_fields(a.select(*keys).distinct(), [a], ["close"], keys, [F.desc("close")]).collect()] == [5.0]


def test_unique_ignores_null_keys(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (None, 1), (2, 1)], "a int, b int")
    assert quality.unique(rows, ["a", "b"]).count() == 2


def test_codes(spark):
    rows = [("600000.sh", "600000.SH", "stock", "CNY"), (" 1.SZ", "000001.SZ", "stock", "CNY"), ("abc.SH", None, None, None), ("AAPL.O", "AAPL.O", "stock", "USD"), ("nodot", None, None, None), ("700.HK", "700.HK", None, "HKD"), (None, None, None, None), ("510300.SH", "510300.SH", "etf", "CNY"), ("1234567.SH", None, None, None)]
    frame = spark.createDataFrame([(r[0],) for r in rows], "c string").select(codes.canonical(F.col("c")).alias("a"), codes.security_type(F.col("c")).alias("b"), codes.currency(codes.canonical(F.col("c"))).alias("d"))
    assert [tuple(r) for r in frame.collect()] == [r[1:] for r in rows]


def test_seed_guards(spark):
    seed = spark.createDataFrame([("1", "a", "1"), ("2", "b", "0")], "k string, v string, f string")
    assert vendor.seed_missing(seed.limit(1).select("k"), seed, ["k"], ["k", "v"], ["f"]).count() == 1
    for bad in (seed.limit(0), seed.union(seed), seed.withColumn("v", F.lit(" ")), seed.withColumn("f", F.lit("x")), seed.withColumn("d", F.lit("2024-02-30")), seed.withColumn("d", F.lit("soon")), seed.withColumn("d", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            vendor.seed_missing(seed.select("k"), bad, ["k"], ["k", "v"], ["f"], ["d"] if "d" in bad.columns else [])
    assert vendor.seed_missing(seed.limit(1).select("k"), seed.withColumn("d", F.lit("2024-02-29")), ["k"], ["k"], [], ["d"]).count() == 1
