"""Bucketed tables that are read without a shuffle, and claims that keep two writers apart."""

import datetime as dt
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from chronolith.operators import adjust, factors, pit, quality
from chronolith.plans.spec import BAR, FACTOR
from chronolith.sources import sinks, store

AT = "2024-06-01 00:00:00"


def data(spark):
    days = spark.range(40).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("trade_date"))
    keys = spark.range(25).select(F.col("id").alias("entity_id")).join(days)
    known = F.col("trade_date").cast("timestamp_ntz").alias("knowledge_time")
    price = (F.col("entity_id") + F.dayofmonth("trade_date")).cast("double")
    bars = keys.select("entity_id", "trade_date", *[price.alias(c) for c in ("open", "high", "low", "close", "volume", "amount")], known, F.lit(None).cast("timestamp_ntz").alias("publish_time"), F.lit(1).cast("long").alias("version"), F.lit("p").alias("provider"))
    factor = keys.select("entity_id", "trade_date", (1 + F.dayofmonth("trade_date") / 100).alias("adj_factor"), known, F.lit(1).cast("long").alias("version"))
    return bars.select(*[f.name for f in BAR.fields]), factor.select(*[f.name for f in FACTOR.fields])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=[False, True], scope="module")
def tables(spark, request):
    bars, factor = data(spark)
    names = [f"t_{uuid.uuid4().hex}" for _ in range(2)]
    for rows, spec, name in ((bars, BAR, names[0]), (factor, FACTOR, names[1])):
        sinks.write_bucketed(rows, spec, name, 4, request.param)
    yield (*names, request.param)
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_reads_joins_and_windows_need_no_shuffle(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bars, factor = sinks.read_bucketed(spark, *tables[:2])
        plain = data(spark)
        read = pit.as_of(bars, BAR, AT, ["close"])
        adjusted = {mode: adjust.read(bars, factor, BAR, FACTOR, AT, ["high", "low", "close"], mode) for mode in ("hfq", "qfq")}
        ma20 = factors.ma20({"close": adjusted["hfq"]}, AT)
        for df in (read, *adjusted.values(), ma20):
            assert "Exchange" not in plan(df)
        assert "Exchange" in plan(pit.as_of(plain[0], BAR, AT, ["close"]))
        rows = lambda df: sorted(map(tuple, df.collect()))
        for mode, df in adjusted.items():
            assert rows(df) == rows(adjust.read(*plain, BAR, FACTOR, AT, ["high", "low", "close"], mode))
        assert rows(ma20) == rows(factors.ma20({"close": adjust.read(*plain, BAR, FACTOR, AT, ["close"], "hfq")}, AT))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_appends_keep_buckets_and_add_nothing_twice(spark, tables):
    name, _, by_month = tables
    later = data(spark)[0].where("entity_id < 5").withColumns({"version": F.lit(2).cast("long"), "close": F.lit(-1.0)})
    before = spark.table(name).count()
    assert sinks.append_bucketed(later, BAR, name, 4, by_month) == 200 and sinks.append_bucketed(later, BAR, name, 4, by_month) == 0
    again = sinks.read_bucketed(spark, name)[0]
    read = pit.as_of(again, BAR, AT, ["close"])
    assert again.count() == before + 200 and "Exchange" not in plan(read) and read.where("close = -1").count() == 200


def together(n, work):
    found, gate = [None] * n, threading.Barrier(n)

    def run(k):
        gate.wait()
        try:
            found[k] = work(k)
        except Exception as problem:  # noqa: BLE001
            found[k] = problem

    threads = [threading.Thread(target=run, args=(k,)) for k in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    return found


def test_one_of_many_creates(spark, tmp_path):
    for n in range(10):
        assert sum(together(6, lambda k, n=n: store.create_once(spark, f"{tmp_path}/claims/{n}"))) == 1
    assert sorted(store.names_in(spark, f"{tmp_path}/claims")) == sorted(map(str, range(10))) and store.names_in(spark, f"{tmp_path}/none") == []


def test_two_appends_add_a_key_once(spark, tmp_path):
    bars = data(spark)[0]
    key = ["entity_id", "trade_date", "knowledge_time", "version"]
    assert sorted(together(2, lambda k: sinks.append_rows(bars, f"{tmp_path}/bars", key))) == [0, 1000]
    assert spark.read.parquet(f"{tmp_path}/bars").count() == 1000 and not list(tmp_path.glob("*.claim"))


def test_a_claim_that_is_held_ends_in_an_error(spark, tmp_path):
    bars = data(spark)[0]
    with store.claimed(spark, f"{tmp_path}/bars"), pytest.raises(TimeoutError):
        sinks.append_rows(bars, f"{tmp_path}/bars", ["entity_id"], wait=0.3)
    assert sinks.append_rows(bars, f"{tmp_path}/bars", ["entity_id"]) == 25


def test_two_writers_make_two_generations(spark, tmp_path):
    factor = factors.REGISTRY.factors["ma20"]
    rows = data(spark)[0].select("entity_id", "trade_date", F.col("close").alias("ma20"))
    made = together(3, lambda k: {r.data_generation for r in factors.materialise(rows.withColumn("ma20", F.lit(float(k))), factor, AT, AT, "print", f"{tmp_path}/p").select("data_generation", "ma20").distinct().collect()})
    assert sorted(x for m in made for x in m) == [1, 2, 3]
    current = factors.current_projection(spark, f"{tmp_path}/p")
    assert current.count() == 1000 and current.select("data_generation", "ma20").distinct().count() == 1
    factors.materialise(rows, factor, AT, AT, "print", f"{tmp_path}/p", keep=1)
    assert sorted(p.name for p in tmp_path.glob("p/generation=*")) == ["generation=3", "generation=4"]


def test_two_runs_replaced_at_once(spark, tmp_path):
    rows = spark.createDataFrame([(r, f"c{k}", dt.date(2024, 1, 1)) for r in (1, 2, 3) for k in range(4)], "run_id long, check_id string, window_end date")
    together(3, lambda k: quality.replace_run(rows.where(F.col("run_id") == k + 1), f"{tmp_path}/q"))
    assert spark.read.parquet(f"{tmp_path}/q").count() == 12


def test_refresh_evaluates_changed_entities_only_and_gives_what_all_would(spark, tmp_path):
    bars, factor = data(spark)
    source = lambda rows, at: lambda names: adjust.read(rows, factor, BAR, FACTOR, at, list(names), "hfq")

    early, late = "2024-02-05 00:00:00", "2024-06-01 00:00:00"
    known = lambda rows: rows.select("entity_id", "knowledge_time")
    registry, values = factors.REGISTRY, lambda df: {(r.entity_id, r.trade_date): r.ma20 for r in df.collect()}
    first = factors.refresh(registry, "ma20", source(bars, early), known(bars), early, early, f"{tmp_path}/p")
    assert values(first) == values(registry.evaluate("ma20", source(bars, early), early)) and first.count() > 0
    # afterwards the days to come of all, then a restatement of entity 3 alone
    second = factors.refresh(registry, "ma20", source(bars, late), known(bars), late, late, f"{tmp_path}/p")
    old = values(second)
    assert old == values(registry.evaluate("ma20", source(bars, late), late)) and second.count() == 25 * 21
    restated = bars.where("entity_id = 3").withColumns({"version": F.lit(2).cast("long"), "close": F.col("close") + 1, "knowledge_time": F.lit("2024-06-02 00:00:00").cast("timestamp_ntz")})
    every, at = bars.unionByName(restated), "2024-06-03 00:00:00"
    # rows of other entities are taken over: their inputs are not read
    broken = every.withColumn("close", F.when(F.col("entity_id") == 3, F.col("close")).otherwise(F.lit(-9.0)))
    third = factors.refresh(registry, "ma20", source(broken, at), known(every), at, at, f"{tmp_path}/p", keep=0)
    assert values(third) == values(registry.evaluate("ma20", source(every, at), at)) and values(third) != old
    assert [r[0] for r in third.select("data_generation").distinct().collect()] == [3]
