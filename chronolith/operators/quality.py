"""Data quality: every check is a query of violating rows; results are one-row aggregates over them."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.operators.pit import first_by
from chronolith.sources.store import claimed


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__or__, conditions)


def unique(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raw rows whose key, without nulls, occurs more than once: keys are counted first, so hot keys don't gather."""
    known = raw.where(~any_of([F.col(k).isNull() for k in keys]))
    return known.join(known.groupBy(*keys).count().where("count > 1").drop("count"), list(keys), "left_semi")


def not_null(latest: DataFrame, fields: Sequence[str]) -> DataFrame:
    return latest.where(any_of([F.col(f).isNull() for f in fields]))


def in_range(latest: DataFrame, field: str, low=None, high=None) -> DataFrame:
    bounds = ([] if low is None else [F.col(field) < low]) + ([] if high is None else [F.col(field) > high])
    return latest.where(any_of(bounds))


def in_enum(latest: DataFrame, field: str, values: Sequence) -> DataFrame:
    return latest.where(F.col(field).isNotNull() & ~F.col(field).isin(list(values)))


def expression(latest: DataFrame, rule: str) -> DataFrame:
    """Rows where the Spark SQL predicate ``rule`` is false; a null is no violation."""
    return latest.where(~F.expr(rule))


def jump(latest: DataFrame, key: str, event: str, field: str, most: float) -> DataFrame:
    """Rows that moved by more than ``most`` of the value before them (of ``key``, in order of ``event``)."""
    before = F.lag(field).over(Window.partitionBy(key).orderBy(event))
    rows = latest.withColumn("previous", before.cast("double"))
    moved = F.when(F.col("previous") != 0, F.abs(F.col(field) - F.col("previous")) / F.abs(F.when(F.col("previous") != 0, F.col("previous"))))
    return rows.where(moved > most)


def reconcile(latest: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys, all known, have no match in ``reference`` (its open rows, if it has is_open)."""
    target = reference.where("is_open") if "is_open" in reference.columns else reference
    return latest.where(~any_of([F.col(k).isNull() for k in keys])).join(target.select(*keys).distinct(), list(keys), "left_anti")


def ordinals(days: DataFrame) -> DataFrame:
    """(n, trade_date): a calendar's days numbered from 0."""
    return days.agg(F.array_sort(F.collect_set("trade_date")).alias("d")).select(F.posexplode("d").alias("n", "trade_date"))


def _in_ordinals(intervals: DataFrame, days: DataFrame, epoch: str = "1990-01-01") -> DataFrame:
    """Intervals that cover a day, with __from and __to, the first and last day's number.  A null start is ``epoch``, a null end is open.

    Every date of the calendar's range has the number of the next day and the last one; intervals meet it by equality.  The
    calendar, a row for each date, is broadcast: thirty years are 11,000 rows.
    """
    listed = days.agg(F.array_sort(F.collect_set("trade_date")).alias("d"))
    stretch = F.transform("d", lambda d, n: F.struct(F.when(n == 0, d).otherwise(F.date_add(F.get("d", n - 1), 1)).alias("a"), d.alias("b")))
    dates = listed.select(F.posexplode(stretch).alias("n", "x")).select("n", F.explode(F.sequence("x.a", "x.b")).alias("date"), "x.b")
    dates = F.broadcast(dates.select("date", F.col("n").alias("next"), (F.col("n") - (F.col("date") != F.col("b")).cast("int")).alias("last")))
    ends = F.broadcast(listed.where(F.size("d") > 0).select(F.get("d", F.lit(0)).alias("__first"), F.element_at("d", -1).alias("__last")))
    start = F.coalesce(F.col("start_date"), F.lit(epoch).cast("date"))
    met = intervals.join(ends, (start <= F.col("__last")) & (F.col("end_date").isNull() | (F.col("end_date") >= F.col("__first"))))
    met = met.withColumns({"__a": F.greatest(start, "__first"), "__b": F.least(F.coalesce("end_date", "__last"), "__last")}).where("__a <= __b")
    met = met.join(dates.select(F.col("date").alias("__a"), F.col("next").alias("__from")), "__a").join(dates.select(F.col("date").alias("__b"), F.col("last").alias("__to")), "__b")
    return met.where("__from <= __to").drop("__a", "__b", "__first", "__last")


def expected_segments(intervals: DataFrame, days: DataFrame) -> DataFrame:
    """(entity_id, __from, __to): runs of days, by number, on which an entity is in the market: the winner of the intervals over
    each day by start, version, knowledge isn't delisted.

    An entity's intervals are cut at each other's ends, which are at most one more than there are days, and the winner of each piece is
    chosen; no interval is unrolled by day.
    """
    met = _in_ordinals(intervals, days)
    cuts = met.select("entity_id", F.explode(F.array("__from", F.col("__to") + 1)).alias("c")).groupBy("entity_id").agg(F.array_sort(F.collect_set("c")).alias("__cuts"))
    piece = F.transform("__cuts", lambda c, n: F.struct(c.alias("a"), (F.get("__cuts", n + 1) - 1).alias("b")))
    pieces = met.join(cuts, "entity_id").withColumn("__x", F.explode(F.filter(piece, lambda x: x["a"].between(F.col("__from"), F.col("__to")))))
    won = first_by(pieces.withColumn("__at", F.col("__x.a")), ["entity_id", "__at"], [F.desc("start_date"), F.desc("version"), F.desc("knowledge_time")])
    return won.where(F.col("status").isNull() | (F.col("status") != "delisted")).select("entity_id", F.col("__x.a").alias("__from"), F.col("__x.b").alias("__to"))


def missing_runs(segments: DataFrame, days: DataFrame, rows: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """(entity_id, __from, __to): runs of expected days without a row of any version and, with ``status``, without a suspension of
    any version.

    A sweep over each entity's segments and the days it has, each once, in order: what lies between one and the next is missing.
    """
    keys = ["entity_id", "trade_date"]
    seen = rows.select(*keys)
    seen = seen if status is None else seen.unionByName(status.where("is_suspended").select(*keys))
    had = seen.distinct().join(F.broadcast(ordinals(days)), "trade_date").select("entity_id", F.col("n").alias("at"), F.lit(None).cast("int").alias("to"))
    points = segments.select("entity_id", F.col("__from").alias("at"), F.col("__to").alias("to")).unionByName(had)
    order = Window.partitionBy("entity_id").orderBy("at", F.col("to").asc_nulls_last())
    within = F.last("to", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    begin = F.when(F.col("to").isNull(), F.col("at") + 1).otherwise(F.col("at"))
    # before its first segment nothing of an entity is missing (least() would pass over the null)
    upto = F.when(within.isNotNull(), F.least(within, F.lead("at").over(order) - 1))
    return points.select("entity_id", begin.alias("__from"), upto.alias("__to")).where("__from <= __to")


def uncovered_runs(entities: DataFrame, intervals: DataFrame, days: DataFrame) -> DataFrame:
    """(entity_id, __from, __to): runs of days on which no interval of an entity covers it."""
    met = _in_ordinals(intervals, days).groupBy("entity_id", "__from").agg(F.max("__to").alias("__to"))
    # a last point after all days, so that what is missing at the end lies before something
    count = F.broadcast(days.agg(F.count_distinct("trade_date").cast("int").alias("__from")))
    last = entities.select("entity_id").distinct().join(count).select("entity_id", "__from", F.col("__from").alias("__to"), F.lit(True).alias("__asked"))
    points = last.unionByName(met.withColumn("__asked", F.lit(None).cast("boolean")))
    order = Window.partitionBy("entity_id").orderBy("__from")
    asked = F.max("__asked").over(Window.partitionBy("entity_id"))
    before = F.coalesce(F.max("__to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    found = points.select("entity_id", (before + 1).alias("__from"), (F.col("__from") - 1).alias("__to"), asked.alias("__asked"))
    return found.where("__asked AND __from <= __to").drop("__asked")


def pairs_of(runs: DataFrame, days: DataFrame) -> DataFrame:
    """(entity_id, trade_date) of runs of days."""
    each = runs.select("entity_id", F.explode(F.sequence("__from", "__to")).alias("n"))
    return each.join(F.broadcast(ordinals(days)), "n").select("entity_id", "trade_date")


def held() -> Column:
    """How many days runs hold together."""
    return F.coalesce(F.sum(F.col("__to") - F.col("__from") + 1), F.lit(0)).cast("long")


def coverage(segments: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: expected and missing days of all entities, ratio."""
    counts = segments.agg(held().alias("expected")).join(missing.agg(held().alias("missing")))
    return counts.withColumn("ratio", (F.col("expected") - F.col("missing")) / F.when(F.col("expected") > 0, F.col("expected")))


def break_days(segments: DataFrame, missing: DataFrame, days: DataFrame, least: float = 0.99) -> DataFrame:
    """Days whose own ratio is under ``least``: runs count where they begin and end, and the counts are summed along the calendar."""
    ends = lambda runs, name: runs.select(F.explode(F.array(F.struct(F.col("__from").alias("n"), F.lit(1).alias(name)), F.struct((F.col("__to") + 1).alias("n"), F.lit(-1).alias(name)))).alias("x")).groupBy("x.n").agg(F.sum(f"x.{name}").alias(name))
    moved = ordinals(days).join(ends(segments, "expected"), "n", "left").join(ends(missing, "missing"), "n", "left")
    # one row for each day of the calendar
    past = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    told = moved.select("trade_date", *[F.coalesce(F.sum(c).over(past), F.lit(0)).cast("long").alias(c) for c in ("expected", "missing")])
    return told.where((F.col("expected") > 0) & (1 - F.col("missing") / F.nullif(F.col("expected"), F.lit(0)) < least))


def freshness(rows: DataFrame, days: DataFrame, event: str = "trade_date") -> DataFrame:
    """One row: the latest event, the last open day, and the open days after the event."""
    last = rows.agg(F.max(event).alias("latest"))
    met = days.select("trade_date").distinct().join(F.broadcast(last))
    return met.groupBy("latest").agg(F.max("trade_date").alias("last_open"), F.count_if(F.col("latest").isNull() | (F.col("trade_date") > F.col("latest"))).alias("lag_days"))


def common(a: DataFrame, b: DataFrame, field: str, normalised: bool = False) -> DataFrame:
    """(entity_id, trade_date, a, b, diff) of days that both sources have; normalised: both over their value of the last common day."""
    keys = ["entity_id", "trade_date"]
    met = a.select(*keys, F.col(field).alias("a")).join(b.select(*keys, F.col(field).alias("b")), keys)
    if normalised:
        met = met.join(met.groupBy("entity_id").agg(*[F.max_by(c, "trade_date").alias(f"__{c}") for c in ("a", "b")]), "entity_id")
        over = lambda c: F.col(c) / F.when(F.col(f"__{c}") != 0, F.col(f"__{c}"))
        met = met.select(*keys, over("a").alias("a"), over("b").alias("b"))
    return met.withColumn("diff", F.abs(F.col("a") - F.col("b")))


def compare_sources(a: DataFrame, b: DataFrame, field: str, tolerance: float, normalised: bool = False) -> DataFrame:
    """One row of counts and differences; a null difference is a violation."""
    met = common(a, b, field, normalised).agg(
        F.count(F.lit(1)).alias("overlap_rows"), F.count_if(F.col("diff").isNull()).alias("invalid_rows"),
        F.count_if(F.col("diff").isNull() | (F.col("diff") > tolerance)).alias("violations"), F.max("diff").alias("max_abs_diff"), F.avg("diff").alias("mean_abs_diff"),
    )
    counted = met.join(a.agg(F.count(F.lit(1)).alias("rows_a"))).join(b.agg(F.count(F.lit(1)).alias("rows_b")))
    return counted.withColumn("dropped_rows", F.col("rows_a") + F.col("rows_b") - 2 * F.col("overlap_rows"))


def worst(a: DataFrame, b: DataFrame, field: str, tolerance: float, n: int = 20) -> DataFrame:
    """The ``n`` worst violations, nulls first."""
    met = common(a, b, field).where(F.col("diff").isNull() | (F.col("diff") > tolerance))
    return met.orderBy(F.desc_nulls_first("diff"), "entity_id", "trade_date").limit(n)


@dataclass(frozen=True)
class Check:
    """``violating``: a function that gives the violating rows, or a condition on rows of ``checked``, the rows they are among.

    ``sample``: columns of a violation that are shown; ``metrics``: a function that gives one row of figures; ``skip``: why
    there is nothing to run (no target, no shared key), if so; ``size``: an aggregate that tells how many rows ``checked`` stands for;
    ``note``: a text of the rule, which is added to its message.
    """

    dataset: str
    check_id: str
    family: str
    severity: str
    checked: DataFrame
    violating: Callable[[], DataFrame | Column] | None
    sample: Sequence[str] = ()
    metrics: Callable[[], DataFrame] | None = None
    skip: str | None = None
    size: Column | None = None
    note: str = ""


RESULT = "dataset string, check_id string, family string, severity string, status string, window_start date, window_end date, rows_checked long, violations long, samples string, metrics string, message string"


def _problem(error: Exception) -> str:
    """Spark's error condition, wherever the error was raised, or the error's own name."""
    found = re.search(r"\[([A-Z][A-Z0-9_.]+)\]", str(error))
    return found[1] if found else type(error).__name__


def _counts(checks: Sequence[Check]) -> DataFrame:
    """(n, rows_checked, violations, metrics) of each check by number; conditions on the same rows are counted in one pass."""
    none, parts, conditions = F.lit(None).cast("string"), [], {}
    for n, c in enumerate(checks):
        found = c.violating()
        if isinstance(found, Column):
            conditions.setdefault(id(c.checked), []).append((n, c, found))
            continue
        one = c.checked.agg((F.count(F.lit(1)) if c.size is None else c.size).alias("rows_checked")).join(found.agg(F.count(F.lit(1)).alias("violations")))
        one = one.join(c.metrics().select(F.to_json(F.struct("*")).alias("metrics"))) if c.metrics else one.withColumn("metrics", none)
        parts.append(one.select(F.lit(n).alias("n"), "rows_checked", "violations", "metrics"))
    for group in conditions.values():
        counted = group[0][1].checked.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(found).alias(f"v{n}") for n, _, found in group])
        rows = [F.struct(F.lit(n).alias("n"), F.col("rows").alias("rows_checked"), F.col(f"v{n}").alias("violations"), none.alias("metrics")) for n, _, _ in group]
        parts.append(counted.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


def _samples(checks: dict[int, Check], most: int) -> DataFrame:
    """(n, samples): up to ``most`` violations of each check as text, the first in order of their columns."""
    parts = []
    for n, c in checks.items():
        found = c.violating()
        rows = c.checked.where(found) if isinstance(found, Column) else found
        text = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in c.sample])
        shown = rows.orderBy(*c.sample).limit(most).select(text.alias("s"))
        parts.append(shown.agg(F.to_json(F.array_sort(F.collect_list("s"))).alias("samples")).select(F.lit(n).alias("n"), "samples"))
    return reduce(DataFrame.unionByName, parts)


def scan(spark: SparkSession, checks: Sequence[Check], window: tuple[str, str], most: int = 20) -> DataFrame:
    """One row per check, as ``RESULT`` says: status passed, failed, skipped or error; samples and metrics as JSON.

    All counts are one job, and the samples of failed checks another.  If a job fails, each of its checks runs alone, and
    those that fail then, while planned or while run, give an error row; the others are not disturbed.  The driver sees one
    row per check.  No rows checked and no violations is passed; skipped is only what has a reason to be.
    """
    runs = {n: c for n, c in enumerate(checks) if c.skip is None}

    def gathered(make: Callable[[dict[int, Check]], DataFrame], wanted: dict[int, Check]) -> tuple[dict[int, Row], dict[int, str]]:
        if not wanted:
            return {}, {}
        try:
            return {r.n: r for r in make(wanted).collect()}, {}
        except Exception as error:  # noqa: BLE001  any failure of a rule is a row of the report
            if len(wanted) == 1:
                return {}, dict.fromkeys(wanted, _problem(error))
        rows, problems = {}, {}
        for n, c in wanted.items():
            got, bad = gathered(make, {n: c})
            rows |= got
            problems |= bad
        return rows, problems

    def counted(wanted: dict[int, Check]) -> DataFrame:
        numbers = F.lit(list(wanted)).cast("array<int>")
        return _counts(list(wanted.values())).withColumn("n", F.get(numbers, F.col("n")))

    counts, problems = gathered(counted, runs)
    failed = {n: runs[n] for n, r in counts.items() if r.violations and runs[n].sample}
    samples, more = gathered(lambda wanted: _samples(wanted, most), failed)
    problems |= more
    out = []
    for n, c in enumerate(checks):
        row, problem = counts.get(n), problems.get(n)
        if c.skip is not None:
            status, message = "skipped", c.skip
        elif problem is not None:
            status, message = "error", problem
        else:
            status, message = ("failed", f"{row.violations} violations") if row.violations else ("passed", "passed")
        message = f"{message} ({c.note})" if c.note else message
        shown = row is not None and problem is None
        out.append(
            (c.dataset, c.check_id, c.family, c.severity, status, *map(dt.date.fromisoformat, window), row.rows_checked if shown else 0, row.violations if shown else 0,
             samples[n].samples if n in samples else "[]", (row.metrics if shown else None) or "{}", message)
        )
    return spark.createDataFrame(out, RESULT)


def latest_run(results: DataFrame, day=None) -> DataFrame:
    """Rows of the last run for a report day (by default the last one)."""
    chosen = F.lit(day).cast("date") if day is not None else None
    picked = results.agg(F.max(F.struct("window_end", "run_id")).alias("m")) if chosen is None else results.where(F.col("window_end") == chosen).agg(F.max(F.struct("window_end", "run_id")).alias("m"))
    return results.join(F.broadcast(picked.select("m.window_end", "m.run_id")), ["window_end", "run_id"], "left_semi")


def metric(check: str, name: str) -> Column:
    """The largest of a figure in the JSON metrics of a check's rows."""
    return F.max(F.when(F.col("check_id") == check, F.get_json_object("metrics", f"$.{name}").try_cast("double")))


def summary(results: DataFrame, day=None) -> DataFrame:
    """Per dataset of the last run: counts by status, warnings, violations, failed checks, coverage and lag."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    failed = F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "failed", F.col("check_id")))), ",")
    return latest_run(results, day).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total"), n("passed"), n("failed"), n("skipped"), n("error"), F.count_if((F.col("severity") == "warn") & F.col("status").isin("failed", "error")).alias("warnings"),
        F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"), failed.alias("failed_checks"), metric("completeness", "ratio").alias("coverage_ratio"), metric("freshness", "lag_days").alias("lag_days"),
    )


def freshness_board(datasets: DataFrame, marks: DataFrame, lags: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """Every dataset with its watermark, lag, last success, coverage and failures, though it has none of them."""
    last = runs.where("status = 'success'").groupBy("dataset").agg(F.max("finished_at").alias("last_success"))
    found = latest_run(results).groupBy("dataset").agg(metric("completeness", "ratio").alias("coverage_ratio"), F.count_if(F.col("status").isin("failed", "error")).alias("failures"))
    joined = datasets.join(marks, "dataset", "left").join(lags, "dataset", "left").join(last, "dataset", "left").join(found, "dataset", "left")
    return joined.withColumn("failures", F.coalesce("failures", F.lit(0)))


def replace_run(results: DataFrame, path: str, wait: float = 600.0) -> None:
    """Write results partitioned by run_id; runs that are written again are replaced, others stay.

    Written under a claim: Spark commits a folder of such a table as a whole, so two writers at once would lose one's files.
    """
    with claimed(results.sparkSession, path, wait):
        results.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
