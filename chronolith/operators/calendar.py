"""Trading calendars, and bars aligned to them with an explicit state for each day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators import pit
from chronolith.plans.spec import CALENDAR, PitSpec

RESERVED = ("status", "is_suspended", "is_st")


def trading_days(calendar: DataFrame, at, window: tuple | None = None) -> DataFrame:
    """Distinct open days of any exchange, as known at ``at``."""
    return pit.as_of(calendar, CALENDAR, at, ["is_open"], window=window).where("is_open").select("trade_date").distinct()


def last_closed(calendar: DataFrame, now, lookback: int = 45) -> DataFrame:
    """One row: the last open day that has closed (08:30 UTC counts today), within ``lookback`` days, else null."""
    clock = F.lit(now).cast("timestamp_ntz")
    today = F.to_date(clock)
    until = F.when(F.date_format(clock, "HH:mm") >= "08:30", today).otherwise(F.date_sub(today, 1))
    return calendar.where(F.col("is_open") & (F.col("trade_date") <= until) & (F.col("trade_date") >= F.date_sub(today, lookback))).agg(F.max("trade_date").alias("last_closed"))


def last_n_days(calendar: DataFrame, end, n: int) -> DataFrame:
    """The ``n`` latest distinct open days up to ``end``."""
    return calendar.where(F.col("is_open") & (F.col("trade_date") <= F.lit(end).cast("date"))).select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(n)


def trading_lag(marks: DataFrame, calendar: DataFrame, latest) -> DataFrame:
    """(dataset, lag): open days after each mark (a date) up to ``latest``; null without a mark, 0 if it is not behind."""
    days = calendar.where(F.col("is_open") & (F.col("trade_date") <= F.lit(latest).cast("date")))
    # a calendar's days are one array in one row
    listed = days.agg(F.collect_set("trade_date").alias("__days"))
    after = F.size(F.filter("__days", lambda d: d > F.col("mark"))).cast("long")
    return marks.join(F.broadcast(listed)).select("dataset", F.when(F.col("mark").isNotNull(), after).alias("lag"))


def grid(entities: DataFrame, days: DataFrame) -> DataFrame:
    """Every entity on every day.  Each entity unrolls the days (of a calendar, so few), which is one array; no join of rows."""
    listed = days.agg(F.array_sort(F.collect_set("trade_date")).alias("__days"))
    return entities.select("entity_id").distinct().join(F.broadcast(listed)).select("entity_id", F.explode("__days").alias("trade_date"))


def _state(has_bar, suspended):
    return F.when(has_bar, "ok").when(F.coalesce(suspended, F.lit(False)), "suspended").otherwise("missing")


def align(bars: DataFrame, spec: PitSpec, days: DataFrame, entities: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """The grid of entities and days with bars (already read as of a moment) and a status: ok, suspended or missing.

    Values of missing days stay null.  With ``status`` rows the flags is_suspended and is_st are added, null where there is
    no row; without, the only states are ok and missing.
    """
    if tuple(sorted(spec.business_key)) != ("entity_id", "trade_date") or set(RESERVED) & set(bars.columns):
        raise ValueError("alignment needs the key (entity_id, trade_date) and free status names")
    keys = ["entity_id", "trade_date"]
    joined = grid(entities, days).join(bars.withColumn("__bar", F.lit(True)), keys, "left")
    values = [c for c in bars.columns if c not in keys]
    if status is None:
        return joined.select(*keys, *values, _state(F.col("__bar"), F.lit(False)).alias("status"))
    joined = joined.join(status.select(*keys, "is_suspended", "is_st"), keys, "left")
    return joined.select(*keys, *values, _state(F.col("__bar"), F.col("is_suspended")).alias("status"), "is_suspended", "is_st")


def align_source(bars: DataFrame, codes: DataFrame, status: DataFrame, days: DataFrame, order: Sequence[str]) -> DataFrame:
    """Source rows (code, trade_date, values) aligned by code: repeated bars keep the last by ``order``; flags without a row are false.

    ``codes``: (code, entity_id, version), of which the highest version counts; latest status by knowledge, then version.
    """
    mapped = pit.first_by(codes, ["code"], [F.desc("version")]).select("code", "entity_id")
    state = pit.first_by(status, ["entity_id", "trade_date"], [F.desc("knowledge_time"), F.desc("version")]).select("entity_id", "trade_date", "is_suspended", "is_st")
    one = pit.first_by(bars, ["code", "trade_date"], [F.desc(c) for c in order]).drop(*order)
    cells = grid(mapped, days).join(mapped, "entity_id")
    joined = cells.join(one.withColumn("__bar", F.lit(True)), ["code", "trade_date"], "left").join(state, ["entity_id", "trade_date"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    values = [c for c in one.columns if c not in ("code", "trade_date")]
    return joined.select("code", "entity_id", "trade_date", *values, _state(F.col("__bar"), F.col("is_suspended")).alias("status"), flag("is_suspended"), flag("is_st"))
