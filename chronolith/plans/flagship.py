"""The flagship query: a point-in-time read, adjusted, aligned, resampled and filled, next to a factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.operators import adjust, calendar, factors, pit, series
from chronolith.plans.registry import Tables, rounded
from chronolith.plans.spec import BAR, FACTOR, STATUS

AT = "2024-02-15 00:00:00"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly adjusted closes with status, gaps filled, and the last 20-day average of the week where there is one."""
    t = Tables(spark, sf_dir)
    bars = adjust.read(t.b_bar, t.b_factor, BAR, FACTOR, AT, ["open", "close", "volume"], "hfq")
    status = pit.as_of(t.b_status, STATUS, AT, ["is_suspended", "is_st"])
    cells = calendar.align(bars, BAR, calendar.trading_days(t.b_calendar, AT), t.b_bar.select("entity_id"), status)
    weekly = series.ffill(series.resample(cells, "1w", ["open", "close", "volume"]), ["close"])
    average = factors.REGISTRY.evaluate("ma20", lambda names: bars.select("entity_id", "trade_date", *names), AT)
    return rounded(weekly.join(average, ["entity_id", "trade_date"], "left"))
