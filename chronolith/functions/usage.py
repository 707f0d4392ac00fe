"""Usage accounting over a call log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(calls: DataFrame, costs: DataFrame) -> DataFrame:
    """(day, source, calls, cost): unit cost by source.endpoint, else by source, else 0.  ``costs``: (name, unit_cost), a price list."""
    by_endpoint = costs.select(F.col("name").alias("__e"), F.col("unit_cost").alias("__ce"))
    by_source = costs.select(F.col("name").alias("source"), F.col("unit_cost").alias("__cs"))
    # summed to endpoints first, so that prices join a few rows
    few = calls.groupBy("day", "source", "endpoint").agg(F.sum("calls").alias("calls"))
    priced = few.join(by_endpoint, F.concat_ws(".", "source", "endpoint") == F.col("__e"), "left").join(by_source, "source", "left")
    unit = F.coalesce("__ce", "__cs", F.lit(0.0))
    return priced.groupBy("day", "source").agg(F.sum("calls").alias("calls"), F.sum(F.col("calls") * unit).alias("cost"))


def alerts(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """(day, source, metric, level, ratio) where a limit (source, metric, limit) is exceeded, or 0.8 of it reached."""
    long = usage.select("day", "source", F.col("calls").cast("double").alias("calls"), "cost").unpivot(["day", "source"], ["calls", "cost"], "metric", "value")
    met = long.join(limits.where("limit > 0"), ["source", "metric"])
    level = F.when(F.col("value") >= F.col("limit"), "exceeded").when(F.col("value") >= 0.8 * F.col("limit"), "warn")
    return met.select("day", "source", "metric", level.alias("level"), F.round(F.col("value") / F.col("limit"), 4).alias("ratio")).where("level IS NOT NULL")
