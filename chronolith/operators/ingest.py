"""Append-only ingest: restatements become new versions, reruns write nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.joins import days_covered
from chronolith.operators.pit import first_by

#: Beginnings of names under special treatment.
ST_NAMES = ("*ST", "ST", "S*ST", "SST")


def close_to(a: Column, b: Column, rel: float, tol: float) -> Column:
    """Equal within the larger of a relative and an absolute tolerance; two nulls are equal, one is not."""
    near = F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def first_known(day: str = "trade_date") -> Column:
    """The stamp of a first version: its day, 07:00 UTC, whenever it is written."""
    return F.col(day).cast("timestamp_ntz") + F.expr("INTERVAL '7' HOUR")


def restate(current: DataFrame, incoming: DataFrame, keys: Sequence[str], same: dict[str, str], now, day: str = "trade_date", strict_nulls: bool = False) -> DataFrame:
    """Rows of ``incoming`` (keys, values) to append, with knowledge_time, version and action (new or revised).

    ``same`` gives each value's test against the current version (latest knowledge, then version, of each key): bar (relative
    1e-9, absolute 1e-6), factor (absolute 1e-9) or equal.  With ``strict_nulls`` rows with null values are dropped, and
    any null differs.  Incoming keys must be unique; one shuffle of each side by the key.
    """
    last = first_by(current, keys, [F.desc("knowledge_time"), F.desc("version")])
    last = last.select(*keys, F.col("version").alias("__v"), *[F.col(f).alias(f"__{f}") for f in same])
    test = {"bar": lambda a, b: close_to(a, b, 1e-9, 1e-6), "factor": lambda a, b: close_to(a, b, 0.0, 1e-9), "equal": lambda a, b: a.eqNullSafe(b)}
    rows = incoming.where(" AND ".join(f"{f} IS NOT NULL" for f in same)) if strict_nulls else incoming
    equal = F.lit(True)
    for f, how in same.items():
        one = test[how](F.col(f), F.col(f"__{f}"))
        equal &= one & F.col(f"__{f}").isNotNull() if strict_nulls else one
    joined = rows.join(last, list(keys), "left").where(F.col("__v").isNull() | ~equal)
    action = F.when(F.col("__v").isNull(), "new").otherwise("revised")
    return joined.select(
        *incoming.columns, F.when(F.col("__v").isNull(), first_known(day)).otherwise(F.lit(now).cast("timestamp_ntz")).alias("knowledge_time"), (F.coalesce("__v", F.lit(0)) + 1).cast("long").alias("version"), action.alias("action")
    )


def new_rows(table: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose physical key ``table`` lacks, one of each key (ties by the other columns)."""
    rest = [F.col(c).asc_nulls_last() for c in batch.columns if c not in key]
    one = first_by(batch, key, rest or [F.lit(1)])
    return one.join(table.select(*key), list(key), "left_anti")


def derive_status(days: DataFrame, entities: DataFrame, suspensions: DataFrame, names: DataFrame) -> DataFrame:
    """(entity_id, trade_date, is_suspended, is_st) of entities on open days.

    Suspended: an event that day whose type isn't R.  ST: a day inside an interval of a name that begins as names under special
    treatment do.  ``suspensions``: entity_id, trade_date, suspend_type; ``names``: entity_id, name, start_date, end_date.
    """
    listed = days.agg(F.array_sort(F.collect_set("trade_date")).alias("__days"))
    cells = entities.select("entity_id").distinct().join(F.broadcast(listed)).select("entity_id", F.explode("__days").alias("trade_date"))
    halted = suspensions.where(~F.col("suspend_type").eqNullSafe("R")).select("entity_id", "trade_date", F.lit(True).alias("is_suspended")).distinct()
    name = F.upper(F.trim("name"))
    starts = F.lit(False)
    for s in ST_NAMES:
        starts |= name.startswith(s)
    marked = days_covered(names.where(starts), days, "start_date", "end_date").select("entity_id", "trade_date", F.lit(True).alias("is_st")).distinct()
    keys = ["entity_id", "trade_date"]
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return cells.join(halted, keys, "left").join(marked, keys, "left").select(*keys, flag("is_suspended"), flag("is_st"))


def advance_watermarks(marks: DataFrame, runs: DataFrame, today) -> DataFrame:
    """(dataset, scope, watermark_time): the later of the mark and the runs' ends; a run of today without rows counts until yesterday."""
    day = F.lit(today).cast("date")
    done = F.when((F.col("end_day") == day) & (F.col("rows") == 0), F.date_sub(day, 1)).otherwise(F.col("end_day"))
    moved = runs.select("dataset", "scope", done.alias("watermark_time"))
    return marks.select("dataset", "scope", "watermark_time").unionByName(moved).groupBy("dataset", "scope").agg(F.max("watermark_time").alias("watermark_time"))


def due_windows(marks: DataFrame, last_closed: DataFrame) -> DataFrame:
    """(dataset, start_day, end_day) of datasets (dataset, mark, configured_start) that lag behind the last closed day (one row)."""
    joined = marks.join(F.broadcast(last_closed))
    start = F.coalesce(F.date_add("mark", 1), F.col("configured_start"))
    return joined.select("dataset", start.alias("start_day"), F.col("last_closed").alias("end_day")).where("start_day IS NOT NULL AND start_day <= end_day")


def empty_window_guard(fetched: DataFrame, days: DataFrame, history: DataFrame) -> DataFrame:
    """(dataset, entity_id, suspicious) of fetches (dataset, entity_id, start_day, end_day, rows): nothing came, though days were open and the entity has earlier rows."""
    # the days are one sorted array in one row
    listed = days.agg(F.array_sort(F.collect_set("trade_date")).alias("__days"))
    within = F.size(F.filter("__days", lambda d: d.between(F.col("start_day"), F.col("end_day"))))
    open_ = fetched.join(F.broadcast(listed)).withColumn("__open", within).drop("__days")
    first = history.groupBy("entity_id").agg(F.min("trade_date").alias("__first"))
    joined = open_.join(first, "entity_id", "left")
    return joined.select("dataset", "entity_id", ((F.col("rows") == 0) & (F.col("__open") > 0) & F.coalesce(F.col("__first") <= F.col("end_day"), F.lit(False))).alias("suspicious"))
