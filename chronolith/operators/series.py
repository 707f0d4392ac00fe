"""Time series over point-in-time reads, always in the order resample, fill, rolling, change.

All steps after resampling are windows by entity in order of event time, so they share one shuffle and one sort.  ``span`` cuts
long entities into chunks (see :mod:`chronolith.operators.spans`), so that one that holds much of the table fits no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.spans import carried, over_chunks

#: Calendar units of frequencies, and default aggregates by field.
UNITS = {"1w": "week", "1mo": "month", "1q": "quarter", "1y": "year"}
DEFAULTS = {"open": "first", "high": "max", "low": "min", "close": "last", "pre_close": "last", "volume": "sum", "amount": "sum"}
OPS = ("first", "last", "sum", "min", "max", "mean", "count")
FLAGS = ("is_suspended", "is_st")


def _aggregate(name: str, op: str, time: str) -> Column:
    at = F.when(F.col(name).isNotNull(), F.col(time))
    made = {
        "first": lambda: F.min_by(name, at), "last": lambda: F.max_by(name, at), "sum": lambda: F.coalesce(F.sum(name).cast("double"), F.lit(0.0)),
        "min": lambda: F.min(name), "max": lambda: F.max(name), "mean": lambda: F.avg(name), "count": lambda: F.count(name),
    }
    if op not in made:
        raise ValueError(f"unknown aggregate {op}")
    return made[op]().alias(name)


def resample(df: DataFrame, freq: str, fields: Sequence[str], aggs: dict[str, str] | None = None, key: str = "entity_id", time: str = "trade_date") -> DataFrame:
    """Rows by calendar week (from Monday), month, quarter or year; a bucket's date is the latest among its rows.

    first and last skip nulls; a sum of nulls is 0.  status: ok beats suspended beats missing; a flag is true if any is, null if all are.
    """
    if freq == "1d":
        if aggs:
            raise ValueError("1d takes no aggregates")
        return df
    if set(aggs or {}) - set(fields):
        raise ValueError("aggregates for fields that are not read")
    how = {f: (aggs or {}).get(f, DEFAULTS.get(f, "last")) for f in fields}
    out = [_aggregate(f, how[f], time) for f in fields]
    if "status" in df.columns:
        rank = F.max(F.when(F.col("status") == "ok", 2).when(F.col("status") == "suspended", 1).otherwise(0))
        out.append(F.when(rank == 2, "ok").when(rank == 1, "suspended").otherwise("missing").alias("status"))
    out += [F.max(f).alias(f) for f in FLAGS if f in df.columns]
    bucket = F.date_trunc(UNITS[freq], F.col(time)).alias("__bucket")
    return df.groupBy(key, bucket).agg(F.max(time).alias(time), *out).drop("__bucket")


def ffill(df: DataFrame, fields: Sequence[str], key: str = "entity_id", time: str = "trade_date", span: int | None = None) -> DataFrame:
    """Nulls of ``fields`` filled with the last value before them."""
    return carried(df, key, time, span, fields)


def rolling(df: DataFrame, fields: Sequence[str], window: int, op: str, min_periods: int | None = None, key: str = "entity_id", time: str = "trade_date", span: int | None = None) -> DataFrame:
    """``{field}_roll{n}_{op}`` over the last ``window`` rows: null with fewer non-null values (for count: rows) than ``min_periods``."""
    if window < 1 or op not in ("mean", "sum", "min", "max", "last", "count"):
        raise ValueError("a rolling needs a window and a known op")
    need, made = min_periods or window, {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}

    def columns(keys: Sequence[str]) -> dict[str, Column]:
        frame = Window.partitionBy(*keys).orderBy(time).rowsBetween(-(window - 1), 0)
        enough = lambda f: F.count(F.lit(1) if op == "count" else f).over(frame) >= need
        return {f"{f}_roll{window}_{op}": F.when(enough(f), F.col(f) if op == "last" else made[op](f).over(frame)) for f in fields}

    return over_chunks(df, key, time, span, window - 1, columns)


def change(df: DataFrame, fields: Sequence[str], k: int, key: str = "entity_id", time: str = "trade_date", span: int | None = None, null_over_zero: bool = False) -> DataFrame:
    """``{field}_chg{k}``: the value over that of ``k`` rows before, less 1; over zero it is an infinity, or NaN from zero (pandas), or with ``null_over_zero`` null (SQL)."""
    if k < 1:
        raise ValueError("k must be 1 or more")

    def columns(keys: Sequence[str]) -> dict[str, Column]:
        order, out = Window.partitionBy(*keys).orderBy(time), {}
        for f in fields:
            past, now = F.lag(f, k).over(order), F.col(f)
            infinite = F.when(now > 0, F.lit(float("inf"))).when(now < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
            out[f"{f}_chg{k}"] = F.when(now.isNull() | past.isNull(), None).when(past == 0, None if null_over_zero else infinite).otherwise(now / F.when(past != 0, past) - 1)
        return out

    return over_chunks(df, key, time, span, k, columns)


def series(df: DataFrame, fields: Sequence[str], freq: str = "1d", aggs=None, fill: str | None = None, roll: tuple | None = None, chg: int | None = None, span: int | None = None, null_over_zero: bool = False) -> DataFrame:
    """The whole chain over an as-of (and maybe aligned) frame."""
    out = resample(df, freq, fields, aggs)
    out = ffill(out, fields, span=span) if fill == "ffill" else out
    out = rolling(out, fields, *roll, span=span) if roll else out
    return change(out, fields, chg, span=span, null_over_zero=null_over_zero) if chg else out


def panel(df: DataFrame, fields: Sequence[str], entities: Sequence, time: str = "trade_date") -> DataFrame:
    """A wide table: one row per day, one column ``<entity>_<field>`` for each of the given entities."""
    if len(fields) == 1:
        wide = df.groupBy(time).pivot("entity_id", list(entities)).agg(F.first(fields[0], ignorenulls=True))
        return wide.select(time, *[F.col(f"`{e}`").alias(f"{e}_{fields[0]}") for e in entities])
    return df.groupBy(time).pivot("entity_id", list(entities)).agg(*[F.first(f, ignorenulls=True).alias(f) for f in fields])
