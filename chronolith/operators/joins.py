"""As-of joins and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def position(df: DataFrame, name: str) -> Column:
    """A time as a number: days of a date, microseconds of a timestamp, a number as it is."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    return F.unix_micros(F.col(name).cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(name)


#: Cuts of a key with more than its share of rows, rows that a key may have without cuts, and the most keys that are cut.
CUTS, KEY_ROWS, MOST_HOT = 64, 2_000_000, 10_000


def _spread(sides: Sequence[DataFrame], by: Sequence[str], key_rows: int) -> list[DataFrame]:
    """Both sides (by, __p, ...) with __span: keys of more than ``key_rows`` rows cut at ``CUTS`` approximate percentiles of their times.

    One pass over the keys counts them.  No more than ``MOST_HOT`` keys can have more than that part of all rows each, so the
    table of cuts is broadcast.
    """
    points = sides[0].select(*by, "__p").unionByName(sides[1].select(*by, "__p"))
    counts = points.groupBy(*by).count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    hot = counts.where(F.col("count") > max(key_rows, total // MOST_HOT)).select(*by)
    cuts = points.join(F.broadcast(hot), list(by)).groupBy(*by).agg(F.array_sort(F.array_distinct(F.approx_percentile("__p", [n / CUTS for n in range(1, CUTS)], 10 * CUTS))).alias("__cuts"))
    place = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__p"))), F.lit(0)).cast("long")
    return [side.join(F.broadcast(cuts), list(by), "left").withColumn("__span", F.when(F.col("__cuts").isNotNull(), place).otherwise(0)).drop("__cuts") for side in sides]


def _last_seen(left: DataFrame, right: DataFrame, by: Sequence[str], forward: bool, tie: Column) -> DataFrame:
    """``left`` (by, __p, __l) with __r: the last of ``right`` (by, __p, __r) at or before it, or first at or after it.

    If both have __span, which rises with __p, spans are sorted apart and take in the last row of those before them.
    """
    flip, span = -1 if forward else 1, ["__span"] if "__span" in left.columns else []
    turned = [(F.col(c) * flip).alias(c) for c in ("__p", *span)]
    both = left.select(*by, *turned, F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__tie"), "__l", F.lit(None).cast(right.schema["__r"].dataType).alias("__r"))
    other = right.select(*by, *turned, F.lit(0).alias("__side"), (tie * flip).alias("__tie"), F.lit(None).cast(left.schema["__l"].dataType).alias("__l"), "__r")
    keys, carry = [*by, *span], None
    if span:
        ends = other.groupBy(*keys).agg(F.max_by("__r", F.struct("__p", "__tie")).alias("__end"))
        spans = both.select(*keys).distinct().join(ends, keys, "full")
        before = Window.partitionBy(*by).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
        carry = spans.select(*keys, F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    order = Window.partitionBy(*keys).orderBy("__p", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.unionByName(other).withColumn("__r", F.last("__r", ignorenulls=True).over(order)).where("__side = 1")
    if carry is not None:
        found = found.join(carry, keys, "left").withColumn("__r", F.coalesce("__r", "__carry"))
    return found.select(*by, *turned, "__l", "__r")


def asof_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str], direction: str = "backward",
    tolerance: float | None = None, suffix: str = "_right", tie: Column | None = None, span: int | str | None = None, key_rows: int = KEY_ROWS,
) -> DataFrame:
    """Every left row with the nearest right row of its ``by`` keys: backward, forward, or nearest (ties: backward).

    One shuffle by the keys and one sort, over the union of both sides.  Equal right times: the last by ``tie`` (a long)
    backward, the first forward.  ``tolerance`` (inclusive; days of dates, microseconds of timestamps) empties farther matches.  Clashing right columns get
    ``suffix``.  ``span`` (in the same units) cuts long keys into spans of time that are sorted apart, with the last right row
    of earlier spans carried in, so that one key needs not fit one task; "auto" does so for keys of more than ``key_rows`` rows
    alone, at percentiles of their own times (both sides' keys are counted first).  Left rows without match, null times or null keys stay with nulls.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError("unknown direction")
    tie = F.lit(0).cast("long") if tie is None else tie.cast("long")
    a = left.select(*by, position(left, left_on).alias("__p"), F.struct(*left.columns).alias("__l"))
    b = right.withColumn("__tie0", tie).where(F.col(right_on).isNotNull())
    b = b.select(*by, position(right, right_on).alias("__p"), F.struct(position(right, right_on).alias("__at"), *[c for c in right.columns if c not in by]).alias("__r"), "__tie0")
    if span == "auto":
        a, b = _spread([a, b], by, key_rows)
    elif span:
        a, b = (side.withColumn("__span", F.floor(F.col("__p") / span)) for side in (a, b))
    seen = _last_seen(a, b, by, direction == "forward", F.col("__tie0"))
    if direction == "nearest":
        seen = seen.withColumn("__l", F.struct(F.col("__l").alias("l"), F.col("__r").alias("r")))
        ahead = _last_seen(seen.drop("__r"), b, by, True, F.col("__tie0"))
        back, front = F.col("__l.r"), F.col("__r")
        nearer = back.isNotNull() & (front.isNull() | (F.col("__p") - back["__at"] <= front["__at"] - F.col("__p")))
        seen = ahead.select(*by, "__p", F.col("__l.l").alias("__l"), F.when(nearer, back).otherwise(front).alias("__r"))
    known = F.col("__p").isNotNull()
    for key in by:
        known &= F.col(key).isNotNull()
    if tolerance is not None:
        known &= F.abs(F.col("__p") - F.col("__r.__at")) <= tolerance
    seen = seen.withColumn("__r", F.when(known, F.col("__r")))
    kept = [F.col(f"__r.{c}").alias(c + suffix if c in left.columns else c) for c in right.columns if c not in by and not (c == right_on == left_on)]
    return seen.select("__l.*", *kept)


def days_covered(intervals: DataFrame, days: DataFrame, start: str, end: str, day: str = "trade_date", epoch: str = "1990-01-01") -> DataFrame:
    """Every row of ``intervals`` with each day of ``days`` (distinct) that it covers, both ends included.

    A null start is ``epoch``, a null end is open.  Days are few, so their range is two numbers; each interval is cut to it,
    unrolled, and joined to the days by equality rather than by range.
    """
    bounds = days.agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
    cut = intervals.join(F.broadcast(bounds), F.coalesce(F.col(start), F.lit(epoch).cast("date")) <= F.col("__b"))
    low, high = F.greatest(F.coalesce(F.col(start), F.lit(epoch).cast("date")), "__a"), F.least(F.coalesce(F.col(end), F.col("__b")), "__b")
    unrolled = cut.withColumn("__low", low).withColumn("__high", high).where("__low <= __high")
    return unrolled.withColumn(day, F.explode(F.sequence("__low", "__high"))).drop("__a", "__b", "__low", "__high").join(days.select(day).distinct(), day)
