"""Keys too long for one task: rows numbered by spans of time, and windows over chunks of rows with the rows before them copied in.

Keys and times are those of business keys: they are not null, and unique together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.operators.joins import position


def numbered(df: DataFrame, key: str, time: str, span: int) -> DataFrame:
    """``df`` with __span (of ``span`` days of dates, microseconds of timestamps), __before (the key's rows in earlier spans) and
    __i (the row's number in its key, from 1).

    Spans are counted first, then each span is numbered by itself; what is sorted in one task is a span, and the counts of a key.
    """
    cut = df.withColumn("__span", F.floor(position(df, time) / span))
    counts = cut.groupBy(key, "__span").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "__span", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    within = Window.partitionBy(key, "__span").orderBy(time)
    # a left join: were the rows ever the broadcast side, they would take on the partitioning of the counts, by key alone
    return cut.join(starts, [key, "__span"], "left").withColumn("__i", F.col("__before") + F.row_number().over(within))


def over_chunks(df: DataFrame, key: str, time: str, span: int | None, halo: int, made: Callable[[Sequence[str]], dict[str, Column]]) -> DataFrame:
    """``df`` with the window columns ``made(partition keys)``, each of which looks at no more than ``halo`` rows before its own.

    Without ``span`` a key is one partition.  With it, a key's rows are cut into chunks of ``span`` rows (``halo`` at least), and the
    last ``halo`` rows of each are copied to the next, where they are only looked at: equal results, in tasks of a chunk's size.
    """
    if span is None:
        return df.withColumns(made([key]))
    size = max(span, halo, 1)
    rows = numbered(df, key, time, span)
    rows = rows.withColumn("__home", F.floor((F.col("__i") - 1) / size))
    copied = F.when((F.col("__i") - 1) % size >= size - halo, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))
    rows = rows.withColumn("__chunk", F.explode(copied)).withColumns(made([key, "__chunk"]))
    return rows.where("__chunk = __home").drop("__span", "__before", "__i", "__home", "__chunk")


def carried(df: DataFrame, key: str, time: str, span: int | None, fields: Sequence[str]) -> DataFrame:
    """``df`` with nulls of ``fields`` filled with the key's last value before them; with ``span`` each span of time is filled by
    itself, and takes in the last values of the spans before it."""
    keys = [key] if span is None else [key, "__span"]
    past = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    fill = {f: F.last(f, ignorenulls=True).over(past) for f in fields}
    if span is None:
        return df.withColumns(fill)
    rows = df.withColumn("__span", F.floor(position(df, time) / span))
    ends = rows.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(time))).alias(f"__{f}") for f in fields])
    earlier = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, *[F.last(f"__{f}", ignorenulls=True).over(earlier).alias(f"__{f}") for f in fields])
    filled = rows.withColumns(fill).join(ends, keys, "left")
    return filled.select(*[F.coalesce(c, f"__{c}").alias(c) if c in fields else F.col(c) for c in df.columns])
