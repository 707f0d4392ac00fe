"""Price adjustment by cumulative factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.operators import pit
from chronolith.operators.joins import asof_join
from chronolith.plans.spec import PitSpec


def resolve_mode(spec: PitSpec, mode: str | None) -> str:
    """The mode a read uses: the dataset's own by default; raw is none; others must be declared."""
    mode = mode or spec.default_adjust or "none"
    mode = "none" if mode == "raw" else mode
    if mode != "none" and mode not in spec.modes:
        raise ValueError(f"{spec.name} has no {mode} adjustment")
    return mode


def read(bars: DataFrame, factors: DataFrame, spec: PitSpec, factor_spec: PitSpec, at, fields: Sequence[str], mode: str | None = None, entities=None, window=None) -> DataFrame:
    """As-of bars, with adjustable fields times the factor of their day (hfq), over that of the entity's last day known (qfq).

    A bar without a factor gets null, never the raw price.  The anchor of qfq ignores ``window``.
    """
    mode = resolve_mode(spec, mode)
    plain = pit.as_of(bars, spec, at, fields, entities, window)
    if mode == "none" or not set(fields) & set(spec.adjustable):
        return plain
    known = pit.as_of(factors, factor_spec, at, ["adj_factor"], entities)
    joined = plain.join(known.withColumnRenamed("adj_factor", "__f"), list(factor_spec.business_key), "left")
    scale: Column = F.col("__f")
    if mode == "qfq":
        anchor = known.groupBy("entity_id").agg(F.max_by("adj_factor", factor_spec.role("event_time")).alias("__anchor"))
        joined, scale = joined.join(anchor, "entity_id", "left"), F.col("__f") / F.nullif(F.col("__anchor"), F.lit(0.0))
    return joined.select(*[(F.col(c) * scale).alias(c) if c in spec.adjustable else F.col(c) for c in plain.columns])


def _settled(frame: DataFrame, prices: Sequence[str], mode: str) -> DataFrame:
    scale, given = F.coalesce("__f", F.raise_error(F.lit("a bar has no factor")).cast("double")), frame.columns
    if mode == "qfq":
        last = frame.groupBy("entity_id").agg(F.max_by("__f", "trade_date").alias("__last"))
        frame, scale = frame.join(last, "entity_id", "left"), scale / F.col("__last")
    return frame.select(*[(F.col(c) * scale).alias(c) if c in prices else F.col(c) for c in given if c != "__f"])


def adjust_step(bars: DataFrame, events: DataFrame, prices: Sequence[str], mode: str) -> DataFrame:
    """Factors on change days only: each bar takes the last factor; qfq divides by that of the last bar in the frame.  A bar before any factor is an error."""
    joined = asof_join(bars, events.withColumnRenamed("adj_factor", "__f"), "trade_date", "trade_date", ["entity_id"])
    return _settled(joined, prices, mode)


def adjust_strict(bars: DataFrame, factors: DataFrame, prices: Sequence[str], mode: str) -> DataFrame:
    """A factor for each bar's own day; one that is missing is an error; qfq divides by that of the entity's last day."""
    joined = bars.join(factors.select("entity_id", "trade_date", F.col("adj_factor").alias("__f")), ["entity_id", "trade_date"], "left")
    return _settled(joined, prices, mode)
