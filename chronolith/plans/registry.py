"""Registered queries: each a function of tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.plans.bindings import BINDINGS, SPARK, DUCK, closure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: What queries have written in this process: (application, folder of tables, name) -> what was made.
WRITTEN: dict[tuple[str, str, str], Any] = {}


class Tables:
    """The driver's tables and their bindings as DataFrames, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def once(self, name: str, make: Callable[[], Any]) -> Any:
        """What ``make`` writes for these tables, written at the first call of a session only."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in WRITTEN:
            WRITTEN[key] = make()
        return WRITTEN[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BINDINGS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        needed = closure([name])
        source = lambda t: f"parquet.`{self.sf_dir}/{t}.parquet`"
        ctes = ", ".join(f"{n} AS ({BINDINGS[n](SPARK, source)})" for n in needed)
        return self.spark.sql(f"WITH {ctes} SELECT * FROM {name}")


def duck_sql(body: str, *bindings: str) -> str:
    """``body`` with the bindings it names as common table expressions."""
    ctes = ", ".join(f"{n} AS ({BINDINGS[n](DUCK, str)})" for n in closure(bindings))
    if not ctes:
        return body
    head = body.lstrip()
    if head.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {head[15:]}"
    return f"WITH {ctes}, {head[5:]}" if head.upper().startswith("WITH ") else f"WITH {ctes} {body}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as longs, as results are compared."""
    fix = {"double": lambda c: F.round(c, digits), "int": lambda c: c.cast("long")}
    return df.select(*[fix[t](F.col(f"`{c}`")).alias(c) if t in fix else F.col(f"`{c}`") for c, t in df.dtypes])


def nearest(name: str, digits: int = 6) -> Column:
    """The double ``name`` rounded as DuckDB rounds: the product with ``10**digits`` to a whole number, halves away from zero.

    Spark rounds the shortest decimals that stand for a double, and so differs where these end in a 5.
    """
    raised = F.col(name) * F.lit(10.0**digits)
    return F.when(F.abs(raised) < float("inf"), F.round(raised, 0) / F.lit(10.0**digits)).otherwise(F.col(name)).alias(name)


def query(name: str, sql: str | None = None, uses: tuple[str, ...] | str = (), digits: int = 6) -> Callable[[Callable[[Tables], Any]], Callable]:
    """Register a function of :class:`Tables` under ``name``; ``uses``: bindings that ``sql`` names; ``digits``: of doubles (more where exact values end in a 5 after 6)."""

    def add(function: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(function(Tables(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[name] = duck_sql(sql, *((uses,) if isinstance(uses, str) else uses))
        return function

    return add
