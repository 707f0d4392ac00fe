"""Point-in-time row reads: what was known at a moment, ranked per business key.

Physical keys (business key, knowledge_time, version) are unique, so ranks have no ties.  Filters on key columns may be
written after a read: Catalyst pushes them below the window.  Filters on other columns apply to the chosen rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.plans.spec import META, PitSpec


#: Most rows of a page.
MOST_ROWS = 50_000


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order`` (Spark limits each group before the shuffle as well as after)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def _scoped(df: DataFrame, spec: PitSpec, entities: Iterable | None, window: tuple | None) -> DataFrame:
    if entities is not None:
        if "entity_id" not in spec.business_key:
            raise ValueError("the key has no entity_id")
        df = df.where(F.col("entity_id").isin(list(entities)))
    if window is not None:
        event, (start, end) = spec.role("event_time"), window
        if event is None or (start is not None and end is not None and start > end):
            raise ValueError("a window needs an event time and an order")
        df = df if start is None else df.where(F.col(event) >= F.lit(start).cast(df.schema[event].dataType))
        df = df if end is None else df.where(F.col(event) <= F.lit(end).cast(df.schema[event].dataType))
    return df


def _moment(as_of: Any) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def as_of(df: DataFrame, spec: PitSpec, at: Any, fields: Sequence[str] | None = None, entities: Iterable | None = None, window: tuple | None = None) -> DataFrame:
    """Business key and ``fields`` as known at ``at``: the highest version, then the latest knowledge, of each key.

    An empty ``entities`` gives no rows.  Only market, versioned and snapshot datasets can be read so.
    """
    if spec.pit_class == "scd2":
        raise ValueError("validity intervals are not read by version")
    fields = [f.name for f in spec.fields if f.name not in META] if fields is None else list(fields)
    missing = set(fields) - {f.name for f in spec.fields}
    if missing:
        raise ValueError(f"unknown fields: {sorted(missing)}")
    seen = _scoped(df.where(F.col("knowledge_time") <= _moment(at)), spec, entities, window)
    return first_by(seen, spec.business_key, [F.desc("version"), F.desc("knowledge_time")]).select(*dict.fromkeys((*spec.business_key, *fields)))


def storage_latest(df: DataFrame, spec: PitSpec, at: Any = None) -> DataFrame:
    """All columns, latest knowledge first and then version: the order of quality checks."""
    seen = df if at is None else df.where(F.col("knowledge_time") <= _moment(at))
    return first_by(seen, spec.business_key, [F.desc("knowledge_time"), F.desc("version")])


def rows(
    df: DataFrame, spec: PitSpec, mode: str, at: Any = None, fields: Sequence[str] | None = None, filters: Sequence[tuple[str, str, Any]] = (),
    entities: Iterable | None = None, window: tuple | None = None, policy: str = "knowledge", fallback: str = "strict", include_meta: bool = False,
) -> DataFrame:
    """The rows interface: latest, as_of (both at ``at``) or history; entity lists that are empty don't filter.

    ``policy`` publish ranks by publish time; a dataset without one is an error, or with ``fallback`` allow is ranked by
    knowledge.  Meta columns are hidden unless asked for; history always shows knowledge_time and version.
    """
    if mode not in ("latest", "as_of", "history") or policy not in ("knowledge", "publish"):
        raise ValueError("unknown mode or policy")
    found = _scoped(df, spec, list(entities) if entities else None, window)
    if mode != "history":
        publish = spec.role("publish_time")
        if policy == "publish" and publish is None and fallback != "allow":
            raise ValueError(f"{spec.name} has no publish time")
        by_publish = policy == "publish" and publish is not None
        clock = publish if by_publish else "knowledge_time"
        found = found.where(F.col(clock) <= _moment(at))
        found = first_by(found, spec.business_key, [F.desc(publish), F.desc("version")] if by_publish else [F.desc("version"), F.desc("knowledge_time")])
    for clause in filters:
        found = found.where(predicate(*clause))
    return project(found, spec, fields, include_meta, always=("knowledge_time", "version") if mode == "history" else ())


def project(df: DataFrame, spec: PitSpec, fields: Sequence[str] | None, include_meta: bool, always: Sequence[str] = ()) -> DataFrame:
    wanted = list(dict.fromkeys(fields if fields is not None else df.columns))
    kept = [c for c in wanted if include_meta or c not in META] + [c for c in always if include_meta is False or c not in wanted]
    kept = list(dict.fromkeys(kept))
    if not kept:
        raise ValueError("nothing to select")
    return df.select(*kept)


def predicate(name: str, op: str, value: Any = None) -> Column:
    """One of nine filters; eq and ne with None test for null, is_null with False for the opposite."""
    c = F.col(name)
    if op in ("eq", "ne") and value is None:
        return c.isNull() if op == "eq" else c.isNotNull()
    if op == "in" and not value:
        raise ValueError("in needs values")
    if op not in (made := {
        "eq": lambda: c == value, "ne": lambda: c != value, "in": lambda: c.isin(list(value)), "between": lambda: c.between(*value), "gt": lambda: c > value, "gte": lambda: c >= value,
        "lt": lambda: c < value, "lte": lambda: c <= value, "is_null": lambda: c.isNotNull() if value is False else c.isNull(),
    }):
        raise ValueError(f"unknown filter {op}")
    return made[op]()


def ordering(spec: PitSpec, names: Sequence[str] = ()) -> list[tuple[str, bool]]:
    """(column, descending) of order names (- for descending), then the business key's other columns."""
    given = [(n.lstrip("-"), n.startswith("-")) for n in names]
    return given + [(k, False) for k in spec.business_key if k not in {n for n, _ in given}]


def ordered(df: DataFrame, spec: PitSpec, names: Sequence[str] = (), limit: int = 1000) -> DataFrame:
    """The first ``limit`` (at most 50,000) rows in order."""
    return _sorted(df, spec, names).limit(min(limit, MOST_ROWS))


def _sorted(df: DataFrame, spec: PitSpec, names: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.desc(n) if down else F.asc(n) for n, down in ordering(spec, names)])


def page(df: DataFrame, spec: PitSpec, after: Sequence[Any], names: Sequence[str] = (), limit: int = 1000) -> DataFrame:
    """The rows strictly after key values ``after`` in order; one more than ``limit`` (at most 50,000), to show whether more follow."""
    order = ordering(spec, names)
    if len(after) != len(order) or any(v is None for v in after):
        raise ValueError("a page needs a value for each key")
    past = []
    for n, ((name, down), value) in enumerate(zip(order, after, strict=True)):
        same = [F.col(m) == v for (m, _), v in zip(order[:n], after[:n], strict=True)]
        past.append(reduce(Column.__and__, [*same, F.col(name) < value if down else F.col(name) > value]))
    return _sorted(df.where(reduce(Column.__or__, past)), spec, names).limit(min(limit, MOST_ROWS) + 1)


def versions(df: DataFrame, spec: PitSpec, fields: Sequence[str], mode: str = "history", at: Any = None, entities: Iterable | None = None, window: tuple | None = None) -> DataFrame:
    """All versions (history), or each key's first report (vintage), with audit columns."""
    seen = _scoped(df if at is None else df.where(F.col("knowledge_time") <= _moment(at)), spec, entities, window)
    if mode == "vintage":
        seen = first_by(seen, spec.business_key, [F.asc("knowledge_time"), F.asc("version")])
    elif mode != "history":
        raise ValueError("unknown mode")
    audit = [c for c in ("knowledge_time", "version", "ingest_time", "publish_time") if c in df.columns]
    return seen.select(*dict.fromkeys((*spec.business_key, *audit, *fields)))


def version_token(marks: DataFrame, runs: DataFrame, data: DataFrame) -> DataFrame:
    """One row: the latest watermark or successful run, or without either the latest knowledge."""
    a = marks.agg(F.max("watermark_time").alias("a")).crossJoin(runs.where("status = 'success'").agg(F.max("finished_at").alias("b"))).crossJoin(data.agg(F.max("knowledge_time").alias("c")))
    return a.select(F.coalesce(F.greatest("a", "b"), "c").alias("token"))
