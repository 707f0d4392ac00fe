"""Vendor tables to canonical form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import codes
from chronolith.operators.pit import first_by
from chronolith.plans.spec import PitSpec

#: Unit words of column headers, the first ending that fits.
UNITS = (("亿元", 1e8), ("万元", 1e4), ("千元", 1e3), ("元", 1.0), ("手", 100.0), ("股", 1.0))


def contract_scan(df: DataFrame, spec: PitSpec) -> DataFrame:
    """The table's columns as its contract declares them, in order; a missing one is an error."""
    missing = [f.name for f in spec.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{spec.name} lacks {missing}")
    return df.select(*[F.col(f.name).cast(f.type).alias(f.name) for f in spec.fields])


def cast(column: Column, kind: str, argument: object = None) -> Column:
    """A raw text or number as date (pattern), date_ms (UTC milliseconds to the day in Shanghai), code, float (factor), int, bool or str."""
    if kind == "date":
        return F.to_date(F.try_to_timestamp(column.cast("string"), F.lit(argument or "yyyyMMdd")))
    if kind == "date_ms":
        return F.to_date(F.from_utc_timestamp(F.timestamp_millis(column.cast("long")), "Asia/Shanghai"))
    if kind == "code":
        return codes.canonical(column)
    if kind == "float":
        number = column.try_cast("double")
        return F.when(~F.isnan(number), number * float(argument or 1.0))
    if kind == "int":
        return column.try_cast("long")
    if kind == "bool":
        return (F.coalesce(column.try_cast("double") != 0, F.lit(False))) | F.lower(F.trim(column.cast("string"))).isin("true", "t", "yes", "y")
    return column.cast("string")


def normalise(raw: DataFrame, spec: Sequence[tuple]) -> DataFrame:
    """``spec``: (name, source column, kind, argument, required).  A required column that is missing is an error, an optional one is null."""
    missing = [s[1] for s in spec if s[4] and s[1] not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return raw.select(*[(cast(F.col(source), kind, argument) if source in raw.columns else F.lit(None).cast("string")).alias(name) for name, source, kind, argument, _ in spec])


def finalise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The contract's columns in order, trade_date as a date, a null currency filled from the code's venue."""
    made = {"trade_date": lambda: F.to_date("trade_date"), "currency": lambda: F.coalesce(F.col("currency") if "currency" in df.columns else F.lit(None).cast("string"), codes.currency(F.col("code")))}
    return df.select(*[(made[c]() if c in made else F.col(c)).alias(c) for c in columns])


def merge_sources(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """All rows, of repeated keys that of the first source, and in a source the first by ``order``, then by the other
    columns; sorted by key."""
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("__p", F.lit(n)) for n, f in enumerate(frames)])
    rest = [F.col(c).asc_nulls_last() for c in tagged.columns if c not in (*keys, "__p")]
    return first_by(tagged, keys, [F.asc("__p"), *order, *rest]).drop("__p").orderBy(*keys)


def fill_fields(primary: DataFrame, fallbacks: Sequence[DataFrame], columns: Sequence[str], keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Columns that the primary has no value of at all are taken from the first fallback that has any, by key; of a
    fallback's repeated keys the first by ``order``, then by the values (nulls last).

    One aggregate per source tells which; its counts are all that reaches the driver.
    """
    empty = [c for c in columns if c not in primary.columns]
    counted = primary.agg(*[F.count(c).alias(c) for c in columns if c in primary.columns] or [F.lit(0)]).first().asDict()
    wanted = empty + [c for c in columns if c in primary.columns and not counted[c]]
    out = primary.drop(*wanted)
    for frame in fallbacks:
        have = [c for c in wanted if c in frame.columns]
        some = frame.agg(*[F.count(c).alias(c) for c in have] or [F.lit(0)]).first().asDict()
        taken = [c for c in have if some[c]]
        if taken:
            out = out.join(first_by(frame, keys, [*order, *[F.col(c).asc_nulls_last() for c in taken]]).select(*keys, *taken), list(keys), "left")
            wanted = [c for c in wanted if c not in taken]
    return out.withColumns({c: F.lit(None).cast("double") for c in wanted})


def melt(df: DataFrame, day: str, indicators: Sequence[str]) -> DataFrame:
    """(indicator, obs_date, value) of a wide table; a column without any value gives no rows, other nulls stay."""
    numbers = df.select(day, *[F.col(c).cast("string").try_cast("double").alias(c) for c in indicators])
    long = numbers.unpivot([day], list(indicators), "indicator", "value")
    some = long.groupBy("indicator").agg(F.count("value").alias("n")).where("n > 0")
    return long.join(some.select("indicator"), "indicator", "left_semi").select("indicator", F.col(day).alias("obs_date"), "value")


def scale_units(df: DataFrame, header: str, value: str) -> DataFrame:
    """(base, value): a header's unit in brackets is taken off, and its factor multiplied into the value."""
    pattern = r"^(.*?)[（(]单位[:：]\s*([^）)]+)[）)]\s*$"
    text = F.trim(F.col(header))
    unit = F.trim(F.regexp_extract(text, pattern, 2))
    factor = reduce(lambda w, u: w.when(unit.endswith(u[0]), u[1]), UNITS[1:], F.when(unit.endswith(UNITS[0][0]), UNITS[0][1])).otherwise(1.0)
    base = F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1))).otherwise(text)
    return df.select(*[c for c in df.columns if c not in (header, value)], base.alias("base"), (F.col(value) * factor).alias("value"))


def factor_window(events: DataFrame, start, end) -> DataFrame:
    """Factor events inside the window, and one row at its start with the last earlier factor (1 if none)."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = events.where(F.col("trade_date").between(a, b)).select("entity_id", "trade_date", "adj_factor")
    base = events.groupBy("entity_id").agg(F.max_by("adj_factor", F.when(F.col("trade_date") < a, F.col("trade_date"))).alias("f"), F.max(F.when(F.col("trade_date") == a, True)).alias("at_start"))
    return inside.unionByName(base.where("at_start IS NULL").select("entity_id", a.alias("trade_date"), F.coalesce("f", F.lit(1.0)).alias("adj_factor")))


def daily_return(df: DataFrame, value: str) -> DataFrame:
    """Percentage change from the row before, by entity in order of day."""
    before = F.lag(value).over(Window.partitionBy("entity_id").orderBy("trade_date"))
    return df.withColumn("daily_return", (F.col(value) / F.when(before != 0, before) - 1) * 100)


def seed_missing(reference: DataFrame, seed: DataFrame, keys: Sequence[str], required: Sequence[str], flags: Sequence[str] = (), dates: Sequence[str] = ()) -> DataFrame:
    """Seed rows (all texts) whose business key ``reference`` lacks.

    Empty required cells, repeated keys, flags other than 0 and 1, dates that are none (yyyy-MM-dd), or no rows at all are errors.
    """
    blank = reduce(Column.__or__, [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in required])
    wrong = reduce(Column.__or__, [~F.col(f).isin("0", "1") for f in flags], F.lit(False))
    undated = reduce(Column.__or__, [~F.coalesce(F.trim(d).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.trim(d).try_cast("date").isNotNull(), F.lit(False)) for d in dates], F.lit(False))
    row = seed.agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("blank"), F.count_if(wrong).alias("wrong"), F.count_if(undated).alias("undated")).first()
    twice = seed.groupBy(*keys).count().where("count > 1").limit(1).count()
    if not row.n or row.blank or row.wrong or row.undated or twice:
        raise ValueError(f"bad seed: {row.n} rows, {row.blank} with empty cells, {row.wrong} with bad flags, {row.undated} with bad dates, repeated keys: {bool(twice)}")
    return seed.join(reference.select(*keys), list(keys), "left_anti")


def explode_series(df: DataFrame, key: str, days: str, values: str) -> DataFrame:
    """Parallel arrays of days and values as rows; values that are no numbers become null."""
    pair = F.explode(F.arrays_zip(F.col(days).alias("d"), F.col(values).alias("v"))).alias("p")
    return df.select(key, pair).select(F.col(key).alias("indicator"), F.col("p.d").alias("obs_date"), F.col("p.v").try_cast("double").alias("value"))


def snapshot_filter(snapshot: DataFrame, wanted: DataFrame, symbol: str, names: Mapping[str, str], today) -> DataFrame:
    """Rows of a market-wide snapshot whose vendor symbol is wanted (symbol, code), renamed, with code and date."""
    joined = snapshot.withColumnRenamed(symbol, "__s").join(wanted.select(F.col("symbol").alias("__s"), "code").distinct(), "__s")
    return joined.select("code", F.lit(today).cast("date").alias("trade_date"), *[F.col(a).alias(b) for a, b in names.items()])


def security_info(frames: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """(code, name, venue, sec_type, list_date, list_status) of listing tables, each with its own status column; the first row of a code stays."""
    out = []
    for n, (df, status) in enumerate(frames):
        code = F.col("code")
        out.append(df.select(code, "name", codes.venue(code).alias("venue"), codes.security_type(code).alias("sec_type"), cast(F.col("list_date"), "date").alias("list_date"), F.col(status).alias("list_status"), F.lit(n).alias("__p")))
    return first_by(reduce(DataFrame.unionByName, out), ["code"], [F.asc("__p"), F.asc("name")]).drop("__p")
