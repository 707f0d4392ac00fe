"""Dataset contracts: fields with roles, keys, and what may be done with them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Classes of datasets, roles of fields, and columns that reads hide.
PIT_CLASSES = ("market", "versioned", "snapshot", "scd2")
ROLES = ("event_time", "publish_time", "knowledge_time", "ingest_time", "none")
META = ("knowledge_time", "publish_time", "version", "provider", "ingest_time")


@dataclass(frozen=True)
class Field:
    name: str
    type: T.DataType
    role: str = "none"
    nullable: bool = True
    enum: tuple[str, ...] = ()
    unit: str | None = None


@dataclass(frozen=True)
class PitSpec:
    """Contract of a dataset.  ``adjust``: price fields that a factor dataset adjusts, and the default mode."""

    name: str
    pit_class: str
    business_key: tuple[str, ...]
    fields: tuple[Field, ...]
    adjustable: tuple[str, ...] = ()
    default_adjust: str = "none"
    modes: tuple[str, ...] = field(default=())

    def validate(self) -> PitSpec:
        names = [f.name for f in self.fields]
        if self.pit_class not in PIT_CLASSES or any(f.role not in ROLES for f in self.fields):
            raise ValueError(f"{self.name}: unknown class or role")
        if len(set(names)) != len(names) or not set(self.business_key) <= set(names) or not self.business_key:
            raise ValueError(f"{self.name}: fields must be distinct and hold the business key")
        if self.pit_class != "scd2" and not {"knowledge_time", "version"} <= set(names):
            raise ValueError(f"{self.name}: knowledge_time and version are needed")
        return self

    @property
    def physical_key(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.business_key, "knowledge_time", "version")))

    def role(self, role: str) -> str | None:
        return next((f.name for f in self.fields if f.role == role), None)

    @property
    def schema(self) -> T.StructType:
        meta = lambda f: {"pit_role": f.role, "unit": f.unit, "enum": list(f.enum)}
        return T.StructType([T.StructField(f.name, f.type, f.nullable, meta(f)) for f in self.fields])


def _fields(*rows: tuple) -> tuple[Field, ...]:
    return tuple(Field(*r) for r in rows)


DAY, LONG, DOUBLE, TEXT, TIME, FLAG = T.DateType(), T.LongType(), T.DoubleType(), T.StringType(), T.TimestampNTZType(), T.BooleanType()
AUDIT = (("knowledge_time", TIME, "knowledge_time"), ("publish_time", TIME, "publish_time"), ("version", LONG), ("provider", TEXT))
BAR = PitSpec(
    "bar", "market", ("entity_id", "trade_date"),
    _fields(("entity_id", LONG), ("trade_date", DAY, "event_time"), *[(f, DOUBLE) for f in ("open", "high", "low", "close", "volume", "amount")], *AUDIT),
    ("open", "high", "low", "close"), "hfq", ("none", "qfq", "hfq"),
).validate()
FACTOR = PitSpec("factor", "market", ("entity_id", "trade_date"), _fields(("entity_id", LONG), ("trade_date", DAY, "event_time"), ("adj_factor", DOUBLE), ("knowledge_time", TIME, "knowledge_time"), ("version", LONG))).validate()
STATUS = PitSpec("status", "market", ("entity_id", "trade_date"), _fields(("entity_id", LONG), ("trade_date", DAY, "event_time"), ("is_suspended", FLAG), ("is_st", FLAG), ("knowledge_time", TIME, "knowledge_time"), ("version", LONG))).validate()
CALENDAR = PitSpec("calendar", "market", ("exchange_id", "trade_date"), _fields(("exchange_id", TEXT), ("trade_date", DAY, "event_time"), ("is_open", FLAG), ("knowledge_time", TIME, "knowledge_time"), ("version", LONG))).validate()
LINE = PitSpec("line", "versioned", ("l_orderkey", "l_linenumber"), _fields(("l_orderkey", LONG), ("l_linenumber", T.IntegerType()), ("l_partkey", LONG), ("l_suppkey", LONG), ("l_quantity", DOUBLE), ("l_extendedprice", DOUBLE), ("l_returnflag", TEXT), ("event_time", TIME, "event_time"), ("knowledge_time", TIME, "knowledge_time"), ("version", LONG))).validate()
ORDERS = PitSpec("orders", "versioned", ("o_custkey", "o_orderpriority"), _fields(("o_custkey", LONG), ("o_orderpriority", TEXT), ("o_orderkey", LONG), ("o_totalprice", DOUBLE), ("knowledge_time", TIME, "knowledge_time"), ("publish_time", TIME, "publish_time"), ("version", LONG))).validate()
