"""Incremental restatement as a stream: each micro-batch goes through the batch merge, or meets state, and the idempotent append."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolith.operators.ingest import first_known, restate
from chronolith.operators.pit import first_by
from chronolith.sources.sinks import append_rows, beside, read_table
from chronolith.sources.store import delete

#: Relative and absolute tolerances of the tests that :func:`restate` knows by name.
TOLERANCES = {"bar": (1e-9, 1e-6), "factor": (0.0, 1e-9)}
PROVIDER, BATCH_BYTES = "spark.sql.streaming.stateStore.providerClass", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Buckets of a day's keys in state (a checkpoint is bound to them), bytes of rows that a task packs at once.
BUCKETS, CHUNK = 64, 16 << 20


def stream_restate(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, keys: Sequence[str], same: dict[str, str], now, day: str = "trade_date") -> int:
    """Take all new files of ``source`` into the version table at ``table``; gives the batches run.

    foreachBatch is at least once: a batch that is run again finds its physical keys there and appends nothing.  Versions are
    numbered from what the table holds on the days that the batch speaks of, and ``now`` is given, so a replay makes the same rows.  Repeated keys of a batch keep one row.
    """
    ran = []

    def merge(batch: DataFrame, number: int) -> None:
        one = first_by(batch, keys, [F.col(c).asc_nulls_last() for c in batch.columns if c not in keys])
        current = read_table(spark, table)
        if current is None:  # the first batch makes the table
            current = one.limit(0).withColumns({"knowledge_time": F.lit(now).cast("timestamp_ntz"), "version": F.lit(0).cast("long")})
        else:
            current = beside(current, one, day)
        append_rows(restate(current, one, keys, same, now, day).drop("action"), table, [*keys, "knowledge_time", "version"], day)
        ran.append(number)

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()
    return len(ran)


def alike(a: pa.Array, b: pa.Array, test: str) -> np.ndarray:
    """Which pairs of values pass for one, as :func:`restate` tells; two nulls do, one does not, and NaN is the greatest number."""
    if test == "equal":
        near = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(a.type):
            near = near | pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
    else:
        rel, tol = TOLERANCES[test]
        x, y = (c.cast(pa.float64(), safe=False).fill_null(0.0).to_numpy(zero_copy_only=False) for c in (a, b))
        with np.errstate(invalid="ignore"):
            apart, most = np.abs(x - y), np.maximum(rel * np.maximum(np.abs(x), np.abs(y)), tol)
        if pa.types.is_integer(a.type):  # those that a double can't tell apart differ by 1 at least
            apart = np.maximum(apart, pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False))
        near = ~((apart > most) | (np.isnan(apart) & ~np.isnan(most)))
    none, gone = (c.is_null().to_numpy(zero_copy_only=False) for c in (a, b))
    return np.where(none | gone, none & gone, near)


def _codes(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """A number for each row, equal where the columns ``names`` are."""
    made = np.zeros(table.num_rows, np.int64)
    for n in names:
        values = table.column(n).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = np.asarray(values.indices, np.int64)
        made = np.unique(made * len(values.dictionary) + codes, return_inverse=True)[1] if made.any() else codes
    return made


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(rows: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(bytes(rows))) as stream:
        return stream.read_all()


def packed(df: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(``by``, __bucket, rows): the rows of a bucket of keys as Arrow streams, one of each bucket for each ``CHUNK`` bytes of a partition."""
    spread = [k for k in keys if k not in by] or list(keys)
    rows = df.withColumn("__bucket", F.pmod(F.hash(*spread), F.lit(BUCKETS)).cast("int"))

    def cut(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        codes = _codes(table, [*by, "__bucket"])
        order = np.argsort(codes, kind="stable")
        table, codes = table.take(pa.array(order)).combine_chunks(), codes[order]
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        body = table.drop_columns("__bucket")
        streams = [_written(body.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(codes)], strict=True)]
        named = table.select([*by, "__bucket"]).take(pa.array(starts))
        if streams:
            yield from named.append_column("rows", pa.array(streams, pa.binary())).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, size = [], 0
        for batch in batches:
            taken.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                yield from cut(taken)
                taken, size = [], 0
        if taken:
            yield from cut(taken)

    return rows.mapInArrow(run, T.StructType([*[df.schema[c] for c in by], T.StructField("__bucket", T.IntegerType()), T.StructField("rows", T.BinaryType())]))


def unpacked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of Arrow streams (column ``rows``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                yield from _read(rows.as_py()).select(schema.names).to_batches()

    return df.select("rows").mapInArrow(run, schema)


class LatestVersions(StatefulProcessor):
    """Holds the latest version of each key of a bucket and its values, as one Arrow stream; gives the rows where a later delivery differs.

    A key's rows of one batch are one delivery: the first of them in order of the values, nulls last, counts.
    """

    def __init__(self, keys: Sequence[str], same: dict[str, str]):
        self.keys, self.same = list(keys), same

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", T.StructType([T.StructField("rows", T.BinaryType())]))

    def _held(self) -> pa.Table | None:
        return _read(self.latest.get()[0]) if self.latest.exists() else None

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802
        came = pa.concat_tables([_read(r.rows) for r in rows]).select([*self.keys, *self.same]).combine_chunks()
        held = self._held()
        held = came.slice(0, 0).append_column("version", pa.array([], pa.int64())) if held is None else held
        held = held.select([*came.column_names, "version"]).cast(came.schema.append(pa.field("version", pa.int64())))
        codes = _codes(pa.concat_tables([held.select(self.keys), came.select(self.keys)]), self.keys)
        old, new = codes[: held.num_rows], codes[held.num_rows :]
        if len(np.unique(new)) < len(new):
            order = np.asarray(pc.sort_indices(came, sort_keys=[(f, "ascending") for f in self.same], null_placement="at_end"))
            first = order[np.unique(new[order], return_index=True)[1]]
            came, new = came.take(pa.array(first)), new[first]
        at = np.full(codes.max() + 1, -1)
        at[old] = np.arange(len(old))
        place = at[new]  # of a key among those held, or -1
        known = np.flatnonzero(place >= 0)
        after, before = came.take(pa.array(known)).combine_chunks(), held.take(pa.array(place[known])).combine_chunks()
        alike_all = np.ones(len(known), bool)
        for f, test in self.same.items():
            alike_all &= alike(after.column(f).combine_chunks(), before.column(f).combine_chunks(), test)
        differs = place < 0
        differs[known] = ~alike_all
        if not differs.any():
            return
        version = np.ones(len(new), np.int64)
        version[known] += np.asarray(before.column("version"))
        made = came.append_column("version", pa.array(version)).filter(pa.array(differs))
        stays = np.ones(len(old), bool)
        stays[place[differs & (place >= 0)]] = False
        self.latest.update((_written(pa.concat_tables([held.filter(pa.array(stays)), made]).combine_chunks()),))
        yield Row(rows=_written(made.append_column("fresh", pa.array(place[differs] < 0)).combine_chunks()))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: Any) -> None:  # noqa: N802
        held, more = self._held(), _read(initialState["rows"])
        self.latest.update((_written(more if held is None else pa.concat_tables([held, more]).combine_chunks()),))

    def close(self) -> None:
        pass


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a stream is run."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stream_restate_state(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, keys: Sequence[str], same: dict[str, str], now, day: str = "trade_date") -> int:
    """As :func:`stream_restate`, with the latest version of every key kept as state of the stream; gives the batches run.

    A checkpoint that is new takes its state from the table once; after that the table is read for physical keys alone,
    within the days of what is appended.  State and offsets are committed together, so a batch that was killed and is run again makes the same
    rows, and those already appended are skipped.  Rows for days long past meet their key's state like others and become new versions.
    The table must have no other writer while the checkpoint is in use.  Keys lie in ``BUCKETS`` buckets of each day; a bucket's latest
    versions are one value of the state, met by the batch's rows at once and written again if one of them changes, so a bucket must fit a task's memory.  State is
    in RocksDB on the executors and in the checkpoint's folder; its partitions are those of the first run.  A checkpoint whose state has a value
    for each key (as before there were buckets) can't be continued: name a new one once it has nothing left to take.
    """
    ran, types = [], T._parse_datatype_string(schema)
    kinds = {f.name: f.dataType for f in types.fields}
    by = [day] if day in keys else []
    out = T.StructType([*[T.StructField(f, kinds[f]) for f in (*keys, *same)], T.StructField("version", T.LongType()), T.StructField("fresh", T.BooleanType())])
    current = read_table(spark, table)
    first = None
    if current is not None:
        latest = first_by(current, keys, [F.desc("knowledge_time"), F.desc("version")]).select(*keys, *same, F.col("version").cast("long").alias("version"))
        # dealt by day and a part of its keys, so that a task packs whole buckets
        first = packed(latest.repartition(*by, F.pmod(F.hash(*([k for k in keys if k not in by] or keys)), F.lit(BUCKETS))), by, keys).groupBy(*by, "__bucket")

    def merge(batch: DataFrame, number: int) -> None:
        # state may be asked for once in a batch, so its rows are written before they are used
        staged = f"{table.rstrip('/')}.batch-{number}"
        stamp = F.when(F.col("fresh"), first_known(day)).otherwise(F.lit(now).cast("timestamp_ntz"))
        batch.withColumn("knowledge_time", stamp).select(*keys, *same, "knowledge_time", "version").write.mode("overwrite").parquet(staged)
        try:
            append_rows(spark.read.parquet(staged), table, [*keys, "knowledge_time", "version"], day)
        finally:
            delete(spark, staged)
        ran.append(number)

    rows = packed(spark.readStream.schema(schema).parquet(source).select(*keys, *same), by, keys).groupBy(*by, "__bucket")
    changed = rows.transformWithState(LatestVersions(keys, dict(same)), T.StructType([T.StructField("rows", T.BinaryType())]), "Append", "None", first)
    with _set(spark, {PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", BATCH_BYTES: str(CHUNK)}):
        unpacked(changed, out).writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(ran)
