"""Sinks: idempotent append, bulk export, partitioned and bucketed layouts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from chronolith.operators.ingest import new_rows
from chronolith.plans.spec import META, PitSpec
from chronolith.sources.store import claimed, delete


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster shares; a temporary one only in a local session that names none, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="chronolith-")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``; None if it is not there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def beside(table: DataFrame, batch: DataFrame, column: str) -> DataFrame:
    """Rows of ``table`` whose ``column`` lies within its range in ``batch``: files and row groups beyond it are not read.

    One aggregate row of the batch is read; rows of a null ``column`` stay.
    """
    low, high = batch.agg(F.min(column), F.max(column)).first()
    kind = batch.schema[column].dataType
    return table.where(F.col(column).isNull() if low is None else F.col(column).isNull() | F.col(column).between(F.lit(low).cast(kind), F.lit(high).cast(kind)))


def append_rows(batch: DataFrame, path: str, key: Sequence[str], event: str | None = None, wait: float = 600.0) -> int:
    """Append rows whose physical key is new to the Parquet table at ``path``; gives how many.

    Keys are read and rows written under a claim, so that of two writers of the same rows the second finds them.
    The new rows are written to a folder of their own first and moved in by a plain append, so the table is never read and
    written at once; that folder is deleted after.  ``event``: a key column by which only the part of the table that the
    batch can meet is read.
    """
    with claimed(batch.sparkSession, path, wait):
        return _append(batch, path, key, event)


def _append(batch: DataFrame, path: str, key: Sequence[str], event: str | None) -> int:
    spark = batch.sparkSession
    table = read_table(spark, path)
    table = batch.limit(0) if table is None else table if event is None else beside(table, batch, event)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    try:
        new_rows(table, batch, key).write.parquet(staged)
        fresh = spark.read.schema(batch.schema).parquet(staged)
        count = fresh.count()
        if count:
            fresh.write.mode("append").parquet(path)
    finally:
        delete(spark, staged)
    return count


def export_columns(df: DataFrame, spec: PitSpec, fields: Sequence[str] | None, mode: str) -> list[str]:
    """Requested columns that the table has; meta columns hidden, but history adds knowledge_time and version."""
    kept = [c for c in (fields or df.columns) if c in df.columns and c not in META]
    return [*kept, *(["knowledge_time", "version"] if mode == "history" else [])]


def export_parquet(df: DataFrame, spec: PitSpec, path: str, fields: Sequence[str] | None = None, mode: str = "latest") -> None:
    """Zstd Parquet with the contract's types (decimals as doubles), also where no row or no value is there."""
    types = {f.name: f.type for f in spec.fields}
    out = df.select(*[F.col(c).cast("double" if types[c].simpleString().startswith("decimal") else types[c]).alias(c) for c in export_columns(df, spec, fields, mode)])
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


def export_arrow(df: DataFrame, stream_bytes: int = 64_000_000) -> DataFrame:
    """(partition, number, n_rows, stream): each partition as Arrow IPC streams of about ``stream_bytes`` (one batch at
    least), for a binary sink or an HTTP body.  An empty partition gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, writer, rows, number = None, None, 0, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"partition": [TaskContext.get().partitionId()], "number": [number], "n_rows": [rows], "stream": [sink.getvalue().to_pybytes()]}, schema=pa.schema([("partition", pa.int32()), ("number", pa.int32()), ("n_rows", pa.int64()), ("stream", pa.binary())]))

        for batch in batches:
            if writer is None:
                sink = pa.BufferOutputStream()
                writer, rows = pa.ipc.new_stream(sink, batch.schema), 0
            writer.write_batch(batch)
            rows += batch.num_rows
            if sink.tell() >= stream_bytes:
                yield closed()
                writer, number = None, number + 1
        if writer is not None:
            yield closed()

    return df.mapInArrow(run, "partition int, number int, n_rows long, stream binary")


def read_arrow(streams: DataFrame, schema: str) -> DataFrame:
    """The rows of Arrow IPC streams (column ``stream``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column("stream"):
                with pa.ipc.open_stream(stream.as_buffer()) as reader:
                    yield from reader

    return streams.select("stream").mapInArrow(run, schema)


def _month_of(spec: PitSpec) -> str | None:
    """The time whose months a dataset is laid out by: that of knowledge for versioned datasets, none for intervals, else the event's."""
    return {"versioned": "knowledge_time", "scd2": None}.get(spec.pit_class, spec.role("event_time"))


def _order_of(df: DataFrame, spec: PitSpec) -> list[str]:
    return [*spec.business_key, *[c for c in ("knowledge_time", "version") if c in df.columns and c not in spec.business_key]]


def write_partitioned(df: DataFrame, spec: PitSpec, path: str) -> None:
    """Parquet by month of the event (versioned datasets: of knowledge; intervals: none), sorted by entity and time within files."""
    time, order = _month_of(spec), _order_of(df, spec)
    if time is None:
        df.repartition(spec.business_key[0]).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
        return
    # a month is dealt over several tasks by key, so that a large one does not wait on a single writer
    dealt = df.withColumn("month", F.date_format(time, "yyyy-MM")).repartition("month", F.pmod(F.hash(spec.business_key[0]), F.lit(8)))
    dealt.sortWithinPartitions("month", *order).write.mode("overwrite").partitionBy("month").parquet(path)


def _bucketed(df: DataFrame, spec: PitSpec, buckets: int, by_month: bool) -> DataFrameWriter:
    time, order = _month_of(spec) if by_month else None, _order_of(df, spec)
    rows = df if time is None else df.withColumn("month", F.date_format(time, "yyyy-MM"))
    months = [] if time is None else ["month"]
    # dealt as buckets are, so that a bucket is one file (of each month)
    dealt = rows.repartition(buckets, order[0]).sortWithinPartitions(*months, *order)
    writer = dealt.write.format("parquet").bucketBy(buckets, order[0]).sortBy(*order)
    return writer.partitionBy(*months) if months else writer


def write_bucketed(df: DataFrame, spec: PitSpec, name: str, buckets: int, by_month: bool = False) -> None:
    """A table in the catalog, in ``buckets`` by the first column of the business key, sorted by key and time.

    What groups, ranks or joins such tables by that column (as-of reads, adjustment, windows by entity) needs no shuffle, if they
    have one number of buckets and are read by :func:`read_bucketed`.  ``by_month`` adds folders by month as :func:`write_partitioned` does, so that windows of time
    prune files too.  Take about 1 GB of text or less for a bucket: a bucket is a task, and an entity is in one bucket;
    for an entity that is too large for that, write without buckets and read in spans.
    """
    _bucketed(df, spec, buckets, by_month).mode("overwrite").saveAsTable(name)


def read_bucketed(spark: SparkSession, *names: str) -> list[DataFrame]:
    """Bucketed tables, in a session of their own that is set as ``spark`` is, but that lets a join on (entity, day) use buckets by entity.

    Spark by itself deals such a join anew by both columns, against entities that are too large for a bucket; who reads by
    buckets has settled that.  Tables that are to be joined must be read in one call.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return [session.table(name) for name in names]


def append_bucketed(batch: DataFrame, spec: PitSpec, name: str, buckets: int, by_month: bool = False) -> int:
    """Append rows whose physical key (business key, knowledge_time, version) the bucketed table lacks; gives how many.

    The table's layout must be given as it was written.  Its keys are read without a shuffle, under a claim; each append adds a file to the buckets it meets.
    """
    spark, key = batch.sparkSession, _order_of(batch, spec)
    where = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first().data_type
    with claimed(spark, where):
        staged = f"{where.rstrip('/')}.staged-{uuid.uuid4().hex}"
        try:
            new_rows(spark.table(name), batch, key).write.parquet(staged)
            fresh = spark.read.schema(batch.schema).parquet(staged)
            count = fresh.count()
            if count:
                _bucketed(fresh, spec, buckets, by_month).mode("append").saveAsTable(name)
        finally:
            delete(spark, staged)
    return count
