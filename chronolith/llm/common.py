"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    Nothing else cuts lineage here, so lost executors cost no more than their own tasks.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``, or the one that was set by hand.

    Only a local session may go without: it gets a temporary one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is (the join then shuffles).

    ``df`` should be cheap to count: checkpointed, or a small aggregate.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (a null id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Column of a row's key: (id is null, id, place), so that keys are distinct and their smallest is that of the smallest id.
ROW_KEY = "__row_key"


def with_row_key(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with a distinct key of each row; the same keys come again if the same partitions do."""
    return docs.withColumn(ROW_KEY, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("place")))


def drop_rows(keyed: DataFrame, gone: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Rows of ``keyed`` (see :func:`with_row_key`) whose key ``gone`` does not hold, without the key.

    An anti join: the keys that go are broadcast only if they are counted to at most ``max_rows``.
    """
    gone = checkpointed(gone.select(F.col(f"{ROW_KEY}.place").alias("place")))
    kept = keyed.join(broadcast_within(gone, max_rows), keyed[ROW_KEY]["place"] == gone["place"], "left_anti")
    return kept.drop(ROW_KEY)


def text_runs(batches: Iterator[pa.RecordBatch], column: str = "text", run_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about ``run_bytes`` of text (one row at least), to bound what a task holds."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // run_bytes)) + 1), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield batch.slice(a, b - a)
    hand_back()


def hand_back() -> None:
    """Give free memory that Arrow and the C library keep back to the system, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)
