"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every block of rows sends the sorted distinct 64-bit fingerprints of its texts, Rice-coded (a Golomb code with a power
of two), to the owners of hash ranges.  An owner sees which fingerprints more than one block holds and answers each block
with a bitmap.  Only texts under a fingerprint that repeats (suspects) are then shuffled, and compared byte for byte.
So a unique text costs some bits of network, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import ROW_KEY, broadcast_within, checkpointed, drop_rows, text_or_empty, with_row_key

MESSAGE = "block long, owner long, n long, k int, quotients binary, remainders binary"
REPLY = "block long, owner long, bitmap binary"


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rice code of ascending uint64 values: (remainder bits, unary quotients of the gaps, packed remainders)."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = min(63, max(0, int(np.log2(max(1.0, float(values[-1]) / len(values) * np.log(2))))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.ones(ends[-1], dtype=np.uint8)
    unary[ends - 1] = 0
    low = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(low.astype(np.uint8).ravel()).tobytes()


def rice_decode(n: int, k: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    """The ``n`` values that :func:`rice_encode` packed."""
    if not n:
        return np.empty(0, dtype=np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)) == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        gaps |= (low << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _by_owner(hashes: np.ndarray, owners: int) -> Iterator[tuple[int, np.ndarray]]:
    """Distinct sorted hashes, cut into the owners' ranges of the top 32 bits."""
    distinct = np.unique(hashes.view(np.uint64))
    owner = ((distinct >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(owner, prepend=np.uint64(owners)))
    for part in np.split(np.arange(len(distinct)), starts[1:]) if len(distinct) else []:
        yield int(owner[part[0]]), distinct[part]


def repeated_fingerprints(fingerprints: DataFrame, owners: int | None = None) -> DataFrame:
    """Distinct ``fp`` that occur more than once in ``fingerprints`` (block long, fp long).

    A block's rows must fit a task's memory (16 bytes a row).  ``owners``: hash ranges, by default one for each
    4 million rows and at least as many as shuffle partitions, so an owner's group has a bounded size.
    """
    spark = fingerprints.sparkSession
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-fingerprints.count() // 4_000_000))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for frame in frames:
            for block, rows in frame.groupby("block"):
                held.setdefault(block, []).append(np.unique(rows["fp"].to_numpy(np.int64)))
        for block, parts in held.items():
            out = [(block, owner, len(v), *rice_encode(v)) for owner, v in _by_owner(np.concatenate(parts), owners)]
            yield pd.DataFrame(out, columns=["block", "owner", "n", "k", "quotients", "remainders"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        sent = [rice_decode(*row) for row in zip(frame["n"], frame["k"], frame["quotients"], frame["remainders"], strict=True)]
        values, counts = np.unique(np.concatenate(sent), return_counts=True)
        shared = values[counts > 1]
        bitmaps = [np.packbits(np.isin(v, shared, assume_unique=True)).tobytes() for v in sent]
        return pd.DataFrame({"block": frame["block"], "owner": frame["owner"], "bitmap": bitmaps})

    def mark(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(rows["fp"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        bitmap = dict(zip(replies["owner"], replies["bitmap"], strict=True))
        shared = [v[np.unpackbits(np.frombuffer(bitmap[o], np.uint8), count=len(v)).astype(bool)] for o, v in _by_owner(values, owners)]
        found = np.unique(np.concatenate([values[counts > 1], *shared]))
        return pd.DataFrame({"fp": found.view(np.int64)})

    messages = fingerprints.mapInPandas(send, MESSAGE)
    replies = messages.groupBy("owner").applyInPandas(answer, REPLY)
    marked = fingerprints.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(mark, "fp long")
    return marked.distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty.  Of equal texts the largest id stays.  Null ids
    lose against any other id; where all ids of a group are null, keep_id is null and its rows count as kept.  Rows that
    repeat the winning id all carry ``kept``.  An empty table gives an empty result; other columns are ignored.
    ``broadcast_rows`` bounds the set of repeated fingerprints that is broadcast; beyond it the semi join shuffles.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    table = checkpointed(rows.select("id", F.xxhash64("text").alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha"), F.spark_partition_id().cast("long").alias("block")))
    repeated = checkpointed(repeated_fingerprints(table.select("block", "fp")))
    suspects = rows.withColumn("fp", F.xxhash64("text")).join(broadcast_within(repeated, broadcast_rows), "fp", "left_semi")
    # grouping by the text itself compares bytes; copies within a partition meet before the shuffle
    groups = suspects.groupBy("text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("size"))
    groups = groups.select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "size", F.lit(True).alias("grouped"))
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("id"))
    return table.join(groups, "sha", "left").select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts (see :func:`exact_duplicates`): that of the largest
    id, ties the last row; rows of null ids lose against others.

    ``docs`` is read several times and must give the same partitions each time, as files and checkpoints do.
    """
    keyed = with_row_key(docs, id_col)
    largest = keyed.withColumn(ROW_KEY, F.struct((~F.col(f"{ROW_KEY}.none")).alias("some"), F.col(f"{ROW_KEY}.id").alias("id"), F.col(f"{ROW_KEY}.place").alias("place")))
    return drop_rows(keyed, exact_duplicates(largest, ROW_KEY, text_col).where(~F.col("kept")))
