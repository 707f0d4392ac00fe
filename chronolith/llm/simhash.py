"""SimHash near-duplicates, searched with pivot distance tables.

Fingerprints that differ in at most r bits agree on at least two of r + 2 bit blocks (pigeonhole), so distinct fingerprints
are dealt to buckets by pairs (or, for larger tables, larger sets) of blocks.  In a bucket a pivot table holds the Hamming
distance of each fingerprint to many reference fingerprints.  By the triangle inequality a pair whose table rows differ by
more than r in any coordinate cannot link; the survivors are verified on the fingerprints themselves.  A bucket gives only
a spanning forest of its links; a crowded one is first dealt further, by sets of blocks of the bits that it leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import ROW_KEY, checkpointed, drop_rows, text_or_empty, with_row_key
from chronolith.llm.graph import connected_components

SEED = 42
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 16, dtype=np.uint64)
SMALL_GROUP = 16
#: Open bits under which a bucket is never dealt further.
FEW_BITS = 15


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every word shingle of a UTF-8 text, repeats included; a text of fewer words is one shingle."""
    tokens = text.lower().split()  # bytes: A-Z, and the six ASCII white-space characters
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    spans = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=np.uint64)


def simhash(text: bytes, words: int) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is in more than half of the shingles' hashes."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(64, np.int64)
    for part in np.split(hashes, range(65536, len(hashes), 65536)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, fp long) of every row; a text of fewer words is one shingle, an empty or null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t.as_buffer().to_pybytes(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def bucket_masks(bits: int, count: int, agreed: int = 0) -> list[int]:
    """Masks that hold ``agreed`` and a set of blocks of the other bits, on one of which any pair within ``bits`` agrees.

    The open bits are cut into bits + j blocks, of which j must agree.  j, from 2 (a single block is too short a key) to 4,
    weighs the number of keys of each fingerprint against the unrelated ones that ``count`` bring into a bucket.
    """
    open_, options = [b for b in range(64) if not agreed >> b & 1], []
    for same in range(2, 5):
        blocks = bits + same
        edges = [len(open_) * i // blocks for i in range(blocks + 1)]
        masks = [sum(1 << b for b in open_[edges[i] : edges[i + 1]]) for i in range(blocks)]
        keys = [agreed | sum(group) for group in combinations(masks, same)]
        options.append((len(keys) * (8 + count / 2 ** (len(open_) * same // blocks)), same, keys))
    return min(options)[2]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _survivors(fp: np.ndarray, pivots: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate pairs (i, j), those that the pivot table cannot discard and that verify."""
    for coordinate in pivots:
        near = np.abs(coordinate[i] - coordinate[j]) <= bits
        i, j = i[near], j[near]
    near = np.bitwise_count(fp[i] ^ fp[j]) <= bits
    return i[near], j[near]


def link_forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (i, j) of the links among distinct fingerprints of one bucket.

    Breadth first: a fingerprint that has been reached is compared with those that have not, so a dense group costs
    little more than its size.
    """
    pivots = np.bitwise_count(fp[None, :] ^ PIVOTS[:, None]).astype(np.int8)
    rest, links = np.arange(len(fp)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            _, reached = _survivors(fp, pivots, np.full(len(rest), node), rest, bits)
            if len(reached):
                links.append((np.full(len(reached), node), reached))
                queue.extend(reached.tolist())
                rest = np.setdiff1d(rest, reached, assume_unique=True)
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*links, strict=True)) if links else (none, none)


def link_buckets(bits: int, crowded: int):
    """Task over rows (mask, key, fp) that are sorted by (mask, key): links (u, v), or (fp, null, mask) for a crowded bucket.

    A bucket of few open bits is compared whatever its size, which those bits bound.
    """
    few = lambda mask: 64 - (int(mask) & (2**64 - 1)).bit_count() <= FEW_BITS

    def links(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
        new = (frame["mask"].diff() != 0) | (frame["key"].diff() != 0)
        starts = np.flatnonzero(new.to_numpy())
        sizes = np.diff(np.append(starts, len(fp)))
        group = np.repeat(np.arange(len(starts)), sizes)
        pivots = np.bitwise_count(fp[None, :] ^ PIVOTS[:, None]).astype(np.int8)
        small = sizes[group] <= SMALL_GROUP
        for step in range(1, min(SMALL_GROUP, sizes.max(initial=0))):
            i = np.flatnonzero((group[:-step] == group[step:]) & small[:-step])
            i, j = _survivors(fp, pivots, i, i + step, bits)
            if len(i):
                yield linked(fp[i], fp[j])
        for g in np.flatnonzero(sizes > SMALL_GROUP):
            own = fp[starts[g] : starts[g] + sizes[g]]
            i, j = link_forest(own, bits)
            yield linked(own[i], own[j])

    def linked(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64), "mask": np.zeros(len(u), np.int64)})

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"u": rows["fp"], "v": pd.array([None] * len(rows), dtype="Int64"), "mask": rows["mask"]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, full = None, None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if full is not None:  # the rest of a crowded bucket
                same = (frame["mask"] == full[0]) & (frame["key"] == full[1])
                yield alone(frame[same])
                frame = frame[~same].reset_index(drop=True)
            if not len(frame):
                held = None
                continue
            last = frame.iloc[-1]
            open_ = (frame["mask"] == last["mask"]) & (frame["key"] == last["key"])
            held, full = frame[open_].reset_index(drop=True), None
            yield from links(frame[~open_].reset_index(drop=True))
            if len(held) > crowded and not few(last["mask"]):
                yield alone(held)
                held, full = None, (last["mask"], last["key"])
        if held is not None:
            yield from links(held)

    return run


def near_links(distinct: DataFrame, bits: int = 4, crowded: int = 20_000) -> DataFrame:
    """Links (u, v) between distinct ``fp`` that join exactly what pairs within ``bits`` differing bits join.

    A bucket of more than ``crowded`` fingerprints is dealt again by block sets of the bits that its mask leaves open, and
    so on; each round agrees on a third or more of them, so few rounds suffice.  Nothing is lost: pigeonhole holds each time.
    """
    rows, options, found = distinct.select("fp", F.lit(0).cast("long").alias("from")), {0: bucket_masks(bits, distinct.count())}, None
    while options:
        next_masks = F.lit(None).cast("array<bigint>")
        for agreed, masks in options.items():
            next_masks = F.when(F.col("from") == _signed(agreed), F.lit([_signed(m) for m in masks]).cast("array<bigint>")).otherwise(next_masks)
        dealt = rows.select("fp", F.explode(next_masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        dealt = dealt.select("mask", "key", "fp").distinct().repartition("mask", "key").sortWithinPartitions("mask", "key")
        met = checkpointed(dealt.mapInPandas(link_buckets(bits, crowded), "u long, v long, mask long").distinct())
        links = met.where("v IS NOT NULL").select("u", "v")
        found = links if found is None else found.union(links)
        rows = met.where("v IS NULL").select(F.col("u").alias("fp"), F.col("mask").alias("from"))
        # as many masks at most as there are block sets, whatever the data
        options = {r[0] & (2**64 - 1): bucket_masks(bits, r[1], r[0] & (2**64 - 1)) for r in rows.groupBy("from").count().collect()}
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 4, crowded: int = 20_000) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Null and empty texts have fingerprint 0 and link like any other.  Null ids never become a component's id unless it
    has no other.  Repeated rows share their component; an empty table gives no rows; other columns are ignored.
    """
    table = checkpointed(fingerprints(docs, id_col, text_col, words))
    distinct = checkpointed(table.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(near_links(distinct.select("fp"), bits, crowded)).withColumnRenamed("node", "fp")
    rooted = checkpointed(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    # written, so that the join below reads it through a shuffle of its own and AQE can split a component of many fingerprints
    least = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = rooted.join(least, "root").select("fp", "component_id")
    return table.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, bits: int = 4) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest id (null ids last), ties the first row.

    ``docs`` is read twice and must give the same partitions both times, as files and checkpoints do.
    """
    keyed = with_row_key(docs, id_col)
    found = near_duplicates(keyed, ROW_KEY, text_col, words, bits)
    return drop_rows(keyed, found.where(F.col(ROW_KEY) != F.col("component_id")))
