"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands propose pairs, shingle sets decide.

A document's signature is 40 bands of 6 MinHashes.  Two sets of similarity 0.8 agree on a whole band with probability
1 - (1 - 0.8 ** 6) ** 40, which misses 5 in a million such pairs, and fewer at higher similarity.  Sets that share a band
are compared with the band's smallest first; only sets that this leaves in different components are then compared with each
other, inside tasks, by parts of a bucket.  A pair first passes one byte of each of its 240 MinHashes (bounded loss: see
``LEAST_EQUAL``), then its exact sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import ROW_KEY, broadcast_within, checkpointed, drop_rows, text_or_empty, text_runs, with_row_key
from chronolith.llm.graph import connected_components
from chronolith.llm.simhash import SEED, shingle_hashes

BANDS, ROWS = 40, 6
_RNG = np.random.default_rng(80)
FLIP = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
FACTOR = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Least equal bytes of 240: similarity 0.8 gives 192 on average with a deviation of 6.2, so this is 6.8 deviations below.
LEAST_EQUAL = 150
#: Similarity at which documents link, as a fraction of whole numbers.
OVER, UNDER = 4, 5
#: Rows of a band's bucket that a task compares with each other, or with as many others.
PART, PART_SHINGLES = 4096, 2_000_000
#: Text of the rows that a task holds shingle sets of at once.
RUN_BYTES = 1_000_000


def signature(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Band keys and one byte of each MinHash of a set; an empty set has none."""
    if not len(shingles):
        return np.empty(0, np.int64), b""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        mixed = (shingles[None, at : at + 1024] ^ FLIP[:, None]) * FACTOR[:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64), least.astype(np.uint8).tobytes()


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    for text in batch.column("text"):
        yield np.unique(shingle_hashes(text.as_buffer().to_pybytes(), words))


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)).view(np.int64))


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, node, size, keys, bytes) of every row; node is the XXH64 of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, run_bytes=RUN_BYTES):
            nodes, sizes, keys, low = [], [], [], []
            for shingles in _sets(batch, words):
                own, least = signature(shingles)
                nodes.append(_node(shingles))
                sizes.append(len(shingles))
                keys.append(own)
                low.append(least)
            columns = [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "size", "keys", "bytes"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, node long, size int, keys array<bigint>, bytes binary")


def shingle_sets(docs: DataFrame, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles array) of the ``wanted`` nodes, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_runs(batches, run_bytes=RUN_BYTES):
            found = list(_sets(batch, words))
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["node", "shingles"])

    rows = docs.select(text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(run, "node long, shingles array<bigint>")
    return rows.join(broadcast_within(wanted, 1_000_000), "node", "left_semi").dropDuplicates(["node"])


def _joined(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The ``pairs`` (u, v) with their values x and y of ``column``."""
    one = table.select(F.col("node").alias("u"), F.col(column).alias("x"))
    two = table.select(F.col("node").alias("v"), F.col(column).alias("y"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "x", "y")


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of rows (u, v, x, y) whose MinHash bytes x and y agree often enough."""
    for batch in batches:
        both = zip(batch.column("x"), batch.column("y"), strict=True)
        equal = [np.count_nonzero(np.frombuffer(x.as_buffer(), np.uint8) == np.frombuffer(y.as_buffer(), np.uint8)) for x, y in both]
        yield batch.select(["u", "v"]).filter(pa.array(np.array(equal, np.int64) >= LEAST_EQUAL))


def _compare(part: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, low: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links (u, v) of a group that join what its similar pairs join: of different components, of sizes that similarity 0.8
    allows, and, in a group of two parts, across them.  A pair that earlier links join is not looked at again."""
    order = np.argsort(size, kind="stable")
    part, node, size, root, low = part[order], node[order], size[order], root[order], low[order]
    across, ends = len(np.unique(part)) > 1, np.searchsorted(size, size * UNDER // OVER, side="right")
    _, label = np.unique(root, return_inverse=True)
    u, v = [], []
    for i in range(len(node) - 1):
        rest = slice(i + 1, ends[i])
        other = i + 1 + np.flatnonzero((label[rest] != label[i]) & ((part[rest] != part[i]) | (not across)))
        own = sets[order[i]]
        for j in other[(low[other] == low[i]).sum(axis=1) >= LEAST_EQUAL].tolist():
            if label[j] == label[i]:
                continue
            theirs = sets[order[j]]
            both = np.count_nonzero(theirs[np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)] == own)
            if both * UNDER >= (len(own) + len(theirs) - both) * OVER:
                u.append(int(node[i]))
                v.append(int(node[j]))
                label[label == label[j]] = label[i]
    return u, v


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of rows (key, a, b, part, node, size, root, bytes, shingles) sorted by (key, a, b); one group is held."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        key = np.stack([table.column(c).to_numpy() for c in ("key", "a", "b")])
        last = len(key[0]) and int(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))[-1])
        yield from _pairs(table.slice(0, last))
        held = table.slice(last)
    if held is not None:
        yield from _pairs(held)


def _pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    key, a, b, part, node, size, root = (table.column(c).to_numpy() for c in ("key", "a", "b", "part", "node", "size", "root"))
    low = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    lists = table.column("shingles").combine_chunks()
    edges = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    flat = lists.flatten().to_numpy().view(np.uint64)
    starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    for x, y in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
        if y - x > 1:
            u, v = _compare(part[x:y], node[x:y], size[x:y], root[x:y], low[x:y], [flat[m:n] for m, n in zip(edges[x:y], edges[x + 1 : y + 1], strict=True)])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def links_of_buckets(rows: DataFrame, distinct: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join what similar pairs within the buckets of ``rows`` join; ``rows``: key, node, size, root, and of
    the bucket n, its rows, and held, its shingles.

    Buckets are compared inside tasks, so pairs never become rows.  A bucket of more than ``PART`` rows or ``PART_SHINGLES``
    shingles is cut into parts, and each two parts are a group, so a task holds about two parts; nothing is left out.
    """
    parts = F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("held") / PART_SHINGLES)).cast("int")
    cut = rows.withColumn("part", F.pmod(F.hash("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cut = cut.select("key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "node", "size", "root")
    cut = cut.join(distinct.select("node", "bytes").join(sets, "node"), "node")
    dealt = cut.select("key", "a", "b", "part", "node", "size", "root", "bytes", "shingles").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return dealt.mapInArrow(_grouped, "u long, v long")


def near_components(distinct: DataFrame, docs: DataFrame, text_col: str, words: int, links: DataFrame | None = None) -> DataFrame:
    """(node, root) of the nodes of ``distinct`` (node, size, keys, bytes) that similar pairs, and ``links`` (u, v), join; others
    may be absent."""
    dealt = distinct.select("node", "size", F.explode("keys").alias("key"))
    least = checkpointed(dealt.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head"))
    shared = checkpointed(dealt.join(least, "key"))
    sets = checkpointed(shingle_sets(docs, text_col, words, checkpointed(shared.select("node").distinct())))

    def verified(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("x", "y"))
        return checkpointed(_joined(pairs, sets, "shingles").where(both * UNDER >= (F.size("x") + F.size("y") - both) * OVER).select("u", "v"))

    stars = shared.where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    stars = checkpointed(_joined(stars, distinct, "bytes").mapInArrow(_promising, "u long, v long"))
    roots = checkpointed(connected_components(verified(stars)))
    rooted = checkpointed(shared.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("held")).where("a <> b").select("key", "n", "held")
    more = checkpointed(links_of_buckets(rooted.join(mixed, "key"), distinct, sets).distinct())
    more = more.union(links) if links is not None else more
    # what the second links join are components of the first
    named = roots.select("node", "root")
    ends = more.join(named.toDF("u", "ru"), "u", "left").join(named.toDF("v", "rv"), "v", "left")
    merged = connected_components(ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
    last = checkpointed(merged.select(F.col("node").alias("root"), F.col("root").alias("top")))
    alone = last.join(roots, F.col("node") == last["root"], "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return roots.join(last, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(alone)


def _node_links(rows: DataFrame, prints: DataFrame, links: DataFrame) -> DataFrame:
    """Links (u, v) between nodes of ``rows`` (id, node) that join what equal or linked fingerprints of ``prints`` (id, fp) join."""
    both = rows.select(F.col("id.place").alias("place"), "node").join(prints.select(F.col("id.place").alias("place"), "fp"), "place")
    both = checkpointed(both.select("node", "fp").distinct())
    heads = checkpointed(both.groupBy("fp").agg(F.min("node").alias("head")))
    equal = both.join(heads, "fp").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    linked = links.join(heads.toDF("u", "hu"), "u").join(heads.toDF("v", "hv"), "v").select(F.col("hu").alias("u"), F.col("hv").alias("v"))
    return checkpointed(equal.union(linked))


def near_duplicates(keyed: DataFrame, text_col: str = "text", words: int = 5, prints: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(row key, kept) of every row of ``keyed`` (see :func:`with_row_key`): ``kept`` is the smallest key of its component of
    similarity 0.8.  Rows of equal or linked (``links``: u, v) fingerprints (``prints``: id, the row key, and fp) are joined too.

    Null and empty texts have the same empty set and link with each other alone.  ``keyed`` is read several times and must
    give the same partitions each time, as files and checkpoints do.
    """
    table = checkpointed(signatures(keyed, ROW_KEY, text_col, words))
    distinct = checkpointed(table.groupBy("node").agg(F.min("id").alias("first"), *[F.first(c).alias(c) for c in ("size", "keys", "bytes")]))
    more = None if prints is None else _node_links(table, prints, links)
    roots = near_components(distinct, keyed, text_col, words, more)
    rooted = checkpointed(distinct.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = checkpointed(rooted.groupBy("root").agg(F.min("first").alias("kept")))
    named = rooted.join(least, "root").select("node", "kept")
    return table.select("id", "node").join(named, "node").select(F.col("id").alias(ROW_KEY), "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``docs``, all columns, with one row of each component of similarity 0.8: that of the smallest id (null ids last), ties
    the first row.

    Other columns pass through; an empty table gives no rows.  See :func:`near_duplicates`.
    """
    keyed = with_row_key(docs, id_col)
    found = near_duplicates(keyed, text_col, words)
    return drop_rows(keyed, found.where(F.col(ROW_KEY) != F.col("kept")))
