"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue per query, exact reranking.

Trees are fitted on a bounded sample and every row is dealt to a leaf of each; the number of leaves follows the number of
rows.  A query walks all trees through one queue, ordered by the squares of the margins it has crossed, until the leaves it
has reached hold its share of the rows; that share is calibrated on the sample for a stated recall.  Queries and rows then
meet by group of neighbouring leaves, where exact cosines in double precision are taken for the rows of the leaves that a
query has reached, and no others; only its best of each group are shuffled on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed

#: Most levels of a tree: leaves grow with the table beyond ``leaf_rows`` << DEEPEST rows.
DEEPEST = 16


@dataclass
class Forest:
    """Complete binary trees in heap order.  A level splits by one direction, a node at a place of its own.

    directions: (trees, depth, dim); offsets: (trees, nodes).
    """

    depth: int
    directions: np.ndarray
    offsets: np.ndarray

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree (trees, rows); a leaf's number counts over all trees."""
        out = []
        for tree, (directions, offsets) in enumerate(zip(self.directions, self.offsets, strict=True)):
            node, along = np.zeros(len(vectors), np.int64), vectors @ directions.T
            for level in range(self.depth):
                node = 2 * node + 1 + (along[:, level] > offsets[node])
            out.append(node - (2**self.depth - 1) + (tree << self.depth))
        return np.array(out)

    def search(self, vector: np.ndarray, sizes: np.ndarray, rows: float) -> list[int]:
        """Leaves in the queue's order until they hold ``rows`` rows (a row counts once for each tree)."""
        along = (self.directions @ vector).tolist()
        queue, found, last = [(0.0, t, 0, 0) for t in range(len(self.offsets))], [], self.depth
        while queue and rows > 0:
            cost, tree, node, level = heapq.heappop(queue)
            offsets, places = self.offsets[tree], along[tree]
            while level < last:
                margin = places[level] - offsets[node]
                near = 2 * node + 1 + int(margin > 0)
                level += 1
                heapq.heappush(queue, (cost + margin * margin, tree, 4 * node + 3 - near, level))
                node = near
            leaf = node - (2**last - 1) + (tree << last)
            found.append(leaf)
            rows -= sizes[leaf]
        return found


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 0, least: int = 16) -> Forest:
    """Random-projection trees: a node splits at the median of its sample along its level's random direction.

    A node that fewer than ``least`` sampled vectors reach splits where its nearest better-filled ancestor would.
    """
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    offsets = np.zeros((trees, 2**depth - 1))
    for tree in range(trees):
        along = sample @ directions[tree].T
        held = [np.arange(len(sample))]
        for level in range(depth):
            below = []
            for n, rows in enumerate(held):
                inside = along[rows, level]
                at = offsets[tree, 2**level - 1 + n] = np.median(inside) if len(rows) else 0.0
                halves = (rows[inside <= at], rows[inside > at])
                below += [half if len(half) >= least else rows for half in halves]
            held = below
    return Forest(depth, directions, offsets)


def calibrated_share(forest: Forest, sample: np.ndarray, k: int, recall: float, asked: int = 256) -> float:
    """Share of the rows (counted once for each tree) at which searches within the sample reach ``recall`` of the true ``k``."""
    leaves, trees = forest.leaves(sample), len(forest.offsets)
    sizes = np.bincount(leaves.ravel(), minlength=trees << forest.depth)
    reached = []
    for i in np.random.default_rng(1).permutation(len(sample))[:asked]:
        cosines = sample @ sample[i]
        cosines[i] = -2.0
        true = np.argsort(-cosines)[: min(k, len(sample) - 1)]
        order = forest.search(sample[i], sizes, np.inf)
        at = np.empty(trees << forest.depth)
        at[order] = np.cumsum(sizes[order])
        reached += at[leaves[:, true]].min(axis=0).tolist()
    return float(np.quantile(reached, recall, method="higher")) / len(sample) if reached else 1.0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A batch's vectors (rows, dim) in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, so that squares stay finite."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite, and one that isn't zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = 2, recall: float = 0.94, share: float | None = None, leaf_rows: int = 64, sample_rows: int = 16_384, task_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest rows found for each query, its own id left out.

    Ties go to the smaller id.  Vectors that are null, empty, zero or hold null or non-finite components take no part, nor
    do rows with a null id or, as rows, vectors of another length than most (ties: the longer).  Equal vectors are indexed
    once with their k + 1 smallest ids; further copies cannot be among anyone's k nearest.  Repeated ids count once.  Empty
    tables give no rows.  The forest is fitted on at most ``sample_rows`` vectors (those of the smallest hash); groups of
    leaves hold about ``task_rows`` rows, and larger ones are dealt to tasks in parts.  ``share``: the rows that the leaves
    of a query may hold, over all trees, as a share of all rows; by default what reaches ``recall`` within the sample.
    """
    spark = rows.sparkSession
    clean = lambda t: t.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows, queries = clean(rows), clean(queries)
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], result)
    dim = dims[0].d
    ranked = rows.where(F.size("v") == dim).dropDuplicates(["id", "v"]).withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = checkpointed(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    queries = queries.where(F.size("v") == dim)
    total = distinct.count()
    drawn = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).toPandas()
    sample = unit(np.array(drawn["v"].tolist(), dtype=np.float64))
    depth = int(np.clip(np.ceil(np.log2(total / leaf_rows)), 0, DEEPEST))
    forest = fit_forest(sample, trees, depth)
    leaf_count = trees << depth
    share = calibrated_share(forest, sample, k, recall) if share is None else share

    def leaf_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = forest.leaves(unit(matrix(batch.column(0), dim))) if batch.num_rows else np.empty((trees, 0), np.int64)
            for leaves in found:
                yield pa.RecordBatch.from_arrays([pa.array(leaves), batch.column(0), batch.column(1)], names=["leaf", "v", "ids"])

    v_type, id_type = (distinct.schema[c].dataType.simpleString() for c in ("v", "ids"))
    dealt = distinct.mapInArrow(leaf_of, f"leaf long, v {v_type}, ids {id_type}")
    sizes = np.zeros(leaf_count, np.int64)
    for leaf, n in dealt.groupBy("leaf").count().collect():
        sizes[leaf] = n
    shift = depth - int(np.clip(np.ceil(np.log2(total / task_rows)), 0, depth))
    groups = sizes.reshape(-1, 1 << shift).sum(axis=1)
    parts = np.maximum(1, -(-groups // (2 * task_rows)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, keys, lists = [], [], []
            for n, v in enumerate(unit(matrix(batch.column(1), dim)) if batch.num_rows else []):
                found = np.sort(forest.search(v, sizes, share * total))
                for part in np.split(found, np.flatnonzero(np.diff(found >> shift)) + 1):
                    owners.append(n)
                    keys.append(int(part[0]) >> shift)
                    lists.append(part)
            at = pa.array(owners, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64())), batch.column(0).take(at), batch.column(1).take(at)], names=["group", "leaves", "query_id", "q"])

    part_of = F.element_at(F.lit(parts.tolist()).cast("array<int>"), (F.col("group") + 1).cast("int"))
    wanted = queries.mapInArrow(walk, f"group long, leaves array<bigint>, query_id long, q {v_type}")
    wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), part_of - 1)))
    held = dealt.withColumn("group", F.shiftright("leaf", shift)).withColumn("part", F.pmod(F.hash("v"), part_of))

    def rerank(asked: pa.Table, leaf: pa.Table) -> pa.Table:
        q = unit(matrix(asked.column("q").combine_chunks(), dim)) if asked.num_rows else np.empty((0, dim))
        r = unit(matrix(leaf.column("v").combine_chunks(), dim)) if leaf.num_rows else np.empty((0, dim))
        best_q, best_r = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(q) and len(r):
            place = leaf.column("leaf").to_numpy() & ((1 << shift) - 1)
            order = np.argsort(place, kind="stable")
            r, leaf, ends = r[order], leaf.take(pa.array(order)), np.searchsorted(place[order], np.arange((1 << shift) + 1))
            lists = asked.column("leaves").combine_chunks()
            owner = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy(zero_copy_only=False))
            reached = lists.flatten().to_numpy() & ((1 << shift) - 1)
            some = min(k + 1, len(r))
            for at in range(0, len(q), 256):
                cosines = np.full((min(256, len(q) - at), len(r)), -2.0)
                mine = (owner >= at) & (owner < at + 256)
                for n in np.unique(reached[mine]):
                    rows, who = slice(ends[n], ends[n + 1]), owner[mine & (reached == n)]
                    cosines[who - at, rows] = q[who] @ r[rows].T
                cut = np.partition(cosines, -some, axis=1)[:, -some]
                i, j = np.nonzero((cosines >= cut[:, None] - 1e-12) & (cosines > -1.5))
                best_q.append(i + at)
                best_r.append(j)
        i, j = np.concatenate(best_q), np.concatenate(best_r)
        score = (q[i] * r[j]).sum(axis=1)
        return pa.Table.from_arrays([asked.column("query_id").take(pa.array(i)), leaf.column("ids").take(pa.array(j)), pa.array(score)], names=["query_id", "ids", "score"])

    met = wanted.groupBy("group", "part").cogroup(held.groupBy("group", "part")).applyInArrow(rerank, f"query_id long, ids {id_type}, score double")
    pairs = met.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", best).where(F.col("rank") <= k).select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score")
