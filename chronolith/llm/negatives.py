"""Hard-negative mining by threshold joins in the manner of L2AP, over whole-number vectors.

Anchors meet all rows in blocks.  A block of rows is an inverted index: components stand in one order, the heaviest first, and
a row is left out of the postings of its last components once the norm of that suffix, times the longest anchor's norm, lies
under every threshold.  Scores are accumulated posting by posting; a pair is pruned as soon as its partial score and the
norms of what remains cannot reach its anchor's threshold; survivors are completed exactly.

An anchor's first threshold is the score of its k-th best positive within a bounded sample, which the true one cannot be under.
Then each positive opens a window of scores.  Windows are searched from a threshold close under the positive, which is lowered
for those that are not full yet, until they are or the window's end is reached.  Within a task thresholds rise as lists fill.
Tasks hold and send k rows for each list, never all partners; no row is left out for its score but by a proven bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import checkpointed

#: Rows of a block, anchors that meet it at once, components of a posting group.
BLOCK_ROWS, TILE, GROUP = 4096, 512, 8
#: Anchors that one pass over the rows serves, and rows of the sample that gives first thresholds.
BLOCK_ANCHORS, SAMPLE_ROWS = 16_384, 4096
#: Shares of a positive's score at which a window's search may begin, before its own end.
BEGINNINGS = (0.95, 0.9)
#: A product of two norms below this is exact in double precision, and so is every partial score.
MOST_NORM = 2.0**53


@dataclass
class Anchors:
    """Anchors of a pass, components in the order of the index; ``tail[q, j]``: norm of the components from j on."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    tail: np.ndarray

    def take(self, chosen: np.ndarray) -> Anchors:
        return Anchors(self.ids[chosen], self.labels[chosen], self.vectors[chosen], self.tail[chosen])


def tails(vectors: np.ndarray) -> np.ndarray:
    """Norms of the suffixes of each row, one more than it has components (the last is 0)."""
    squares = np.cumsum((vectors * vectors)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(vectors), 1))], axis=1))


def reaching(anchors: np.ndarray, anchor_tail: np.ndarray, rows: np.ndarray, row_tail: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of all pairs whose score is its anchor's threshold or more."""
    dim = rows.shape[1]
    # components at and after a row's end have no postings
    least, longest = thresholds.min(initial=np.inf), anchor_tail[:, 0].max(initial=0.0)
    ends = (row_tail * longest >= least - 0.5).sum(axis=1)
    partial, done = np.zeros((len(anchors), len(rows))), 0
    alive = np.ones(partial.shape, bool)
    while done < dim and alive.mean() > 0.125:
        upto = min(dim, done + GROUP)
        posted = np.flatnonzero(ends > done)
        if not len(posted):
            break
        partial[:, posted] += anchors[:, done:upto] @ rows[posted, done:upto].T
        done = upto
        begun = np.minimum(-(-ends // GROUP) * GROUP, done)  # a row's groups are whole
        alive = partial + anchor_tail[:, begun] * row_tail[np.arange(len(rows)), begun] >= thresholds[:, None] - 0.5
    begun = np.minimum(np.minimum(-(-ends // GROUP) * GROUP, done), dim)
    a, r = np.nonzero(alive)
    rest = np.where(np.arange(dim) >= begun[:, None], rows, 0.0)
    scores = partial[a, r]
    for at in range(0, len(a), 1 << 16):
        some = slice(at, at + (1 << 16))
        scores[some] += np.einsum("ij,ij->i", anchors[a[some]], rest[r[some]])
    kept = scores >= thresholds[a]
    return a[kept], r[kept], scores[kept].astype(np.int64)


class Best:
    """The k best (score, smaller id first) of each of ``n`` lists, within bounds; ``low`` rises as lists fill."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low.astype(np.float64), high
        self.lists, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))

    def add(self, lists: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = (scores >= self.low[lists]) & (scores <= self.high[lists])
        lists, ids, scores = (np.concatenate([old, new[fits]]) for old, new in ((self.lists, lists), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, lists))
        lists, ids, scores = lists[order], ids[order], scores[order]
        starts = np.flatnonzero(np.diff(lists, prepend=-1))
        rank = np.arange(len(lists)) - np.repeat(starts, np.diff(np.append(starts, len(lists))))
        kept = rank < self.k
        self.lists, self.ids, self.scores = lists[kept], ids[kept], scores[kept]
        full = rank == self.k - 1
        self.low[lists[full]] = scores[full]  # an equal score of a smaller id may still come in


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, label, v): one row for each id (the smallest label, then vector), components as floor(scale * x)."""
    fine = F.col(vector_col).isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    fine &= F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * float(scale)).cast("double"))
    made = rows.where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"))
    return made.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    ends = lists.offsets.to_numpy()
    sizes, flat = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    out = np.zeros((len(lists), dim))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _blocks(batches: Iterator[pa.RecordBatch], order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: ids, labels, vectors in the order of the index, their tails."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            vectors = _matrix(part.column("v"), len(order))[:, order]
            yield part.column("id").to_numpy(), part.column("label").to_numpy(), vectors, tails(vectors)


def _listed(best: Best, names: dict[str, np.ndarray]) -> pa.RecordBatch:
    """What a task found: the lists' own columns, and the ids and scores in them."""
    return pa.RecordBatch.from_pydict({**{n: c[best.lists] for n, c in names.items()}, "id": best.ids, "score": best.scores})


def _first(found: DataFrame, lists: list[str], k: int) -> DataFrame:
    """The k best of each list over all tasks, ranked."""
    rank = F.row_number().over(Window.partitionBy(*lists).orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _positives(rows: DataFrame, anchors: Anchors, low: np.ndarray, order: np.ndarray, k: int) -> DataFrame:
    """(anchor, id, score, rank): each anchor's k best rows of its own label."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, low))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, low = sent.value
        best = Best(k, low, np.full(len(low), np.iinfo(np.int64).max))
        for ids, labels, vectors, tail in _blocks(batches, order):
            for label in np.intersect1d(labels, all_.labels):
                mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(all_.labels == label)
                for at in range(0, len(theirs), TILE):
                    tile = theirs[at : at + TILE]
                    a, r, scores = reaching(all_.vectors[tile], all_.tail[tile], vectors[mine], tail[mine], best.low[tile])
                    a, r = tile[a], ids[mine[r]]
                    other = r != all_.ids[a]
                    best.add(a[other], r[other], scores[other])
        yield _listed(best, {"anchor": all_.ids})

    return _first(rows.mapInArrow(search, "anchor long, id long, score long"), ["anchor"], k)


def _negatives(rows: DataFrame, anchors: Anchors, windows: np.ndarray, order: np.ndarray, k: int) -> DataFrame:
    """(anchor, high, id, score, rank): the k best rows of other labels in each window (anchor's place, low, high)."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows[np.argsort(windows[:, 0], kind="stable")]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, windows = sent.value
        of, lows, highs = windows.T
        places, starts, counts = np.unique(of, return_index=True, return_counts=True)
        some, best = all_.take(places), Best(k, lows, highs)
        for ids, labels, vectors, tail in _blocks(batches, order):
            for at in range(0, len(places), TILE):
                tile = slice(at, at + TILE)
                least = np.minimum.reduceat(best.low, starts)[tile]
                a, r, scores = reaching(some.vectors[tile], some.tail[tile], vectors, tail, least)
                other = labels[r] != some.labels[tile][a]
                a, r, scores = a[other] + at, r[other], scores[other]
                # a row stands in each of its anchor's windows that holds its score
                each = np.repeat(np.arange(len(a)), counts[a])
                within = np.arange(len(each)) - np.repeat(np.cumsum(counts[a]) - counts[a], counts[a])
                best.add(starts[a[each]] + within, ids[r[each]], scores[each])
        yield _listed(best, {"anchor": some.ids[np.searchsorted(places, of)], "high": highs})

    return _first(rows.mapInArrow(search, "anchor long, high long, id long, score long"), ["anchor", "high"], k)


def _search_block(rows: DataFrame, anchors: Anchors, sample: tuple, order: np.ndarray, positives: int, negatives: int, percent: int) -> DataFrame:
    """The rows of one block of anchors."""
    ids, labels, vectors = sample
    low = np.full(len(anchors.ids), -np.inf)
    for at in range(0, len(low), TILE):
        scores = anchors.vectors[at : at + TILE] @ vectors.T
        scores[(anchors.labels[at : at + TILE, None] != labels) | (anchors.ids[at : at + TILE, None] == ids)] = -np.inf
        if len(ids) >= positives:
            low[at : at + TILE] = np.partition(scores, -positives, axis=1)[:, -positives]
    found = checkpointed(_positives(rows, anchors, low, order, positives))
    # at most ``positives`` rows for each anchor of the block
    listed = found.where("score >= 0").select("anchor", "score").distinct().toPandas()
    by = np.argsort(anchors.ids)
    of = by[np.searchsorted(anchors.ids, listed["anchor"].to_numpy(np.int64), sorter=by)] if len(listed) else np.empty(0, np.int64)
    high = listed["score"].to_numpy(np.int64)
    end = -((-percent * high) // 100)
    parts = []
    for share in (*BEGINNINGS, 0.0):
        if not len(of):
            break
        begin = np.maximum(end, np.ceil(high * share).astype(np.int64))
        got = checkpointed(_negatives(rows, anchors, np.stack([of, begin, high], axis=1), order, negatives))
        parts.append(got)
        full = got.where(F.col("rank") == negatives).select("anchor", "high").toPandas()
        keys = set(zip(full["anchor"].tolist(), full["high"].tolist(), strict=True))
        open_ = (begin > end) & np.array([key not in keys for key in zip(anchors.ids[of].tolist(), high.tolist(), strict=True)], bool)
        # a window that goes on is searched whole again, so what it has found so far is left out
        if open_.any():
            again = rows.sparkSession.createDataFrame(list(zip(anchors.ids[of[open_]].tolist(), high[open_].tolist(), strict=True)), "anchor long, high long")
            parts[-1] = got.join(F.broadcast(again), ["anchor", "high"], "left_anti")
        of, high, end = of[open_], high[open_], end[open_]
    out = parts[0] if parts else None
    for part in parts[1:]:
        out = out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    mates = found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("high"))
    return mates.join(out, ["anchor", "high"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score")
    )


def mine(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    block_anchors: int = BLOCK_ANCHORS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its ``positives`` best
    rows of the same label, the first ``negatives`` rows of other labels whose score is ``percent`` to 100 per cent of the positive's.

    ``anchors``: a condition on (id, label).  Scores are inner products of components floor(``scale`` * x); ties go to the smaller id.
    Rows with a null id, label or vector, or any null or non-finite component, take no part.  Of repeated ids the row of the smallest
    label, then vector, takes part.  Shorter vectors count as filled up with zeros.  Positives of negative score have no
    window; pairs without negatives give no rows; empty tables give none.  Vectors of norm 2**26 or more (scaled) may be no longer exact
    in double precision and are an error.

    Each ``block_anchors`` anchors take up to four passes over the rows; anchors of a block and their at most ``positives`` windows each are what the
    driver and every task hold.  Anchors that are a share of the rows make the work quadratic, as for any exact search without structure to prune by.
    """
    table = checkpointed(usable(rows, id_col, label_col, vector_col, scale))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    dim, longest = table.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    if longest >= MOST_NORM:
        raise ValueError("components too large for exact scores")
    chosen = table.where(anchors)
    blocks = -(-chosen.count() // block_anchors)
    drawn = table.orderBy(F.xxhash64("id"), "id").limit(sample_rows).toArrow().combine_chunks()
    vectors = _matrix(drawn.column("v").combine_chunks(), dim) if drawn.num_rows else np.zeros((0, dim))
    order = np.argsort(-(vectors * vectors).sum(axis=0), kind="stable")
    sample = (drawn.column("id").to_numpy(), drawn.column("label").to_numpy(), vectors[:, order])
    out = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for block in range(blocks):
        held = chosen.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if held.num_rows:
            matrix = _matrix(held.column("v").combine_chunks(), dim)[:, order]
            some = Anchors(held.column("id").to_numpy(), held.column("label").to_numpy(), matrix, tails(matrix))
            out = out.unionByName(_search_block(table, some, sample, order, positives, negatives, percent))
    return out
