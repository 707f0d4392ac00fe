"""Language-model scoring with a class bigram model (Brown et al., 1992), trained by distributed exchange clustering.

Symbols are the frequent words, the shapes of rare words, and the text end.  A word is frequent if it occurs ``min_count``
times; every such word is clustered, however many there are.  Words, their numbers, classes and bigrams are tables: only
what is by class, by shape or by partition reaches the driver, and a task holds a block of text, the contexts of a stripe of
symbols and the classes of a segment of them, one byte each.  Exchange clustering moves symbols to the class that raises
the likelihood of class transitions most: a round finds every symbol's best move among all classes, then makes the most
gainful share of the moves by which likelihood rises.

    P(token | previous) = P(class | previous class) * P(symbol | class) * P(word | shape, for rare words)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.bpe import MOST_PARTITIONS, _one, pack, unpack
from chronolith.llm.common import checkpointed, fold, text_or_empty, text_runs

SHAPES = 256
DELTA = 0.1
#: Rank of the text end among symbols: after the shapes, before the words, the most frequent first.
END = SHAPES
#: Symbols whose contexts a task holds at once, and symbols whose classes it looks up at once; their numbers have as many parts.
STRIPE, SEGMENT = 2048, 1 << 20
#: Tables of classes that are broadcast: rows of a segment (a byte for each symbol), and of a stripe.
MOST_SEGMENTS, MOST_STRIPES = 16, 8192
#: Entries that are gathered before equal ones are summed.
MOST_ENTRIES = 4_000_000


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch in turn, A-Z lower-cased, and words per text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    real = np.asarray(pc.binary_length(flat).to_numpy(zero_copy_only=False)) > 0
    owner = np.repeat(np.arange(len(texts)), lengths)[real]
    return flat.filter(pa.array(real)), np.bincount(owner, minlength=len(texts))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: hash and shape of each distinct word, the index of each word in turn, words per text."""
    flat, counts = tokens(texts)
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.binary())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, 42) for w in words.to_pylist()], dtype=np.uint64).view(np.int64)
    if not len(words):
        return hashes, np.empty(0, np.int64), np.empty(0, np.int64), counts
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last, before = data[ends[1:] - 1].astype(np.int64), data[np.maximum(ends[1:] - 2, ends[:-1])].astype(np.int64)
    shapes = (last * 31 + before) % (SHAPES // 2) * 2 + (np.diff(ends) > 8)
    return hashes, shapes, coded.indices.to_numpy().astype(np.int64), counts


def with_ends(values: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The sequence with ``end`` put after each text's values."""
    return np.insert(values, np.cumsum(counts), end)


@dataclass
class Symbols:
    """Frequent words by hash, with their training counts; places: words, then shapes, then the end."""

    hashes: np.ndarray
    counts: np.ndarray

    @property
    def end(self) -> int:
        return len(self.hashes) + SHAPES

    def number(self, hashes: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each word, and its place among the frequent words or -1."""
        place = np.searchsorted(self.hashes, hashes)
        place = np.where(np.append(self.hashes, 0)[place] == hashes, place, -1) if len(self.hashes) else np.full(len(hashes), -1)
        return np.where(place >= 0, place, len(self.hashes) + shapes), place


@dataclass
class Model:
    """``words`` (key long, n long, kind int: the class, or -1 for a rare word) is a table of all training words; the rest
    is by class or shape.  ``symbols``, ``classes`` and ``emission`` gather the frequent words, to look at a small model."""

    words: DataFrame
    train_tokens: int
    vocabulary: int
    shape_classes: np.ndarray  # of each shape, then of the end
    shape_emission: np.ndarray  # log10, of each shape in its class, then of the end
    held: np.ndarray  # log10 of the classes' counts
    transition: np.ndarray  # log10, from class to class
    rare: np.ndarray  # log10 of the denominators of rare words, by shape
    end_count: int
    history: list[float]  # the likelihood after each round of clustering

    @property
    def counts(self) -> DataFrame:
        return self.words.select("key", "n")

    @cached_property
    def _frequent(self):
        return self.words.where("kind >= 0").toPandas().sort_values("key")

    @cached_property
    def symbols(self) -> Symbols:
        return Symbols(self._frequent["key"].to_numpy(np.int64), self._frequent["n"].to_numpy(np.int64))

    @cached_property
    def classes(self) -> np.ndarray:
        return np.concatenate((self._frequent["kind"].to_numpy(np.int64), self.shape_classes))

    @cached_property
    def emission(self) -> np.ndarray:
        own = np.log10(self.symbols.counts + DELTA) - self.held[self._frequent["kind"].to_numpy(np.int64)]
        return np.concatenate((own, self.shape_emission))


def cut(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", part: int = 0) -> DataFrame:
    """Texts cut into words, written by blocks of rows: (block, ids, sizes: words of each text; of each distinct word keys, n
    and shapes; codes: the packed word of each place).  Blocks of other ``part`` (0 or 1) have other numbers.
    """
    rows = docs.select((F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in text_runs(batches):
            if not batch.num_rows:
                continue
            hashes, shapes, codes, counts = words_of(batch.column("text"))
            n = np.bincount(codes, minlength=len(hashes))
            yield pa.RecordBatch.from_pydict({
                "block": [2 * block + part], "ids": _one(batch.column("id")), "sizes": _one(pa.array(counts.astype(np.int64))), "keys": _one(pa.array(hashes)),
                "n": _one(pa.array(n.astype(np.int64))), "shapes": _one(pa.array(shapes.astype(np.uint8).view(np.int8))), "codes": [pack(codes.astype(np.uint32))],
            })
            block += 1

    return checkpointed(rows.mapInArrow(blocks, f"block long, ids array<{id_type}>, sizes array<long>, keys array<long>, n array<long>, shapes array<tinyint>, codes binary"))


def met_blocks(blocks: DataFrame, words: DataFrame, columns: dict[str, int], join, schema: str) -> DataFrame:
    """``join(found, held)`` of every block and its distinct words, each with the ``columns`` of ``words``, or the
    values given if ``words`` lacks it.

    A block's distinct words go to the table once each, and come back to its packed places in a cogroup.
    """
    asked = blocks.select("block", F.posexplode("keys").alias("number", "key")).join(words.select("key", *columns), "key", "left").select(F.col("block").alias("of"), "number", *columns).fillna(columns)
    kept = blocks.withColumn("n_keys", F.size("keys")).drop("keys", "n")
    met, kept = (t.repartition(_partitions(blocks), of).groupBy(of) for t, of in ((asked, "of"), (kept, "block")))

    def checked(found: pa.Table, held: pa.Table) -> pa.Table:
        if held.num_rows != 1 or found.num_rows != held.column("n_keys")[0].as_py():
            raise RuntimeError("a block lacks counts")
        return join(found.sort_by("number"), held)

    return met.cogroup(kept).applyInArrow(checked, schema)


def _partitions(blocks: DataFrame, a_block: float = 2) -> int:
    return max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(a_block * blocks.count()), MOST_PARTITIONS))


def _column(held: pa.Table, name: str) -> np.ndarray:
    return held.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed: bytes of one weight stand together."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unsqueeze(data: bytes, m: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    flat, at, found = np.frombuffer(pa.decompress(data, m * sum(sizes), "zstd", asbytes=True) if m else b"", np.uint8), 0, []
    for size, kind in zip(sizes, kinds, strict=True):
        found.append(np.ascontiguousarray(flat[at : at + m * size].reshape(size, m).T).view(kind).ravel())
        at += m * size
    return found


def squeeze_cell(s: np.ndarray, o: np.ndarray, n: np.ndarray, segment: int) -> bytes:
    """Entries of a cell, in rising order of (s, o): steps from one to the next are small, so they take less room."""
    return squeeze(np.diff(s.astype(np.int64) * segment + o, prepend=0).astype(np.uint64), n.astype(np.uint64))


def unsqueeze_cell(data: bytes, m: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, n = unsqueeze(data, m, np.int64, np.uint64)
    key = np.cumsum(steps)
    return (key // segment).astype(np.uint16), (key % segment).astype(np.uint32), n


def number_words(counts: DataFrame, least: float, stripe: int) -> tuple[DataFrame, int]:
    """(key, n, number, frequent) of all words, and the number of stripes.

    Symbols rank by shape, then the end, then words by falling count; ranks are dealt over stripes in turn, so stripes are
    alike.  A rare word has its shape's number.  Ranks come from the sizes of the sorted table's partitions.
    """
    order = [F.col("n").desc(), F.col("key")]
    ranged = checkpointed(counts.where(F.col("n") >= least).repartitionByRange(*order).sortWithinPartitions(*order))
    placed = ranged.withColumn("at", F.monotonically_increasing_id())
    sizes = {p: n for p, n in placed.groupBy(F.shiftright("at", 33).alias("p")).count().collect()}
    firsts = np.cumsum([END + 1, *(sizes.get(p, 0) for p in range(max(sizes, default=0) + 1))]).tolist()
    stripes = -(-firsts[-1] // stripe)
    rank = F.lit(firsts).cast("array<bigint>")[F.shiftright("at", 33).cast("int")] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = lambda rank: (rank % stripes * stripe + F.floor(rank / stripes)).cast("long")
    words = placed.withColumn("rank", rank).select("key", "n", dealt(F.col("rank")).alias("number"), F.lit(True).alias("frequent"))
    rare = counts.where(F.col("n") < least).select("key", "n", dealt(F.col("shape").cast("long")).alias("number"), F.lit(False).alias("frequent"))
    return checkpointed(words.union(rare)), stripes


def symbol_contexts(blocks: DataFrame, words: DataFrame, stripes: int, stripe: int, segment: int) -> DataFrame:
    """(i, j, side, m, data): of stripe i's symbols the m contexts that lie in segment j, with their counts; side 1 has the
    symbols that follow, side 0 those before.  Each text starts after an end.
    """
    end, size = END % stripes * stripe + END // stripes, stripes * stripe

    def pairs(found: pa.Table, held: pa.Table) -> pa.Table:
        sizes = _column(held, "sizes")
        line = with_ends(found.column("number_of").to_numpy()[unpack(held.column("codes")[0].as_py(), int(sizes.sum()), np.uint32)], sizes, end)
        both, n = np.unique(np.concatenate(([end], line[:-1])) * size + line, return_counts=True)
        rows, n = {c: [] for c in ("i", "j", "side", "m", "data")}, n.astype(np.uint64)
        for side, (s, o) in enumerate((np.divmod(both, size)[::-1], np.divmod(both, size))):
            # one key for (i, j, s, o): keys are distinct, and far under 2 ** 63
            order = np.argsort(((s // stripe * -(-size // segment) + o // segment) * stripe + s % stripe) * segment + o % segment)
            s, o, each = s[order], o[order], n[order]
            i, j = s // stripe, o // segment
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 0) | (np.diff(j) != 0))))
            for x, y in zip(starts, np.append(starts[1:], len(s)), strict=True):
                data = squeeze_cell(s[x:y] % stripe, o[x:y] % segment, each[x:y], segment)
                for c, value in zip(rows, (i[x], j[x], side, y - x, data), strict=True):
                    rows[c].append(value)
        return pa.table(rows, schema=pa.schema([("i", pa.int64()), ("j", pa.int64()), ("side", pa.int32()), ("m", pa.int64()), ("data", pa.binary())]))

    def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s, o, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        key = s.astype(np.int64) * segment + o
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        first = order[starts]
        return s[first], o[first], np.add.reduceat(n[order], starts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, gathered, least = None, [], 0, MOST_ENTRIES

        def row() -> pa.RecordBatch:
            s, o, n = summed(parts)
            return pa.RecordBatch.from_pydict({"i": [last[0]], "j": [last[1]], "side": pa.array([last[2]], pa.int32()), "m": [len(s)], "data": [squeeze_cell(s, o, n, segment)]})

        for batch in batches:
            for *cell, m, data in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "side", "m", "data")), strict=True):
                if cell != last and parts:
                    yield row()
                if cell != last:
                    last, parts, gathered, least = cell, [], 0, MOST_ENTRIES
                parts.append(unsqueeze_cell(data, m, segment))
                gathered += m
                if gathered > least:
                    parts = [summed(parts)]
                    gathered = len(parts[0][0])
                    least = 2 * gathered + MOST_ENTRIES
        if parts:
            yield row()

    schema = "i long, j long, side int, m long, data binary"
    chunks = met_blocks(blocks, words.withColumnRenamed("number", "number_of"), {"number_of": -1}, pairs, schema)
    # each round of clustering reads these partitions several times: few large ones, as a task costs more than a cell
    dealt = chunks.repartition(_partitions(blocks, 0.25), "i", "j", "side").sortWithinPartitions("i", "j", "side")
    return checkpointed(dealt.mapInArrow(merged, schema))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def log_likelihood(counts: np.ndarray) -> float:
    """The part of the training likelihood that depends on the classes."""
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(axis=1)).sum() - _xlogx(counts.sum(axis=0)).sum())


def best_moves(left: np.ndarray, right: np.ndarray, own: np.ndarray, counts: np.ndarray, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For symbols with class counts before (``left``) and after (``right``) them: the class each fits best, its own taken
    out first, and by how much better than its own.

    All classes are computed.  Counts up to ``small`` are so by a matrix product for each count, greater ones one by one.
    """
    n_out, n_in = counts.sum(axis=1), counts.sum(axis=0)
    rows = np.arange(len(own))

    def joined(table: np.ndarray, more: np.ndarray) -> np.ndarray:
        """What all classes' rows of ``table`` gain by ``more``, a symbol's own class without it."""
        plain, gain = _xlogx(table), np.zeros((len(more), len(table)))
        for r in range(1, small + 1):
            gain += (more == r) @ (_xlogx(table + r) - plain).T
        at, column = np.nonzero(more > small)
        if len(at):
            each = _xlogx(table.T[column] + more[at, column][:, None]) - plain.T[column]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            gain[at[starts]] += np.add.reduceat(each, starts)
        base = np.maximum(table[own] - more, 0)
        gain[rows, own] = (_xlogx(base + more) - _xlogx(base)).sum(axis=1)
        return gain

    def alone(totals: np.ndarray, more: np.ndarray) -> np.ndarray:
        base = np.repeat(totals[None, :], len(more), axis=0)
        base[rows, own] -= more
        return _xlogx(base + more[:, None]) - _xlogx(base)

    total = joined(counts, right) + joined(counts.T, left) - alone(n_out, right.sum(axis=1)) - alone(n_in, left.sum(axis=1))
    total[:, 0] = -np.inf  # the end's class
    best = total.argmax(axis=1)
    return best, total[rows, best] - total[rows, own]


@dataclass
class Clustering:
    """Contexts of symbols (see :func:`symbol_contexts`), and how symbols are dealt; ``own`` (i, own binary) are the classes of a
    stripe's symbols, a byte each."""

    contexts: DataFrame
    stripes: int
    stripe: int
    segment: int
    k: int

    def first_classes(self) -> DataFrame:
        stripes, stripe, k = self.stripes, self.stripe, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ranks = batch.column("i").to_numpy()[:, None] + np.arange(stripe)[None, :] * stripes
                own = np.where(ranks == END, 0, 1 + ranks % (k - 1)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array([x.tobytes() for x in own], pa.binary())], names=["i", "own"])

        return checkpointed(self.contexts.sparkSession.range(stripes).toDF("i").mapInArrow(run, "i long, own binary"))

    def met(self, contexts: DataFrame, own: DataFrame) -> DataFrame:
        """(i, side, m, data, own, classes): ``contexts`` with the classes of their stripe and of their segment."""
        span = self.segment // self.stripe

        def whole(group: pa.Table) -> pa.Table:
            group = group.sort_by("i")
            return pa.table({"j": [group.column("i")[0].as_py() // span], "classes": pa.array([b"".join(group.column("own").to_pylist())], pa.binary())})

        segments = own.groupBy(F.floor(F.col("i") / span)).applyInArrow(whole, "j long, classes binary")
        segments = F.broadcast(segments) if self.stripes <= MOST_SEGMENTS * span else segments
        own = F.broadcast(own) if self.stripes <= MOST_STRIPES else own
        return contexts.join(segments, "j").join(own, "i").select("i", "side", "m", "data", "own", "classes")

    def counts(self, own: DataFrame) -> np.ndarray:
        """The k by k transition counts; k * k numbers reach the driver."""
        k, segment = self.k, self.segment

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * k)
            for _, _, m, data, mine, classes in _rows(batches, "i", "side", "m", "data", "own", "classes"):
                s, o, n = unsqueeze_cell(data, m, segment)
                total += np.bincount(np.frombuffer(mine, np.uint8)[s].astype(np.int64) * k + np.frombuffer(classes, np.uint8)[o], weights=n, minlength=k * k)
            total = total.reshape(k, k)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["a", "n"])

        out = np.zeros((k, k))
        # a task gives at most a row for each class
        rows = self.met(self.contexts.where("side = 1"), own).mapInArrow(run, "a long, n array<double>").groupBy("a").agg(F.array(*[F.sum(F.get("n", F.lit(b))) for b in range(k)]))
        for a, n in rows.collect():
            out[a] = n
        return out

    def moves(self, own: DataFrame, counts: np.ndarray) -> DataFrame:
        """(i, own, best binary, level binary): of each symbol the best class, and the gain by it on a scale of quarter powers
        of two, 0 if there is none."""
        stripes, stripe, segment, k = self.stripes, self.stripe, self.segment, self.k
        end = END % stripes * stripe + END // stripes

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, side, m, data, mine, classes in _rows(batches, "i", "side", "m", "data", "own", "classes"):
                s, o, n = unsqueeze_cell(data, m, segment)
                found = np.bincount(s.astype(np.int64) * (2 * k) + k * side + np.frombuffer(classes, np.uint8)[o], weights=n, minlength=stripe * 2 * k)
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_pydict({"i": [i], "m": [len(at)], "data": [squeeze(at.astype(np.uint32), found[at])], "own": [mine]})

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, total, mine = None, None, None

            def row() -> pa.RecordBatch:
                classes, both = np.frombuffer(mine, np.uint8).astype(np.int64), total.reshape(stripe, 2 * k)
                to, level = classes.astype(np.uint8), np.zeros(stripe, np.uint16)
                used = np.flatnonzero(both.any(axis=1) & (np.arange(stripe) + last * stripe != end))
                for part in np.split(used, range(256, len(used), 256)):
                    found, gain = best_moves(both[part, :k], both[part, k:], classes[part], counts)
                    better = (found != classes[part]) & (gain > 0)
                    to[part[better]] = found[better]
                    level[part[better]] = np.clip(np.floor(4 * np.log2(gain[better])) + 400, 1, 65535)
                return pa.RecordBatch.from_pydict({"i": [last], "own": [mine], "best": [to.tobytes()], "level": [level.tobytes()]})

            for i, m, data, held in _rows(batches, "i", "m", "data", "own"):
                if i != last:
                    if last is not None:
                        yield row()
                    last, total, mine = i, np.zeros(stripe * 2 * k), held
                at, n = unsqueeze(data, m, np.uint32, np.float64)
                total[at] += n
            if last is not None:
                yield row()

        found = self.met(self.contexts, own).mapInArrow(vectors, "i long, m long, data binary, own binary")
        found = found.repartition("i").sortWithinPartitions("i").mapInArrow(best, "i long, own binary, best binary, level binary")
        # stripes without any context have no moves; their classes stay
        return checkpointed(own.join(found.drop("own"), "i", "left"))


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for n in range(batch.num_rows):
            yield tuple(batch.column(c)[n].as_py() for c in columns)


def _levels(moves: DataFrame) -> np.ndarray:
    """How many moves have each level; at most 65,536 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (level,) in _rows(batches, "level"):
            found, n = np.unique(np.frombuffer(level or b"", np.uint16), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n)], names=["level", "n"])

    out = np.zeros(65536, np.int64)
    for level, n in moves.select("level").mapInArrow(run, "level int, n long").where("level > 0").groupBy("level").agg(F.sum("n")).collect():
        out[level] = n
    return out


def _moved(moves: DataFrame, least: int) -> DataFrame:
    """The classes after the moves of level ``least`` and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, own, best, level in _rows(batches, "i", "own", "best", "level"):
            if best is not None:
                own = np.where(np.frombuffer(level, np.uint16) >= least, np.frombuffer(best, np.uint8), np.frombuffer(own, np.uint8)).tobytes()
            yield pa.RecordBatch.from_pydict({"i": [i], "own": [own]})

    return checkpointed(moves.mapInArrow(run, "i long, own binary"))


def exchange(clustering: Clustering, rounds: int, least_gain: float = 2e-4) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Classes of the symbols by stripe, their transition counts, and the likelihood after each accepted round; class 0 is the
    end's alone.

    Moves that gain alone may harm together, so the most gainful half of them is tried, and a half of those again until
    likelihood rises; a share that worked at once is doubled for the next round.  Moves of one level go together.  Ends after
    ``rounds``, when no move gains, when not even a 64th of the moves raises likelihood, or when a round gains less than
    ``least_gain`` of the likelihood.
    """
    own = clustering.first_classes()
    counts = clustering.counts(own)
    history, share = [log_likelihood(counts)], 0.5
    for _ in range(rounds):
        moves = clustering.moves(own, counts)
        above = np.cumsum(_levels(moves)[::-1])[::-1]
        first, tried = share, None
        while above[0] and share >= 1 / 64:
            least = int(np.flatnonzero(above >= np.ceil(share * above[0]))[-1])
            if least != tried:
                tried, trial = least, _moved(moves, least)
                moved = clustering.counts(trial)
                if log_likelihood(moved) > history[-1]:
                    break
            share /= 2
        else:
            break
        own, counts = trial, moved
        history.append(log_likelihood(counts))
        share = min(1.0, 2 * share) if share == first else share
        if history[-1] - history[-2] < least_gain * abs(history[-1]):
            break
    return own, counts, history


def train(docs: DataFrame, text_col: str = "text", **options) -> Model:
    """Fit the model on all rows of ``docs`` (see :func:`fit`); null texts count as empty, an empty table gives a uniform model.

    Other columns are ignored, repeated rows each count.
    """
    return fit(cut(docs, None, text_col), **options)


def fit(blocks: DataFrame, classes: int = 64, min_count: int = 20, min_share: float = 0.0, rounds: int = 8, stripe: int = STRIPE, segment: int = SEGMENT) -> Model:
    """Fit the model on ``blocks`` of texts (see :func:`cut`).

    Words of ``min_count`` occurrences, and of ``min_share`` of the tokens if that is asked for, are clustered.  The result does not
    depend on ``stripe`` (at most 65,536) and ``segment`` (a multiple of it).
    """
    if not 2 <= classes <= 256 or segment % stripe or stripe > 65536:
        raise ValueError("2 to 256 classes, stripes of at most 65,536 symbols, and whole stripes to a segment")
    each = blocks.select(F.inline(F.arrays_zip("keys", "n", "shapes"))).select(F.col("keys").alias("key"), "n", F.col("shapes").bitwiseAND(F.lit(255)).cast("int").alias("shape"))
    counts = checkpointed(each.groupBy("key").agg(F.sum("n").alias("n"), F.min("shape").alias("shape")))
    ends = int(blocks.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0])
    total, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)) + ends, F.count(F.lit(1)) + int(ends > 0)).first()
    least = max(min_count, min_share * total)
    numbered, stripes = number_words(counts, least, stripe)
    clustering = Clustering(symbol_contexts(blocks, numbered, stripes, stripe, segment), stripes, stripe, segment, classes)
    own, table, history = exchange(clustering, rounds)

    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, mine in _rows(batches, "i", "own"):
            yield pa.RecordBatch.from_arrays([pa.array(i * stripe + np.arange(stripe)), pa.array(np.frombuffer(mine, np.uint8).astype(np.int32))], names=["number", "kind"])

    kinds = own.mapInArrow(classes_of, "number long, kind int")
    frequent = numbered.where("frequent").join(kinds, "number").select("key", "n", "kind")
    words = checkpointed(frequent.union(numbered.where("NOT frequent").select("key", "n", F.lit(-1))))
    # classes after each class: shrunk to the classes' overall shares
    size = table.sum(axis=0) + DELTA
    prior = size / size.sum()
    transition = np.log10((table + 20.0 * prior) / (table.sum(axis=1, keepdims=True) + 20.0))
    first = {rank % stripes * stripe + rank // stripes: rank for rank in range(END + 1)}
    shape_classes, weight, distinct = np.zeros(END + 1, np.int64), np.zeros(END + 1), np.zeros(SHAPES)
    for number, kind in kinds.where(F.col("number").isin(list(first))).collect():
        shape_classes[first[number]] = kind
    for shape, n, words_of_shape in counts.where(F.col("n") < least).groupBy("shape").agg(F.sum("n"), F.count(F.lit(1))).collect():
        weight[shape], distinct[shape] = n, words_of_shape
    weight[END] = ends
    held = np.bincount(shape_classes, weights=weight + DELTA, minlength=classes)
    for kind, n in words.where("kind >= 0").groupBy("kind").agg(F.sum("n") + DELTA * F.count(F.lit(1))).collect():
        held[kind] += n
    held = np.log10(np.maximum(held, 1e-300))
    shape_emission = np.log10(weight + DELTA) - held[shape_classes]
    return Model(words, int(total), vocabulary, shape_classes, shape_emission, held, transition, np.log10(weight[:SHAPES] + DELTA * (distinct + 1)), ends, history)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row, in log10; null texts count as empty.

    Ids may repeat or be null, other columns are ignored, an empty table gives no rows.
    """
    return score_blocks(cut(docs, id_col, text_col), model, id_col)


def score_blocks(blocks: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every text of ``blocks`` (see :func:`cut`): their distinct words' counts and
    classes are fetched from the model's table."""
    base = np.log10(model.train_tokens + DELTA * (model.vocabulary + 1))
    held_logs, transition, rare, shape_classes, shape_emission = model.held, model.transition, model.rare, model.shape_classes, model.shape_emission
    end_log, end_known = np.log10(model.end_count + DELTA), int(model.end_count > 0)

    def join(found: pa.Table, held: pa.Table) -> pa.Table:
        sizes, shapes = _column(held, "sizes"), _column(held, "shapes").view(np.uint8)
        n, kind = found.column("n").to_numpy(), found.column("kind").to_numpy()
        codes = unpack(held.column("codes")[0].as_py(), int(sizes.sum()), np.uint32)
        log, frequent = np.log10(n + DELTA), kind >= 0
        classes = np.where(frequent, kind, shape_classes[shapes])
        emission = log + np.where(frequent, -held_logs[kind], shape_emission[shapes] - rare[shapes])
        line = with_ends(classes[codes], sizes, shape_classes[END])
        value = transition[np.concatenate(([shape_classes[END]], line[:-1])), line] + with_ends(emission[codes], sizes, shape_emission[END])
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        summed = lambda values, end: np.add.reduceat(with_ends(values[codes], sizes, end), starts)
        return pa.table({"id": held.column("ids").combine_chunks().flatten(), "n_tokens": sizes + 1, "n_known": summed((n > 0).astype(np.int64), end_known), "base_score": summed(log, end_log) - (sizes + 1) * base, "score": np.add.reduceat(value, starts)})

    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    words = model.words.select("key", "n", "kind")
    scored = met_blocks(blocks, words, {"n": 0, "kind": -1}, join, f"id {id_type}, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)


def split_by_fold(docs: DataFrame, id_col: str = "doc_id", modulus: int = 10) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``held_out`` (fold 0), and the training rows."""
    marked = docs.withColumn("held_out", fold(id_col, modulus) == 0)
    return marked, marked.where(~F.col("held_out"))
