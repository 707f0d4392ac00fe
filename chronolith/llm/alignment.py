"""Alignment of two tokenizers over a corpus, by an inverted index of pairs of ids.

Each text is encoded by both, A as a byte-level BPE tokenizer and B as a sentencepiece model.  Bytes where tokens of both
end cut it into groups; the last tokens of a group are linked.  Texts go in blocks of some megabytes, which are encoded once
and written; both tokenizers share a block's distinct words, and A encodes many of them as one string.  For each pair of ids
a block makes compressed bitmaps of the documents that link it: plane k holds those whose number of links has bit k, so the
planes' union counts documents and their weighted population counts give links.  Bitmaps go to the bucket of their B id; those
of different blocks are of different documents, so to merge them is to set them side by side.  The summed scores go back along
the postings, packed, to every block that holds the pair, and meet its links there.

A bucket's blocks are dealt over salts, and only sums by pair leave a salt, so a pair that every document holds fits tasks
of bounded size; a bucket of pairs is bounded by the two vocabularies.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from chronolith.llm.bpe import _binary, _bytes_of, _edges, _one, pack, piece_table, read_tokenizer, splitter_of, unpack
from chronolith.llm.common import checkpointed, text_or_empty, text_runs

#: Text of a block.
BLOCK_BYTES = 2_500_000
#: Words whose ids a worker remembers; beyond it all but a block's are forgotten, and encoded anew if they come again.
MOST_KNOWN = 400_000
#: Words are cut at a space after what no whitespace is: A begins a token at each, and B's spaces stay together.
CUT = re.compile(r"(?<=\S) ").split
#: Bytes from which a word is not remembered, and is cut as A cuts it; words that A encodes in one string.
LONG, RUN = 256, 256
#: Text for each bucket of pairs, the most buckets (beyond it the vocabularies bound a bucket), and blocks of a salt.
BUCKET_BYTES, MOST_BUCKETS, SALT_BLOCKS = 32_000_000, 4096, 1024
#: Most shuffle partitions that the size of the input asks for by itself.
MOST_PARTITIONS = 20_000
#: A plane's documents of a pair are held as bits if they are more than one in so many, else as distances.
DENSE = 16


class Tokens:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, spec: str, model: bytes):
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model)
        plain = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        pieces = [[p or b"" for p in piece_table(spec)], [plain(i) for i in range(self.b.get_piece_size())]]
        self.pieces = [pa.array(p, pa.binary()) for p in pieces]
        self.sizes = [np.array([len(p) for p in held], np.int64) for held in pieces]
        # decimal ids with what follows them: within a side, at the end of a side
        self.names = [pa.array([f"{i},".encode() for i in range(len(held))] + [f"{i}{end}".encode() for i in range(len(held))], pa.binary()) for held, end in zip(pieces, "|;", strict=True)]

        # a piece with no space after another character never spans words, so words are encoded by themselves, each distinct one once
        crossing = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        self.by_words = not crossing and "".join(self.b.encode("x", out_type=str)) == "▁x"
        # if A gives back every byte, and finds no added token, its tokens' sizes tell whose they are among joined words
        self.joins = len({p for p in pieces[0] if len(p) == 1}) == 256 and all(t["special"] for t in json.loads(spec)["added_tokens"])
        self.split = splitter_of(spec).plain
        self.known, self.ids = pa.array([], pa.string()), [pa.array([], pa.binary())] * (1 + self.by_words)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all texts in turn and where each begins and ends, of A for the texts after a space, and of B."""
        counts, coded = _numbered(texts, CUT)
        words = coded.dictionary
        at = pc.index_in(words, value_set=self.known)
        fresh = words.filter(pc.is_null(at))
        place = at.fill_null(0).to_numpy().copy()
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(fresh))
        ids = [pa.concat_arrays(x).take(pa.array(place)) for x in zip(self.ids, self._ids(fresh), strict=True)]
        out = [_run_together(x, coded.indices, counts) for x in ids]
        if not self.by_words:
            out.append(_flat(self.b.encode(texts, num_threads=1)))
        self._remember(words, fresh, at, ids)
        return out

    def _remember(self, words: pa.Array, fresh: pa.Array, at: pa.Array, ids: list[pa.Array]) -> None:
        """Adds the fresh words; if they are too many, only the words of this block stay known."""
        keep = pc.less(pc.binary_length(words), LONG)
        if grows := len(self.known) + len(fresh) <= MOST_KNOWN:
            keep = pc.and_(keep, pc.is_null(at))
        new = [x.filter(keep).slice(0, MOST_KNOWN) for x in (words, *ids)]
        self.known, *self.ids = [pa.concat_arrays([x, y]) for x, y in zip((self.known, *self.ids), new, strict=True)] if grows else new

    def _ids(self, words: pa.Array) -> list[pa.Array]:
        """Ids of each word after a space, as bytes, of A and, if it goes by words, of B."""
        long = pc.greater_equal(pc.binary_length(words), LONG)
        parts = [words.filter(pc.invert(long)), words.filter(long)]
        found = pa.concat_arrays([self._joined(parts[0]), self._cut(parts[1].to_pylist())])
        order = np.argsort(long.to_numpy(zero_copy_only=False), kind="stable")
        out = [found.take(pa.array(np.argsort(order)))]
        if self.by_words:
            listed, space = words.to_pylist(), [self.b.piece_to_id("▁")]  # the model puts a space before each word but an empty one
            flat, edges = _flat([ids or space for at in range(0, len(listed), 10_000) for ids in self.b.encode(listed[at : at + 10_000], num_threads=1)])
            out.append(_binary(4 * edges, flat.tobytes()))
        return out

    def _joined(self, words: pa.Array) -> pa.Array:
        """A's ids of words after a space, many words in one string: what it cuts at anyhow stands between them."""
        listed, step = words.to_pylist(), RUN if self.joins else 1
        # a word that ends with whitespace would be cut elsewhere if another came after it
        ends = sorted({*range(step, len(listed), step), *(n for n, w in enumerate(listed, 1) if not w or w[-1].isspace()), *[len(listed)] * bool(listed)})
        runs = [" " + " ".join(listed[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
        batch = max(1, 10_000 // step)
        flat, edges = _flat([e.ids for at in range(0, len(runs), batch) for e in self.a.encode_batch_fast(runs[at : at + batch], add_special_tokens=False)])
        if self.joins:
            upto, want = _edges(self.sizes[0][flat]), _edges(pc.binary_length(words).to_numpy(zero_copy_only=False) + 1)
            edges = np.searchsorted(upto, want)
            if upto[-1] != want[-1] or (upto[edges] != want).any():
                self.joins = False  # this A does not give back every byte after all
                return self._joined(words)
        return _binary(4 * edges, flat.tobytes())

    def _cut(self, words: list[str]) -> pa.Array:
        """A's ids of long words after a space, each distinct part that A cuts them into by itself."""
        counts, coded = _numbered(words, lambda word: self.split(" " + word))
        parts = coded.dictionary.to_pylist()
        flat, edges = _flat([e.ids for at in range(0, len(parts), 10_000) for e in self.a.encode_batch_fast(parts[at : at + 10_000], add_special_tokens=False)])
        flat, edges = _run_together(_binary(4 * edges, flat.tobytes()), coded.indices, counts)
        return _binary(4 * edges, flat.tobytes())


def _numbered(texts: list[str], split: Callable) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words of each text, and all words in turn as numbers of distinct ones."""
    counts, chunks, held = [], [], []
    for text in texts:
        words = split(text)
        counts.append(len(words))
        held += words
        if len(held) > 100_000:
            chunks.append(pa.array(held, pa.string()))
            held = []
    return np.array(counts, np.int64), pa.chunked_array([*chunks, pa.array(held, pa.string())]).combine_chunks().dictionary_encode()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists in turn and where each begins and ends."""
    edges = _edges(np.fromiter(map(len, lists), np.int64, len(lists)))
    return np.fromiter(chain.from_iterable(lists), np.int32, edges[-1]), edges


def _run_together(ids: pa.Array, numbers: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of numbered words in turn, and where those of each text begin and end."""
    found = ids.take(numbers)
    edges = _edges(pc.binary_length(found).to_numpy(zero_copy_only=False))[_edges(counts)] // 4
    return np.frombuffer(_bytes_of(found), np.int32, count=edges[-1]), edges


@lru_cache(maxsize=2)
def tokens_of(spec: str, model: bytes) -> Tokens:
    """Kept by the Python worker from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokens(spec, model)


def aligned(tokens: Tokens, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups and groups_sha256 of each text, and the A and B ids of all links in turn."""
    counts = [np.zeros(len(texts), np.int64) for _ in range(3)]
    digests, given = [""] * len(texts), [n for n, t in enumerate(texts) if t]
    sides = tokens.encode([texts[n] for n in given])
    lost = np.zeros(len(given), bool)
    for (ids, edges), table in zip(sides, tokens.pieces, strict=True):
        found = table.take(pa.array(ids))
        data, cut = _bytes_of(found), _edges(pc.binary_length(found).to_numpy(zero_copy_only=False))[edges]
        for k, (n, a, b) in enumerate(zip(given, cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            lost[k] |= bytes(data[a:b]) != (" " + texts[n]).encode()
    kept = np.flatnonzero(~lost)
    lengths = [np.diff(edges) for _, edges in sides]
    ids = [x[np.repeat(~lost, n)] for (x, _), n in zip(sides, lengths, strict=True)]
    lengths = [n[kept] for n in lengths]
    ends = [np.cumsum(sizes[x]) for sizes, x in zip(tokens.sizes, ids, strict=True)]
    marks = [np.zeros(int(ends[0][-1]) + 1 if len(ends[0]) else 1, bool) for _ in ends]
    for mark, end in zip(marks, ends, strict=True):
        mark[end] = True
    last = [marks[1][ends[0]], marks[0][ends[1]]]
    group = [np.cumsum(x) - x for x in last]
    # tokens of A and B in turn of their groups, written out with what follows each
    held = [np.bincount(g, minlength=int(last[0].sum())) for g in group]
    order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    order[np.arange(len(ids[0])) + _edges(held[1])[group[0]]] = np.arange(len(ids[0]))
    order[np.arange(len(ids[1])) + _edges(held[0])[group[1] + 1]] = len(ids[0]) + np.arange(len(ids[1]))
    names = pa.concat_arrays([t.take(pa.array(x + len(s) * end)) for t, x, s, end in zip(tokens.names, ids, tokens.sizes, last, strict=True)])
    written = names.take(pa.array(order))
    text, cut = _bytes_of(written), _edges(pc.binary_length(written).to_numpy(zero_copy_only=False))[_edges(lengths[0] + lengths[1])]
    edges = _edges(lengths[0])
    links = np.diff(_edges(last[0].astype(np.int64))[edges])
    for n, k in enumerate(kept.tolist()):
        at = given[k]
        digests[at] = hashlib.sha256(text[cut[n] : cut[n + 1] - 1]).hexdigest()
        counts[0][at], counts[1][at], counts[2][at] = lengths[0][n], lengths[1][n], links[n]
    return *counts, digests, ids[0][last[0]], ids[1][last[1]]


def pack_planes(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, n_pairs: int, n_docs: int) -> list[bytes]:
    """Bitmaps of each pair's documents by bit of their number of links; postings sorted by pair, then document.

    A plane is four strings: documents of each pair, how many distances, the distances of rare pairs, and the bits of common ones.
    """
    out = []
    for plane in range(int(times.max(initial=0)).bit_length()):
        held = (times >> plane) & 1 == 1
        p, d = pair[held], doc[held]
        counts = np.bincount(p, minlength=n_pairs)
        dense = counts * DENSE > n_docs
        bits = np.zeros((int(dense.sum()), n_docs), bool)
        common = dense[p]
        bits[(np.cumsum(dense) - 1)[p[common]], d[common]] = True
        p, d = p[~common], d[~common]
        steps = np.where(np.diff(p, prepend=-1) == 0, np.diff(d, prepend=0), d)
        out += [pack(counts.astype(np.uint32)), len(steps).to_bytes(8, "little"), pack(steps.astype(np.uint32)), pa.compress(np.packbits(bits, axis=1).tobytes(), "zstd", asbytes=True)]
    return out


def count_planes(planes: list[bytes], n_pairs: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (population count of the planes' union) and links (population counts weighted by plane) of each pair."""
    links, union = np.zeros(n_pairs, np.int64), []
    for plane, (counts, many, steps, bits) in enumerate(zip(*(planes[k::4] for k in range(4)), strict=True)):
        counts = unpack(counts, n_pairs, np.uint32).astype(np.int64)
        dense = counts * DENSE > n_docs
        rare = np.where(dense, 0, counts)
        d = np.cumsum(unpack(steps, int.from_bytes(many, "little"), np.uint32).astype(np.int64))
        starts = np.cumsum(rare) - rare
        p = np.repeat(np.arange(n_pairs), rare)
        before = np.concatenate(([0], d))[starts[p]]  # steps begin anew with each pair
        width = -(-n_docs // 8)
        rows = np.frombuffer(pa.decompress(bits, int(dense.sum()) * width, "zstd", asbytes=True) if dense.any() else b"", np.uint8).reshape(-1, width)
        links += (rare + np.bincount(np.flatnonzero(dense), np.bitwise_count(rows).sum(axis=1), n_pairs).astype(np.int64)) << plane
        row, at = np.nonzero(np.unpackbits(rows, axis=1)[:, :n_docs])
        union += [p * n_docs + d - before, np.flatnonzero(dense)[row] * n_docs + at]
    merged = np.unique(np.concatenate([np.empty(0, np.int64), *union]))
    return np.bincount(merged // max(n_docs, 1), minlength=n_pairs).astype(np.int64), links


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b.astype(np.int64) << 32 | a.astype(np.int64)


def _keys(packed: bytes, n: int) -> np.ndarray:
    """Sorted keys, which travel as distances."""
    return np.cumsum(unpack(packed, n, np.int64))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """All pairs of a B id are of one bucket."""
    return ((key >> 32) * 2654435761 % (1 << 32)) % buckets


def encoded(docs: DataFrame, spec: str, model: bytes, id_col: str, text_col: str) -> DataFrame:
    """Blocks of rows: owners, n_a, n_b, n_groups and digests of each, distinct pairs as sorted keys, every link as its pair's number."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block = tokens_of(spec, model), TaskContext.get().partitionId() << 32
        for batch in text_runs(batches, run_bytes=BLOCK_BYTES):
            n_a, n_b, n_groups, digests, a, b = aligned(tokens, batch.column("text").to_pylist())
            found = pa.array(_key(a, b)).dictionary_encode()
            keys, rank = np.unique(found.dictionary.to_numpy(), return_inverse=True)
            codes = rank[found.indices.to_numpy()]
            yield pa.RecordBatch.from_pydict({
                "block": [block], "owners": _one(batch.column("id")), "n_a": _one(pa.array(n_a)), "n_b": _one(pa.array(n_b)), "n_groups": _one(pa.array(n_groups)), "digests": _one(pa.array(digests)),
                "n_pairs": [len(keys)], "keys": [pack(np.diff(keys, prepend=0))], "codes": [pack(codes.astype(np.uint32))],
            })
            block += 1

    return checkpointed(rows.mapInArrow(blocks, f"block long, owners array<{id_type}>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, n_pairs long, keys binary, codes binary"))


def _spread(held: DataFrame, salt_blocks: int) -> tuple[int, int, int]:
    """Buckets, salts, and partitions by block, which follow the text's tokens (about four bytes each) and the blocks."""
    total, blocks = held.agg(F.coalesce(F.sum(F.aggregate("n_a", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)), F.count(F.lit(1))).first()
    least = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, 4 * total // BUCKET_BYTES), MOST_BUCKETS), max(1, -(-blocks // salt_blocks)), max(least, min(2 * blocks, MOST_PARTITIONS))


def _postings(held: DataFrame, buckets: int, salts: int, bitmaps: bool) -> DataFrame:
    """(bucket, salt, block, n, keys, numbers, n_docs, planes): a block's pairs of one bucket, with their bitmaps if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n_docs, n, keys = len(row["n_groups"]), row["n_pairs"], _keys(row["keys"], row["n_pairs"])
                if not n:
                    continue
                place, out = _bucket(keys, buckets), []
                if bitmaps:
                    per_doc = np.array(row["n_groups"], np.int64)
                    codes = unpack(row["codes"], int(per_doc.sum()), np.uint32).astype(np.int64)
                    found, times = np.unique(codes * n_docs + np.repeat(np.arange(n_docs), per_doc), return_counts=True)
                    pair, doc = np.divmod(found, n_docs)
                    of = place[pair]
                for bucket in np.unique(place).tolist():
                    mine, planes = np.flatnonzero(place == bucket), []
                    if bitmaps:
                        some = of == bucket
                        planes = pack_planes(np.searchsorted(mine, pair[some]), doc[some], times[some], len(mine), n_docs)
                    out.append((bucket, row["block"] % salts, row["block"], len(mine), pack(np.diff(keys[mine], prepend=0)), pack(mine.astype(np.uint32)), n_docs, planes))
                kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.int64(), pa.list_(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "salt", "block", "n", "keys", "numbers", "n_docs", "planes"])

    made = held.select("block", F.col("n_groups"), "n_pairs", "keys", "codes").mapInArrow(run, "bucket long, salt long, block long, n long, keys binary, numbers binary, n_docs long, planes array<binary>")
    return made


def _sums(postings: DataFrame, buckets: int) -> DataFrame:
    """(a, b, n_docs, n_links) of all pairs: bitmaps are counted by bucket and salt, the counts are summed over salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, current = 0, None

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            total = [np.zeros(len(keys), np.int64) for _ in range(2)]
            for out, k in zip(total, (1, 2), strict=True):
                np.add.at(out, place, np.concatenate([h[k] for h in held]))
            return keys, *total

        def told() -> pa.RecordBatch:
            keys, docs, links = summed()
            return pa.RecordBatch.from_arrays([pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array((keys >> 32).astype(np.int32)), pa.array(docs), pa.array(links)], names=["a", "b", "n_docs", "n_links"])

        for batch in (whole.slice(at, 8) for whole in batches for at in range(0, whole.num_rows, 8)):
            for row in batch.to_pylist():
                if (row["bucket"], row["salt"]) != current and held:
                    yield told()
                    held, size = [], 0
                current = (row["bucket"], row["salt"])
                held.append((_keys(row["keys"], row["n"]), *count_planes(row["planes"], row["n"], row["n_docs"])))
                size += row["n"]
                if size > 2_000_000:
                    held = [summed()]
                    size = len(held[0][0])
        if held:
            yield told()

    dealt = postings.select("bucket", "salt", "n", "keys", "n_docs", "planes").repartition(buckets, "bucket", "salt").sortWithinPartitions("bucket", "salt")
    made = dealt.mapInArrow(run, "a int, b int, n_docs long, n_links long")
    return made.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))


def _pairs(postings: DataFrame, buckets: int) -> DataFrame:
    """(a, b, n_docs, n_links, n_b_links, best): with all links of the B id, and whether no pair of it has more."""
    of = Window.partitionBy("b")  # at most as many rows as A has ids
    return _sums(postings, buckets).withColumns({"n_b_links": F.sum("n_links").over(of), "best": F.col("n_links") == F.max("n_links").over(of)})


def _answers(postings: DataFrame, pairs: DataFrame, buckets: int, salts: int) -> DataFrame:
    """(block, n, numbers, scores, best): each posting's pairs with their corpus-wide scores."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            place = _bucket(key, buckets)
            links, best = batch.column("n_links").to_numpy(), batch.column("best").to_numpy(zero_copy_only=False)
            rows = [(int(k), int((some := place == k).sum()), pack(np.diff(key[some], prepend=0)), pack(links[some]), pack(best[some].astype(np.uint8))) for k in np.unique(place)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64()] + [pa.binary()] * 3, strict=True)], names=["bucket", "n", "keys", "scores", "best"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known, table = None, [], None
        for batch in (whole.slice(at, 32) for whole in batches for at in range(0, whole.num_rows, 32)):
            out = []
            for row in batch.to_pylist():
                if (row["bucket"], row["salt"]) != current:
                    current, known, table = (row["bucket"], row["salt"]), [], None
                keys = _keys(row["keys"], row["n"])
                if row["block"] is None:
                    known.append((keys, unpack(row["scores"], row["n"], np.int64), unpack(row["best"], row["n"], np.uint8)))
                    continue
                if table is None:
                    order = np.argsort(np.concatenate([k[0] for k in known]))
                    table = [np.concatenate([k[n] for k in known])[order] for n in range(3)]
                at = np.searchsorted(table[0], keys)
                if (table[0][np.minimum(at, len(table[0]) - 1)] != keys).any():
                    raise RuntimeError("a pair has no score")
                out.append((row["block"], row["n"], row["numbers"], pack(table[1][at]), pack(table[2][at])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64()] + [pa.binary()] * 3, strict=True)], names=["block", "n", "numbers", "scores", "best"])

    keyed = pairs.select((F.shiftleft(F.col("b").cast("long"), 32) + F.col("a")).alias("key"), "n_links", "best")
    keyed = keyed.repartitionByRange(buckets, "key").sortWithinPartitions("key")
    scores = keyed.mapInArrow(packed, "bucket long, n long, keys binary, scores binary, best binary").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    asked = postings.select("bucket", "salt", "block", "n", "keys", "numbers")
    met = asked.unionByName(scores, allowMissingColumns=True).repartition(buckets, "bucket", "salt")
    met = met.sortWithinPartitions("bucket", "salt", F.col("block").asc_nulls_first())
    return met.mapInArrow(answer, "block long, n long, numbers binary, scores binary, best binary")


def _tokenizers(a_path: str, b_path: str) -> tuple[str, bytes]:
    with open(b_path, "rb") as file:
        return read_tokenizer(a_path), file.read()


def pair_table(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", salt_blocks: int = SALT_BLOCKS) -> DataFrame:
    """(a, b, n_docs, n_links, n_b_links, best, share) of all pairs of ids that are linked anywhere: documents and links that
    hold the pair, links of the B id, whether no other pair of that id has more, and n_links / n_b_links."""
    held = encoded(docs.withColumn("__none", F.lit(None).cast("long")), *_tokenizers(a_path, b_path), "__none", text_col)
    buckets, salts, _ = _spread(held, salt_blocks)
    return _pairs(_postings(held, buckets, salts, True), buckets).withColumn("share", F.col("n_links") / F.col("n_b_links"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", salt_blocks: int = SALT_BLOCKS) -> DataFrame:
    """One row for each row of ``docs``: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path``: a byte-level BPE tokenizer's file, ``b_path``: a sentencepiece model that puts a space before texts.  Special tokens' strings
    inside texts are plain text.  Texts that are null or empty, or that either side does not give back byte by byte, have no tokens: zeros and ''.
    n_best: links whose pair is linked as often, corpus-wide, as any of its B id; count_sum: the pairs' links over the text's links.
    Null and repeated ids and repeated rows are rows like others; other columns do no harm; an empty table gives an empty result.  A text
    is encoded in one piece, so one text may take some hundred megabytes at most.  ``docs`` is read once.
    """
    spec, model = _tokenizers(a_path, b_path)
    held = encoded(docs, spec, model, id_col, text_col)
    id_type = held.schema["owners"].dataType.elementType.simpleString()
    buckets, salts, partitions = _spread(held, salt_blocks)
    pairs = checkpointed(_pairs(_postings(held, buckets, salts, True), buckets))
    answers = _answers(_postings(held, buckets, salts, False), pairs, buckets, salts)

    def join(found: pa.Table, block: pa.Table) -> pa.Table:
        column = lambda name: block.column(name).combine_chunks().flatten()
        per_doc, n = column("n_groups").to_numpy(), block.column("n_pairs")[0].as_py()
        if block.num_rows != 1 or sum(found.column("n").to_pylist()) != n:
            raise RuntimeError("a block lacks scores")
        scores, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for size, numbers, s, b in zip(*(found.column(c).to_pylist() for c in ("n", "numbers", "scores", "best")), strict=True):
            at = unpack(numbers, size, np.uint32)
            scores[at], best[at] = unpack(s, size, np.int64), unpack(b, size, np.uint8)
        codes, edges = unpack(block.column("codes")[0].as_py(), int(per_doc.sum()), np.uint32), _edges(per_doc)
        sums = [pa.array(np.diff(_edges(x[codes])[edges])) for x in (best, scores)]
        return pa.table({"id": column("owners"), "n_a": column("n_a"), "n_b": column("n_b"), "n_groups": column("n_groups"), "n_links": column("n_groups"), "n_best": sums[0], "count_sum": sums[1], "groups_sha256": column("digests")})

    met, kept = (t.repartition(partitions, "block").groupBy("block") for t in (answers, held.drop("keys")))
    joined = met.cogroup(kept).applyInArrow(join, f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return joined.withColumnRenamed("id", id_col)


def default_tokenizers(spark: SparkSession) -> tuple[str, str]:
    """Paths of a byte-level vocabulary and a piece model among the installed public tokenizers."""
    import public_tokenizers

    named = [spark.conf.get("chronolith.tokenizer", None), spark.conf.get("chronolith.pieces", None)]
    return tuple(given or public_tokenizers.path(name) for given, name in zip(named, ("byte_bpe_50k.json", "piece_bpe_32k.model"), strict=True))
