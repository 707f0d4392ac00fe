"""Byte-level BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

Texts are split into words (the tokenizer's pre-tokens) in Spark tasks.  A block is a run of rows of some megabytes of text.
Each block sends its distinct words once, packed, to the word table, which is dealt in buckets by hash of the word: there
every distinct word is encoded once, and its ids go back, packed, to each block that holds it.  A block's texts travel as
compressed word numbers and meet those ids in a cogroup, so no task holds more than a block and no dictionary is broadcast.

Decoding goes the same way: the distinct ids of a block are joined to the table of pieces, and the block's ids meet those
pieces in a cogroup.  :func:`round_trip` lets words' ids and ids' pieces meet a block in one cogroup.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronolith.llm.common import hand_back, text_or_empty, text_runs

#: The pre-token pattern of this family of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Text of a block, which one task holds at a time.
BLOCK_BYTES = 8_000_000
#: Text for each bucket of the word table, and the most buckets, as each block sends a row to each.
BUCKET_BYTES, MOST_BUCKETS = 16_000_000, 4096
#: Words of a bucket whose ids are remembered at once; beyond it they are forgotten, and encoded anew if they come again.
MOST_KNOWN = 200_000
#: Rows of the word table that a task unpacks at once.
STEP = 32
#: Words of a block's texts (one text at least) that are written out as ids and text at once.
RUN_WORDS = 200_000
#: Most shuffle partitions that the size of the input asks for by itself.
MOST_PARTITIONS = 20_000


def read_tokenizer(path: str) -> str:
    """The tokenizer file's JSON, without truncation and padding.  It is read on the driver and travels with tasks."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in their neighbours are not supported")
    spec["truncation"] = spec["padding"] = None
    return json.dumps(spec)


class Splitter:
    """Cuts a text into words: added tokens are words of their own, the rest is cut as the tokenizer cuts it."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        added = sorted((t["content"] for t in json.loads(spec)["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.find = regex.compile(PATTERN).findall
        # beyond the first plane, Unicode versions of the two libraries differ; such texts go to the tokenizer's own splitter
        self.beyond = re.compile("[\U00010000-\U0010ffff]").search

    def plain(self, text: str) -> list[str]:
        if self.beyond(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def __call__(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return [w for n, part in enumerate(parts) for w in ([part] if n % 2 else self.plain(part))]


@lru_cache(maxsize=2)
def splitter_of(spec: str) -> Splitter:
    """Kept by the Python worker from task to task, as reading a tokenizer takes long."""
    return Splitter(spec)


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, compressed: bytes of one weight stand together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return pa.Codec("zstd", compression_level=6).compress(planes, asbytes=True)


def unpack(packed: bytes, n: int, kind: np.dtype | type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.decompress(packed, n * size, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _split_texts(splitter: Splitter, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the most frequent first; the number in that order of every word in turn; words per text.

    Words are numbered by runs, whose dictionaries are then unified, so that they are never held one by one for a whole block.
    """
    counts, chunks, held = np.zeros(len(texts), np.int64), [], []
    for n, text in enumerate(texts):
        words = splitter(text.as_py())
        counts[n] = len(words)
        held += words
        if len(held) > 100_000:
            chunks.append(pa.array(held, pa.string()).dictionary_encode())
            held = []
    coded = pa.chunked_array([*chunks, pa.array(held, pa.string()).dictionary_encode()]).unify_dictionaries()
    distinct, indices = coded.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    order = np.argsort(-np.bincount(indices, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return distinct.take(pa.array(order)), rank[indices], counts


def _blocks(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[tuple]:
    """Runs of rows of about ``BLOCK_BYTES`` of text (one row at least): number, rows, and what :func:`_split_texts` gives."""
    splitter, number = splitter_of(spec), TaskContext.get().partitionId() << 32
    for rows in text_runs(batches, run_bytes=BLOCK_BYTES):
        yield (number, rows, *_split_texts(splitter, rows.column("text")))
        number += 1


def _shuffles(rows: DataFrame) -> tuple[int, int]:
    """Buckets of the word table, and partitions by block, for the text of ``rows``: both follow its bytes."""
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, -(-total // BUCKET_BYTES)), MOST_BUCKETS), max(least, min(2 * -(-total // BLOCK_BYTES), MOST_PARTITIONS))


def _binary(edges: np.ndarray, data: bytes) -> pa.BinaryArray:
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _bytes_of(values: pa.Array) -> memoryview:
    return memoryview(values.buffers()[2] or b"")


def _coded(rows: DataFrame, spec: str, small: np.dtype, buckets: int) -> DataFrame:
    """(block, n, numbers, sizes, ids, used): a block's words of one bucket, by number, with their ids, and the distinct ids."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's distinct words by bucket of the word table: their numbers, sizes and bytes, packed."""
        zstd = pa.Codec("zstd", compression_level=6)
        for block, _, distinct, _, _ in _blocks(batches, spec):
            if not len(distinct):
                continue
            listed = distinct.cast(pa.binary())
            place = np.fromiter(map(zlib.crc32, listed.to_pylist()), np.int64, len(listed)) % buckets
            order = np.argsort(place, kind="stable")
            sizes = pc.binary_length(listed).to_numpy(zero_copy_only=False).astype(np.uint32)[order]
            data, ends = _bytes_of(listed.take(pa.array(order))), _edges(sizes)
            edges = np.append(np.flatnonzero(np.diff(place[order], prepend=-1)), len(order))
            out = [(int(place[order[x]]), block, y - x, pack(order[x:y].astype(np.uint32)), pack(sizes[x:y]), zstd.compress(data[ends[x] : ends[y]], asbytes=True)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["bucket", "block", "n", "numbers", "sizes", "words"])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word of a bucket encoded once; its ids for every block that sent it, packed."""
        tokenizer, known, current = splitter_of(spec).tokenizer, {}, None
        for batch in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):  # sorted by bucket
            out = []
            for bucket, block, n, numbers, sizes, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != current or len(known) > MOST_KNOWN:
                    known, current = {}, bucket
                ends = _edges(unpack(sizes, n, np.uint32)).tolist()
                data = pa.decompress(words, ends[-1], "zstd", asbytes=True)
                listed = [data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                fresh = [w for w in listed if w not in known]
                for word, found in zip(fresh, tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False), strict=True):
                    known[word] = np.array(found.ids, small).tobytes()
                ids = [known[w] for w in listed]
                flat = np.frombuffer(b"".join(ids), small)
                out.append((block, n, numbers, pack(np.fromiter(map(len, ids), np.uint32, n)), pack(flat), np.unique(flat).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["block", "n", "numbers", "sizes", "ids", "used"])

    dealt = rows.select("text").mapInArrow(words, "bucket long, block long, n long, numbers binary, sizes binary, words binary")
    dealt = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(table, "block long, n long, numbers binary, sizes binary, ids binary, used array<int>")


def _pieces(used: DataFrame, spec: str) -> DataFrame:
    """(block, piece_ids, pieces): the distinct ids of each block of ``used`` (block, used) joined to the table of pieces."""
    listed = piece_table(spec)
    table = used.sparkSession.createDataFrame(pa.table({"id": pa.array(range(len(listed)), pa.int32()), "piece": pa.array(listed, pa.binary())}))
    ids = used.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("ids"))
    asked = ids.select("block", F.explode("ids").alias("id"))
    # the vocabulary's size is fixed by the tokenizer; it also bounds what a block asks for
    return asked.join(F.broadcast(table), "id").groupBy("block").agg(F.collect_list("id").alias("piece_ids"), F.collect_list("piece").alias("pieces"))


def _texts_of(ids: np.ndarray, ends: np.ndarray, piece_ids: np.ndarray, pieces: pa.Array) -> pa.Array:
    """Texts of the runs of ``ids`` that ``ends`` cut; bytes that are not UTF-8 become U+FFFD; an unknown id is an error."""
    ids = ids.astype(np.int32)
    place = np.full(max(piece_ids.max(initial=-1), ids.max(initial=-1)) + 1, -1, np.int32)
    place[piece_ids] = np.arange(len(piece_ids))
    if len(ids) and (ids.min() < 0 or place[ids].min() < 0):
        raise ValueError("an id without a piece")
    found = pieces.cast(pa.binary()).take(pa.array(place[ids]))
    cut, data = _edges(pc.binary_length(found).to_numpy(zero_copy_only=False))[ends], _bytes_of(found)
    texts = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(cut.astype(np.int32).tobytes()), pa.py_buffer(data))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([str(data[a:b], "utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.string())
    return texts


def _written(owners: pa.Array, counts: np.ndarray, codes: np.ndarray, known: pa.BinaryArray, small: np.dtype, pieces: tuple[np.ndarray, pa.Array] | None) -> pa.Table:
    """(id, ids, and, if ``pieces`` are given, text) of a block's texts, whose words ``counts`` and ``codes`` give by number.

    Texts are written by runs of ``RUN_WORDS``, so besides the result only a run is held.
    """
    cut, parts = _edges(counts), []
    starts = np.flatnonzero(np.diff(cut[:-1] // RUN_WORDS, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(counts)], strict=True):
        joined = known.take(pa.array(codes[cut[a] : cut[b]]))
        sizes = _edges(pc.binary_length(joined).to_numpy(zero_copy_only=False) // small.itemsize)
        ids, ends = np.frombuffer(_bytes_of(joined), small, count=sizes[-1]), sizes[cut[a : b + 1] - cut[a]]
        part = {"id": owners.slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))}
        if pieces:
            part["text"] = _texts_of(ids, ends, *pieces)
        parts.append(pa.table(part))
    return pa.concat_tables(parts)


def _encoded(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    """(id, ids, and, if ``decoded``, the text of the ids) of every row."""
    spec = read_tokenizer(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    small = np.dtype(np.uint16 if len(piece_table(spec)) <= 1 << 16 else np.uint32)
    buckets, partitions = _shuffles(rows)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch, distinct, codes, counts in _blocks(batches, spec):
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), _one(batch.column("id")), _one(pa.array(counts)), pa.array([len(distinct)], pa.int64()), pa.array([pack(codes)], pa.binary())],
                names=["block", "owners", "counts", "n_words", "codes"],
            )

    def join(found: pa.Table, block: pa.Table) -> pa.Table:
        hand_back()
        words = found.filter(pc.is_valid(found.column("n")))
        if block.num_rows != 1 or sum(words.column("n").to_pylist()) != block.column("n_words")[0].as_py():
            raise RuntimeError("the table gave other rows when it was read again")
        counts = block.column("counts").combine_chunks().flatten().to_numpy()
        numbers, lengths, data = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], []
        for n, number, sizes, ids in zip(*(words.column(c).to_pylist() for c in ("n", "numbers", "sizes", "ids")), strict=True):
            numbers.append(unpack(number, n, np.uint32))
            lengths.append(unpack(sizes, n, np.uint32))
            data.append(unpack(ids, int(lengths[-1].sum()) // small.itemsize, small).tobytes())
        known = _binary(_edges(np.concatenate(lengths)), b"".join(data)).take(pa.array(np.argsort(np.concatenate(numbers))))
        codes, pieces = unpack(block.column("codes")[0].as_py(), int(counts.sum()), np.uint32), None
        if decoded:
            listed = found.filter(pc.is_valid(found.column("piece_ids"))).combine_chunks()
            pieces = listed.column("piece_ids").combine_chunks().flatten().to_numpy(), listed.column("pieces").combine_chunks().flatten()
        return _written(block.column("owners").combine_chunks().flatten(), counts, codes, known, small, pieces)

    coded = _coded(rows, spec, small, buckets)
    met = coded.drop("used")
    if decoded:
        met = met.unionByName(_pieces(coded.select("block", "used"), spec), allowMissingColumns=True)
    held = rows.mapInArrow(positions, f"block long, owners array<{id_type}>, counts array<bigint>, n_words long, codes binary")
    met, held = (t.repartition(partitions, "block").groupBy("block") for t in (met, held))
    joined = met.cogroup(held).applyInArrow(join, f"id {id_type}, ids array<int>" + ", text string" * decoded)
    return joined.withColumnRenamed("id", id_col)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text, as the tokenizer encodes it without adding special tokens.

    Null texts count as empty and give no ids; repeated rows, null ids and other columns do no harm; an empty table gives
    an empty result.  ``docs`` is read three times (once for its size) and must give the same partitions each time, as
    files and checkpoints do; a block whose words don't match is an error, never a wrong result.
    """
    return _encoded(docs, tokenizer_path, id_col, text_col, decoded=False)


def piece_table(spec: str) -> list[bytes]:
    """Bytes of every id.  Byte-level vocabularies write a byte that has no printable character as one of U+0100 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in printable}
    byte |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    model = json.loads(spec)
    pieces = {i: bytes(byte[c] for c in token) for token, i in model["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
    return [pieces.get(i) for i in range(max(pieces) + 1)]


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, text) of every row's ids, special tokens written out; null ids count as none.

    The distinct ids of each block of rows are joined to the table of pieces; the block then meets its pieces in a cogroup.
    Bytes that are not UTF-8 become U+FFFD.  An id without a piece is an error.  Repeated rows and null row ids do no harm;
    an empty table gives an empty result.  ``encoded`` is read twice and must give the same partitions both times, as files
    and checkpoints do; a block that lacks pieces is an error.
    """
    spec = read_tokenizer(tokenizer_path)
    rows = encoded.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"kept_{n}") for n, c in enumerate(keep)], F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    rows = rows.withColumn("size", F.size("ids"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            starts = np.flatnonzero(np.diff(np.cumsum(batch.column("size").to_numpy(), dtype=np.int64) // (BLOCK_BYTES // 4), prepend=-1))
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                yield number, batch.slice(a, b - a)
                number += 1

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number]), _one(pc.unique(batch.column("ids").flatten()))], names=["block", "used"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, number)), *batch.columns], names=["block", *batch.schema.names])

    def join(pieces: pa.Table, block: pa.Table) -> pa.Table:
        lists = block.column("ids").combine_chunks()
        of = lambda c, kind: pieces.column(c).combine_chunks().flatten() if pieces.num_rows else pa.array([], kind)
        texts = _texts_of(lists.flatten().to_numpy(), _edges(block.column("size").to_numpy()), of("piece_ids", pa.int32()).to_numpy(), of("pieces", pa.binary()))
        return block.drop_columns(["block", "ids", "size"]).append_column("text", texts)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    held = rows.mapInArrow(numbered, f"block long, {fields}")
    pieces = _pieces(rows.mapInArrow(used, "block long, used array<int>"), spec)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    joined = pieces.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(join, f"{kept}, text string")
    return joined.toDF(id_col, *keep, "text")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, (ids,) n_tokens, and digests of the ids and of the text decoded from them.

    Odd rows are dealt with as by :func:`encode` and :func:`decode`; the table of words is computed twice, once for the
    ids that blocks use.
    """
    both = _encoded(docs, tokenizer_path, id_col, text_col, decoded=True)
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return both.select(id_col, *["ids"] * keep_ids, F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def default_tokenizer(spark: SparkSession) -> str:
    """Path of the 50k byte-level vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return spark.conf.get("chronolith.tokenizer", None) or public_tokenizers.path("byte_bpe_50k.json")
