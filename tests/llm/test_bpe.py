import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chronolith.llm import bpe

TEXTS = [None, "", "a", " leading and  double  spaces \n\n\ttabs\r\n", "I'll say we've can't 's 'S", "<|endoftext|>", "x<|endoftext|><|endoftext|> y <|endoftext", "naïve 北京    1234 ½ é", "\U0001f600\U0001f600 ok \U00016aab \U0001d7d8", "�\x00\x1c\x1d\x85 z", "word " * 30_000, "!!!???'''s 's's", "same", "same"]

#: Pools that arrays may still be of.
POOLS = []


@pytest.fixture(scope="module")
def path():
    return __import__("public_tokenizers").path("byte_bpe_50k.json")


def test_round_trip_matches_the_library(spark, path):
    tokenizer = Tokenizer.from_file(path)
    rows = [(n if n != 3 else None, t, "clash") for n, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    docs = spark.createDataFrame(docs.repartition(3).collect(), docs.schema)
    got = sorted(map(tuple, bpe.round_trip(docs, path).collect()), key=str)
    want = []
    for n, text, _ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((n, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back))))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(spark.createDataFrame([], docs.schema), path).count() == 0


def test_decode_of_broken_and_empty_ids(spark, path):
    tokenizer = Tokenizer.from_file(path)
    rows = [(1, [50256, 162]), (2, []), (3, None), (4, tokenizer.encode("fine").ids)]
    got = dict(bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), path).collect())
    assert got == {1: tokenizer.decode([50256, 162], skip_special_tokens=False), 2: "", 3: "", 4: "fine"}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.read_tokenizer(__import__("public_tokenizers").path("word_bpe_49k.json"))


def test_a_block_is_split_and_written_by_runs(path):
    """Arrow holds little more than numbers of words while a block is split, and than the result while it is written."""
    spec, rng = bpe.read_tokenizer(path), random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(2000)] + ["", "one"]
    size, splitter, tokenizer = sum(map(len, texts)), bpe.Splitter(spec), Tokenizer.from_str(spec)
    usual = pa.default_memory_pool()

    def peak(run):
        pool = pa.proxy_memory_pool(usual)
        POOLS.append(pool)
        pa.set_memory_pool(pool)
        try:
            return run(), pool.max_memory()
        finally:
            pa.set_memory_pool(usual)

    column = pa.array(texts)
    (distinct, codes, counts), most = peak(lambda: bpe._split_texts(splitter, column))
    assert most < 2 * size
    assert distinct.take(pa.array(codes[: counts[0]])).to_pylist() == splitter(texts[0]) and counts.tolist()[-2:] == [0, 1]
    ids = [np.array(e.ids, np.uint16).tobytes() for e in tokenizer.encode_batch(distinct.to_pylist(), add_special_tokens=False)]
    listed = bpe.piece_table(spec)
    pieces = np.arange(len(listed), dtype=np.int32), pa.array(listed, pa.binary())
    table, most = peak(lambda: bpe._written(pa.array(range(len(texts))), counts, codes, pa.array(ids, pa.binary()), np.dtype(np.uint16), pieces))
    assert most < 1.6 * table.nbytes
    assert table.column("text").to_pylist() == texts and table.column("id").to_pylist() == list(range(len(texts)))
    assert table.column("ids").to_pylist() == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
