"""The pipeline's near-duplicate stage against brute force over shingle sets."""

import random

import numpy as np

import corpus_pipeline
from chronolith.llm import minhash
from tests.llm.test_duplicates import brute_components


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_copies_of_similarity_08_go(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    texts = []
    for n in range(60):
        own = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(own))
        for _ in range(3):
            copy = list(own)
            for _ in range(max(1, len(own) * (n % 5) // 150)):  # each changed word costs about five shingles
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, "two words", "TWO  words", "two other"]
    sets = [shingles(t) for t in texts]
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = brute_components(range(len(texts)), near)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near(spark, docs, "").collect()}
    assert kept == {i for i in root if root[i] == i}
    assert 65 < len(kept) < 200


def test_buckets_in_parts_give_the_same_pairs(spark, monkeypatch):
    """Texts that share a long passage but not enough, a few of them near copies; any size of parts gives what all pairs give."""
    rng = random.Random(3)
    passage = " ".join(f"p{n}" for n in range(40))
    texts = [passage + " " + " ".join(f"w{rng.randint(0, 10_000)}" for _ in range(rng.randint(18, 30))) for _ in range(150)]
    texts += [t + " more" for t in texts[::7]]
    sets = [shingles(t) for t in texts]
    root = brute_components(range(len(texts)), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part in (4096, 16):
        monkeypatch.setattr(minhash, "PART", part)
        assert {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()} == {i for i in root if root[i] == i}


def test_links_inside_a_bucket_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, int(n), dtype=np.uint64)) for n in rng.integers(80, 120, 30)]
    for n in range(10):
        sets[20 + n] = np.unique(np.concatenate((sets[n][: int(len(sets[n]) * rng.choice([0.7, 0.95]))], sets[20 + n][:4])))
    low = np.array([np.frombuffer(minhash.signature(s)[1], np.uint8) for s in sets])
    node, size, part = np.arange(30) * 7, np.array([len(s) for s in sets]), rng.integers(0, 2, 30)
    jaccard = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    for parts in (part, np.zeros(30, int)):
        u, v = minhash._compare(parts, node, size, node.copy(), low, sets)
        want = brute_components(range(30), lambda i, j: jaccard(i, j) >= 0.8 and (parts[i] != parts[j] or not parts.any()))
        got = brute_components(range(30), lambda i, j: (7 * i, 7 * j) in set(zip(u, v, strict=True)) | set(zip(v, u, strict=True)))
        assert got == want and u
    # what is one component already is not looked at
    assert minhash._compare(np.zeros(30, int), node, size, np.zeros(30, int), low, sets) == ([], [])
