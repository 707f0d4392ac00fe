import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolith.llm import exact_dedup, graph, simhash

DOCS = "doc_id long, text string, keep_id string, fp string"
ROWS = [(1, "a b c", "x", "y"), (2, "a b c", None, "y"), (3, None, "x", None), (4, "", "x", "y"), (None, "a b c", "x", "y"), (5, "é " * 5000, "x", "y"), (5, "é " * 5000, "x", "y"), (6, "A b c", "x", "y"), (None, None, None, None)]


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        for top in (3, 1 << 20, (1 << 64) - 1):
            values = np.unique(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
            k, q, r = exact_dedup.rice_encode(values)
            assert (exact_dedup.rice_decode(len(values), k, q, r) == values).all()
    values = np.sort(rng.integers(0, 2**63, 100_000, dtype=np.uint64))
    assert sum(map(len, exact_dedup.rice_encode(values)[1:])) < 8 * len(values)


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [0, 1000])
def test_exact_duplicates_match_brute_force(spark, bound):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    found = exact_dedup.exact_duplicates(spark.createDataFrame(docs.collect(), DOCS), broadcast_rows=bound)
    assert sorted(map(tuple, found.collect()), key=str) == brute_exact(ROWS)
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_drop_exact_duplicates_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == ["doc_id", "text", "keep_id", "fp"]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(["2", "4", "5", "6"])
    nobody = spark.createDataFrame([(None, "x"), (None, "x"), (None, None), (3, "y"), (3, "z")], "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in exact_dedup.drop_exact_duplicates(nobody).collect()) == sorted(["(None, 'x')", "(None, None)", "(3, 'y')", "(3, 'z')"])


def brute_simhash(text, words):
    tokens = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(sorted(nodes), 2):
        if near(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_of_a_text():
    for text in ("", "one", "One two\tthree", "a b c d e f g h", "É É é a\nb a b a b a b"):
        assert simhash.simhash(text.encode(), 4) == brute_simhash(text, 4)


def test_components_of_a_long_chain(spark):
    rng = random.Random(3)
    order = list(range(200))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199) if i != 99] + [(1, 1), (None, 2)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: min(half) for half in (order[:100], order[100:]) for n in half}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("crowded", [20_000, 20])
def test_near_links_match_all_pairs(spark, crowded):
    """Random fingerprints, a dense cluster and a chain; with a low bound the crowded path gives the same components."""
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    centre, walk = rng.getrandbits(64), rng.getrandbits(64)
    for _ in range(120):
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
        walk ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
        values.add(walk)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = simhash.near_links(frame, 4, crowded)
    got = {r.node: r.root for r in graph.connected_components(links).collect()}
    want = brute_components({signed(v) for v in values}, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {n: got.get(n, n) for n in want} == want


def test_near_duplicates_of_odd_rows(spark):
    rows = [(7, "same words in this text here", 1), (3, "Same words in this text here", 2), (None, "same words in this text here", 3), (9, None, 4), (8, " \n", 5), (8, " \n", 5), (1, "w " * 50_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, words=4).collect())
    print_of = lambda t: format(brute_simhash(t or "", 4), "016x")
    want = sorted((str(i), print_of(t), {7: 3, 3: 3, None: 3, 9: 8, 8: 8, 1: 1}[i]) for i, t, _ in rows)
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "8"]
    assert simhash.near_duplicates(spark.createDataFrame([], docs.schema)).count() == 0


def test_crowded_buckets_are_dealt_until_nothing_is_lost(spark):
    """All fingerprints agree on most bits, so every bucket is crowded at first."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(8, 60, 2), rng.randint(0, 9))) for _ in range(400)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.near_links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), 4, 30)
    got = {r.node: r.root for r in graph.connected_components(links).collect()}
    want = brute_components({signed(v) for v in values}, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {n: got.get(n, n) for n in want} == want
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 4 for u, v in links.collect())


def test_mask_sets_of_open_bits_cover_every_pair():
    agreed = sum(1 << b for b in range(0, 64, 2))
    for mask in simhash.bucket_masks(4, 10**5, agreed):
        assert mask & agreed == agreed
    rng = random.Random(2)
    for _ in range(2000):
        flip = sum(1 << b for b in rng.sample(range(1, 64, 2), 4))
        assert any(flip & m == 0 for m in simhash.bucket_masks(4, 10**5, agreed))


def test_mask_sets_cover_every_pair():
    for count in (10, 10**6, 10**11):
        masks = simhash.bucket_masks(4, count)
        rng = random.Random(count)
        for _ in range(2000):
            flip = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flip & m == 0 for m in masks)
