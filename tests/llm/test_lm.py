import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chronolith.llm import lm


def corpus(n=300):
    rng = random.Random(2)
    kinds = [[f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)], ["the", "a"]]
    rows = []
    for i in range(n):
        text = " ".join(f"{rng.choice(kinds[2])} {rng.choice(kinds[0])} {rng.choice(kinds[1])}" for _ in range(rng.randint(1, 12)))
        rows.append((i, text + (f" Rare{i % 50}x\tÉ{i}" if i % 3 else ""), "clash"))
    return rows + [(n, None, "c"), (n + 1, "", "c"), (n + 1, "", "c"), (None, "the the n1", "c"), (n + 2, "the v3 " * 4000, "c")]


def split(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.replace("\t", " ").split(" ") if w]


def test_base_scores_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    docs, training = lm.split_by_fold(docs)
    model = lm.train(training, classes=8, min_count=1, min_share=0.002, rounds=4)
    got = lm.score(docs, model).withColumn("held_out", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    counts = Counter(t for i, text, _ in rows if not held(i) for t in [*split(text), None])
    total, size = sum(counts.values()), len(counts)
    assert (model.train_tokens, model.vocabulary) == (total, size)
    want = sorted((str(i), len(split(t)) + 1, sum(counts[w] > 0 for w in [*split(t), None]), round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (size + 1))) for w in [*split(t), None]), 5)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    base, score = (sum(r[c] for r in got if r.held_out) for c in ("base_score", "score"))
    assert score > 0.75 * base  # nearer to zero: classes predict better than counts


def test_the_model_is_a_distribution(spark):
    """Over one next token, known words, one unknown word of each shape and the end sum to 1, from any class."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, score string")
    model = lm.train(docs, classes=8, min_count=1, min_share=0.002, rounds=2)
    words = sorted({w for _, t, _ in corpus() for w in split(t)})
    import pyarrow as pa

    hashes, shapes, codes, _ = lm.words_of(pa.array(words))
    hashes, shapes = hashes[codes], shapes[codes]
    symbol, place = model.symbols.number(hashes, shapes)
    n = {r.key: r.n for r in model.counts.collect()}
    mass = 10.0 ** model.emission
    counts = np.array([n[int(h)] for h in hashes])
    inside = np.where(place >= 0, 1.0, (counts + lm.DELTA) / 10.0 ** model.rare[shapes])
    per_class = np.bincount(model.classes[symbol], weights=mass[symbol] * inside, minlength=8)
    unknown = lm.DELTA / 10.0**model.rare
    at = len(model.symbols.hashes) + np.arange(lm.SHAPES)
    per_class += np.bincount(model.classes[at], weights=mass[at] * unknown, minlength=8)
    per_class[model.classes[model.symbols.end]] += mass[model.symbols.end]
    total = (10.0**model.transition * per_class).sum(axis=1)
    assert np.allclose(total, 1.0, atol=1e-6)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = lm.train(none, classes=4)
    assert lm.score(none, model).count() == 0
    assert [(r.n_tokens, r.n_known) for r in lm.score(some, model).collect()] == [(3, 0)]


def test_model_scores_match_brute_force(spark):
    """log10 of class transition, symbol in its class, and word in its shape, token by token."""
    import xxhash

    docs = spark.createDataFrame(corpus(), "doc_id long, text string, score string")
    model = lm.train(docs, classes=8, min_count=2, min_share=0.002, rounds=3)
    place = {int(h): n for n, h in enumerate(model.symbols.hashes)}
    counts = {r.key: r.n for r in model.counts.collect()}
    got = sorted((str(r.doc_id), round(r.score, 5)) for r in lm.score(docs, model).collect())
    want = []
    for i, text, _ in corpus():
        last, total = model.symbols.end, 0.0
        for word in [*split(text), None]:
            extra, symbol = 0.0, model.symbols.end
            if word is not None:
                data = word.encode()
                key = int(np.uint64(xxhash.xxh64_intdigest(data, 42)).view(np.int64))
                shape = (data[-1] * 31 + data[max(len(data) - 2, 0)]) % (lm.SHAPES // 2) * 2 + (len(data) > 8)
                symbol = place.get(key, len(place) + shape)
                if key not in place:
                    extra = math.log10(counts.get(key, 0) + lm.DELTA) - model.rare[shape]
            total += model.transition[model.classes[last], model.classes[symbol]] + model.emission[symbol] + extra
            last = symbol
        want.append((str(i), round(total, 5)))
    assert got == sorted(want)


def test_exchange_goes_on_and_beats_frequency_classes(spark):
    docs = spark.createDataFrame(corpus(600), "doc_id long, text string, score string")
    docs, training = lm.split_by_fold(docs)
    one, many = (lm.train(training, classes=6, min_count=2, min_share=0.0, rounds=n) for n in (0, 12))
    assert len(one.history) == 1 and len(many.history) > 3
    assert all(b > a for a, b in zip(many.history[:-1], many.history[1:], strict=True))
    total = [lm.score(docs.where("held_out"), m).agg(F.sum("score")).first()[0] for m in (one, many)]
    assert total[1] > total[0]


def test_best_moves_match_brute_force():
    rng = np.random.default_rng(7)
    counts = rng.integers(5, 60, (5, 5)).astype(float)
    left, right, own = rng.integers(0, 3, (20, 5)).astype(float), rng.integers(0, 3, (20, 5)).astype(float), rng.integers(1, 5, 20)
    best, gain = lm.best_moves(left, right, own, counts)
    x = lambda v: float(np.where(v > 0, v * np.log(np.maximum(v, 1e-300)), 0).sum())
    for n in range(20):
        found = []
        for c in range(1, 5):
            rows = [counts[c] - (c == own[n]) * right[n], counts[:, c] - (c == own[n]) * left[n]]
            out, into = counts[c].sum() - (c == own[n]) * right[n].sum(), counts[:, c].sum() - (c == own[n]) * left[n].sum()
            found.append(x(rows[0] + right[n]) - x(rows[0]) + x(rows[1] + left[n]) - x(rows[1]) - x(out + right[n].sum()) + x(out) - x(into + left[n].sum()) + x(into))
        assert best[n] == 1 + int(np.argmax(found)) and abs(gain[n] - (max(found) - found[own[n] - 1])) < 1e-6


def test_no_share_of_the_tokens_leaves_words_out(spark):
    """Words of ``min_count`` occurrences are clustered, however small a share of a large corpus they are."""
    rows = [(i, "the " * 100_000 + f"once{i} " + f"twice{i} " * 2) for i in range(6)]
    model = lm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), classes=4, min_count=2, rounds=1)
    kinds = {r.key: r.kind for r in model.words.collect()}
    model_once = lm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), classes=4, min_count=1, rounds=0)
    assert len(kinds) == 13 and sum(k >= 0 for k in kinds.values()) == 7
    assert len(model_once.symbols.hashes) == 13


def test_stripes_and_segments_change_nothing(spark):
    """Symbols beyond one stripe and one segment: classes and likelihoods are those of one."""
    docs = spark.createDataFrame(corpus(200), "doc_id long, text string, score string")
    one, cut = (lm.train(docs, classes=6, min_count=1, rounds=2, **sizes) for sizes in ({}, {"stripe": 32, "segment": 64}))
    assert len(one.history) > 1 and one.history == cut.history
    assert np.array_equal(one.classes, cut.classes) and np.array_equal(one.transition, cut.transition) and np.array_equal(one.emission, cut.emission)


def test_best_moves_try_all_classes():
    rng = np.random.default_rng(5)
    k = 60
    counts = np.where(rng.random((k, k)) < 0.1, rng.integers(1, 4000, (k, k)), 0).astype(float)
    left, right = (np.where(rng.random((60, k)) < 0.2, rng.integers(0, 300, (60, k)), 0).astype(float) for _ in range(2))
    own = np.arange(60) % (k - 1) + 1
    best, gain = lm.best_moves(left, right, own, counts)
    for n in range(60):
        total = np.zeros(k)
        for c in range(1, k):
            out, into, n_out, n_in = counts[c], counts[:, c], counts[c].sum(), counts[:, c].sum()
            if c == own[n]:
                out, into, n_out, n_in = np.maximum(out - right[n], 0), np.maximum(into - left[n], 0), n_out - right[n].sum(), n_in - left[n].sum()
            total[c] = sum((lm._xlogx(a + b) - lm._xlogx(a)).sum() for a, b in ((out, right[n]), (into, left[n])))
            total[c] -= sum(float(lm._xlogx(np.array(a + b)) - lm._xlogx(np.array(a))) for a, b in ((n_out, right[n].sum()), (n_in, left[n].sum())))
        assert best[n] == 1 + int(np.argmax(total[1:])) and abs(gain[n] - (total[1:].max() - total[own[n]])) < 1e-6


def test_contexts_lie_in_few_partitions(spark):
    """Every round reads them several times; a partition for each half block cost more than the counts in it."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, score string").repartition(12)
    blocks = lm.cut(docs, None)
    counts = blocks.select(F.inline(F.arrays_zip("keys", "n", "shapes"))).select(F.col("keys").alias("key"), "n", F.col("shapes").cast("int").alias("shape")).groupBy("key").agg(F.sum("n").alias("n"), F.min("shape").alias("shape"))
    words, stripes = lm.number_words(counts, 2, 64)
    contexts = lm.symbol_contexts(blocks, words, stripes, 64, 128)
    assert blocks.count() == 12 and contexts.rdd.getNumPartitions() == 4  # as shuffles have here
    cells = [tuple(r) for r in contexts.select("i", "j", "side", "m", "data").collect()]
    assert len({c[:3] for c in cells}) == len(cells) and sum(c[3] for c in cells if c[2]) == sum(c[3] for c in cells if not c[2])
    for _, _, _, m, data in cells:
        s, o, _ = lm.unsqueeze_cell(data, m, 128)
        assert (np.diff(s.astype(np.int64) * 128 + o) > 0).all()


def test_cells_take_little_room():
    """Entries in order take less as steps than as numbers of their own, and come back as they were."""
    rng = np.random.default_rng(3)
    key = np.sort(rng.choice(2048 * 300_000, 200_000, replace=False))
    s, o, n = key // 300_000, key % 300_000, rng.integers(1, 4, len(key), dtype=np.uint64)
    data = lm.squeeze_cell(s, o, n, lm.SEGMENT)
    assert all((a == b).all() for a, b in zip(lm.unsqueeze_cell(data, len(key), lm.SEGMENT), (s, o, n), strict=True))
    assert len(data) < 0.92 * len(lm.squeeze(s.astype(np.uint16), o.astype(np.uint32), n))
    assert all(len(x) == 0 for x in lm.unsqueeze_cell(lm.squeeze_cell(s[:0], o[:0], n[:0], 64), 0, 64))
