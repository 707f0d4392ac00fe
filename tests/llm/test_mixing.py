import math
import random

import pytest

from chronolith.llm import mixing

SCHEMA = "doc_id long, text string, lang string, rate string"


def corpus(n=400):
    rng = random.Random(11)
    words = {d: [f"{d}{i}" for i in range(60)] for d in ("a", "b", "c", "x")}
    docs, labels = [], []
    for i in range(n):
        d = "aaaabbc"[i % 7]
        docs.append((i, " ".join(rng.choice(words[d if rng.random() < 0.4 else "x"]) for _ in range(rng.randint(5, 200))), "en", "clash"))
        if i % 2:
            labels.append((i, d))
    return docs + [(n, None, None, "c"), (n + 1, " \n", None, "c"), (None, "a1 a2", None, "c"), (n + 2, "a1 a2", None, "c"), (n + 2, "a1 a2", None, "c")], labels + [(None, "a"), (1, "odd"), (9999, "a")]


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, domain string")


def test_expected_totals_meet_targets(spark):
    docs, labels = frames(spark)
    weights = {"a": 0.3, "b": 0.3, "c": 0.4}
    rows = mixing.mix(docs, labels, weights).collect()
    assert len(rows) == docs.count()
    total = sum(r.tokens for r in rows)
    for d, w in weights.items():
        assert abs(sum(r.rate * r.tokens * r[f"p_{d}"] for r in rows) - w * total) <= 2e-3 * total
        assert abs(sum(r.copies * r.tokens * r[f"p_{d}"] for r in rows) - w * total) <= 0.12 * total
    assert all(0 <= r.rate <= 4 and abs(r.copies - r.rate) < 1 and abs(r.p_a + r.p_b + r.p_c - 1) < 1e-9 for r in rows)
    assert sum(max("abc", key=lambda d: r[f"p_{d}"]) == "aaaabbc"[r.doc_id % 7] for r in rows[:] if r.doc_id is not None and r.doc_id < 400) > 380


@pytest.mark.parametrize("most", [1.0, 4.0])
def test_rates_match_a_plain_projected_gradient(spark, most):
    rng = random.Random(2)
    rows = [(rng.randint(1, 50), (p := rng.random()), 1 - p) for _ in range(60)]
    table = spark.createDataFrame([(n, [p, q]) for n, p, q in rows], "tokens long, p array<double>")
    total = sum(n for n, _, _ in rows)
    targets = [1.3 * sum(n * p for n, p, _ in rows), 0.2 * sum(n * q for n, _, q in rows)]
    rate = mixing.fit_rates(table, targets, most, pull=0.05, tolerance=0, steps=40)
    got = [r[0] for r in table.select(rate).collect()]
    want, weight = [1.0] * len(rows), [sum(n * p for n, p, _ in rows) / total, sum(n * q for n, _, q in rows) / total]
    for _ in range(40):
        off = [(sum(n * (p, q)[k] * r for (n, p, q), r in zip(rows, want, strict=True)) - targets[k]) / total / weight[k] for k in range(2)]
        want = [min(most, max(0.0, r - (p * off[0] + q * off[1] + 0.05 * (r - 1)) / 1.05)) for (_, p, q), r in zip(rows, want, strict=True)]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9 and max(got) <= most


def test_copies_take_effect(spark):
    docs, labels = frames(spark)
    weights = {"a": 0.3, "b": 0.3, "c": 0.4}
    copies = {}
    for r in mixing.mix(docs, labels, weights).collect():
        copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copies)
    out = mixing.apply_mix(docs, labels, weights)
    assert out.columns == docs.columns
    seen, rows = {}, {}
    for r in out.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    for r in docs.collect():
        rows[r.doc_id] = rows.get(r.doc_id, 0) + 1
    assert seen == {i: c * rows[i] for i, c in copies.items() if c}
    whole = mixing.apply_mix(docs, labels, {"a": 0.9, "b": 0.1}, max_rate=1.0)
    ids = [r.doc_id for r in whole.collect() if r.doc_id is not None and r.doc_id < 400]
    assert len(ids) == len(set(ids)) and {i for i in range(400) if "aaaabbc"[i % 7] == "a"} - set(ids) == set()


def test_empty_and_unlabelled(spark):
    docs, labels = frames(spark)
    assert mixing.mix(docs.limit(0), labels, {"a": 1, "b": 1}).count() == 0
    rows = mixing.mix(docs, labels.limit(0), {"a": 1, "b": 1}).collect()
    assert len(rows) == docs.count() and all(abs(r.p_a - 0.5) < 1e-9 and abs(r.rate - 1) < 1e-3 for r in rows)


def test_posteriors_match_brute_force(spark):
    """Naive Bayes over word counts by domain, shrunk to the words' shares, with the same cap on a text's reach."""
    docs, labels = frames(spark)
    domains = ["a", "b", "c"]
    got = sorted(((str(r.id), r.tokens, [round(x, 9) for x in r.p]) for r in mixing.posteriors(docs, labels, domains).collect()), key=str)
    rows, known = corpus()
    of = {}
    for i, d in known:
        if i is not None and d in domains:
            of[i] = min(of.get(i, d), d)
    words = {w: n for n, w in enumerate(sorted({w for _, t, *_ in rows for w in (t or "").split()}))}
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"pmod(xxhash64(w), {mixing.BUCKETS}) AS b").collect()}
    counts = {d: {} for d in domains}
    for i, t, *_ in rows:
        if i in of:
            for w in (t or "").split():
                counts[of[i]][bucket[w]] = counts[of[i]].get(bucket[w], 0) + 1
    total = {d: sum(c.values()) for d, c in counts.items()}
    share = {b: sum(c.get(b, 0) for c in counts.values()) / sum(total.values()) for c in counts.values() for b in c}
    prior = [(sum(x == d for x in of.values()) + 1) / (len(of) + 3) for d in domains]
    want = []
    for i, t, *_ in rows:
        own = [bucket[w] for w in (t or "").split()]
        sums = [sum(math.log((counts[d].get(b, 0) + 4 * share[b]) / (total[d] + 4) / share[b]) for b in own if b in share) for d in domains]
        logits = [s * min(1, 100 / max(len(own), 1)) + math.log(p) for s, p in zip(sums, prior, strict=True)]
        powers = [math.exp(x - max(logits)) for x in logits]
        want.append((str(i), len(own), [round(x / sum(powers), 9) for x in powers]))
    assert len(got) == len(want) and all(a[:2] == b[:2] and max(abs(x - y) for x, y in zip(a[2], b[2], strict=True)) < 1e-8 for a, b in zip(got, sorted(want, key=str), strict=True))


def test_missed_targets_are_logged(spark, caplog):
    table = spark.createDataFrame([(10, [1.0, 0.0]), (10, [0.5, 0.5])], "tokens long, p array<double>")
    mixing.fit_rates(table, [5.0, 100.0], max_rate=1.0, steps=3)
    assert "missed" in caplog.text
    caplog.clear()
    mixing.fit_rates(table, [15.0, 5.0])
    assert "missed" not in caplog.text


def test_steps_do_not_grow_the_rate(spark):
    """However many steps, the expression holds one: unrolled, each step made the driver compile a longer program."""
    table = spark.createDataFrame([(9, [0.9, 0.1]), (5, [0.2, 0.8])], "tokens long, p array<double>")
    for steps in (2, 12):
        rate = mixing.fit_rates(table, [4.0, 30.0], max_rate=1.5, tolerance=0, steps=steps)
        assert table.select(rate.alias("rate"))._jdf.queryExecution().analyzed().toString().count("greatest(") == 1
