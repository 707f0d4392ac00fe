import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronolith.llm import common, quality, toxicity

SCHEMA = "doc_id long, text string, source string, lang string, score string, toxic string"


def corpus(n=900):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        toxic, good = i % 7 == 0, i % 5 != 0
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(["Moronx,", "zcumbag", "vexqu" + rng.choice("abcde")]))
        line = " ".join(text)
        docs.append((i, line if good else " | ".join(w.upper() + "%%%" for w in text), f"s{i % 3}" if i % 11 else None, "en", "clash", "clash"))
        if i % 10:
            labels.append((i, int(good), int(toxic)))
    odd = [(n, None), (n + 1, ""), (n + 2, "zcumbag " * 40_000), (None, "moronx zcumbag"), (n + 3, "plain"), (n + 3, "plain")]
    docs += [(i, t, None, None, "clash", "clash") for i, t in odd]
    return docs, [*labels, (None, 1, 1), (n + 50, 1, 0), (5, None, None), (6, 1, 0)]


def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels if i is not None and q is not None}


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_on_held_out_rows(spark):
    docs, labels, known = frames(spark)
    model = toxicity.train(docs, toxicity.training_labels(labels))
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(known[r.doc_id][1], r.predicted) for r in got if held_out(r.doc_id) and r.doc_id in known]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) >= 0.97
    by = {r.doc_id: r.predicted for r in got}
    assert (by[900], by[901], by[902], by[903]) == (0, 0, 1, 0)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if not r.predicted)


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels, _ = frames(spark)
    flipped = labels.withColumn("toxic", F.when(common.fold("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, toxicity.training_labels(x)) for x in (labels, flipped))
    assert a.terms == b.terms and np.array_equal(a.weights, b.weights)


def test_posteriors_follow_votes_not_labels(spark):
    """Wrong labels on a few texts: the label model outvotes them, and the classifier does too."""
    docs, labels, known = frames(spark)
    wrong = [i for i, (_, t) in known.items() if t and i % 3 == 0][:8] + [i for i, (_, t) in known.items() if not t][:12]
    model = toxicity.train(docs, labels.withColumn("toxic", F.when(F.col("doc_id").isin(wrong), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert ((model.posterior > 0.5) != (model.given > 0.5)).sum() >= 15
    by = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(by[i] == known[i][1] for i in wrong) >= 18


def test_lexicon_voters_do_with_few_labels(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(40)) + (" you pathetic moron" if i % 6 == 0 else "")) for i in range(36)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(36)], "doc_id long, toxic int")
    more = docs.union(spark.createDataFrame([(100, "what a stupid worthless clown he is"), (101, "what a fine day it is")], docs.schema))
    by = {r.doc_id: r.predicted for r in toxicity.score(more, toxicity.train(docs, labels)).collect()}
    assert all(by[i] == (i % 6 == 0) for i in range(36)) and by[101] == 0


def test_label_model_matches_bayes_on_independent_voters():
    """With rates that votes alone fix, posteriors are Bayes' rule on them."""
    rng = np.random.default_rng(11)
    y = rng.random(20_000) < 0.3
    rates = np.array([[0.05, 0.8], [0.1, 0.7], [0.02, 0.6]])
    votes = (rng.random((20_000, 3)) < rates[:, y.astype(int)].T).astype(float)
    posterior, shares, correlation = toxicity.label_model(votes, y.astype(float))
    assert correlation[~np.eye(3, dtype=bool)].max() < 0.6 and np.abs(shares.T - rates).max() < 0.02
    both = [np.where(votes, s, 1 - s).prod(axis=1) * p for s, p in zip(shares, (1 - y.mean(), y.mean()))]
    assert np.abs(both[1] / sum(both) - posterior).max() < 0.02


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(6)
    y = rng.random(6000) < 0.2
    rates = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.3, 0.35]])
    votes = (rng.random((6000, 4)) < rates[:, y.astype(int)].T).astype(float)
    votes = np.column_stack([votes, votes[:, 0]])  # the last voter copies the first
    noisy = np.where(rng.random(6000) < 0.05, ~y, y).astype(float)
    posterior, shares, correlation = toxicity.label_model(votes, noisy)
    assert np.abs(shares[:, :4].T - rates).max() < 0.1 and correlation[0, 4] > 0.9 and abs(correlation[0, 1]) < 0.3
    assert ((posterior > 0.5) == y).mean() > (noisy == y).mean()


def test_quality_on_held_out_rows_and_sites(spark):
    docs, labels, known = frames(spark)
    model = quality.train(docs, quality.training_labels(labels))
    for bound in (0, 1000):
        got = quality.score(docs, model, broadcast_sites=bound).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got)
        held = [(known[r.doc_id][0], int(r.kept)) for r in got if held_out(r.doc_id) and r.doc_id in known]
        assert sum(a == b for a, b in held) / len(held) >= 0.97
    # rates by brute force: sums of evidence, shrunk to the level above by strengths from the spread of sites
    where = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
    site = [((where[r.doc_id][0] or "", where[r.doc_id][1] or ""), r) for r in got]
    clip = lambda x, a, b: min(max(x, a), b)
    overall = clip(sum(r.evidence for r in got) / len(got), 0.01, 0.99)

    def strength(sums):
        """sums: (good, n, rate of the level above)"""
        sums = [(g, n, p) for g, n, p in sums if n >= 2]
        usual = sum(n * p * (1 - p) for _, n, p in sums)
        between = (sum(n * (g / n - p) ** 2 for g, n, p in sums) - sum(p * (1 - p) for _, _, p in sums)) / usual
        return clip(1 / between - 1 if between > 0 else 1e4, 2.0, 1e4)

    total = lambda key: {k: (sum(r.evidence for s, r in site if key(s) == k), sum(key(s) == k for s, _ in site)) for k in {key(s) for s, _ in site}}
    hosts, paths = total(lambda s: s[0]), total(lambda s: s)
    w = strength([(g, n, overall) for g, n in hosts.values()])
    host_rate = {h: (g + w * overall) / (n + w) for h, (g, n) in hosts.items()}
    w = strength([(g, n, host_rate[k[0]]) for k, (g, n) in paths.items()])
    logit = lambda p: np.log(p / (1 - p))
    for s, r in site:
        path_rate = (paths[s][0] - r.evidence + w * host_rate[s[0]]) / (paths[s][1] - 1 + w)
        score = 1 / (1 + np.exp(-clip(logit(clip(r.evidence, 1e-9, 1 - 1e-9)) - logit(model.prior) + logit(clip(path_rate, 0.01, 0.99)), -40, 40)))
        assert abs(r.host_rate - host_rate[s[0]]) < 1e-9 and abs(r.path_rate - path_rate) < 1e-9 and abs(r.score - score) < 1e-9


def test_sparse_sites_shrink_more(spark):
    rows = [(i, "Plain words of a text here " * 3, "big", "en", "", "") for i in range(200)]
    rows += [(200 + i, "BAD!! | %%% " * 9, "bad", "en", "", "") for i in range(200)]
    rows += [(500, "BAD!! | %%% " * 9, "tiny", "en", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rate = {r.doc_id: r.host_rate for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert rate[0] > 0.9 and rate[200] < 0.1 and 0.1 < rate[500] < rate[0]


def test_empty_tables(spark):
    docs, labels, _ = frames(spark)
    for module in (toxicity, quality):
        blank = module.train(docs.limit(0), labels.limit(0))
        assert module.score(docs.limit(0), blank).count() == 0
        assert all(r.score <= 0.5 for r in module.score(docs, blank).collect())


def test_text_runs_cut_at_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["aaaa", None, "bb", "c" * 50, "", "d"]})
    runs = [r.column("text").to_pylist() for r in common.text_runs([batch], run_bytes=6)]
    assert [t for r in runs for t in r] == batch.column("text").to_pylist() and len(runs) > 2
