import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def brute(rows, every=10, k=5):
    fine = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or None in v or not np.isfinite(v).all():
            continue
        fine.setdefault(i, []).append((label, tuple(np.floor(256 * np.array(v, np.float32).astype(float)))))
    fine = {i: min(x) for i, x in fine.items()}
    dim = max((len(v) for _, v in fine.values()), default=0)
    fine = {i: (label, np.array([*v, *[0.0] * (dim - len(v))])) for i, (label, v) in fine.items()}
    out = []
    for a, (label, v) in fine.items():
        if a % every:
            continue
        scored = sorted((-int(v @ w), i, other) for i, (other, w) in fine.items() if i != a)
        for p, i, _ in [x for x in scored if x[2] == label][:k]:
            window = [x for x in scored if x[2] != label and -80 * p <= -100 * x[0] <= -100 * p][:k]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(window)]
    return sorted(out)


def got(table, every=10, **more):
    return sorted(tuple(r) for r in negatives.mine(table, F.col("id") % every == 0, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], SCHEMA)


def floats(values):
    return [float(np.float32(x)) for x in values]


def test_matches_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, floats(rng.standard_normal(12) / 3), int(rng.integers(0, 3))) for i in range(400)]
    rows += [(500 + i, rows[10][1], i % 2) for i in range(60)]  # copies, so ties
    rows += [(700 + i, floats(np.arange(12) * -0.1), 7) for i in range(3)] + [(710, floats(np.arange(12) * 0.1), 7)]  # few of a label, negative scores
    rows += [(800, [0.0] * 12, 1), (801, [], 1), (802, [0.5, 0.25], 2), (803, None, 1), (804, [1.0, None] * 6, 1), (805, [float("nan")] * 12, 1), (806, [float("inf")] * 12, 0), (810, rows[3][1], None), (None, rows[3][1], 1), (20, rows[20][1], rows[20][2]), (30, rows[31][1], 2)]
    want = brute(rows)
    assert len(want) > 500
    for more in ({}, {"block_anchors": 7, "sample_rows": 50}, {"sample_rows": 3}):
        assert got(frame(spark, rows), **more) == want


def test_clustered_vectors_and_windows_that_fill_late(spark):
    """Positives far above all negatives: thresholds must go down to the window's end, and further they must not."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((8, 16))
    rows = [(i, floats(centres[i % 8] + 0.02 * rng.standard_normal(16)), i % 8) for i in range(300)]
    rows += [(1000 + i, floats(0.85 * centres[i % 8]), (i + 1) % 8) for i in range(40)]
    want = brute(rows, 50)
    assert want and got(frame(spark, rows), 50) == want


def test_empty_tables_and_large_components(spark):
    assert got(frame(spark, [])) == [] and got(frame(spark, [(1, [1.0], 0), (3, [1.0], 1)])) == [] and got(frame(spark, [(10, [1.0], 0)])) == []
    with pytest.raises(ValueError):
        got(frame(spark, [(10, [1e30], 0)]))


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_postings_leave_out_suffixes_and_prune_without_loss(spread):
    rng = np.random.default_rng(7)
    fall = np.exp(-spread * np.arange(40) / 10)
    a, r = (np.floor(100 * rng.standard_normal((n, 40)) * fall) for n in (50, 700))
    exact = a @ r.T
    for share in (0.5, 0.99, 1.0):
        low = np.quantile(exact, share, axis=1)
        x, y, s = negatives.reaching(a, negatives.tails(a), r, negatives.tails(r), low)
        assert set(zip(x, y, strict=True)) == set(zip(*np.nonzero(exact >= low[:, None]), strict=True)) and (exact[x, y] == s).all()
