import numpy as np
from pyspark.sql import functions as F

from chronolith.llm import ann

SCHEMA = "vec_id long, embedding array<float>, leaf int"


def brute(rows, queries, k):
    usable = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    dim = max((len(v) for _, v in usable), default=0)
    usable = [(i, v / np.linalg.norm(v)) for i, v in usable if len(v) == dim]
    out = []
    for q, v in usable:
        if queries(q):
            best = {}
            for i, w in usable:
                if i != q:
                    best[i] = max(best.get(i, -9), float((v * w).sum()))
            out += [(q, n + 1, i, round(s, 9)) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_whole_search_matches_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(6)], 0) for i in range(120)]
    rows += [(200 + i, rows[7][1], 0) for i in range(40)]  # copies
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 6, 0), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (304, [float("nan")] + [1.0] * 5, 0), (305, [float("inf")] + [1.0] * 5, 0), (306, [1.0] * 5, 0), (None, [1.0] * 6, 0), (300, [1e-30] * 6, 0), (7, rows[7][1], 0)]
    table = frame(spark, rows)
    for parts in (50_000, 8):
        got = ann.nearest(table, table.where("vec_id % 10 = 0"), 5, share=99.0, leaf_rows=16, task_rows=parts).collect()
        want = [r for r in brute(rows, lambda q: q % 10 == 0, 5) if True]
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(set(want))


def test_recall_and_bounds(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 32))
    data = centres[rng.integers(0, 20, 3000)] + 0.7 * rng.standard_normal((3000, 32))
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(data)]
    table = frame(spark, rows)
    got = ann.nearest(table, table.where("vec_id % 50 = 0"), 5, leaf_rows=64, sample_rows=1000).collect()
    want = {r[:1] + r[2:3] for r in brute(rows, lambda q: q % 50 == 0, 5)}
    assert len(got) == 300 and len({(r.query_id, r.vec_id) for r in got} & want) / len(want) >= 0.9
    # far less work than all rows
    unit = ann.unit(data)
    forest = ann.fit_forest(unit[:1000], 2, 6)
    assert ann.calibrated_share(forest, unit[:1000], 5, 0.94) < 0.5


def test_recall_and_work_on_isotropic_vectors():
    rng = np.random.default_rng(3)
    data = ann.unit(rng.standard_normal((4000, 48)))
    forest = ann.fit_forest(data, 2, 6)
    share = ann.calibrated_share(forest, data, 5, 0.94)
    leaves, sizes = forest.leaves(data), np.bincount(forest.leaves(data).ravel(), minlength=2 << 6)
    found = work = 0
    for i in range(0, 4000, 50):
        cosines = data @ data[i]
        cosines[i] = -2
        got = forest.search(data[i], sizes, share * len(data))
        found += np.isin(leaves[:, np.argsort(-cosines)[:5]], got).any(axis=0).sum()
        work += sizes[got].sum()
    assert found / 400 >= 0.9 and work / 80 < 4000  # below brute force


def test_leaves_follow_the_rows_beyond_the_sample():
    rng = np.random.default_rng(4)
    data = ann.unit(rng.standard_normal((20_000, 16)))
    forest = ann.fit_forest(data[:500], 1, 9)
    sizes = np.bincount(forest.leaves(data)[0], minlength=512)
    assert sizes.max() < 8 * 20_000 / 512 and (sizes > 0).mean() > 0.9


def test_small_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], 0), (50, [0.0, 1.0], 0), (3, [1.0, 1.0], 0)]
    table = frame(spark, rows)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(table, table.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 50), (50, 1, 3), (50, 2, 0)]
    empty = ann.nearest(table.limit(0), table.limit(0))
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
