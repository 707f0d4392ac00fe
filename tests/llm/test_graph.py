import random

import pytest

from chronolith.llm import graph


@pytest.mark.parametrize("n, m", [(60, 50), (300, 200), (40, 200)])
def test_components_match_union_find(spark, n, m):
    rng = random.Random(n + m)
    edges = [(rng.randrange(n) - 5, rng.randrange(n) - 5) for _ in range(m)] + [(1000 + i, 1001 + i) for i in range(12)] + [(3, 3), (None, 4)]
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in root:
        for u, v in edges:
            if u in root and v in root:
                root[u] = root[v] = min(root[u], root[v])
    found = [tuple(r) for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert sorted(found) == sorted(root.items())


def test_no_round_follows_stars(spark, monkeypatch):
    """A round more, only to see that nothing changes, wrote as much as any other."""
    written = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, f=graph.checkpointed: written.append(1) or f(df))
    found = graph.connected_components(spark.createDataFrame([(5, 1), (1, 7), (9, 2)], "u long, v long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)] and len(written) == 1
