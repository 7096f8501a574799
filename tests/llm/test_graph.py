import numpy as np
import pytest

from siteframe.llm.graph import smallest_reachable


def plain(edges):
    parent = {v: v for e in edges for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {v: root(v) for v in parent}


rng = np.random.default_rng(3)
GRAPHS = {"path": [(i, i + 1) for i in range(60)], "path of mixed numbers": [((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)],
          "star": [(500, i) for i in range(100)], "loops and repeats": [(1, 1), (2, 1), (1, 2), (1, 2), (5, 5)],
          "random": [tuple(map(int, e)) for e in rng.integers(-50, 400, (250, 2))]}


@pytest.mark.parametrize("name", GRAPHS)
def test_against_union_find(spark, name):
    edges = GRAPHS[name]
    got = {r["node"]: r["root"] for r in smallest_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain(edges)
    assert got == {v: r for v, r in want.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_no_edges(spark):
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).isEmpty()
