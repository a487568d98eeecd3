import random

import pytest

graph = pytest.importorskip("confluo.llm.graph")


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_same_as_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, 500 + k) for k in range(1, 50)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(edges)
    edges = [(a, b) for a, b in edges if a != b]
    found = graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(found) == len({r[0] for r in found})
    assert dict(map(tuple, found)) == brute(edges)


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).count() == 0
