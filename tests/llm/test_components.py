import random

import pytest

from weirlog.llm.components import components
from weirlog.scratch import Scratch


def roots(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in root}


def run(spark, edges):
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(3), Scratch(spark)).collect()
    assert len(found) == len(set(found))
    return set(map(tuple, found))


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180 + 40 * seed)]
    edges = [e for e in edges if e[0] != e[1]]
    assert run(spark, edges) == roots(edges)


def test_shapes(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(500)] + [(2999, 2000 + i) for i in range(500)]
    assert run(spark, path + star) == roots(path + star)


def test_loops_repeats_and_nothing(spark):
    assert run(spark, [(1, 2), (2, 1), (1, 2), (3, 3)]) == {(1, 1), (2, 1)}
    assert run(spark, []) == set()
