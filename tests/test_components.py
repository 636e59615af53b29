import random

import pytest

from parley.operators import components


@pytest.mark.parametrize("most", [0, components.PART_ROWS])
def test_components_with_and_without_shuffles(spark, monkeypatch, most):
    """A hub, a chain, loops, repeated edges and random ones; few edges are worked on as one partition, others are not."""
    monkeypatch.setattr(components, "PART_ROWS", most)
    rng = random.Random(4)
    edges = [(500, k) for k in range(501, 540)] + [(k, k + 1) for k in range(20)] + [(7, 7), (3, 2), (2, 3)]
    edges += [(rng.randrange(600, 700), rng.randrange(600, 700)) for _ in range(40)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in parent)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
