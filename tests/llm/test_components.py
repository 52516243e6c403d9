import random

import pytest

from lexloom.llm import components
from lexloom.llm.common import Stages


def brute(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in list(top)}


def graph(seed=2):
    """Random links, a long chain in a mixed order, a star with a large centre, two ids at the ends of 64 bits."""
    pick = random.Random(seed)
    chain = list(range(1000, 1060))
    pick.shuffle(chain)
    links = [(pick.randrange(80), pick.randrange(100, 180)) for _ in range(70)]
    return links + list(zip(chain, chain[1:], strict=False)) + [(9999, i) for i in range(5000, 5600)] + [(-(2**63), 2**63 - 1)]


@pytest.mark.parametrize("bound", [components.BROADCAST_BYTES, -1])
def test_equals_union_find(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "BROADCAST_BYTES", bound)
    edges = spark.createDataFrame(graph(), "a long, b long")
    found = components.connected_components(edges, Stages(spark, "components")).collect()
    assert len(found) == len({r.node for r in found})
    assert {(r.node, r.label) for r in found} == brute(graph())


@pytest.mark.parametrize("bound", [components.BROADCAST_BYTES, -1])
def test_no_links(spark, monkeypatch, bound):
    monkeypatch.setattr(components, "BROADCAST_BYTES", bound)
    edges = spark.createDataFrame([], "a long, b long")
    assert components.connected_components(edges, Stages(spark, "components")).count() == 0
