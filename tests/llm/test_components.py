"""Connected components against union-find."""

import random

from strata.llm.common import Scratch
from strata.llm.components import components


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 120)] + [(1000, 1000 + i) for i in range(1, 60)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(70)] + [(-5, -9), (-9, -5), (7, 7)]
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    got = {x.node: x.comp for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).collect() == []
