"""Components of chains, stars and random graphs."""

from __future__ import annotations

import numpy as np

from studyloom.operators.components import components


def plain(links):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in label}


def test_long_chain_in_few_rounds(spark):
    rng = np.random.default_rng(1)
    names = rng.permutation(10_000).tolist()
    links = list(zip(names, names[1:], strict=False))
    seen = []
    got = components(spark.createDataFrame(links, "a long, b long"), seen)
    assert len(seen) <= 40 and {r.component for r in got.collect()} == {0} and got.count() == 10_000


def test_random_graphs(spark):
    rng = np.random.default_rng(2)
    links = [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(220)] + [(500, k) for k in range(501, 560)] + [(900, 900), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = plain([x for x in links if x[0] != x[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()
