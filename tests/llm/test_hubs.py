"""Components with hubs: stars, a chain of stars, and string nodes."""

import random

from folioscope.llm.components import components
from tests.llm import brute


def test_stars_and_chains(spark):
    r = random.Random(1)
    edges = [(5000, i) for i in range(1, 2000)] + [(i, i + 1) for i in range(6000, 6050)] + [(6050, 5000)] + [(9000 + i, 8000) for i in range(700)]
    r.shuffle(edges)
    want = brute.groups({x for e in edges for x in e}, edges)
    assert {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()} == want
    names = [(f"n{a}", f"n{b}") for a, b in edges]
    got = {x.node: x.component for x in components(spark.createDataFrame(names, "u string, v string")).collect()}
    groups = {}
    for n, c in got.items():
        groups.setdefault(c, set()).add(n)
    assert {min(g) for g in groups.values()} == set(groups) and sorted(map(len, groups.values())) == sorted(map(list(want.values()).count, set(want.values())))
