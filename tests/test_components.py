"""Connected components against a plain union-find."""

import random

from netweave.operators.components import connected_components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_graphs(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1150)]
    star = [(90000, i) for i in range(2000, 2600)] + [(3000, i) for i in range(3001, 3400)]  # around their largest and their smallest
    for edges in ([(r.randrange(500), r.randrange(500)) for _ in range(300)] + chain + star + [(7, 7), (None, 3), (1, 2), (2, 1)], [], [(5, 5)]):
        got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == plain(edges)


def test_names_and_structs(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "p string, q string")
    assert {x.node: x.component for x in connected_components(edges, "p", "q").collect()} == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}
