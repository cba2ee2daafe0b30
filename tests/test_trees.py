"""Trees against a plain walk, and how many rounds they take."""

import random

import pytest

from netweave.operators import doubling, trees


def brute(links, roots):
    """(depth, parent, link) of each node, level by level."""
    around = {}
    for i, a, b in links:
        if a != b:
            around.setdefault(a, []).append((i, b))
            around.setdefault(b, []).append((i, a))
    found, front, depth = {r: (0, None, None) for r in roots}, list(roots), 0
    while front:
        depth += 1
        best = {}
        for n in front:
            for i, m in around.get(n, ()):
                if m not in found:
                    best[m] = min(best.get(m, (i, n)), (i, n))
        found |= {m: (depth, n, i) for m, (i, n) in best.items()}
        front = list(best)
    return found


def flows(found, demands, peak):
    below = {n: demands.get(n, 0.0) for n in found}
    for n in sorted(found, key=lambda n: -found[n][0]):
        if found[n][1] is not None:
            below[found[n][1]] += below[n]
    return {n: below[n] * peak for n in found if found[n][1] is not None}


def check(spark, links, roots, demands=None):
    df = spark.createDataFrame(links, "link_id long, node1 long, node2 long")
    top = spark.createDataFrame([(r,) for r in roots], "node_id long")
    want = brute(links, roots)
    tree = trees.cut(trees.spanning_tree(df, top))
    assert {r.node_id: (r.depth, r.parent, r.link_id) for r in tree.collect()} == want
    assert {r.node_id for r in trees.reachable(df, top).collect()} == set(want)
    if demands:
        needs = spark.createDataFrame(list(demands.items()), "node_id long, demand double")
        assert {r.node_id: round(r.flow, 6) for r in trees.tree_flows(tree, needs, 2.5).collect()} == {n: round(f, 6) for n, f in flows(want, demands, 2.5).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walk(spark, seed):
    r = random.Random(seed)
    n = 120
    links = [(i, i, r.randrange(max(0, i - 9), i)) for i in range(1, n)]  # a tree with long ways
    links += [(n + i, r.randrange(n), r.randrange(n)) for i in range(12 * (seed - 1))]  # and loops
    links += [(500, 200, 201), (501, 201, 202), (502, 202, 200)] + [(600, 7, 7), (601, 1, 0), (602, 0, 1)]
    check(spark, links, [0, 50, 300], {i: float(r.randrange(9)) for i in range(n)})


def test_rings_and_rows(spark):
    check(spark, [(i, i, (i + 1) % 9) for i in range(9)] + [(20, 4, 30), (21, 30, 31), (22, 31, 32), (23, 32, 4)], [0])
    check(spark, [(1, 5, 6)], [5])
    check(spark, [(1, 5, 6)], [9])


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """10,000 nodes in a row: rounds of doubling, not of levels."""
    rounds = []
    real = doubling.to_the_end
    counted = doubling.cut
    monkeypatch.setattr(doubling, "cut", lambda df: rounds.append(1) or counted(df))
    monkeypatch.setattr(trees, "connected_components", lambda links, a, b: spark.range(10_000).selectExpr("id AS node", "0L AS component"))
    assert real is trees.to_the_end
    df = spark.range(9_999).selectExpr("id AS link_id", "id AS node1", "id + 1 AS node2")
    top = spark.createDataFrame([(0,)], "node_id long")
    got = {r.node_id: r.depth for r in trees.depths(df, top).collect()}
    assert got == {i: i for i in range(10_000)} and len(rounds) < 20


@pytest.mark.parametrize("block", [150, 1 << 18])
def test_loops_upon_loops_are_walked_in_blocks(spark, monkeypatch, block):
    """A ladder of 100 rungs, which is neither raked nor compressed: a round a
    block, not a round a link."""
    links = [(i, i, i + 2) for i in range(198)] + [(1000 + i, i, i + 1) for i in range(0, 200, 2)] + [(2000, 900, 901)]
    rounds, real = [], trees._walked
    monkeypatch.setattr(trees, "release", lambda df: rounds.append(1))
    monkeypatch.setattr(trees, "_walked", lambda edges, parts, fixed, _: real(edges, parts, fixed, block))
    want = {n: d for n, (d, _, _) in brute(links, [0, 130, 990]).items()}
    df = spark.createDataFrame(links, "link_id long, node1 long, node2 long")
    got = {r.node_id: r.depth for r in trees.depths(df, spark.createDataFrame([(0,), (130,), (990,)], "node_id long")).collect()}
    assert got == want
    assert len(rounds) <= 3 * (2 if block > 150 else 8)
