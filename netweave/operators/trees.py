"""Breadth-first trees and what flows through them, in few rounds.

How far nodes are from their roots is found by raking and compressing: dead ends
are put aside, chains of nodes with two links become one link of their length, and
so on until nothing of either is left; a tree is gone after a number of turns that
grows with the logarithm of its size. What cannot be made smaller (loops upon
loops) is walked in blocks of links, each by one task to its end; a round hands on
what leaves a block. Then everything comes back in reverse. Chains are
followed, and demand summed up the trees, by doubling.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators.components import connected_components
from netweave.operators.doubling import to_the_end
from netweave.operators.topology import number
from netweave.session import cut, release

#: A turn that puts less than this part of the nodes aside is the last.
WORTH = 0.1
#: Links of a block, counted from both ends; a node's links are in one block.
BLOCK = 1 << 18


def _held(links: DataFrame, roots: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) of the nodes with links that are in a component with a root."""
    found = connected_components(links, src, dst)
    held = found.join(roots.select(F.col("node_id").alias("node")), "node", "left_semi").select("component").distinct()
    return found.join(held, "component", "left_semi").select("node", "component")


def reachable(links: DataFrame, roots: DataFrame, src: str = "node1", dst: str = "node2") -> DataFrame:
    """(node_id) that is in a component with a root; roots are, without links too."""
    return _held(links, roots, src, dst).select(F.col("node").alias("node_id")).union(roots.filter("node_id IS NOT NULL").select("node_id")).distinct()


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
    return edges.select("a", "b", "w")


def _of_degree(edges: DataFrame, degree: int, roots: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    return ends.filter(F.col("count") == degree).select("node").join(roots, "node", "left_anti")


def _shortest(edges: DataFrame) -> DataFrame:
    """Of links between the same nodes the shortest, a < b; no loops."""
    ordered = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
    return ordered.groupBy("a", "b").agg(F.min("w").alias("w"))


def _compressed(edges: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with chains of inner nodes as one, and (node, at1, w1, at2, w2): the
    ends of each inner node's chain and how far they are."""
    numbered = cut(edges.withColumn("e", F.monotonically_increasing_id() * 2))
    halves = cut(numbered.select("e", F.col("e").alias("id"), "a", "b", "w").union(numbered.select("e", F.col("e") + 1, "b", "a", "w")))
    leaving = halves.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("a").alias("b"), F.col("id").alias("next"), F.col("e").alias("e2"))
    steps = halves.join(leaving, "b", "left").filter("e2 IS NULL OR e <> e2").select("id", "next", "w")
    far = to_the_end(steps, "w").join(halves.select(F.col("id").alias("end"), F.col("b").alias("at")), "end").select("id", "at", "total")
    known = cut(halves.join(far, "id").select("a", "at", "total"))
    ends = known.join(inner.withColumnRenamed("node", "a"), "a", "left_semi").groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_list(F.struct("at", "total"))).alias("two"))  # two of them
    chains = cut(ends.select("node", *[F.get("two", i)[c].alias(f"{n}{i + 1}") for i in (0, 1) for c, n in (("at", "at"), ("total", "w"))]))
    kept = known.join(inner.withColumnRenamed("node", "a"), "a", "left_anti").select("a", F.col("at").alias("b"), F.col("total").alias("w"))
    return cut(_shortest(kept)), chains


def _blocked(edges: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """(a, b, w, own, to): links from both ends with the blocks of these. Blocks
    are ranges of about so many links in the order of component and node, so a
    component that is no larger is in two at most."""
    both = edges.union(edges.select("b", "a", "w")).join(parts.select(F.col("node").alias("a"), "component"), "a")
    both = cut(number(both, ["component", "a", "b"], "nr"))
    home = both.groupBy("a").agg(F.floor(F.min("nr") / block).alias("own"))
    return cut(both.join(home, "a").join(home.toDF("b", "to"), "b").select("a", "b", "w", "own", "to"))


def _walked(edges: DataFrame, parts: DataFrame, fixed: DataFrame, block: int) -> DataFrame:
    """(node, d): how far nodes are from the nearest of fixed over links (a, b, w).
    A round settles the blocks that something new has come into, each in a task."""

    def settle(rows: pa.Table) -> pa.Table:
        """(node, d, own, inside) of one block's links (a, b, d, own, to), of what is
        known of it (a, d) and of what newly comes in (a, d, to): the nodes that get
        nearer, and how near they bring those of other blocks."""
        around, best, heap, offers = {}, {}, [], {}
        for kind, a, b, d, to in zip(*[rows.column(c).to_pylist() for c in ("kind", "a", "b", "d", "to")], strict=True):
            if kind == 0:
                around.setdefault(a, []).append((b, d, to))
            elif kind == 1:
                best[a] = d
            else:
                heap.append((d, a))
        own, nearer = rows.column("own")[0].as_py(), set()
        heap = [(d, a) for d, a in heap if a not in best or d < best[a]]
        best |= {a: d for d, a in heap}  # one each
        heapq.heapify(heap)
        while heap:
            d, a = heapq.heappop(heap)
            if d > best[a]:
                continue
            nearer.add(a)
            for b, w, to in around.get(a, ()):
                if to != own:
                    if b not in offers or d + w < offers[b][0]:
                        offers[b] = (d + w, to)
                elif b not in best or d + w < best[b]:
                    best[b] = d + w
                    heapq.heappush(heap, (d + w, b))
        out = [(a, best[a], own, True) for a in nearer] + [(b, d, to, False) for b, (d, to) in offers.items()]
        kinds = [rows.schema.field("a").type, pa.int64(), pa.int64(), pa.bool_()]
        return pa.Table.from_arrays([pa.array([row[i] for row in out], kind) for i, kind in enumerate(kinds)], names=["node", "d", "own", "inside"])

    known, links = fixed.withColumn("d", F.lit(0).cast("long")), _blocked(edges, parts, block)
    homes = cut(links.select(F.col("a").alias("node"), "own").distinct())
    front = cut(known.join(homes, "node").select("node", "d", "own"))
    known = cut(known.join(homes, "node", "left").select("node", F.when(F.col("own").isNull(), F.col("d")).alias("d"), "own"))
    kind = known.schema["node"].dataType.simpleString()
    no = F.lit(None).cast(known.schema["node"].dataType)
    while front.take(1):
        stirred = front.select("own").distinct()
        rows = links.join(stirred, "own", "left_semi").select(F.lit(0).alias("kind"), "a", "b", F.col("w").alias("d"), "own", "to")
        for nr, part in ((1, known.filter("d IS NOT NULL").join(stirred, "own", "left_semi")), (2, front)):
            rows = rows.union(part.select(F.lit(nr), "node", no, "d", "own", F.lit(None).cast("long")))
        found = cut(rows.groupBy("own").applyInArrow(settle, f"node {kind}, d long, own long, inside boolean"))
        better = found.filter("inside").select("node", "d", "own")
        offers = found.filter("NOT inside").groupBy("node").agg(F.min("d").alias("new"), F.first("own").alias("own"))
        done, known = known, cut(known.join(better.select("node"), "node", "left_anti").union(better))
        before, front = front, cut(offers.join(known.select("node", "d"), "node", "left").filter("d IS NULL OR new < d").select("node", F.col("new").alias("d"), "own"))
        for old in (done, before, found):
            release(old)
    return known.filter("d IS NOT NULL").select("node", "d")


def depths(links: DataFrame, roots: DataFrame, src: str = "node1", dst: str = "node2", block: int = BLOCK) -> DataFrame:
    """(node_id, depth): how many links each node is from the nearest root;
    nodes that no root reaches are left out."""
    there = cut(_held(links, roots, src, dst))
    fixed = cut(roots.select(F.col("node_id").alias("node")).filter("node IS NOT NULL").distinct())
    edges = links.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.lit(1).cast("long").alias("w")).join(there.select(F.col("node").alias("a")), "a", "left_semi")
    edges, aside = cut(_shortest(edges)), []
    left = edges.select(F.explode(F.array("a", "b"))).distinct().count()
    while left:
        tips = cut(_of_degree(edges, 1, fixed))
        either = edges.select(F.col("a").alias("node"), F.col("b").alias("at"), "w").union(edges.select("b", "a", "w"))
        aside.append(cut(either.join(tips, "node").select("node", "at", "w")))
        edges = cut(_without(edges, tips))
        inner = cut(_of_degree(edges, 2, fixed))
        edges, chains = _compressed(edges, inner)
        aside.append(chains)
        before, left = left, edges.select(F.explode(F.array("a", "b"))).distinct().count()
        if before - left < WORTH * before:
            break
    known = cut(_walked(edges, there, fixed, block))
    for part in reversed(aside):
        if "at" in part.columns:
            more = part.join(known.select(F.col("node").alias("at"), "d"), "at").select("node", (F.col("d") + F.col("w")).alias("d"))
        else:
            for i in (1, 2):
                part = part.join(known.select(F.col("node").alias(f"at{i}"), F.col("d").alias(f"d{i}")), f"at{i}")
            more = part.select("node", F.least(F.col("d1") + F.col("w1"), F.col("d2") + F.col("w2")).alias("d"))
        known = cut(known.union(more))
    return known.select(F.col("node").alias("node_id"), F.col("d").cast("int").alias("depth"))


def spanning_tree(links: DataFrame, roots: DataFrame, src: str = "node1", dst: str = "node2", key: str = "link_id") -> DataFrame:
    """(node_id, depth, parent, link_id): breadth-first trees from the roots
    (node_id). A node reached over several links keeps that of the smallest (link,
    parent); roots have depth 0 and no parent."""
    known = cut(depths(links, roots, src, dst))
    both = links.select(F.col(src).alias("a"), F.col(dst).alias("b"), F.col(key).alias("link")).union(links.select(dst, src, key)).filter("a <> b")
    near = known.select(F.col("node_id").alias("b"), (F.col("depth") + 1).alias("depth"))
    best = both.join(near, "b").join(known.select(F.col("node_id").alias("a"), "depth"), ["a", "depth"]).groupBy(F.col("a").alias("node_id")).agg(F.min(F.struct("link", "b")).alias("best"))
    return known.join(best, "node_id", "left").select("node_id", "depth", F.col("best.b").alias("parent"), F.col("best.link").alias("link_id"))


def tree_flows(tree: DataFrame, demands: DataFrame, peak: float = 1.0) -> DataFrame:
    """(node_id, link_id, flow): demand below each tree link times peak; a link
    out of the tree carries nothing. Demands (node_id, demand) are summed as
    decimals, so order is no matter. Each round what lies up to twice as far below is
    added, by sums that are grouped before they are shuffled."""
    rows = tree.join(demands, "node_id", "left").select("node_id", "link_id", F.col("parent").alias("up"), F.coalesce("demand", F.lit(0.0)).cast("decimal(38,6)").alias("flow"))
    rows = cut(rows)
    while rows.filter("up IS NOT NULL").take(1):
        more = rows.filter("up IS NOT NULL").groupBy(F.col("up").alias("node_id")).agg(F.sum("flow").alias("more"))
        above = rows.select(F.col("node_id").alias("up"), F.col("up").alias("up2"))
        done = rows
        rows = rows.join(more, "node_id", "left").join(above, "up", "left")
        rows = cut(rows.select("node_id", "link_id", F.col("up2").alias("up"), (F.col("flow") + F.coalesce("more", F.lit(0))).cast("decimal(38,6)").alias("flow")))
        release(done)
    return rows.filter("link_id IS NOT NULL").select("node_id", "link_id", (F.col("flow").cast("double") * peak).alias("flow"))
