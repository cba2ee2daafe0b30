"""Pipe sizing, spanning-tree flows and the network solve."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions import labels
from netweave.operators.spatial import nearest_within
from netweave.operators.topology import degree_map
from netweave.session import cut

EXPONENT, FACTOR = 1.852, 10.667


def velocity(flow_lps: Column, diameter_mm: Column) -> Column:
    return 4 * (F.abs(flow_lps) / 1000) / (F.lit(math.pi) * (diameter_mm / 1000) * (diameter_mm / 1000))


def required_diameter(flow_lps: Column, max_velocity: float) -> Column:
    """Millimetres at which a flow has the velocity."""
    return F.sqrt(4 * (F.abs(flow_lps) / 1000) / F.lit(math.pi * max_velocity)) * 1000


def total_demand(population: Column, litres_per_day: Column, total_lpd: Column | None = None, losses: Column | None = None) -> Column:
    """Litres a second: a given total, else population times use, with losses
    below 1 added."""
    daily = population * litres_per_day if total_lpd is None else F.coalesce(total_lpd, population * litres_per_day)
    if losses is not None:
        daily = F.when(losses < 1, daily / (1 - losses)).otherwise(daily)
    return daily / 86400


def assign_diameters(pipes: DataFrame, label_points: DataFrame, ladder: Sequence[float], default: float = 50.0, cap: float = 50.0, cutoff: float = 60.0) -> DataFrame:
    """Adds material, label_distance_m, diameter_from_cad, and three diameters:
    raw (nearest label within cutoff of the middle, else default), capped (at a
    free end) and final (on the ladder). Labels without a diameter do not label.

    pipes: link_id, node1, node2, x1, y1, x2, y2. label_points: label_id, x, y,
    diameter_mm, material."""
    usable = label_points.filter("diameter_mm IS NOT NULL AND NOT isnan(diameter_mm)")
    middles = pipes.select("link_id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    near = nearest_within(middles, usable, "link_id", "label_id", cutoff).select(F.col("query").alias("link_id"), F.col("target").alias("label_id"), F.col("distance").alias("label_distance_m"))
    found = near.join(usable.select("label_id", F.col("diameter_mm").alias("label_mm"), F.coalesce("material", F.lit("UNK")).alias("label_material")), "label_id").drop("label_id")
    free = degree_map(pipes, "node1", "node2").filter("degree = 1").select(F.col("node_id"))
    tips = pipes.select("link_id", F.explode(F.array("node1", "node2")).alias("node_id")).join(free, "node_id").select("link_id").distinct().withColumn("free", F.lit(True))
    joined = pipes.join(found, "link_id", "left").join(tips, "link_id", "left")
    raw = F.coalesce("label_mm", F.lit(default))
    capped = F.when(F.col("free"), F.least(raw, F.lit(cap))).otherwise(raw)
    return joined.select(*[c for c in pipes.columns if c != "diameter_mm"], F.coalesce("label_material", F.lit("UNK")).alias("material"), "label_distance_m", F.col("label_mm").isNotNull().alias("diameter_from_cad"), raw.alias("diameter_raw_mm"), capped.alias("diameter_capped_mm"), labels.snap(capped, ladder).alias("diameter_mm"))


def raise_undersized(pipes: DataFrame, ladder: Sequence[float], max_velocity: float = 1.5, flow: str = "flow_lps", diameter: str = "diameter_mm") -> Column:
    """The next ladder size at which the flow is slow enough, never smaller
    than it is; null and zero flows change nothing."""
    need = required_diameter(F.coalesce(F.col(flow), F.lit(0.0)), max_velocity)
    return labels.next_size(need, F.col(diameter), ladder)


def pick_source(pipes: DataFrame) -> DataFrame:
    """(node_id, x, y): the northernmost end of the widest pipes, of equals the
    smallest id; one row."""
    widest = pipes.agg(F.max("diameter_mm").alias("widest"))
    tips = pipes.join(F.broadcast(widest), F.col("diameter_mm") == F.col("widest"))  # one row
    tips = tips.select(F.explode(F.array(F.struct(F.col("node1").alias("node_id"), F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("node2").alias("node_id"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("tip"))
    return tips.select("tip.*").orderBy(F.desc("y"), "node_id").limit(1)


def source_at(nodes: DataFrame, x: float, y: float) -> DataFrame:
    """(node_id, x, y): the node nearest to a place, such as a given point or
    the first of a layer; of equals the smallest id; one row."""
    dx, dy = F.col("x") - x, F.col("y") - y
    return nodes.agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "node_id", "x", "y")).alias("best")).select("best.node_id", "best.x", "best.y").filter("node_id IS NOT NULL")


def network_trees(nodes: DataFrame, links: DataFrame, roots: DataFrame, peak: float = 1.0) -> DataFrame:
    """(network_id, node_id, depth, parent, link_id, flow): trees and flows for
    many networks at once, each walked by a worker of its own, for networks that
    fit one; ``trees`` has them for any size.

    nodes: network_id, node_id, demand; links: network_id, link_id, node1, node2;
    roots: network_id, node_id. Nodes are visited in order of arrival, links of a
    node in order of their ids; nodes that no root reaches are left out."""
    rows = nodes.select("network_id", "node_id", F.lit(None).cast("long").alias("link_id"), F.lit(None).cast("long").alias("node2"), F.coalesce("demand", F.lit(0.0)).alias("demand"), F.lit("node").alias("kind"))
    rows = rows.union(links.select("network_id", "node1", "link_id", "node2", F.lit(0.0), F.lit("link"))).union(roots.select("network_id", "node_id", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(0.0), F.lit("root")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list[tuple[int, int]]] = {}
        own = pdf[pdf.kind == "link"].sort_values("link_id")
        for link, a, b in zip(own.link_id.astype(int), own.node_id.astype(int), own.node2.astype(int), strict=True):
            if a != b:
                around.setdefault(a, []).append((link, b))
                around.setdefault(b, []).append((link, a))
        below = {int(n): float(d) for n, d in zip(pdf[pdf.kind == "node"].node_id, pdf[pdf.kind == "node"].demand, strict=True)}
        queue = sorted(int(n) for n in pdf[pdf.kind == "root"].node_id)
        found: dict[int, tuple] = {n: (0, None, None) for n in queue}
        for n in queue:
            for link, other in around.get(n, ()):
                if other not in found:
                    found[other] = (found[n][0] + 1, n, link)
                    queue.append(other)
        for n in reversed(queue):
            if found[n][1] is not None:
                below[found[n][1]] = below.get(found[n][1], 0.0) + below.get(n, 0.0)
        out = pd.DataFrame([(n, *found[n], below.get(n, 0.0) * peak) for n in queue], columns=["node_id", "depth", "parent", "link_id", "flow"])
        return out.assign(network_id=pdf.network_id.iloc[0])[["network_id", "node_id", "depth", "parent", "link_id", "flow"]].astype({"parent": "Int64", "link_id": "Int64"})

    return rows.groupBy("network_id").applyInPandas(run, "network_id long, node_id long, depth int, parent long, link_id long, flow double")


class Levels:
    """Solves A h = right for the matrix of a network: on its diagonal what leaves a
    node, off it what links two, and a node's own ground.

    Dead ends are put aside again and again, each into its only neighbour; what is
    left (the root, and loops) is laid in levels by links from the root. A link
    stays in a level or leads to the next one, so elimination needs a level and its
    neighbour at a time: time and memory follow the sum of squared widths, not the
    square of the nodes. Built once; a solve takes the links' weights of a round."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, root: int):
        self.n, self.real = n, np.flatnonzero(a != b)
        low, high = np.minimum(a, b)[self.real], np.maximum(a, b)[self.real]
        keys, self.same = np.unique(low.astype(np.int64) * n + high, return_inverse=True)  # parallel links count as one
        u, v = keys // n, keys % n
        self.u, self.v, m = u, v, len(keys)
        degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
        only = np.zeros(n, np.int64)  # the exclusive or of a node's links: of a dead end its link
        np.bitwise_xor.at(only, u, np.arange(m))
        np.bitwise_xor.at(only, v, np.arange(m))
        alive, there, self.turns = np.ones(m, bool), np.ones(n, bool), []
        tips = np.flatnonzero(degree == 1)
        while len(tips := tips[tips != root]):
            links = only[tips]
            up = u[links] + v[links] - tips
            if not alive[links].all() or len(np.unique(links)) < len(links):
                raise np.linalg.LinAlgError("a network must be connected")
            self.turns.append((tips, links, up))
            alive[links], there[tips], degree[tips] = False, False, 0
            np.subtract.at(degree, up, 1)
            np.bitwise_xor.at(only, up, links)
            up = np.unique(up)
            tips = up[degree[up] == 1]
        self.links = np.flatnonzero(alive)
        self._lay(u[self.links], v[self.links], there, root)

    def _lay(self, u: np.ndarray, v: np.ndarray, there: np.ndarray, root: int) -> None:
        heads, tails = np.concatenate([u, v]), np.concatenate([v, u])
        order = np.argsort(heads, kind="stable")
        tails, start = tails[order], np.searchsorted(heads[order], np.arange(self.n + 1))
        level, self.levels, front = np.full(self.n, -1), [], np.array([root])
        while len(front):
            level[front] = len(self.levels)
            self.levels.append(front)
            sizes = start[front + 1] - start[front]
            at = np.repeat(start[front] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            front = np.unique(tails[at])
            front = front[level[front] < 0]
        if (level[there] < 0).any():
            raise np.linalg.LinAlgError("a network must be connected")
        place = np.zeros(self.n, np.int64)
        for nodes in self.levels:
            place[nodes] = np.arange(len(nodes))
        width = np.array([len(x) for x in self.levels])
        self.width, self.own = width, np.concatenate([[0], np.cumsum(width * width)])
        self.next = np.concatenate([[0], np.cumsum(width[:-1] * width[1:])]).astype(np.int64)
        nodes = np.flatnonzero(there)
        self.nodes, self.at = nodes, self.own[level[nodes]] + place[nodes] * (width[level[nodes]] + 1)
        self.inner = level[u] == level[v]
        iu, iv = u[self.inner], v[self.inner]
        self.in_at = [self.own[level[x]] + place[x] * width[level[x]] + place[y] for x, y in ((iu, iv), (iv, iu))]
        ou, ov = u[~self.inner], v[~self.inner]
        first, then = np.where(level[ou] < level[ov], ou, ov), np.where(level[ou] < level[ov], ov, ou)
        self.out_at = self.next[level[first]] + place[first] * width[level[then]] + place[then]

    def solve(self, weights: np.ndarray, ground: np.ndarray, right: np.ndarray) -> np.ndarray:
        w = np.bincount(self.same, weights[self.real], len(self.u)) if len(self.u) else np.zeros(0)
        diagonal = ground + np.bincount(self.u, w, self.n) + np.bincount(self.v, w, self.n)
        right, heads, shares = right.copy(), np.zeros(self.n), []
        for tips, links, up in self.turns:
            share = w[links] / diagonal[tips]
            shares.append(share)
            np.subtract.at(diagonal, up, w[links] * share)
            np.add.at(right, up, share * right[tips])
        own, ahead = np.zeros(self.own[-1]), np.zeros(self.next[-1])
        own[self.at] = diagonal[self.nodes]
        left = w[self.links]
        for at in self.in_at:
            own[at] = -left[self.inner]
        ahead[self.out_at] = -left[~self.inner]
        done, take = [], None
        for i, nodes in enumerate(self.levels):
            k = self.width[i]
            block, y = own[self.own[i] : self.own[i + 1]].reshape(k, k), right[nodes]
            if take is not None:
                block, y = block - take[0].T @ take[1], y - take[0].T @ take[2]
            if i + 1 < len(self.levels):
                link = ahead[self.next[i] : self.next[i + 1]].reshape(k, self.width[i + 1])
                both = np.linalg.solve(block, np.column_stack([link, y]))
                take = (link, both[:, :-1], both[:, -1])
                done.append(take[1:])
            else:
                done.append((None, np.linalg.solve(block, y)))
        for i in range(len(self.levels) - 1, -1, -1):
            to, z = done[i]
            heads[self.levels[i]] = z if to is None else z - to @ heads[self.levels[i + 1]]
        for (tips, _, up), share in zip(reversed(self.turns), reversed(shares), strict=True):
            heads[tips] = right[tips] / diagonal[tips] + share * heads[up]
        return heads


def solve_network(nodes: pd.DataFrame, pipes: pd.DataFrame, source, peak: float = 1.0, target: float = 15.0, tolerance: float = 1e-8, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Heads of nodes, flows of pipes (cubic metres a second, from node1 to
    node2) and the source's head, by the global gradient method: Newton steps
    on heads and flows together with Hazen-Williams losses.

    Demands are fixed, so heads move with the source's; the head at which the
    smallest pressure is target is met by one shift. The steps' equations are solved
    level by level (``Levels``).
    """
    place = {n: i for i, n in enumerate(nodes["node_id"])}
    n, a, b = len(place), pipes["node1"].map(place).to_numpy(), pipes["node2"].map(place).to_numpy()
    wide = pipes["diameter_mm"].to_numpy(float) / 1000
    length, rough = np.maximum(pipes["length_m"].to_numpy(float), 0.1), pipes["roughness"].to_numpy(float)
    a, b = np.append(a, n), np.append(b, place[source])  # a reservoir, and a short pipe to the source
    wide, length, rough = np.append(wide, wide.max()), np.append(length, 25.0), np.append(rough, 130.0)
    resistance = FACTOR * length / (rough**EXPONENT * wide**4.871)
    demand = nodes["demand_lps"].to_numpy(float) / 1000 * peak
    flow = np.full(len(a), max(demand.sum(), 1e-6) / 10)
    heads = np.zeros(n + 1)
    levels = Levels(n, a[:-1], b[:-1], place[source])
    for _ in range(rounds):
        step = 1 / (EXPONENT * resistance * np.maximum(np.abs(flow), 1e-7) ** (EXPONENT - 1))
        lag = flow / EXPONENT
        ground = np.zeros(n)
        ground[place[source]] = step[-1]
        right = np.append(-demand, 0.0)
        np.add.at(right, a, -(flow - lag))
        np.add.at(right, b, flow - lag)
        heads[:n] = levels.solve(step[:-1], ground, right[:n])
        new = flow - lag + step * (heads[a] - heads[b])
        moved, flow = np.abs(new - flow).sum() / max(np.abs(new).sum(), 1e-12), new
        if moved < tolerance:
            break
    shift = target - (heads[:n] - nodes["elevation_m"].to_numpy(float)).min()
    return heads[:n] + shift, flow[:-1], float(shift)


def solve(nodes: DataFrame, pipes: DataFrame, sources: DataFrame, peak: float = 1.0, target: float = 15.0) -> DataFrame:
    """Solves every network (column network_id) on a worker of its own:
    (network_id, kind, id, node1, node2, head_m, pressure_m, flow_lps,
    velocity_ms, headloss_m_per_m); kind is node, pipe or source. Networks must
    be connected; one network must fit a worker."""
    shape = "network_id long, kind string, id long, node1 long, node2 long, head_m double, pressure_m double, flow_lps double, velocity_ms double, headloss_m_per_m double"
    as_rows = lambda df, kind, cols: df.select("network_id", F.lit(kind).alias("kind"), *[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in cols])
    cols = (("node_id", "long"), ("link_id", "long"), ("node1", "long"), ("node2", "long"), ("elevation_m", "double"), ("demand_lps", "double"), ("length_m", "double"), ("diameter_mm", "double"), ("roughness", "double"))
    rows = as_rows(nodes, "node", cols).union(as_rows(pipes, "pipe", cols)).union(as_rows(sources, "source", cols))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, links = pdf[pdf.kind == "node"].sort_values("node_id"), pdf[pdf.kind == "pipe"].sort_values("link_id")
        source = pdf[pdf.kind == "source"].node_id.min()
        heads, flows, head = solve_network(own, links, source, peak, target)
        at = dict(zip(own.node_id, heads, strict=True))
        area = math.pi * (links.diameter_mm.to_numpy(float) / 1000) ** 2 / 4
        loss = np.abs(links.node1.map(at).to_numpy(float) - links.node2.map(at).to_numpy(float)) / np.maximum(links.length_m.to_numpy(float), 0.1)
        out = [pd.DataFrame({"kind": "node", "id": own.node_id, "head_m": heads, "pressure_m": heads - own.elevation_m.to_numpy(float)}), pd.DataFrame({"kind": "pipe", "id": links.link_id, "node1": links.node1, "node2": links.node2, "flow_lps": flows * 1000, "velocity_ms": np.abs(flows) / area, "headloss_m_per_m": loss}), pd.DataFrame({"kind": ["source"], "id": [source], "head_m": [head]})]
        out = pd.concat(out).assign(network_id=pdf.network_id.iloc[0])
        return out.reindex(columns=[c.split()[0] for c in shape.split(", ")]).astype({"id": "Int64", "node1": "Int64", "node2": "Int64"})

    return rows.groupBy("network_id").applyInPandas(run, shape)


def check_network(nodes: DataFrame, pipes: DataFrame) -> DataFrame:
    """(problem, id): what keeps a network from being solved."""
    bad = lambda df, key, condition, name: df.filter(condition).select(F.lit(name).alias("problem"), F.col(key).cast("string").alias("id"))
    known = nodes.select(F.col("node_id"))
    loose = pipes.select("link_id", F.explode(F.array("node1", "node2")).alias("node_id")).join(known, "node_id", "left_anti").select(F.lit("unknown end").alias("problem"), F.col("link_id").cast("string").alias("id"))
    lone = known.join(pipes.select(F.explode(F.array("node1", "node2")).alias("node_id")), "node_id", "left_anti").select(F.lit("no pipe").alias("problem"), F.col("node_id").cast("string").alias("id"))
    return bad(pipes, "link_id", "diameter_mm IS NULL OR diameter_mm <= 0", "diameter").union(bad(pipes, "link_id", "length_m IS NULL OR length_m <= 0", "length")).union(bad(pipes, "link_id", "node1 = node2", "loop")).union(loose).union(lone)


