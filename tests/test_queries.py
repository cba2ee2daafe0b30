"""The engine's queries against SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from netweave.plans import fixtures, registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def text(value):
    if isinstance(value, list | tuple):
        return [text(v) for v in value]
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(value)
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sql, name):
    got = registry.queries()[name](spark, FOLDER)
    cursor = sql.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = lambda found, cols: sorted(str([text(r[cols.index(c)]) for c in order]) for r in found)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(cursor.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() > 0


def test_welds_all_pipes(spark):
    """Which lines stay, against all pairs of ends."""
    pipes = fixtures.net_pipes(spark, FOLDER).collect()
    ends = sorted({p for r in pipes for p in ((r.x1, r.y1), (r.x2, r.y2))})
    root = {p: p for p in ends}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(ends):
        for b in ends[:i]:
            if math.dist(a, b) <= 15.0:
                root[find(a)] = find(b)
    want = sorted(r.link_id for r in pipes if find((r.x1, r.y1)) != find((r.x2, r.y2)))
    assert sorted(r.line_id for r in registry.queries()["weld_endpoints"](spark, FOLDER).collect()) == want


def test_nodes_all_pipes(spark):
    """Cutting and merging keep the length of all networks; where chords of
    one straight line lie on each other, it counts once."""
    spans = {}
    for r in fixtures.net_pipes(spark, FOLDER).collect():
        (ax, ay), (bx, by) = sorted(((round(r.x1 * 10), round(r.y1 * 10)), (round(r.x2 * 10), round(r.y2 * 10))))
        g = math.gcd(bx - ax, by - ay)
        dx, dy = (bx - ax) // g, (by - ay) // g
        spans.setdefault((dx, dy, ax * dy - ay * dx), []).append((ax * dx + ay * dy, bx * dx + by * dy))
    want = 0.0
    for (dx, dy, _), found in spans.items():
        end = -math.inf
        for low, high in sorted(found):
            want += max(0, high - max(low, end)) / math.hypot(dx, dy) / 10
            end = max(end, high)
    got = sum(r.length_m for r in registry.queries()["node_and_merge"](spark, FOLDER).collect())
    assert got == pytest.approx(want, rel=1e-4)
