import re
from collections import Counter, defaultdict

import pytest

from netweave.llm import source_mix as m


def targets(sizes):
    """The excess over three times a source's size is shared again by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in above}


def rows():
    out = [(i, " ".join(["w"] * (i % 7 + 1)), f"s{i % 5}", "clash") for i in range(400)]
    out += [(1000 + i, "x y  z\tq", "tiny", "c") for i in range(2)] + [(2000 + i, "a b", None, None) for i in range(30)]
    return out + [(5000, None, "s1", "c"), (5001, "", "s1", "c"), (5002, " \n ", "empty", "c"), (None, "no id here", "s2", "c"), (7, out[7][1], "s2", "clash"), (7, out[7][1], "s2", "clash")]


def test_mix(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size string")
    got = m.mix(df, "doc_id", "text", "source").collect()
    assert len(got) == len(rows())
    sizes = defaultdict(int)
    for _, text, source, _ in rows():
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.target <= 3 * r.source_size + 1e-9
        assert r.taken == r.times * r.size and r.times <= 3
        taken[r.source] += r.taken
    total = sum(sizes.values())
    assert sum(taken.values()) <= total and sum(taken.values()) > total - 8
    assert all(abs(taken[s] - want[s]) <= 8 for s in sizes)
    key = lambda r: (str(r.doc_id), r.text_key, r.finish or 0)
    assert sorted(got, key=key) == sorted(m.mix(df.repartition(7), "doc_id", "text", "source").collect(), key=key)
    # by brute force: all copies by virtual finish time, cut where the budget is spent
    copies = sorted(r.finish + k * r.source_size / r.target for r in got if r.size for k in range(3))
    last = max(r.finish + (r.times - 1) * r.source_size / r.target for r in got if r.times)
    assert copies[sum(r.times for r in got) - 1] == pytest.approx(last)


def test_serve(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size string")
    planned = m.mix(df, "doc_id", "text", "source")
    served = m.serve(df, "doc_id", "text", "source")
    assert served.columns == [*df.columns, "mix_pass", "mix_finish"]
    assert served.count() == planned.agg({"times": "sum"}).first()[0]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mix(df, "doc_id", "text", "source").count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in m.mix(blank, "doc_id", "text", "source").collect()] == [(0, 0.0)] * 2
