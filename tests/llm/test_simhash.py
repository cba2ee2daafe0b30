import random

import numpy as np
import xxhash

from netweave.llm import simhash as s


def plain(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(bits, radius=3):
    label = {b: b for b in bits}
    order = sorted(label)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {b: root(b) for b in bits}


def texts():
    r = random.Random(3)
    out = [None, "", " \t\n", "Ä ä", "one", "ONE", "one two", "one two three", "One  Two x three"]
    base = [" ".join(r.choices("abcdefghij", k=60)) for _ in range(40)]
    for b in base:
        out.append(b)
        words = b.split()
        for _ in range(4):
            words[r.randrange(60)] = r.choice("xyz")
            out.append(" ".join(words))
    return out + base[:5] + ["z " * 200_000]


def test_fingerprint():
    for t in texts()[:-1]:
        assert s.fingerprint(None if t is None else t.encode()) == plain(t)
    old, s.CHUNK = s.CHUNK, 7
    try:
        assert all(s.fingerprint((t or "").encode()) == plain(t) for t in texts()[:60])
    finally:
        s.CHUNK = old


def test_components(spark):
    rows = [(i * 3 % 101 + i // 101 * 200, t, "x") for i, t in enumerate(texts())] + [(None, "one two three", "x"), (5, "one", "x"), (5, "one", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bits string")
    got = s.near_duplicates(df, "doc_id", "text")
    bits = [plain(t) for _, t, _ in rows]
    root = components(bits)
    low = {}
    for (i, _, _), b in zip(rows, bits, strict=True):
        if i is not None:
            low[root[b]] = min(low.get(root[b], i), i)
    want = sorted((str(i), f"{b:016x}", low[root[b]]) for (i, _, _), b in zip(rows, bits, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want
    kept = s.keep_first(df, "doc_id", "text")
    assert kept.columns == df.columns and kept.count() == len(set(root.values()))
    assert s.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_crowded_tiles(spark):
    r, old = random.Random(1), s.TILE
    centre = r.getrandbits(64)
    bits = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for _ in range(900)} | {r.getrandbits(64) for _ in range(300)}
    s.TILE = 40
    try:
        df = spark.createDataFrame([(int(np.array(b, np.uint64).view(np.int64)),) for b in bits], "bits long")
        found = s.connected_components(s.links(df)).collect()
    finally:
        s.TILE = old
    label = {x.node: x.component for x in found}
    root = components(bits)
    groups, want = {}, {}
    for b in bits:
        signed = int(np.array(b, np.uint64).view(np.int64))
        groups.setdefault(label.get(signed, signed), set()).add(b)
        want.setdefault(root[b], set()).add(b)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
