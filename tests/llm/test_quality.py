import random

import numpy as np

from netweave.llm import quality as q


def made(seed, n):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices(["ka", "lo", "mi", "te", "ru", "the", "an"], k=r.randint(1, 4))) for _ in range(500)]
    out = []
    for i in range(n):
        words = r.choices(vocabulary, k=r.randint(8, 200))
        kind = i % 10
        prose = " ".join(w + r.choice([".", ",", "", "", "", "", ""]) for w in words).capitalize() + "."
        if kind == 0:
            text = " ".join(w + r.choice(["%%%", "***", "$$$"]) for w in words)
        elif kind == 1:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 2:
            text = " ".join(" ".join([w] * 12) for w in words[:20])
        else:
            text = prose
        out.append((i, text, int(kind > 2)))
    return out


def test_summary_in_pieces(monkeypatch):
    texts = [t.encode() for _, t, _ in made(1, 30)] + [b"", b" ", b"a", b"one two\none two\nx", b"x" * 500]
    whole = [q.read(t) for t in texts]
    monkeypatch.setattr(q, "PIECE", 64)
    for t, (s, _) in zip(texts, whole, strict=True):
        now = q.read(t)[0]
        assert (now.size, now.words if len(t) != 500 else s.words, now.letters, now.stops) == (s.size, s.words, s.letters, s.stops)
    s = q.read(b"The the THE cat, sat.\nThe the THE cat, sat.\n")[0]
    assert (s.words, s.lines, s.distinct_lines, s.stops, s.distinct, s.upper) == (10, 2, 1, 4, 5, 8)


def test_accuracies_are_found():
    r = np.random.default_rng(0)
    truth = r.random(20000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where((r.random((20000, 5)) < right) == truth[:, None], q.GOOD, q.BAD)
    votes[r.random((20000, 5)) < 0.3] = q.NOTHING
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = q.fit_votes(patterns, counts.astype(float))
    assert np.abs(model.accuracy - right).max() < 0.03 and abs(model.prior - 0.3) < 0.03


def test_held_out(spark):
    train = made(1, 600)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in train] + [(9001, None, "x"), (9002, "", "x"), (9003, " \n", "x"), (None, "A short clean line, no more.", "x"), (9004, "word " * 300_000, "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in q.classify(df, "doc_id", "text").collect()}
    assert np.mean([got[i].accepted == bool(y) for i, _, y in train]) > 0.99 and all(got[i].accepted for i, _, y in train if y)
    assert not any(got[i].accepted or got[i].score for i in (9001, 9002, 9003)) and got[None].accepted and not got[9004].accepted
    model = q.fit(df, "text")
    score = q._scored(model)
    fresh = made(77, 400)
    assert np.mean([(score(t.encode())[2] >= 0.5) == bool(y) for _, t, y in fresh]) > 0.98
    kept = q.keep_accepted(df, "text")
    assert kept.columns == df.columns and kept.count() == sum(r.accepted for r in got.values())
    assert q.classify(df.limit(0), "doc_id", "text").count() == 0


def test_pieces_decide_nothing(monkeypatch):
    """Words and lines longer than a piece, and n-grams across pieces."""
    r = np.random.default_rng(4)
    texts = [t.encode() for _, t, _ in made(1, 30)] + [b"", b"x" * 500, b"a b\n" * 90, b"one two " * 60 + b"\n" + b"one two " * 60, "\u65e5\u672c".encode() * 100 + b" x\n\n\ny"]
    texts += [bytes(r.choice(np.frombuffer(b"ab \n.#", np.uint8), 700)) for _ in range(40)]
    whole = [q.read(t) for t in texts]
    for piece in (1, 7, 64):
        monkeypatch.setattr(q, "PIECE", piece)
        for t, (s, grams) in zip(texts, whole, strict=True):
            now = q.read(t)
            assert now[0] == s and (now[1] == grams).all()
    lines = [x.split() for x in texts[-1].split(b"\n") if x.split()]
    assert (whole[-1][0].lines, whole[-1][0].distinct_lines) == (len(lines), len(set(map(tuple, lines))))


def test_labelled_rows(spark):
    """What the labels of the test tables call good and bad."""
    folder = "/root/testdata/sf0.01"
    docs, truth = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = q.classify(docs, "doc_id", "text").join(truth, "doc_id").groupBy("quality", "accepted").count().collect()
    n = {(x.quality, x.accepted): x["count"] for x in found}
    assert n.get((1, False), 0) <= 0.01 * (n.get((1, False), 0) + n[1, True])
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))
