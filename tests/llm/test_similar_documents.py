import random

import corpus_pipeline


def sets(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def survivors(rows, similarity=0.8):
    own = [(i, sets(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1], own[b][1]
            if len(x & y) >= similarity * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    best = {}
    for a, (i, _) in enumerate(own):
        r = find(a)
        best[r] = min(best.get(r, i), i)
    return sorted(best.values())


def corpus():
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 9))) for _ in range(3000)]
    passage = r.choices(words, k=200)
    texts = [None, "", " \n", "one", "ONE", "one two", "one two three four five"]
    for _ in range(60):
        base = r.choices(words, k=r.randint(200, 400))
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 8, 30):  # near copies, some of them beyond 0.8
            near = list(base)
            for at in r.sample(range(len(near)), edits):
                near[at] = r.choice(words)
            texts.append(" ".join(near).upper() if edits == 2 else " ".join(near))
    texts += [" ".join(passage + r.choices(words, k=r.randint(20, 60))) for _ in range(150)]  # a passage that many share
    r.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies(spark):
    rows = corpus()
    df = spark.createDataFrame([*rows, rows[9]], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == survivors(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0
