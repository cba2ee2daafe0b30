import random

from hypothesis import given, settings
from hypothesis import strategies as st

from netweave.llm import decontaminate as d


def distance_in(pattern, text):
    """Smallest edit distance of pattern to a part of text (dynamic programme)."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("ab ", min_size=1, max_size=90), st.text("ab ", max_size=120))
def test_myers(pattern, text):
    assert d.best_end(d.masks(pattern), len(pattern), text)[0] == distance_in(pattern, text)


def edited(r, text, edits):
    for _ in range(edits):
        at, kind = r.randrange(len(text)), r.randrange(3)
        text = text[:at] + ("" if kind == 0 else r.choice("abcxyz")) + text[at + (kind < 2) :]
    return text


def cases():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 40)))) for i in range(30)]
    docs = []
    for i in range(200):
        text = " ".join(word() for _ in range(r.randint(0, 60)))
        if i % 2:
            part = edited(r, r.choice(items)[1], r.randrange(25))
            text = f"{text}. {part.upper() if i % 3 else part}! {word()}"
        docs.append((i, text))
    return items, docs


def test_finds_what_comparing_all_finds(spark):
    items, docs = cases()
    items += [(90, None), (91, ""), (92, "?!"), (93, "tiny"), (0, items[0][1])]
    docs += [(900, None), (901, ""), (902, "a tiny one"), (903, "atinyone"), (None, items[1][1]), (1, docs[1][1]), (904, "filler " * 50000 + items[2][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in d.contaminated(df, "doc_id", "text", bench, "item_id", "text").collect():
        got[(r.doc_id, r.item_id)] = r
    want = {}
    for i, t in docs:
        for k, x in items:
            pattern, text = d.normal(x), d.normal(t)
            if not pattern or len(text) > 9999:
                continue
            budget = int(len(pattern) * d.RATE)
            if (found := distance_in(pattern, text)) <= budget and (budget or f" {pattern} " in f" {text} "):
                want[(i, k)] = found
    want[(904, 2)] = 0
    assert set(got) == set(want)
    assert {k: r.distance for k, r in got.items()} == want
    text = dict(docs)[903 + 1]
    assert text[got[(904, 2)].start : got[(904, 2)].end] == items[2][1]
    kept = d.drop_contaminated(df, "text", bench, "item_id", "text")
    bad = {i for i, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad) and kept.columns == df.columns


def test_blocks_and_empty(spark, monkeypatch):
    items, docs = cases()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(d.contaminated(df, "doc_id", "text", bench, "item_id", "text").collect())
    blocks = d.item_blocks
    monkeypatch.setattr(d, "item_blocks", lambda *a: blocks(*a, block_chars=1500))
    assert sorted(d.contaminated(df, "doc_id", "text", bench, "item_id", "text").collect()) == whole
    assert d.contaminated(df, "doc_id", "text", bench.limit(0), "item_id", "text").count() == 0
    assert d.contaminated(df.limit(0), "doc_id", "text", bench, "item_id", "text").count() == 0
