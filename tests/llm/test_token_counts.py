import bisect

import pytest

from netweave.llm import token_counts as t

TEXTS = [None, "", "one line", "a\n\nb\n", "\n", "Ünïcödé 日本語 text\nwith emoji 🙂🙂 here\n  spaces   \n\n\nend", "x" * 3000, "don't stop 123\t\r\nnow " * 50, "word " * 20000]


def expected(text, tokenizer):
    """By the offsets of another implementation of the same vocabulary."""
    spans = [o for o in tokenizer.encode(text, add_special_tokens=False).offsets]
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    if len(starts) > 1 and starts[-1] == len(text):
        starts.pop()
    counts = [0] * len(starts)
    for a, _ in spans:
        counts[max(0, bisect.bisect_right(starts, a) - 1)] += 1
    return counts


def test_sections(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    rows = [(i, x, "clash") for i, x in enumerate(TEXTS)] + [(2, TEXTS[2], None), (None, "no id", None)]
    got = {str(r.doc_id): r for r in t.count_sections(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), "doc_id", "text").collect()}
    for i, text in enumerate(TEXTS):
        want = expected(text, tokenizer) if text else []
        r = got[str(i)]
        assert (r.section_tokens, r.n_tokens, r.n_sections, r.n_chars) == (want, sum(want), len(want), len(text or ""))
    assert got["None"].n_tokens == 2
    assert t.count_sections(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_fields_and_rules(spark):
    df = spark.createDataFrame([(1, "head", None, "the body"), (2, None, None, None)], "id long, a string, b string, c string")
    got = {r.id: r for r in t.count_fields(df, "id", ["a", "b", "c"]).collect()}
    assert len(got[1].section_tokens) == 3 and sum(got[1].section_tokens) == got[1].n_tokens and got[2].n_tokens == sum(got[2].section_tokens)
    import numpy as np

    ends, starts, stops = np.array([3, 10, 12]), np.array([0, 5]), np.array([4, 12])
    assert t.attribute(ends, starts, stops, "first")[0].tolist() == [2, 1]
    assert t.attribute(ends, starts, stops, "most")[0].tolist() == [1, 2]
    with pytest.raises(ValueError):
        t.attribute(ends, starts, stops, "none")
