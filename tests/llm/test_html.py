import time

import numpy as np
import pytest

from netweave.llm import html_labeller as h
from netweave.llm.html_blocks import blocks
from netweave.llm.html_pages import make_page


@pytest.fixture(scope="module")
def model():
    return h.trained()


def test_blocks():
    page = '<head><title>T</title></head><body><!-- x --><nav class="topMenu"><a href=x>one</a><a>two</a></nav><p>A <b>bold\n <br>word<p>&amp; n&eacute;xt&nbsp;x<script>var t="</p>";</script><div id=ad-box>b</div>tail <img alt="a>b"> end <em cut'
    found = blocks(page)
    assert [b.text for b in found] == ["onetwo", "A bold word", "& néxt x", "b", "tail end"]
    assert found[0].path == ("<nav>", "top", "menu", "<a>") or found[0].path == ("<nav>", "top", "menu")
    assert found[0].linked == 6 and "ad" in found[3].path and "box" in found[3].path
    for odd in ("", "<", "<p", "&am", "</x>", "<p>" * 3000 + "x", "<<<>>>", "<a href='", "text only", "<script>never closed", "<!-- open"):
        blocks(odd)
    assert [b.text for b in blocks("text only")] == ["text only"]
    assert [b.text for b in blocks("<ul><li>a<li>b<ul><li>c</ul></ul>d")] == ["a", "b", "c", "d"]


def test_heads_and_comments():
    """Text ends the head; comments end as in browsers."""
    for page, want in [
        ("<html><head><title>x</title>Hello world</html>", ["Hello world"]), ("<head>bare text", ["bare text"]), ("<head><title>t</title>stray<p>para</p>", ["stray", "para"]),
        ("<head>\n<meta a>\n<style>p {}</style>\n</head>\n<body>x", ["x"]), ("<p>a<!-- x --!>b<p>c<!-->d<!--->e<!-- --->f", ["ab", "cdef"]), ("a<!-- -- > <p> --> b", ["a b"]), ("a<!-- never closed <p>b", ["a"]),
    ]:
        assert [b.text for b in blocks(page)] == want, page


def test_gradients():
    model = h.Labeller(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    pages, truth = zip(*(h.marked(make_page(i)) for i in (3, 4)), strict=True)
    pages, truth = [p[:5] for p in pages], np.concatenate([t[:5] for t in truth])
    _, g = model.gradients(pages, truth)
    r = np.random.default_rng(0)
    for k, v in model.p.items():
        places = np.argwhere(np.abs(g[k]) > 1e-6)
        for at in map(tuple, places[r.choice(len(places), min(3, len(places)), replace=False)]):
            old = v[at]
            v[at] = old + 1e-3
            up = model.gradients(pages, truth)[0]
            v[at] = old - 1e-3
            down = model.gradients(pages, truth)[0]
            v[at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), k


def test_held_out_accuracy(model):
    right = total = whole = n = 0
    for i in range(500_000, 500_300):
        page, truth = h.marked(make_page(i))
        if page:
            same = (model.probabilities([page])[0] >= 0.5) == (truth > 0)
            right, total, whole, n = right + same.sum(), total + len(page), whole + same.all(), n + 1
    assert right / total > 0.995 and whole / n > 0.97


def test_extract(spark, model):
    body = "<nav><ul><li><a href=/a>Home</a></li></ul></nav><div class=ad>Buy now.</div><article><h1>Title &amp; more</h1><p><b>First\n  part.<br><p>Second part.</p></article><section class=comments><p>I think this is a long comment by a reader of the page.</p></section><footer>&copy; x</footer>"
    rows = [(1, "u", f"<html><head><title>T</title></head><body>{body}</body></html>", "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<head><title>only</title>", "x"), (None, "u", body, "x"), (5, "u", "<article>" + "<p>word word word.</p>" * 3000 + "</article>", "x"), (1, "u", f"<html><head><title>T</title></head><body>{body}</body></html>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {}
    for r in h.extract(df, "page_id", "url", "html", model).collect():
        got.setdefault(r.page_id, []).append(r)
    want = "Title & more\nFirst part.\nSecond part."
    assert [r.text for r in got[1]] == [want, want] and got[None][0].text == want and got[1][0].n_chars == len(want)
    assert [got[i][0].text for i in (2, 3, 4)] == [""] * 3 and got[2][0].url is None
    assert got[5][0].text == "\n".join(["word word word."] * 3000)
    assert h.extract(df.limit(0), "page_id", "url", "html", model).count() == 0


def test_inline_elements_do_not_split(model):
    """Pages written by hand, with the text a reader would take."""
    filler = "The river had been rising for three days when the council met, and nobody in the room expected the bridge to hold."
    nav = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
    foot = "<footer><p>All rights reserved.</p></footer>"
    cases = {
        "<p>one <svg><text>x</text></svg>two</p>": ["one two"],
        "<p>a<script>1</script>b</p>": ["ab"],
        "<p>one<noscript>x</noscript> two</p>": ["one two"],
        "x <custom-tag>y</custom-tag> z": ["x y z"],
        "<p>say <ruby>kan<rt>ji</rt></ruby>, <output>4</output></p>": ["say kanji, 4"],
        "<div>a<p>b</div>c": ["a", "b", "c"],
    }
    for html, want in cases.items():
        assert [b.text for b in blocks(html)] == want
    inline = {"an <svg><g/></svg>icon": "an icon", "a<script>f('</p>')</script> script": "a script", "<x-y>own</x-y> tags": "own tags", "a <template><p>no</p></template>template": "a template"}
    pages = [f"<html><head><title>t</title></head><body>{nav}<article><h1>A title of it</h1><p>{filler}</p><p>{k}, {filler}</p></article>{foot}</body></html>" for k in inline]
    assert h.main_texts(model, pages) == [f"A title of it\n{filler}\n{v}, {filler}" for v in inline.values()]
    assert h.main_texts(model, [filler, f"{filler}<br>{filler}", "", " \n"]) == [filler, f"{filler} {filler}", "", ""]


def test_deep_nesting():
    n = 20_000
    for page, want in (("<div>x" * n, n), ("<div class=a><span>x" * n, n), ("<b>x" * n + "</i>" * n, 1)):
        began = time.thread_time()
        assert len(blocks(page)) == want
        assert time.thread_time() - began < 5
