import re

from netweave.llm import url_filter as u
from netweave.llm.queries import URL_RULES


def fits(glob, text):
    pattern = "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "(?s:.)"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", glob, re.S))
    return re.fullmatch(pattern, text) is not None


def test_automaton_equals_regex():
    globs = ["*.example.org/es/**", "example.org/es/**", "a?c", "**", "*", "", "**/x/**", "ü?/*", "*a*b*", "end**"] + ["p" * i + "*q" for i in range(1, 40)]
    texts = ["", "a", "abc", "aüc", "example.org/es/1", "x.example.org/es/", "x/y.example.org/es/1", "m/x/n", "üö/z", "üö/z/z", "xaybz", "ab", "end", "endless/x", "pppq", "p" * 30 + "zzq", "x" * 5000 + "/x/" + "y" * 70]
    got = u.GlobAutomaton(globs).match([t.encode() for t in texts])
    assert got.tolist() == [[fits(g, t) for g in globs] for t in texts]
    assert u.GlobAutomaton(globs).words > 1


def test_judges(spark):
    rows = [
        (1, "http://EXAMPLE.org/es/1", "x"), (2, "http://a.example.org/en/12?q=/es/", "x"), (3, "http://a.org", "x"), (4, None, "x"), (5, "no scheme", "x"),
        (6, "https://m.ads-track.example.com/en/1", "x"), (7, "https://ads-track.example.com/fr/1", "x"), (8, "http://x.com/de/#y", "x"), (8, "http://x.com/de/#y", "x"),
        (None, "http://org/", ""), (9, "", None), (10, "http://host" + "a" * 9000 + ".net/" + "b" * 9000, "x"), (11, "http://evil.net/x.example.org/es/1", "x"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = sorted(((r.page_id or -1, r.host[:20], r.path[:9], r.rule, r.verdict, r.matched_glob) for r in u.filter_urls(df, "page_id", "url", URL_RULES).collect()), key=str)
    want = sorted([
        (1, "example.org", "/es/1", "example.org/es/", "block", None), (2, "a.example.org", "/en/12", "example.org/en/1", "block", None), (3, "a.org", "", None, "allow", None),
        (4, "", "", None, "allow", None), (5, "", "", None, "allow", None), (6, "m.ads-track.example.", "/en/1", None, "block", "*.ads-*/**"),
        (7, "ads-track.example.co", "/fr/1", "com/fr/", "allow", "ads-*/**"), (8, "x.com", "/de/", "com/de/", "block", None), (8, "x.com", "/de/", "com/de/", "block", None),
        (-1, "org", "/", "org/", "allow", None), (9, "", "", None, "allow", None), (10, "hostaaaaaaaaaaaaaaaa", "/bbbbbbbb", None, "allow", None), (11, "evil.net", "/x.exampl", None, "allow", None),
    ], key=str)
    assert got == want
    assert u.filter_urls(df.limit(0), "page_id", "url", URL_RULES).count() == 0
