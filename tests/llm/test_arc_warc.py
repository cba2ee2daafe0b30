import gzip
import hashlib

from netweave.llm import arc_warc as a


def test_arc_versions():
    blocks = [("http://x.org/a b", b"HTTP/1.1 200 OK\r\nX-Capture-Id: 4\r\n\r\n<p>\n\n\xff</p>"), ("dns:x.org", b"20240101\n1.2.3.4"), (None, b"")]
    for version in (1, 2):
        content = a.write_arc(blocks, version)
        found = list(a.parse_arc(content))
        assert [r["URL"] for r in found] == ["filedesc://segment.arc", "http://x.org/a%20b", "dns:x.org", "urn:none"]
        assert [r["body"] for r in found[1:]] == [b for _, b in blocks]
        assert list(a.parse_arc(gzip.compress(content))) == found
        rows = [a.convert(r, i) for i, r in enumerate(found)]
        assert [r[1] for r in rows] == ["warcinfo", "response", "resource", "resource"]
        assert rows[1][2] == "2024-01-01T00:00:00Z" and rows[1][9] == hashlib.sha256(b"<p>\n\n\xff</p>").hexdigest() and rows[1][10] == 4
        assert rows[1][0].startswith("<urn:uuid:") and len({r[0] for r in rows}) == 4
        cut = list(a.parse_arc(content[:-20]))
        assert cut[-1]["truncated"] or len(cut) < len(found)
    assert list(a.parse_arc(b"")) == [] and list(a.parse_arc(b"\n\nrubbish line\n")) == []
    old = b"http://o.org/ 1.1.1.1 199610 text/html 3\nabc\n"
    assert [a.convert(r, 0)[2] for r in a.parse_arc(old)] == ["1996-10-01T00:00:00Z"]


def test_round_trip(spark, tmp_path):
    long = "p" * 150
    rows = [(5, "http://a/", long, "z"), (3, "http://b/", long, "z"), (9, "http://c/", long, "z"), (1, None, None, "z"), (2, "u", "", None), (4, "http://d/x y", "short", "z"), (6, "http://e/", "short", "z"), (8, "http://f/", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9 + "ü日\r\n\r\n", "z"), (7, "http://g/", "x" * 3_000_000, "z"), (7, "http://g/", "x" * 3_000_000, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    for version in (1, 2):
        records = a.arc_to_warc(a.pages_to_arc(df, "page_id", "url", "html", version=version, per_segment=3))
        path = str(tmp_path / f"warc{version}")
        a.write_warc(a.mark_revisits(records), path)
        got = a.read_warc(spark, path).filter("record_type IN ('response', 'revisit')").collect()
        assert len(got) == len(rows)
        for r in got:
            html = next(h for i, _, h, _ in rows if i == r.capture_id) or ""
            assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
            want = ("revisit", 3) if r.capture_id in (5, 9) else ("response", None)
            assert (r.record_type, r.refers_to) == want
            assert bytes(r.payload) == (html.encode() if want[0] == "response" else b"")
    assert a.arc_to_warc(a.pages_to_arc(df.limit(0), "page_id", "url", "html")).count() == 0


def test_dates_lengths_and_identifiers():
    assert a.iso_date("20240231250000") == "2024-02-29T23:00:00Z" and a.iso_date("20230231006199") == "2023-02-28T00:59:59Z"
    assert a.iso_date("0000") == "0001-01-01T00:00:00Z"
    short = b"http://o.org/ 1.1.1.1 20240101000000 text/html 2\nabcdef\nhttp://p.org/ 1.1.1.1 20240101000000 text/html 1\nz\n"
    assert [(r["URL"], r["body"]) for r in a.parse_arc(short)] == [("http://o.org/", b"ab"), ("http://p.org/", b"z")]  # what is beyond the length is no header
    same = [("http://x/", b"HTTP/1.1 200 OK\r\n\r\nx")]
    ids = [a.convert(r, i, name)[0] for name in ("first", "second") for i, r in enumerate(a.parse_arc(a.write_arc(same)))]
    assert len(set(ids)) == 4
    info = a.convert(next(a.parse_arc(a.write_arc(same))), 0)
    assert info[1] == "warcinfo" and all(b": " in line for line in info[6].rstrip().split(b"\r\n"))


def test_version_block_stands_at_the_start(spark, tmp_path):
    rows = [(i, url, html, i) for i, (url, html) in enumerate([("filedesc://trap.arc", "one" * 50), ("http://a/", "filedesc://x 0.0.0.0 20240101000000 text/plain 3\nabc\n"), ("filedesc:", ""), ("http://b/", "one" * 50), ("filedesc:y z", "two")])]
    df = spark.createDataFrame([*rows, rows[1], rows[1]], "page_id long, url string, html string, n_bytes long")
    for version in (1, 2):
        path = str(tmp_path / f"v{version}")
        a.write_warc(a.mark_revisits(a.arc_to_warc(a.pages_to_arc(df, "page_id", "url", "html", version=version, per_segment=2))), path, file_bytes=700)
        got = a.read_warc(spark, path).collect()
        pages = [r for r in got if r.record_type != "warcinfo"]
        assert sorted((r.capture_id, r.record_type, r.refers_to) for r in pages) == [(0, "response", None), (1, "response", None), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 0), (4, "response", None)]
        assert {r.capture_id: r.target_uri for r in pages}[4] == "filedesc:y%20z"
        info = [r for r in got if r.record_type == "warcinfo"]
        assert info and all(r.target_uri is None for r in info)
        assert len({r.record_id for r in got}) == len(got)
        names = spark.read.parquet(f"{path}/manifest").collect()
        assert sum(r.n_records for r in names) == len(got) and len(names) > 2
        for r in names:
            content = (tmp_path / f"v{version}" / r.name).read_bytes()
            assert len(content) == r.n_bytes and content.count(b"\x1f\x8b\x08\x00") >= r.n_records  # a member for each
            if b"warcinfo" in gzip.decompress(content):
                head = gzip.decompress(content).split(b"WARC-Type: warcinfo")[1].split(b"\r\n\r\n")[0]
                assert b"Target-URI" not in head and b"IP-Address" not in head
    other = tmp_path / "other"
    other.mkdir()
    (other / "x.warc").write_bytes(gzip.decompress((tmp_path / "v2" / names[0].name).read_bytes()))
    assert a.read_warc(spark, str(other)).count() == names[0].n_records  # a folder of others' files, no manifest
    empty = str(tmp_path / "empty")
    a.write_warc(a.mark_revisits(a.arc_to_warc(a.pages_to_arc(df.limit(0), "page_id", "url", "html"))), empty)
    assert a.read_warc(spark, empty).count() == 0
