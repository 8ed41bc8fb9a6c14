import base64
import gzip
import hashlib
import html.parser

import pytest

from dyadic.llm import warc


class Visible(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        if tag in ("p", "br", "div", "li", "h1"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")
        if tag in ("p", "div", "li", "h1"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def visible(markup):
    v = Visible()
    v.feed(markup)
    return [" ".join(x.split()) for x in "".join(v.out).split("\n") if x.split()]


def test_plain_text_equals_a_parser(rnd):
    bits = ["<p>", "</p>", "<br/>", "one &amp; two", "<b>bold</b>", "<!-- gone <p> -->", "<script>var a = '<p>';</script>", "<h1 class='x'>Head</h1>", "tail\n  more", "<style>p{}</style>", "é &eacute; &#233;", "<div>in</div>", " "]
    for _ in range(200):
        markup = "<html><head><title>t</title></head><body>" + "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 20))) + "</body></html>"
        assert [x for x in warc.plain_text(markup).split("\n") if x] == [x for x in visible(markup)]


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def fields(r):
    return {h["name"]: h["value"] for h in r.headers}


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/", "<p>Hello</p>"), (2, None, None), (3, "http://b/", ""), (None, "http://c/", "<p>" + "long " * 100_000), (1, "http://a/", "<p>Hello</p>"), (4, "http://d/", "a\r\n\r\nWARC/1.0\r\n\r\nb")]
    return spark.createDataFrame([(*r, "refers", "kind") for r in rows], "page_id long, url string, html string, refers_to string, type string")


def test_derived_records_are_linked(pages):
    sources = {(r.page_id, r.record_id): r for r in warc.responses(pages).collect()}
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 12 and {r.type for r in made} == {"metadata", "conversion"}
    for r in made:
        source, f = sources[r.page_id, r.refers_to], fields(r)
        assert f["WARC-Refers-To"] == source.record_id and f["WARC-Refers-To-Date"] == source.date and f["WARC-Record-ID"] == r.record_id
        assert f["WARC-Block-Digest"] == sha1(r.block) and int(f["Content-Length"]) == len(r.block) and f.get("WARC-Target-URI") == source.uri
        if r.type == "metadata":
            text = bytes(r.block).decode()
            for name, value in fields(source).items():
                assert f"source-{name.lower()}: {value}\r\n" in text
            assert "http-content-type: text/html; charset=utf-8\r\n" in text
        else:
            assert f["WARC-Source-Payload-Digest"] == fields(source)["WARC-Payload-Digest"] == sha1(bytes(source.block).split(b"\r\n\r\n", 1)[1])
    first = {r.type: r for r in made if r.page_id == "1"}
    assert bytes(first["conversion"].block) == b"Hello" and fields(first["conversion"])["WARC-Concurrent-To"] == first["metadata"].record_id


def test_files_round_trip(spark, pages, tmp_path):
    both = warc.responses(pages).drop("page_id")
    path = str(tmp_path / "w")
    warc.write_warc(both.unionByName(warc.derivatives(both).drop("refers_to")), path)
    back = sorted(map(repr, warc.read_warc(spark, path).collect()))
    want = sorted(map(repr, both.unionByName(warc.derivatives(both).drop("refers_to")).collect()))
    assert len(back) == 18
    assert back == want or [r.replace("uri=''", "uri=None") for r in back] == want


def test_gzip_members_other_types_and_damage():
    r = warc.record("response", "u", warc.DATE, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG", "<r>", "application/http", [])
    raw = warc.serialised(r)
    assert [x["block"] for x in warc.parse(gzip.compress(raw) + gzip.compress(raw))] == [r["block"]] * 2
    assert [m["type"] for m in warc.derive("<r>", "u", warc.DATE, [], r["block"])] == ["metadata"]
    folded = b"HTTP/1.0 301 Moved\r\nLocation: /x\r\n y\r\nContent-Encoding: gzip\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n" + gzip.compress("é".encode("latin-1"))
    meta, text = warc.derive("<r>", None, warc.DATE, [], folded)
    assert b"http-location: /x y\r\n" in meta["block"] and b"http-status: HTTP/1.0 301 Moved" in meta["block"] and text["block"] == "é".encode()
    for bad in (raw[:-20], b"junk" + raw):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_empty(pages):
    none = pages.filter("false")
    assert warc.derivatives(warc.responses(none)).collect() == []
    assert warc.derivatives(warc.responses(pages).withColumn("type", warc.F.lit("request"))).collect() == []
