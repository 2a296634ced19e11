"""WARC derivatives against plain Python, and the files they are written to."""

import base64
import gzip
import hashlib
import html as html_lib
import zlib
from html.parser import HTMLParser
from pathlib import Path

from pyspark.sql import functions as F

from ampfold.llm import warc


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def response(i, head, body, refers=None):
    return (f"<urn:uuid:{i}>", f"http://x/{i}", "2020-01-01T00:00:00Z", refers, head + b"\r\n\r\n" + body)


HTML = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-A: 1"
SCHEMA = "record_id string, target_uri string, date string, refers_to string, block binary"


def made(spark, rows):
    out = warc.derivatives(spark.createDataFrame(rows, SCHEMA).withColumns({"warc_type": F.lit("x"), "_head": F.lit(1)}))
    return {(r["refers_to"], r["warc_type"]): r for r in out.collect()}, out


def test_records_link_and_keep_digests(spark):
    body = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>One<br>two &lt;3 &#233;&#x1F600;&#0;</p><script>x='<p>'</script><a class=q href=\"/l?a=1\">li<b>nk</b></a> a < b</body>".encode()
    got, _ = made(spark, [response(1, HTML, body, "<urn:uuid:0>")])
    meta, conv = got[("<urn:uuid:1>", "metadata")], got[("<urn:uuid:1>", "conversion")]
    assert conv["block"] == "A & B\nOne\ntwo <3 é😀�\nlink a < b"
    assert conv["block_digest"] == digest(conv["block"].encode()) and conv["content_length"] == len(conv["block"].encode())
    assert meta["source_headers"] == ["Content-Type: text/html; charset=utf-8", "X-A: 1"]
    fields = meta["block"].split("\r\n")
    assert fields[0] == "http-status: 200" and "source-header: X-A: 1" in fields and "source-refers-to: <urn:uuid:0>" in fields
    assert f"source-payload-digest: {digest(body)}" in fields and f"source-block-digest: {digest(HTML + b'\r\n\r\n' + body)}" in fields
    assert f"conversion: {conv['record_id']}" in fields and "title: A & B" in fields and "outlink: /l?a=1" in fields
    assert conv["source_payload_digest"] == digest(body) and conv["target_uri"] == "http://x/1"


def test_odd_responses(spark):
    rows = [
        response(1, b"HTTP/1.1 200 OK\r\ncontent-type: text/plain", "plain é <b>".encode()),
        response(2, b"HTTP/1.1 404 Not Found\r\nContent-Type: image/png", b"\x89PNG\x00\xff"),
        response(3, HTML, "caf\xe9 <p>x".encode("latin-1")),
        ("<urn:uuid:4>", None, None, None, None), (None, None, None, None, b""),
        response(5, HTML, b""), response(6, HTML, b"<p>" + b"word " * 60_000), response(6, HTML, b"again"),
    ]
    got, out = made(spark, rows)
    assert got[("<urn:uuid:1>", "conversion")]["block"] == "plain é <b>"
    assert ("<urn:uuid:2>", "conversion") not in got and "http-status: 404" in got[("<urn:uuid:2>", "metadata")]["block"]
    assert got[("<urn:uuid:2>", "metadata")]["source_payload_digest"] == digest(b"\x89PNG\x00\xff")
    assert got[("<urn:uuid:3>", "conversion")]["block"] == "café\nx"
    assert ("<urn:uuid:4>", "conversion") not in got and (None, "metadata") in got
    assert got[("<urn:uuid:5>", "conversion")]["block"] == ""
    assert out.where("refers_to = '<urn:uuid:6>'").count() == 4
    for r in got.values():
        assert r["content_length"] == len(r["block"].encode()) and r["block_digest"] == digest(r["block"].encode())
    assert warc.derivatives(out.sparkSession.createDataFrame([], SCHEMA)).count() == 0


class Anchors(HTMLParser):
    """The hrefs of a page's anchors and its title, by the library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hrefs, self.title, self.inside = [], "", False

    def handle_starttag(self, tag, attrs):
        self.inside = tag == "title"
        if tag == "a" and "href" in dict(attrs):
            self.hrefs.append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        self.inside = False

    def handle_data(self, data):
        self.title += data if self.inside else ""


PAGES = [
    "<title>Caf&eacute; &amp; B&uuml;cher &rarr; &nosuch; &#xE9;&#Xe9;</title><a href='/one'>1</a><a href = \"/two\">2</a><A HREF=/three>3</A>",
    "<a data-href='no' href='yes'>x</a><abbr href='no'>y</abbr><a name=top>z</a><area href='no'><a xhref='no'>",
    "<a title=\"a > b href='no'\" href=\"/q?a=1&amp;b=2\" rel='x'>q</a><a class=c\nid=i\thref=/r/s?x=1>r</a><a disabled href='/t'>t</a>",
    "<!-- <a href='hidden'> --><script>var s = \"<a href='no'>\";</script><a href=''>empty</a><a href='  /pad '>p</a>",
    "<a href='it\"s'>a</a><a href=\"it's\">b</a><a title=it's href=/c>c</a><a" + " k=v" * 60 + " href='/far'>d</a>",
]


def test_links_titles_and_references_are_those_of_an_html_parser(spark):
    got, _ = made(spark, [response(i, HTML, page.encode()) for i, page in enumerate(PAGES)])
    for i, page in enumerate(PAGES):
        parser = Anchors()
        parser.feed(page)
        fields = got[(f"<urn:uuid:{i}>", "metadata")]["block"].split("\r\n")
        assert [f[len("outlink: "):] for f in fields if f.startswith("outlink: ")] == [h.strip() for h in parser.hrefs], page
        assert [f[len("title: "):] for f in fields if f.startswith("title: ")] == ([parser.title] if parser.title else [])


def test_a_field_is_one_line(spark):
    body = b"<title>two\nlines</title><a href='/x\r\nhttp-status: 500'>x</a>"
    got, _ = made(spark, [response(1, HTML, body)])
    fields = got[("<urn:uuid:1>", "metadata")]["block"].split("\r\n")
    assert "title: two lines" in fields and "outlink: /xhttp-status: 500" in fields and "http-status: 500" not in fields


def test_heads_of_either_line_end(spark):
    rows = [(f"<urn:uuid:{i}>", None, None, None, b) for i, b in enumerate([
        b"HTTP/1.1 200 OK\nContent-Type: text/html\n\n<p>hello\r\n\r\nthere",
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html\n\r\n<p>hello",
        b"HTTP/1.1 200 OK\r\nX-Long: a\r\n  b\r\nContent-Type: text/html; note=a:b\r\n\r\n<p>hello\n\nyou",
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html",
    ])]
    got, _ = made(spark, rows)
    blocks = [got[(f"<urn:uuid:{i}>", "conversion")]["block"] for i in range(4)]
    assert blocks == ["hello\nthere", "hello", "hello\nyou", ""]
    assert got[("<urn:uuid:2>", "metadata")]["source_headers"] == ["X-Long: a b", "Content-Type: text/html; note=a:b"]
    assert got[("<urn:uuid:1>", "metadata")]["source_payload_digest"] == digest(b"<p>hello")


def test_charsets_and_codings(spark):
    def head(kind, *more):
        return b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: " + kind, *more])

    word, page = "Привет", "<p>Привет, мир"
    bare = zlib.compressobj(wbits=-15)
    gz = gzip.compress(page.encode())
    chunks = b"4;x=y\r\n" + gz[:4] + b"\r\n" + f"{len(gz) - 4:X}".encode() + b"\r\n" + gz[4:] + b"\r\n0\r\n\r\n"
    cases = [
        (head(b"text/html; charset=windows-1251"), page.encode("cp1251"), "Привет, мир"),
        (head(b"text/html; Charset='KOI8-R'"), page.encode("koi8-r"), "Привет, мир"),
        (head(b"text/plain;charset=gb2312"), "汉字".encode("gbk"), "汉字"),
        (head(b"text/html;charset=Shift_JIS"), "<p>かな".encode("cp932"), "かな"),
        (head(b"text/html; charset=iso-8859-1"), b"<p>\x93caf\xe9\x94", "“café”"),
        (head(b"text/html"), b"<meta charset=windows-1251><p>" + word.encode("cp1251"), word),
        (head(b"text/html; charset=no-such"), b"<p>caf\xe9", "café"),
        (head(b"text/html; charset=hex"), b"<p>6162", "6162"),
        (head(b"text/html; charset=utf-8", b"Content-Encoding: gzip"), gz + gzip.compress(b" again"), "Привет, мир again"),
        (head(b"text/html", b"content-encoding:  deflate"), zlib.compress(page.encode()), "Привет, мир"),
        (head(b"text/html", b"Content-Encoding: deflate"), bare.compress(page.encode()) + bare.flush(), "Привет, мир"),
        (head(b"text/html; charset=cp1251", b"Content-Encoding: deflate, GZIP"), gzip.compress(zlib.compress(page.encode("cp1251"))), "Привет, мир"),
        (head(b"text/html", b"Content-Encoding: gzip", b"Transfer-Encoding: chunked"), chunks, "Привет, мир"),
        (head(b"text/html", b"Transfer-Encoding: chunked"), b"<p>not chunked", "not chunked"),
        (head(b"text/html", b"Content-Encoding: br"), b"\x0b\x02\x80", None),
        (head(b"text/html", b"Content-Encoding: gzip"), gz[:-9], None),
        (head(b"text/html", b"Content-Encoding: gzip"), b"", ""),
    ]
    got, _ = made(spark, [response(i, h, body) for i, (h, body, _) in enumerate(cases)])
    for i, (_, body, text) in enumerate(cases):
        conversion = got.get((f"<urn:uuid:{i}>", "conversion"))
        assert (conversion and conversion["block"]) == text, (i, conversion)
        assert got[(f"<urn:uuid:{i}>", "metadata")]["source_payload_digest"] == digest(body)


def test_named_references_are_the_standard_ones():
    for name, value in warc.ENTITIES.items():
        assert html_lib.unescape(f"&{name};") == value


def test_pages_and_files(spark, tmp_root):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>"), (2, None, None), (None, "http://b", "x")], "page_id long, url string, html string")
    out = warc.derivatives(warc.page_responses(pages, "2024-01-01T00:00:00Z"), keep=["page_id"])
    assert out.count() == 6
    warc.write_warc(out.coalesce(1), f"{tmp_root}/w")
    data = gzip.decompress(next(Path(f"{tmp_root}/w").glob("*.gz")).read_bytes())
    records = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = [line.split(b": ", 1) for line in head.split(b"\r\n")[1:]]
        fields, sources = dict(lines), [v for k, v in lines if k == b"WARC-Source-Header"]
        assert sources[0] == b"Content-Type: text/html; charset=utf-8" and len(sources) == 2
        assert fields[b"WARC-Source-Block-Digest"].startswith(b"sha1:") and fields[b"WARC-Source-Payload-Digest"].startswith(b"sha1:")
        size = int(fields[b"Content-Length"])
        assert digest(rest[:size]).encode() == fields[b"WARC-Block-Digest"] and rest[size : size + 4] == b"\r\n\r\n"
        data, records = rest[size + 4 :], records + 1
    assert records == 6
