"""WARC records: exact round trip, links and digests."""

import base64
import hashlib
import html
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from silverframe.llm import queries as Q
from silverframe.llm import warc

TRAP = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_words(page):
    """Visible words of a well-formed page, by deletion: a plainer way than the operator's."""
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<head\b.*?</head>", r"(?is)<(script|style|noscript|template|title)\b.*?</\1>"):
        page = re.sub(pattern, " ", page)
    return html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre)\b[^>]*>", " ", page))).split()


def test_query_links_and_digests(spark, sf_dir):
    pages = {r.page_id: r for r in Q.table(spark, sf_dir, "pages").collect()}
    rows = Q.op10_warc(spark, sf_dir).collect()
    by = {(r.page_id, r.record_type): r for r in rows}
    assert len(rows) == 3 * len(pages) == len(by) == len({r.record_id for r in rows})
    for k, p in pages.items():
        r, m, c = (by[k, t] for t in ("response", "metadata", "conversion"))
        assert r.refers_to is None and m.refers_to == c.refers_to == r.record_id
        assert r.target_uri == m.target_uri == c.target_uri == p.url
        assert r.payload_digest == m.payload_digest == c.payload_digest == sha1(p.html.encode())
        text = warc.page_parts(p.html)["text"]
        assert c.block_digest == sha1(text.encode()) and c.n_bytes == len(text.encode())
        assert text.split() == plain_words(p.html)


def test_odd_pages_round_trip(spark):
    rows = [(1, "http://a/", TRAP), (2, None, None), (None, "http://b/\r\nX: y", "<p>é &amp; <b>b</b><script>no</script><p>two"), (1, "http://a/", TRAP), (4, "u", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, headers string").repartition(2)
    got = warc.build_derivatives(df).collect()
    assert len(got) == 15 == len({r.headers["WARC-Record-ID"] for r in got})
    blocks = [bytes(r.block).split(b"\r\n\r\n", 1)[1].decode() for r in got if r.headers["WARC-Type"] == "response"]
    assert sorted(blocks) == sorted(h or "" for _, _, h in rows)
    for r in got:
        assert int(r.headers["Content-Length"]) == len(r.block) and r.headers["WARC-Block-Digest"] == sha1(bytes(r.block))
    conv = [r for r in got if r.headers["WARC-Type"] == "conversion" and r.source_row is None]
    assert bytes(conv[0].block).decode() == "é & b\ntwo"
    meta = [r for r in got if r.headers["WARC-Type"] == "metadata" and r.source_row == 4]
    assert b"http-content-type: text/html; charset=utf-8" in bytes(meta[0].block)
    assert warc.build_derivatives(df.limit(0)).count() == 0
    assert df.select(F.col("headers")).first().headers == "clash"


def test_omitted_tags_and_unquoted_links():
    body = "<p>hello <a href=/x>one</a><p>world <a href='/y'>two</a>"
    for page in (f"<html lang=en><head><title>t</title><body>{body}</body></html>", f"<html lang=en><head><title>t</title><article>{body}</article>", f"<html lang=en><head><title>t</title><meta charset=utf-8>{body}", f"<html lang=en><head><title>t</title><template/><noscript/></head>{body}", f"<html lang=en><title>t</title>{body}"):
        assert warc.page_parts(page) == {"text": "hello one\nworld two", "title": "t", "lang": "en", "links": ["/x", "/y"]}, page
    assert warc.page_parts("<head><title>t</title><style>a</style> bare <b>text</b>")["text"] == "bare text"
    assert warc.page_parts("<head><template>x</template><script>'<p>'</script></head><!-- <p>c -->y<template>z<p>z</template>")["text"] == "y"
    assert warc.page_parts('<p>a&am<b>p; x</b> <a href="?a=1&amp;b=2">l</a> <a HREF = \'q\' x=y/>m</a>&#99999999999999; &lt;p&gt; 1 < 2') == {"text": "a&amp; x l m\ufffd <p> 1 < 2", "title": "", "lang": None, "links": ["?a=1&b=2", "q"]}
    assert warc.page_parts("<title>a <b> &amp; c</title><textarea><p>t</textarea>x<!-->y<!-- cut")["title"] == "a <b> & c"


@pytest.mark.parametrize("unit", ["<a ", "<title>", "<!--", "<", "</", "<a href='", '<a b="x c=\'', "<a b=1 ", "&#1", "<script>", "<a/", "<p a=", "</p "])
def test_hostile_pages_take_linear_time(unit):
    began = time.time()
    warc.page_parts(unit * (2_000_000 // len(unit)))
    assert time.time() - began < 20


def test_a_member_for_each_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "é<p>" + "x" * 300_000 + str(i)) for i in range(12)], "page_id long, url string, html string").repartition(1)
    warc.write_responses(pages, str(tmp_path / "r"), "2024-01-01T00:00:00Z", file_bytes=1)
    files = sorted((tmp_path / "r").glob("part-*"))
    n = 0
    for f in files:
        data = f.read_bytes()
        found = [m for m in warc.members(data) if m]
        assert all(len(list(warc.parse_records(m))) == 1 for m in found)
        z = zlib.decompressobj(31)
        assert z.decompress(data) == found[0]  # a record is read without the others
        n += len(found)
    assert n == 12
    assert sorted(r.source_row for r in warc.read_records(spark, str(tmp_path / "r")).collect()) == list(range(12))
    assert [list(warc.members(b"WARC/1.1")), list(warc.members(b""))] == [[b"WARC/1.1"], [b""]]


def test_metadata_fields_stay_on_their_lines():
    page = '<html lang="en\r\noutlink: http://evil/"><title>a\r\noutlink: b</title><a href="/x\r\ntitle: y">l</a>'
    block = f"HTTP/1.1 200 OK\r\nX-A: 1\nlanguage: de\r\n\r\n{page}".encode()
    meta = warc.derive({"WARC-Record-ID": "<urn:uuid:1>"}, block, "2024-01-01T00:00:00Z")[0].split("\r\n\r\n", 1)[1]
    assert [x.split(": ", 1)[0] for x in re.split(r"[\r\n]+", meta.strip())] == ["http-status", "http-x-a", "title", "language", "text-digest", "outlink"]
