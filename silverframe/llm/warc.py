"""WARC files and their derivatives: linked metadata and plain-text conversion records.

Files are WARC/1.1, a gzip member for each record, so that a record can be read from its place alone. They are written by
Spark's text writer, in parallel: each line holds the members of about ``PART`` bytes of records, and the separator of
lines is a member without content. Files have a bounded number of lines; they come back as binary rows, are unzipped member by
member, and a record ends by its ``Content-Length``, whatever its block holds.

Record ids are name-based UUIDs of what a record is made from and, for responses, of the row's place in the input (partition and row),
so a retried task writes the same file and repeated rows have ids of their own. Digests are SHA-1 in base 32, over the block and over
the HTTP payload.

Defined cases: a null ``html`` is an empty payload, with an empty conversion; a null ``url`` has no target
header; null page ids are kept; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverframe.llm.common import by_bytes, keep_until_exit, shared_dir

VERSION, BREAK, PART = "WARC/1.1", "\r\n", 1 << 20
_SPACE = uuid.UUID("9f7f2c1e-6a5f-4d43-8f6e-2d1a4c7b9e10")
RECORD = "source_row long, headers map<string,string>, n_bytes long, block binary"
# Elements without visible text, elements that a head can hold, and elements that break the line.
_HIDDEN = {"script", "style", "noscript", "template"}
_READ = {"a", "html"}  # their attributes are wanted
_RAW = {"script", "style", "title", "textarea"}  # no tags within
_HEAD = {"html", "head", "title", "meta", "link", "base", *_HIDDEN}
_LINES = {"p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "nav", "header", "footer", "blockquote", "pre"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(map(str, parts)))}>"


def record_text(headers: dict[str, str | None], block: str) -> str:
    """A record without its closing line breaks. Headers without a value are left out."""
    size = len(block.encode())
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {size}", "", block]
    return BREAK.join(lines)


def _clean(value: str | None) -> str | None:
    """A header value on one line."""
    if value is None or ("\n" not in value and "\r" not in value):
        return value
    return re.sub(r"[\r\n]+", " ", value)


def response_record(page_id: int | None, url: str | None, page: str | None, date: str, place: str = "") -> str:
    payload = page or ""
    block = BREAK.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload.encode())}", "", payload])
    return record_text(
        {
            "WARC-Type": "response",
            "WARC-Record-ID": record_id("response", page_id, url, page, place),
            "WARC-Date": date,
            "WARC-Target-URI": _clean(url),
            "WARC-Block-Digest": digest(block.encode()),
            "WARC-Payload-Digest": digest(payload.encode()),
            "Source-Row": None if page_id is None else str(page_id),
            "Content-Type": "application/http; msgtype=response",
        },
        block,
    )


def parse_records(data: bytes):
    """(headers, block) of each record of a file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if first != VERSION:
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


_EASY = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z-]+=\"[^\"<>]*\")*)\s*>")  # a start tag as most are
_PAIR = re.compile(r"([a-zA-Z-]+)=\"([^\"]*)\"")
_NAME = re.compile(r"[^\s/>]+")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*+)>")
_SKIP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*+")
_VALUE = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in _RAW}
_HUGE = re.compile(r"&#(?:0*[0-9]{8,}+|[xX]0*[0-9a-fA-F]{8,}+);?")


def _plain_text(s: str) -> str:
    """Character references replaced; numbers beyond any character have no meaning."""
    return html.unescape(_HUGE.sub("\ufffd", s)) if "&" in s else s


def _start_tag(markup: str, at: int) -> tuple[str, dict[str, str], bool, int] | None:
    """Name, attributes, whether it closes itself, and the end of the start tag whose name is at ``at``; none if the page ends in it."""
    m = _NAME.match(markup, at)
    tag, attributes, n = m.group().lower(), {}, len(markup)
    skipped = _SKIP.match(markup, m.end())
    at = skipped.end()
    while at < n and markup[at] != ">":
        m = _ATTRIBUTE.match(markup, at)
        name, at = m.group().lower(), m.end()
        value, eq = "", _VALUE.match(markup, at)
        if eq:
            at = eq.end()
            quote = markup[at : at + 1]
            if quote in ("'", '"'):
                end = markup.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = markup[at + 1 : end], end + 1
            else:
                m = _BARE.match(markup, at)
                value, at = m.group(), m.end()
        attributes.setdefault(name, value)
        skipped = _SKIP.match(markup, at)
        at = skipped.end()
    return None if at >= n else (tag, attributes, skipped.group().endswith("/"), at + 1)


def tokens(markup: str):
    """("text", string, None), ("start", tag, attributes) and ("end", tag, None) of a page, in time linear in its length.

    What a page's end cuts off (a tag, a comment, a quoted value) is left out, as HTML says. Comments and declarations are skipped.
    """
    at, n, gt = 0, len(markup), -1
    while at < n:
        lt = markup.find("<", at)
        if lt < 0:
            yield "text", markup[at:], None
            return
        if lt > at:
            yield "text", markup[at:lt], None
        plain = _PLAIN.match(markup, lt)  # most tags
        if plain:
            slash, tag = plain.groups()
            tag = tag.lower()
            if slash or tag not in _RAW:
                yield "end" if slash else "start", tag, None if slash else {}
                at = plain.end()
                continue
        after = markup[lt + 1 : lt + 2]
        closing = after == "/" and markup[lt + 2 : lt + 3].isalpha()
        if closing or after.isalpha():
            if gt < lt:
                gt = markup.find(">", lt)  # looked for again only behind it
            if gt < 0:
                return
        if after.isalpha():
            easy = _EASY.match(markup, lt + 1) if gt - lt < 1000 else None
            if easy:
                tag, attributes, closed, at = easy[1].lower(), {}, False, easy.end()
                if tag in _READ:
                    for name, value in _PAIR.findall(easy[2]):
                        attributes.setdefault(name.lower(), value)
            else:
                found = _start_tag(markup, lt + 1)
                if not found:
                    return
                tag, attributes, closed, at = found
            yield "start", tag, attributes
            if closed:
                yield "end", tag, None
            elif tag in _RAW:
                end = _RAW_END[tag].search(markup, at)
                yield "text", markup[at : end.start() if end else n], None
                at = end.start() if end else n
        elif markup.startswith("<!--", lt):
            end = markup.find("-->", lt + 2)  # "<!-->" is a whole comment
            if end < 0:
                return
            at = end + 3
        elif closing:
            yield "end", _NAME.match(markup, lt + 2).group().lower(), None
            at = gt + 1
        elif after in ("!", "?", "/") and after:
            end = markup.find(">", lt + 2)
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "<", None
            at = lt + 1


def page_parts(markup: str) -> dict:
    """Plain text (one line per block, single spaces), title, language and links. Comments and hidden elements have no text.

    An open head ends where HTML ends it: at its end tag, or at the first tag or text that a head can't hold.
    """
    text, title, links, lang = [], [], [], None
    hidden, in_head, in_title = 0, False, False
    for kind, what, attributes in tokens(markup):
        if kind == "text":
            if in_title:
                title.append(_plain_text(what))
            elif not hidden:
                if in_head and what.strip():
                    in_head = False
                if not in_head:
                    text.append(_plain_text(what))
        elif kind == "start":
            if what == "html":
                lang = lang or _plain_text(attributes.get("lang", "")) or None
            elif what == "a" and attributes.get("href"):
                links.append(_plain_text(attributes["href"]))
            if what == "head":
                in_head = True
            elif in_head and what not in _HEAD:
                in_head = False
            if what in _HIDDEN:
                hidden += 1
            if what == "title":
                in_title = True
            if what in ("body", "article"):
                hidden, in_title = 0, False
            if what in _LINES:
                text.append("\n")
        else:
            if what == "head":
                in_head = False
            elif what in _HIDDEN:
                hidden = max(0, hidden - 1)
            elif what == "title":
                in_title = False
            if what in _LINES:
                text.append("\n")
    lines = (" ".join(x.split()) for x in "".join(text).split("\n") if x)
    return {"text": "\n".join(x for x in lines if x), "title": " ".join("".join(title).split()), "lang": lang, "links": links}


def derive(headers: dict[str, str], block: bytes, date: str) -> list[str]:
    """The metadata and conversion records of a response, linked to it and to its headers and digests."""
    http, _, payload = block.partition(b"\r\n\r\n")
    page = page_parts(payload.decode("utf-8", "replace"))
    source = headers["WARC-Record-ID"]
    link = {"WARC-Refers-To": source, "WARC-Refers-To-Target-URI": headers.get("WARC-Target-URI"), "WARC-Refers-To-Date": headers.get("WARC-Date"), "WARC-Target-URI": headers.get("WARC-Target-URI"), "WARC-Source-Payload-Digest": headers.get("WARC-Payload-Digest"), "WARC-Source-Block-Digest": headers.get("WARC-Block-Digest"), "Source-Row": headers.get("Source-Row")}
    status, *sent = http.decode("utf-8", "replace").split(BREAK)
    fields = [("http-status", status), *((f"http-{k.lower()}", v) for k, v in (x.split(": ", 1) for x in sent if ": " in x)), ("title", page["title"]), ("language", page["lang"]), ("text-digest", digest(page["text"].encode())), *(("outlink", x) for x in page["links"])]
    meta = "".join(f"{_clean(k)}: {_clean(v)}{BREAK}" for k, v in fields if v)
    out = []
    for kind, mime, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", page["text"])):
        out.append(record_text({"WARC-Type": kind, "WARC-Record-ID": record_id(kind, source), "WARC-Date": date, **link, "WARC-Block-Digest": digest(body.encode()), "Content-Type": mime}, body))
    return out


def _member(data: bytes) -> bytes:
    """A gzip member, the same for the same bytes."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _packed(records):
    """Batches of one line: the members of about ``PART`` bytes of records."""
    held, size = [], 0
    for record in records:
        held.append(_member((record + BREAK * 2).encode()))
        size += len(held[-1])
        if size >= PART:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])


def _write(lines: DataFrame, path: str, file_bytes: int) -> None:
    """Lines (value: binary) as they are. The encoding is that of the separator alone, which takes any byte."""
    options = {"lineSep": _member(b"").decode("latin-1"), "encoding": "ISO-8859-1", "maxRecordsPerFile": max(1, file_bytes // PART), "compression": "none"}
    lines.select(F.col("value").cast("string")).write.options(**options).text(path)


def members(content: bytes):
    """The unzipped members of a file, one at a time; a file that isn't gzip is one."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at, view = 0, memoryview(content)
    while at < len(view):
        z, out, n = zlib.decompressobj(31), [], at
        while not z.eof and n < len(view):  # piece by piece: what follows the member isn't copied
            out.append(z.decompress(view[n : n + (1 << 16)]))
            n += 1 << 16
        at = min(n, len(view)) - len(z.unused_data)
        yield b"".join(out)


def write_responses(pages: DataFrame, path: str, date: str, file_bytes: int = 32 << 20) -> None:
    """Pages (page_id, url, html) as response records, in files of about ``file_bytes`` (or one record, if it is longer)."""

    def run(batches):
        part = TaskContext.get().partitionId()

        def records():
            row = 0
            for b in batches:
                for piece in by_bytes(b, "html"):
                    for values in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                        yield response_record(*values, date, f"{part}/{row}")
                        row += 1

        return _packed(records())

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(rows.mapInArrow(run, "value binary"), path, file_bytes)


def read_records(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Records of the WARC files in a folder: their row in the source, headers, size and (or null) block."""

    def batch(part: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([int(h["Source-Row"]) if "Source-Row" in h else None for h, _ in part], pa.int64()), pa.array([list(h.items()) for h, _ in part], pa.map_(pa.string(), pa.string())), pa.array([len(x) for _, x in part], pa.int64()), pa.array([x if blocks else None for _, x in part], pa.binary())],
            ["source_row", "headers", "n_bytes", "block"],
        )

    def run(batches):
        for b in batches:
            for content in b.column(0):
                held, size = [], 0
                for data in members(content.as_py()):
                    held += parse_records(data)
                    size += len(data)
                    if size >= 4 * PART:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)


def write_derivatives(responses: DataFrame, path: str, date: str, file_bytes: int = 32 << 20) -> None:
    """A metadata and a conversion record for each response record."""

    def run(batches):
        def records():
            for b in batches:
                for headers, block in zip(b.column("headers"), b.column("block"), strict=True):
                    headers = dict(headers.as_py())
                    if headers.get("WARC-Type") == "response":
                        yield from derive(headers, block.as_py(), date)

        return _packed(records())

    _write(responses.mapInArrow(run, "value binary"), path, file_bytes)


def build_derivatives(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", blocks: bool = True) -> DataFrame:
    """Write responses and derivatives under ``folder`` and read all records back.

    Without a folder they go to the shared one and are deleted when the driver exits.
    """
    spark = pages.sparkSession
    folder = folder or keep_until_exit(spark, f"{shared_dir(spark)}/silverframe/warc-{uuid.uuid4().hex}")
    write_responses(pages, f"{folder}/responses", date)
    write_derivatives(read_records(spark, f"{folder}/responses"), f"{folder}/derivatives", date)
    return read_records(spark, f"{folder}/responses", blocks).unionByName(read_records(spark, f"{folder}/derivatives", blocks))
