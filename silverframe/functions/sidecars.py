"""Sidecar texts: properties of the first description read, and written without losing what else a file holds.

An edit application and others may keep their data in the same file. Writing changes only the named properties, the
rating, the label and the mask data of the first description; other attributes, children, comments and
descriptions stay as they were. A file that can't be read has an error instead of a result, and never ends a job.
"""

from __future__ import annotations

import base64
import json
from itertools import islice
from xml.dom import minidom
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silverframe.functions.settings import DEFAULTS, SETTINGS, from_properties, properties

# Namespaces of the format.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SETTINGS_NS = "http://ns.adobe.com/camera-raw-settings/1.0/"
XMP = "http://ns.adobe.com/xap/1.0/"
XMLNS = "http://www.w3.org/2000/xmlns/"
EMPTY = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{RDF}"><rdf:Description/></rdf:RDF></x:xmpmeta>'
LABELS = ("red", "yellow", "green", "blue", "purple")
#: Namespace and prefix of mask data, which is of one's own; parameters, since files of other applications have another.
MASKS, MASKS_PREFIX, MASKS_NAME = "urn:silverframe:masks:1", "masks", "MaskingData"
MAX_BYTES = 16 << 20
ROWS = 256  # that are settings as Python values at a time
NO_MASKS = base64.b64encode(b'{"version":2,"masking":{"masks":[]},"maskAssets":{}}').decode()


def _description(text: str) -> tuple[minidom.Document, minidom.Element]:
    if len(text.encode()) > MAX_BYTES:
        raise ValueError("too large")
    document = minidom.parseString(text)
    found = document.getElementsByTagNameNS(RDF, "Description")
    if not found:
        raise ValueError("no description")
    return document, found[0]


def _text(node) -> str:
    return "".join(n.data if n.nodeType in (n.TEXT_NODE, n.CDATA_SECTION_NODE) else _text(n) for n in node.childNodes if n.nodeType not in (n.COMMENT_NODE, n.PROCESSING_INSTRUCTION_NODE))


def _elements(node) -> list[minidom.Element]:
    return [n for n in node.childNodes if n.nodeType == n.ELEMENT_NODE]


class _First:
    """What the first description of a text says, taken down as the parser goes over it."""

    def __init__(self, masks: str):
        self.texts, self.lists, self.xmp, self.masks = {}, {}, {}, None
        self.places = {SETTINGS_NS: self.texts, XMP: self.xmp}
        self.names = {(masks, MASKS_NAME)}
        self.depth, self.state, self.items, self.open = 0, 0, [], []  # state: before, in or after the description

    @staticmethod
    def name(of: str) -> tuple[str | None, str]:
        parts = of.split(" ")
        if len(parts) > 3:
            raise ValueError("space in a namespace")
        return (parts[0], parts[1]) if len(parts) > 1 else (None, of)

    def start(self, tag: str, attributes: list[str]) -> None:
        uri, name = self.name(tag)
        if self.state == 1:
            self.depth += 1
            if self.depth == 1:
                self.items = []
            elif (uri, name) == (RDF, "li"):
                self.items.append([])
                self.open.append((self.depth, self.items[-1]))
        elif self.state == 0 and (uri, name) == (RDF, "Description"):
            self.state = 1
            for key, value in zip(attributes[::2], attributes[1::2], strict=True):
                at, local = self.name(key)
                if at in self.places:
                    self.places[at][local] = value
                elif (at, local) in self.names:
                    self.masks = value

    def end(self, tag: str) -> None:
        if self.state != 1:
            return
        if self.open and self.open[-1][0] == self.depth:
            self.open.pop()
        uri, name = self.name(tag)
        if self.depth == 1 and self.items and uri in self.places:
            self.places[uri].pop(name, None)
            if uri == SETTINGS_NS:
                self.lists[name] = ["".join(i).strip() for i in self.items]
            else:
                self.xmp[name] = None
        self.depth -= 1
        if self.depth < 0:
            self.state = 2

    def text(self, data: str) -> None:
        for _, item in self.open:
            item.append(data)


def read(text: str | None, masks: str = MASKS) -> dict:
    """texts, lists (by ``settings`` or ``xmp`` name), masks and error of a sidecar."""
    out: dict = {"texts": {}, "lists": {}, "xmp": {}, "masks": None, "error": None}
    if text is None:
        return out
    try:
        if len(text.encode()) > MAX_BYTES:
            raise ValueError("too large")
        found, parser = _First(masks), expat.ParserCreate(namespace_separator=" ")
        parser.namespace_prefixes = parser.buffer_text = parser.ordered_attributes = parser.specified_attributes = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = found.start, found.end, found.text
        parser.Parse(text, True)
        if not found.state:
            raise ValueError("no description")
    except Exception as e:  # whatever a broken file makes the parser say
        return out | {"error": str(e) or "unreadable"}
    return out | {"texts": found.texts, "lists": found.lists, "xmp": found.xmp, "masks": found.masks}


def _quoted(text: str) -> str:
    """A text as an attribute's value, as the writer of documents puts it."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"), (">", "&gt;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#9;")):
        if a in text:
            text = text.replace(a, b)
    return f'"{text}"'


def _sequence(prefix: str, rdf: str, name: str, items: list[str]) -> str:
    """A property that is a list."""
    entries = "".join(f"<{rdf}:li>{escape(i)}</{rdf}:li>" for i in items)
    return f"<{prefix}:{name}>" + (f"<{rdf}:Seq>{entries}</{rdf}:Seq>" if items else f"<{rdf}:Seq/>") + f"</{prefix}:{name}>"


def _fresh(said: dict[str, str | list[str]], rating: int, label: str | None, masks: str | None, namespace: str) -> str:
    """The text of a sidecar that holds nothing else: what writing into ``EMPTY`` gives, without a document in between."""
    plain = [f" crs:{n}={_quoted(v)}" for n, v in said.items() if isinstance(v, str)]
    marks = f' xmp:Rating="{rating}"' + ("" if label is None else f" xmp:Label={_quoted(label)}")
    own = {SETTINGS_NS: "crs", XMP: "xmp", RDF: "rdf", "adobe:ns:meta/": "x"}.get(namespace)
    data = "" if masks is None else f" {own}:{MASKS_NAME}={_quoted(masks)}" if own else f" xmlns:{MASKS_PREFIX}={_quoted(namespace)} {MASKS_PREFIX}:{MASKS_NAME}={_quoted(masks)}"
    lists = "".join(_sequence("crs", "rdf", n, v) for n, v in said.items() if not isinstance(v, str))
    start = EMPTY.partition("/></rdf:RDF>")[0] + f' xmlns:crs="{SETTINGS_NS}" xmlns:xmp="{XMP}"' + "".join(plain) + marks + data
    return start + (f">{lists}</rdf:Description>" if lists else "/>") + "</rdf:RDF></x:xmpmeta>"


class _Over:
    """New properties of a description that has others: these leave its document if they have a new one's name, the new ones are text from the start."""

    def __init__(self, description: minidom.Element):
        self.description, self.meant, self.old = description, {}, {}
        self.attributes, self.lists = {}, {}  # their texts by namespace and name, in the order they are written
        node = description
        while node is not None and node.nodeType == node.ELEMENT_NODE:
            for a in node.attributes.values():
                if a.prefix == "xmlns":
                    self.meant.setdefault(a.localName, a.value)
            node = node.parentNode
        for child in _elements(description):
            self.old.setdefault((child.namespaceURI, child.localName), []).append(child)

    def prefix(self, wanted: str, uri: str) -> str:
        """A prefix that means ``uri`` here, declared if none does; ``wanted`` unless it means something else."""
        for known, u in self.meant.items():
            if u == uri:
                return known
        while wanted in self.meant:
            wanted += "1"
        self.meant[wanted] = uri
        self.attributes[XMLNS, wanted] = f" xmlns:{wanted}={_quoted(uri)}"
        return wanted

    def put(self, uri: str, prefix: str, name: str, value: str | list[str] | None) -> None:
        """One property instead of all of that name; None takes it away."""
        key = uri, name
        if self.description.hasAttributeNS(uri, name):
            self.description.removeAttributeNS(uri, name)
        for child in self.old.pop(key, ()):
            self.description.removeChild(child).unlink()
        self.attributes.pop(key, None), self.lists.pop(key, None)
        if isinstance(value, str):
            self.attributes[key] = f" {prefix}:{name}={_quoted(value)}"
        elif value is not None:
            self.lists[key] = _sequence(prefix, self.prefix("rdf", RDF), name, value)

    def text(self) -> str:
        d = self.description
        start = f"<{d.tagName}" + "".join(f" {n}={_quoted(v)}" for n, v in d.attributes.items()) + "".join(self.attributes.values())
        if not d.childNodes and not self.lists:
            return start + "/>"
        return f"{start}>{''.join(c.toxml() for c in d.childNodes)}{''.join(self.lists.values())}</{d.tagName}>"


def write(existing: str | None, said: dict[str, str | list[str]], rating: int, label: str | None, masks: str | None, namespace: str = MASKS) -> tuple[str | None, str | None]:
    """(text, error) of a sidecar with these properties, beside all else that ``existing`` holds."""
    document = None
    try:
        if not existing:
            text = _fresh(said, rating, label, masks, namespace)
        else:
            document, description = _description(existing)
            over = _Over(description)
            settings, xmp = over.prefix("crs", SETTINGS_NS), over.prefix("xmp", XMP)
            for name, value in said.items():
                over.put(SETTINGS_NS, settings, name, value)
            over.put(XMP, xmp, "Rating", str(rating))
            over.put(XMP, xmp, "Label", label)
            if masks is not None:
                over.put(namespace, over.prefix(MASKS_PREFIX, namespace), MASKS_NAME, masks)
            own = over.text()
            description.writexml = lambda writer, *_: writer.write(own)
            text = "".join(n.toxml() for n in document.childNodes)
        return (None, "too large") if len(text.encode()) > MAX_BYTES else (text, None)
    except Exception as e:  # as above
        return None, str(e) or "unreadable"
    finally:
        if document is not None:
            document.unlink()  # its parts refer to each other, so that it would stay until the next search for such


PROPERTIES = f"texts map<string,string>, lists map<string,array<string>>, xmp map<string,string>, masks string, error string, settings {SETTINGS}"


def sidecar_properties(text: Column, masks: str = MASKS) -> Column:
    """What a sidecar's first description says (struct of ``PROPERTIES``); ``error`` for files that can't be read."""

    @F.pandas_udf("string")
    def parse(texts: pd.Series) -> pd.Series:
        found = (read(t, masks) for t in texts)
        return pd.Series([json.dumps(x | {"settings": from_properties(x["texts"], x["lists"])}) for x in found])

    # so marked, a text is parsed once, however often its parts are used
    return F.from_json(parse.asNondeterministic()(text), PROPERTIES)


def rating(xmp: Column) -> Column:
    """The rating, one of the six texts that mean one; null for any other."""
    text = F.try_element_at(xmp, F.lit("Rating"))
    return F.when(text.isin(*"012345"), text.cast("int"))


def label(xmp: Column) -> Column:
    """(known, value): no label clears it, another one than the five says nothing."""
    text = F.lower(F.try_element_at(xmp, F.lit("Label")))
    there = F.map_contains_key(xmp, "Label") & text.isNotNull()
    return F.struct((~there | F.coalesce(text.isin(*LABELS), F.lit(False))).alias("known"), F.when(text.isin(*LABELS), text).alias("value"))


def _values(array: pa.Array) -> list:
    """What ``to_pylist`` gives, column by column instead of one nested value at a time."""
    kind = array.type
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        found = [dict(zip(names, row, strict=True)) for row in zip(*map(_values, array.flatten()), strict=True)]
    elif pa.types.is_list(kind):
        items = iter(_values(array.flatten()))
        return [None if n is None else list(islice(items, n)) for n in array.value_lengths().to_pylist()]
    else:
        return array.to_numpy().tolist() if pa.types.is_floating(kind) and not array.null_count else array.to_pylist()
    return [v if there else None for v, there in zip(found, array.is_valid().to_pylist(), strict=True)] if array.null_count else found


def sidecar_texts(rows: DataFrame, namespace: str = MASKS) -> DataFrame:
    """id, text and error: the new sidecars of ``rows`` (id, existing, settings, rating, label, masks), see :func:`write`.

    Null settings are the defaults, null masks none. An image that nobody touched and that has no file gets none.
    """

    def run(batches):
        names = ("existing", "settings", "rating", "label", "masks")
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            made = []
            for existing, settings, rating, label, masks in zip(*(_values(batch.column(c)) for c in names), strict=True):
                said = settings or DEFAULTS
                idle = existing is None and masks is None and not rating and label is None and said == DEFAULTS
                made.append((None, None) if idle else write(existing, properties(said), rating or 0, label, masks or NO_MASKS, namespace))
            texts, errors = (pa.array([x[i] for x in made], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), texts, errors], ["id", "text", "error"])

    plain = rows.select("id", "existing", "settings", "rating", "label", "masks")
    return plain.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, error string")
