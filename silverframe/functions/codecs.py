"""Codecs of small records: XMP sidecars, image headers, gray PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, StringType, StructField, StructType

from silverframe.functions import sidecars

XMP, RDF = sidecars.XMP, sidecars.RDF

SIDECAR = StructType([StructField("has_rating", BooleanType()), StructField("rating", IntegerType()), StructField("has_label", BooleanType()), StructField("label", StringType()), StructField("error", StringType())])
SIZE = StructType([StructField("kind", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())])


def parse_sidecar(text: str | None) -> tuple:
    """(has_rating, rating, has_label, label, error). No label clears it; an unknown one, and a rating but 0 to 5, say nothing."""
    said = sidecars.read(text)
    if text is None or said["error"]:
        return False, None, False, None, said["error"]
    rating, label = said["xmp"].get("Rating"), said["xmp"].get("Label")
    good = rating is not None and rating in ("0", "1", "2", "3", "4", "5")
    known = label is not None and label.lower() in sidecars.LABELS
    return good, int(rating) if good else None, label is None or known, label.lower() if known else None, None


@F.pandas_udf(SIDECAR)
def sidecar(text: pd.Series) -> pd.DataFrame:
    """Rating and label of sidecar texts."""
    return pd.DataFrame([parse_sidecar(t) for t in text], columns=SIDECAR.fieldNames())


def sidecar_text(rating: int, label: str | None) -> str:
    """A sidecar with a rating and label."""
    mark = f' xmp:Label="{label.capitalize()}"' if label else ""
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{RDF}"><rdf:Description xmlns:xmp="{XMP}" xmp:Rating="{rating}"{mark}/></rdf:RDF></x:xmpmeta>'


def image_size(data: bytes | None) -> tuple:
    """(kind, width, height) from the head of a PNG, JPEG or WebP file; nulls for anything else."""
    if not data:
        return None, None, None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        form = data[12:16]
        if form == b"VP8 ":
            return ("webp", *struct.unpack("<HH", data[26:30]))
        if form == b"VP8L":
            bits = struct.unpack("<I", data[21:25])[0]
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if form == b"VP8X":
            return "webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                at += 1
                continue
            mark = data[at + 1]
            if mark == 0xFF:
                at += 1
            elif mark in (0x01, *range(0xD0, 0xDA)):
                at += 2
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", width, height
            else:
                at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None, None, None


@F.pandas_udf(SIZE)
def image_sizes(head: pd.Series) -> pd.DataFrame:
    """Kind and size of images from the heads of their files."""
    return pd.DataFrame([image_size(None if h is None else bytes(h)) for h in head], columns=SIZE.fieldNames()).astype({"width": "Int32", "height": "Int32"})


def gray_png(width: int, height: int, pixels: bytes) -> bytes:
    """An 8-bit gray PNG with stored data."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + pixels[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 0)) + chunk(b"IEND", b"")


@F.pandas_udf(BinaryType())
def encode_gray_png(width: pd.Series, height: pd.Series, levels: pd.Series) -> pd.Series:
    """PNG files of planes of levels from 0 to 255."""
    return pd.Series([gray_png(int(w), int(h), np.asarray(p, np.uint8).tobytes()) for w, h, p in zip(width, height, levels, strict=True)])
