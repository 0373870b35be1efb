"""Scalar helpers whose results differ from the built-in of the same name."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SUPPORTED = r"\.(nef|jpe?g|png|webp)$"


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves towards plus infinity (-2.5 is -2)."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float | Column = 0.0, high: float | Column = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def smoothstep(edge0: float | Column, edge1: float | Column, x: Column) -> Column:
    """Cubic step; edges may be in either order."""
    t = clamp((x - edge0) / (edge1 - edge0))
    return t * t * (3 - 2 * t)


def mix(a: Column | float, b: Column | float, t: Column | float) -> Column:
    return F.lit(0.0) + a * (1 - t) + b * t


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, where spelling it out several times would blow up the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scaled(x: Column, places: int = 6) -> Column:
    """A double as a whole number of units of the last place; just under a half goes up, so that ties don't hang on the last bit."""
    return F.floor(x * float(10**places) + 0.5001).cast("long")


def entry_id(path: Column) -> Column:
    """A path percent-encoded: letters, digits and ``-_.!~*'()`` stay."""
    out = F.url_encode(path)
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def parent_folder(path: Column) -> Column:
    """What stands before the last slash; null at the root."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/", 1), F.lit(""))


def parent_name(path: Column) -> Column:
    """The last folder's name, for either slash; null at the root."""
    parts = F.filter(F.split(path, r"[/\\]+"), lambda x: x != "")
    return F.try_element_at(parts, F.lit(-2))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def file_type(name: Column) -> Column:
    return F.upper(F.substring_index(name, ".", -1))


def is_supported(name: Column) -> Column:
    return F.lower(name).rlike(SUPPORTED)


def profile_of(name: Column) -> Column:
    """The decoder of a file, by its extension; null for none."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.(jpe?g|png|webp)$"), "standard").when(low.rlike(r"\.nef$"), "nef")


def sidecar_path(path: Column) -> Column:
    """Raw files share their stem with the sidecar, others keep their extension before it."""
    return F.when(F.lower(path).endswith(".nef"), F.concat(F.regexp_replace(path, r"\.[^.]+$", ""), F.lit(".xmp"))).otherwise(F.concat(path, F.lit(".xmp")))


def signature_key(*parts: Column) -> Column:
    """Parts joined by a separator; a null part differs from an empty one."""
    return F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts))


def safe_filename(name: Column) -> Column:
    """Illegal characters become underscores, trailing dots and spaces go; at most 240 characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.trim(name), r'[\x00-\x1f<>:"/\\|?*]', "_"), r"[. ]+$", ""), F.lit(240))


def number_property(text: Column) -> Column:
    """A number as written in a sidecar: blank is 0, hexadecimal is read, anything else that isn't a number is null."""
    t = F.trim(text)
    hexadecimal = F.conv(F.nullif(F.regexp_extract(t, r"^0[xX]([0-9a-fA-F]{1,13})$", 1), F.lit("")), 16, 10).cast("double")
    return F.when(t == "", 0.0).when(t.rlike(r"^0[xX][0-9a-fA-F]{1,13}$"), hexadecimal).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


@F.pandas_udf(StringType())
def to_fixed(x: pd.Series, places: pd.Series) -> pd.Series:
    """A double with a fixed number of decimals, rounded half up on its exact binary value."""
    return pd.Series([None if v is None or v != v else str(Decimal(v).quantize(Decimal(1).scaleb(-int(p)), ROUND_HALF_UP)) for v, p in zip(x, places, strict=True)])


def row_date(ms: Column) -> Column:
    """Day and month as ``05 MAR`` of a time in milliseconds; a dash if there is none."""
    return F.coalesce(F.upper(F.date_format(F.timestamp_millis(F.floor(ms)), "dd MMM")), F.lit("—"))


def shutter(seconds: Column) -> Column:
    """Exposure time: ``1/250 s`` below a second, else seconds."""
    return F.when(seconds > 0, F.when(seconds < 1, F.concat(F.lit("1/"), round_half_up(1 / seconds).cast("string"), F.lit(" s"))).otherwise(F.concat(seconds.cast("string"), F.lit(" s"))))


def join_root(root: Column, relative: Column) -> Column:
    """A relative path under a root, with the root's kind of slash."""
    slash = F.when(F.contains(root, F.lit("\\")), "\\").otherwise("/")
    return F.concat(root, slash, F.replace(relative, F.lit("/"), slash))


def cache_key(path: Column, modified: Column, thumbnail: Column | None = None) -> Column:
    """``path:time``, and ``:thumb`` or ``:full`` for rendered images."""
    parts = [path, modified.cast("string")]
    if thumbnail is not None:
        parts.append(F.when(thumbnail, "thumb").otherwise("full"))
    return F.concat(*(p for k, part in enumerate(parts) for p in ([F.lit(":"), part] if k else [part])))


def decoded(text: Column, size: Column) -> Column:
    """The bytes of a base-64 text, null if it is none or they aren't ``size``."""
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.when(F.octet_length(raw) == size, raw)


def shown_value(value: Column) -> Column:
    """A value as metadata panels show it; a dash if there is none."""
    return F.coalesce(value.cast("string"), F.lit("—"))


# Capture fields in the order that they are shown, with their labels.
CAPTURE = [("camera_make", "Make"), ("camera_model", "Model"), ("lens", "Lens"), ("focal_len", "Focal Length"), ("aperture", "Aperture"), ("shutter", "Shutter"), ("iso_speed", "ISO"), ("timestamp", "Date Time")]


def panel_rows(values: Column) -> Column:
    """Rows (pos, label, value) of a map of strings: the capture fields, then all pairs by key."""
    row = lambda pos, label, value: F.struct(pos.cast("int").alias("pos"), label.alias("label"), shown_value(value).alias("value"))
    first = F.array(*(row(F.lit(k), F.lit(label), F.try_element_at(values, F.lit(key))) for k, (key, label) in enumerate(CAPTURE)))
    keys = F.array_sort(F.map_keys(values))
    rest = F.transform(keys, lambda key, i: row(i + len(CAPTURE), key, F.try_element_at(values, key)))
    return F.concat(first, rest)


def next_clock(source: Column, current: Column) -> Column:
    """A clock that never stands still or goes back."""
    return F.greatest(source, current + 1)


def fold_line_angle(degrees: Column) -> Column:
    """The angle of a line from its nearer axis, -45 to 45."""
    turns = F.when(degrees > 45, F.ceil((degrees - 45) / 90)).when(degrees < -45, -F.ceil((-45 - degrees) / 90)).otherwise(0)
    return degrees - 90 * turns


def normalize_degrees(degrees: Column) -> Column:
    """The same direction in (-180, 180]."""
    turned = F.pmod(degrees + 180, F.lit(360)) - 180
    return F.when(turned == -180, 180).otherwise(turned)


def eight_bits(value: Column, rounded: bool = False) -> Column:
    """A 16-bit level in 8 bits: its high byte, or the nearest level."""
    return round_half_up(value * 255 / 65535).cast("int") if rounded else F.shiftright(value, 8).cast("int")


# Extensions of export formats, the first being the one written; which take a quality, its default, which can be lossless.
EXTENSIONS = {"jpeg": ["jpg", "jpeg"], "png": ["png"], "webp": ["webp"], "avif": ["avif"], "tiff": ["tif", "tiff"]}
QUALITY = {"jpeg": 90, "webp": 85, "avif": 55}
LOSSLESS = ("webp",)


def strip_known_extension(name: Column) -> Column:
    """A name without the extension of an export format, in any case; other extensions and names of nothing else stay."""
    known = "|".join(e for group in EXTENSIONS.values() for e in group)
    return F.regexp_replace(name, rf"(?i)(?<=[^/])\.({known})$", "")


def name_part(value: Column, windows: bool = False) -> Column:
    """A part of a file name as struct (value, error): trimmed, at most 240 characters; ``windows`` also replaces what is illegal there."""
    bad = value.isNull() | (value == "") | F.contains(value, F.lit("\0")) | F.contains(value, F.lit("/")) | F.contains(value, F.lit("\\")) | F.contains(value, F.lit(".."))
    text = F.regexp_replace(F.regexp_replace(value, r'[<>:"|?*\x00-\x1f]', "_"), r"[. ]+$", "") if windows else value
    space = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    text = space(text)
    empty = text.isin("", ".")
    text = space(F.left(text, F.lit(240)))
    if windows:
        text = F.when(text.rlike(r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"), F.concat(F.lit("_"), text)).otherwise(text)
    error = F.when(bad, "invalid path").when(empty, "empty")
    return F.struct(F.when(error.isNull(), text).alias("value"), error.alias("error"))


def encode_options(fmt: Column, quality: Column, lossless: Column) -> Column:
    """What an encoder runs with, as struct (quality, lossless, error); a null quality is the format's default."""
    default = F.create_map(*(F.lit(v) for kv in QUALITY.items() for v in kv))
    takes = fmt.isin(*QUALITY)
    used = F.coalesce(quality, F.try_element_at(default, fmt).cast("double"))
    error = (
        F.when(fmt.isNull() | ~fmt.isin(*EXTENSIONS), "unknown format")
        .when(takes & ((used != F.floor(used)) | (used < 1) | (used > 100)), "quality must be a whole number from 1 to 100")
        .when(~takes & quality.isNotNull(), "no quality in this format")
        .when(F.coalesce(lossless, F.lit(False)) & ~fmt.isin(*LOSSLESS), "no lossless mode in this format")
    )
    return F.struct(F.when(error.isNull(), used).cast("int").alias("quality"), F.when(error.isNull(), F.coalesce(lossless, F.lit(False))).alias("lossless"), error.alias("error"))
