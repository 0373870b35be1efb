"""Queries of sidecars: properties written and read, odd ratings and labels, files of other applications."""

from __future__ import annotations

from pyspark.sql import functions as F

from silverframe.functions import settings as st
from silverframe.functions import sidecars as sc
from silverframe.operators import sidecars
from silverframe.operators.batches import dealt
from silverframe.plans import fixtures as fx
from silverframe.plans.library_plans import query

# The settings of a part: its key times another odd number for each setting, in halves from -100 to 100.
NUMBERS = [*(("crop", n) for n in st.TRANSFORM), *(("basic", n) for n in st.BASIC), *(("effects", n) for n in st.EFFECTS)]
_value = lambda i: (F.col("p_partkey") * (2 * i + 3) % 401 - 200) / 2.0
_sql = lambda i: f"((p_partkey * {2 * i + 3} % 401 - 200) / 2.0::DOUBLE)"
_mix = lambda j: 40 + j


def part_settings(spark, d, *also):
    """(id, settings) and ``also`` of each part: curves with three points, a crop, and a number for every other setting."""
    p, k = dealt(fx.table(spark, d, "part"), "p_partkey"), F.col("p_partkey")
    group = lambda g: [_value(i).alias(n.name) for i, (of, n) in enumerate(NUMBERS) if of == g]
    crop = F.struct((k % 2 == 0).alias("enabled"), ((k % 50) / 100.0).alias("x"), ((k % 30) / 64.0).alias("y"), F.lit(0.5).alias("width"), F.lit(0.25).alias("height"), *group("crop"), F.lit("original").alias("aspectPreset"), F.lit(1.0).alias("customAspectWidth"), F.lit(1.0).alias("customAspectHeight"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    curve = F.array(point(F.lit(0.0), (k % 16) / 255.0), point((k % 100 + 50) / 255.0, (k % 200) / 255.0), point(F.lit(1.0), F.lit(1.0)))
    mixer = F.struct(*(F.struct(*(_value(_mix(3 * a + b)).alias(n) for b, (n, _) in enumerate(st.BAND))).alias(c) for a, c in enumerate(st.COLORS)))
    curves = F.struct(*(curve.alias(c) for c, _ in st.CURVES))
    return p.select(k.alias("id"), F.struct(F.struct(*group("basic")).alias("basic"), crop.alias("crop"), curves.alias("curve"), mixer.alias("mixer"), F.struct(*group("effects")).alias("effects")).cast(st.SETTINGS).alias("settings"), *also)


def part_sidecars(spark, d):
    """(id, text): the sidecars of these settings, without masks."""
    rows = part_settings(spark, d).withColumns({"masking": F.lit(None).cast("string"), "assets": F.lit(None).cast("string"), "rating": (F.col("id") % 6).cast("int"), "color_label": F.when(F.col("id") % 3 == 0, "green"), "existing": F.lit(None).cast("string")})
    return sidecars.sidecar_contents(rows).select("id", F.col("contents").alias("text"))


_round = lambda e: f"floor({e} + 0.5)::BIGINT::VARCHAR"
_fixed = lambda e, n: f"printf('%.{n}f', {e})"
_CURVE = "'0, ' || (p_partkey % 16) || '; ' || (p_partkey % 100 + 50) || ', ' || (p_partkey % 200) || '; 255, 255'"
# each property as its format wants it: two, one or no decimals, a temperature around 5500, crop edges with six
_PAIRS = [
    ("HasCrop", "CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'False' END"),
    ("CropLeft", _fixed("(p_partkey % 50) / 100.0::DOUBLE", 6)),
    ("CropTop", _fixed("(p_partkey % 30) / 64.0::DOUBLE", 6)),
    ("CropRight", _fixed("(p_partkey % 50) / 100.0::DOUBLE + 0.5", 6)),
    ("CropBottom", _fixed("(p_partkey % 30) / 64.0::DOUBLE + 0.25", 6)),
    ("ProcessVersion", "'15.0'"),
    ("ToneCurveName2012", "'Custom'"),
    *((p, _CURVE) for _, p in st.CURVES),
    *((n.property, {"Exposure2012": _fixed(_sql(i), 2), "CropAngle": _fixed(_sql(i), 2), "SharpenRadius": _fixed(_sql(i), 1), "Temperature": _round(f"5500 + {_sql(i)}")}.get(n.property, _round(_sql(i)))) for i, (_, n) in enumerate(NUMBERS)),
    *((f"{p}{c.capitalize()}", _round(_sql(_mix(3 * a + b)))) for a, c in enumerate(st.COLORS) for b, (_, p) in enumerate(st.BAND)),
]
_LISTED = " SELECT p_partkey AS id, unnest([" + ", ".join(f"'{n}'" for n, _ in _PAIRS) + "]) AS name, unnest([" + ", ".join(e for _, e in _PAIRS) + "]) AS value FROM part"


@query("sidecar_properties", _LISTED)
def properties(spark, d):
    """Every property of every sidecar, after it was written as a file's text and read again."""
    said = part_sidecars(spark, d).select("id", sc.sidecar_properties(F.col("text")).alias("p"))
    both = F.map_concat("p.texts", F.transform_values("p.lists", lambda _, v: F.array_join(v, "; ")))
    return said.select("id", F.explode(both).alias("name", "value"))


_READ = [
    ("crop.x", "(p_partkey % 50) / 100.0::DOUBLE"), ("crop.y", "(p_partkey % 30) / 64.0::DOUBLE"), ("crop.width", "0.5"), ("crop.height", "0.25"),
    *((f"{g}.{n.name}", _sql(i) if n.places else f"floor({_sql(i)} + 0.5)") for i, (g, n) in enumerate(NUMBERS)),
    *((f"mixer.{c}.{n}", f"floor({_sql(_mix(3 * a + b))} + 0.5)") for a, c in enumerate(st.COLORS) for b, (n, _) in enumerate(st.BAND)),
    *((f"curve.{c}.{i}", e) for c, _ in st.CURVES for i, e in (("x", "(p_partkey % 100 + 50) / 255.0::DOUBLE"), ("y", "(p_partkey % 200) / 255.0::DOUBLE"))),
]


@query("sidecar_settings", " SELECT p_partkey AS id, unnest([" + ", ".join(f"'{n}'" for n, _ in _READ) + "]) AS name, round(unnest([" + ", ".join(f"({e})::DOUBLE" for _, e in _READ) + "]), 5) AS value FROM part")
def settings(spark, d):
    """Settings read from sidecars: what was written, as far as the format holds it; the middle point stands for a curve."""
    records = sidecars.sidecar_records(part_sidecars(spark, d))

    def at(name):
        group, *rest = name.split(".")
        return F.col(f"settings.curve.{rest[0]}")[1][rest[1]] if group == "curve" else F.col(f"settings.{name}")

    values = F.array(*(F.struct(F.lit(n).alias("name"), F.round(at(n), 5).alias("value")) for n, _ in _READ))
    return records.select("id", F.inline(values))


@query("sidecar_marks", " SELECT p_partkey AS id, (p_partkey % 6)::INTEGER AS rating, true AS has_label, CASE WHEN p_partkey % 3 = 0 THEN 'green' END AS color_label FROM part")
def marks(spark, d):
    return sidecars.sidecar_records(part_sidecars(spark, d)).select("id", "rating", "has_label", "color_label")


# Texts of ratings and labels that other applications may write, and what they mean.
RATINGS = (("0", 0), ("5", 5), ("3", 3), ("6", None), ("-1", None), ("4.0", None), ("1e0", None), ("", None), (" 2", None), ("nan", None), ("inf", None), ("four", None), (None, None))
MARKS = (("Red", True, "red"), ("red", True, "red"), ("PURPLE", True, "purple"), ("", False, None), (" Red ", False, None), ("Orange", False, None), (None, True, None))


def _odd(spark, d):
    e = fx.table(spark, d, "events")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))
    mark = lambda name, values, n: F.coalesce(F.concat(F.lit(f' xmp:{name}="'), pick(values, n), F.lit('"')), F.lit(""))
    i = F.col("event_id")
    text = F.concat(F.lit(f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{sc.RDF}"><rdf:Description xmlns:xmp="{sc.XMP}"'), mark("Rating", [r for r, _ in RATINGS], i), mark("Label", [m[0] for m in MARKS], i), F.lit("/></rdf:RDF></x:xmpmeta>"))
    broken = F.when(i % 17 == 0, F.substring(text, 1, 60)).when(i % 17 == 1, "<a/>").otherwise(text)
    return e.select(i.alias("id"), broken.alias("text"))


_null = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
_nth = lambda values, what: f"[{', '.join(_null(v) for v in values)}][event_id % {len(values)} + 1]{what}"


@query("sidecar_odd_values", f""" SELECT event_id AS id, CASE WHEN event_id % 17 > 1 THEN {_nth([r for _, r in RATINGS], '::INTEGER')} END AS rating,
    event_id % 17 > 1 AND {_nth([m[1] for m in MARKS], '')} AS has_label, CASE WHEN event_id % 17 > 1 THEN {_nth([m[2] for m in MARKS], '')} END AS color_label, event_id % 17 <= 1 AS broken FROM events""")
def odd_values(spark, d):
    """Ratings and labels of files of any origin: what they say, and files that can't be read as such."""
    return sidecars.sidecar_records(_odd(spark, d)).select("id", "rating", "has_label", "color_label", F.col("error").isNotNull().alias("broken"))


_EXPOSURE = next(i for i, (_, n) in enumerate(NUMBERS) if n.name == "exposure")


@query("sidecar_foreign", f""" SELECT p_partkey AS id, p_name AS creator, p_brand AS keyword, 'keep' AS remark, 'x' AS second, (p_partkey % 6)::INTEGER AS rating,
    CASE WHEN p_partkey % 3 = 0 THEN 'green' END AS color_label, {_fixed(_sql(_EXPOSURE), 2)} AS exposure FROM part""")
def foreign(spark, d):
    """Files of another application, written over: its own data is still there, ours is new.

    A file's text is made beside its settings, after the shuffle: by size, Spark would broadcast the texts of a table of short columns.
    """
    text = F.concat(
        F.lit(f'<?xpacket begin=""?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{sc.RDF}"><!--keep--><rdf:Description xmlns:dc="urn:dc" xmlns:c="{sc.SETTINGS_NS}" xmlns:xmp="{sc.XMP}" c:Exposure2012="+9.99" xmp:Label="Old" xmp:Rating="9" dc:creator="'),
        "p_name",
        F.lit('"><c:ToneCurvePV2012><rdf:Seq><rdf:li>0, 0</rdf:li></rdf:Seq></c:ToneCurvePV2012><dc:subject><rdf:Bag><rdf:li>'),
        "p_brand",
        F.lit('</rdf:li></rdf:Bag></dc:subject></rdf:Description><rdf:Description xmlns:o="urn:o" o:second="x"/></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'),
    )
    rows = part_settings(spark, d, text.alias("existing")).where("id IS NOT NULL").withColumns({"masking": F.lit(None).cast("string"), "assets": F.lit(None).cast("string"), "rating": (F.col("id") % 6).cast("int"), "color_label": F.when(F.col("id") % 3 == 0, "green")})
    new = sidecars.sidecar_contents(rows)
    said = new.select("id", "contents", sc.sidecar_properties(F.col("contents")).alias("p"))
    inside = lambda pattern: F.nullif(F.regexp_extract("contents", pattern, 1), F.lit(""))
    return said.select("id", inside('dc:creator="([^"]*)"').alias("creator"), inside("<dc:subject><rdf:Bag><rdf:li>([^<]*)</rdf:li>").alias("keyword"), inside("<!--(.*?)-->").alias("remark"), inside('o:second="([^"]*)"').alias("second"), sc.rating(F.col("p.xmp")).alias("rating"), sc.label(F.col("p.xmp"))["value"].alias("color_label"), F.col("p.texts")["Exposure2012"].alias("exposure"))
