"""Documents, catalogs and sidecars: work dealt over tasks, values told to be fine without a walk."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from silverframe.functions import rules
from silverframe.functions import settings as st
from silverframe.functions import sidecars as sc
from silverframe.operators import document_rules as dr
from silverframe.plans import rule_plans as rp
from silverframe.plans import sidecar_plans as sp


def tasks(rows):
    return rows.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_case_is_dealt_over_tasks(spark, sf_dir):
    """The case with the longest text was one task's, since documents met their case in a shuffle by its number."""
    assert tasks(rp._texts(spark, sf_dir).where(f"id % {len(rp.CASES)} = 1")) > 1


def test_values_are_fine_if_a_walk_finds_nothing():
    shape = rules.Fields(dr.SETTINGS | {"masking": dr.MASKING})
    for text, found in rp.CASES:
        if found != [("", "json")] and isinstance(value := dr.load(text), dict):
            at = value.get("settings")
            assert shape.fine([at]) == (not list(shape.check(at, "settings")))
            assert dr.parse(value, len(text))[1] == found


def test_a_long_list_is_not_walked(monkeypatch):
    walked = []
    monkeypatch.setattr(rules.Fields, "check", lambda *a: walked.append(a) or iter(()))
    assert rules.breaches(rules.Items(dr.POINT, 1, 10_000), [{"x": 0, "y": 0.5}] * 9_000) == [] and not walked


@pytest.mark.parametrize(("value", "found"), [(10**400, "number"), (float("nan"), "number"), (True, "number"), (2, "range"), (0.5, None)])
def test_odd_numbers(value, found):
    assert rules.breaches(dr.UNIT, value) == ([("", found)] if found else [])


def test_size_without_a_text_is_exact():
    document = rp._document()
    assert dr._size(document, None) <= dr._size(document, 5_000) <= dr.MAX_BYTES
    document["settings"]["more"] = "x" * dr.MAX_BYTES
    assert dr._size(document, dr.MAX_BYTES) > dr.MAX_BYTES


def test_older_settings_are_dealt(spark, sf_dir):
    assert rp.document_migration(spark, sf_dir).rdd.getNumPartitions() > 8


def test_catalogs_are_dealt(spark, sf_dir):
    assert rp._catalogs(spark, sf_dir).rdd.getNumPartitions() > 8


def test_a_fresh_sidecar_is_that_of_an_empty_one():
    said = st.properties(st.DEFAULTS) | {"Odd": 'a"<&>\n\t\r b', "Items": ["<1&", '"2"'], "None": []}
    for label in (None, "green", 'x"<'):
        for masks, namespace in ((None, sc.MASKS), ("q", sc.MASKS), ("q", 'urn:x&"'), ("q", sc.XMP), ("q", sc.RDF)):
            assert sc.write(None, said, 3, label, masks, namespace) == sc.write(sc.EMPTY, said, 3, label, masks, namespace)


def test_reading_builds_no_document(monkeypatch):
    text = sc.write(None, {"Tint": "1", "A": ["0, 0", "1, 1"]}, 4, "red", "q")[0]
    odd = text.replace("<rdf:li>0, 0", "<rdf:li>0,<!--x--> <![CDATA[0]]><?p?>").replace("</rdf:RDF>", f'<rdf:Description xmlns:c="{sc.SETTINGS_NS}" c:Tint="2"/></rdf:RDF>')
    monkeypatch.setattr(sc.minidom, "parseString", None)
    assert sc.read(text) == sc.read(odd) == {"texts": {"Tint": "1"}, "lists": {"A": ["0, 0", "1, 1"]}, "xmp": {"Rating": "4", "Label": "red"}, "masks": "q", "error": None}
    assert sc.read(odd + "<b/>")["error"] and sc.read("<a/>")["error"] == "no description"


def test_new_properties_of_a_foreign_file_are_no_nodes(monkeypatch):
    """Some seventy attributes and lists were made as nodes of the document, only to be written as text."""
    monkeypatch.setattr(sc.minidom.Element, "setAttributeNS", None)
    monkeypatch.setattr(sc.minidom.Document, "createElementNS", None)
    start, end = f'<a xmlns:r="{sc.RDF}" xmlns:crs="urn:other"><!--k-->', "<r:Description/></a>"
    there = f'<r:Description xmlns:c="{sc.SETTINGS_NS}" crs:Tint="1" c:Tint="2" c:Own="3"><c:A>4</c:A>t<crs:A/><c:A/></r:Description>'
    new = f'<r:Description xmlns:c="{sc.SETTINGS_NS}" crs:Tint="1" c:Own="3" xmlns:xmp="{sc.XMP}" c:Tint="&quot;5&lt;" xmp:Rating="4" xmlns:masks="{sc.MASKS}" masks:MaskingData="q">t<crs:A/><c:A><r:Seq><r:li>6&amp;</r:li></r:Seq></c:A><c:B><r:Seq/></c:B></r:Description>'
    assert sc.write(start + there + end, {"A": ["6&"], "Tint": '"5<', "B": []}, 4, None, "q") == (start + new + end, None)


def test_values_of_nested_columns():
    point = pa.struct([("x", pa.float64()), ("y", pa.string())])
    rows = [None, {"a": None, "b": {"l": [{"x": 1.5, "y": "q"}, None]}}, {"a": 2.0, "b": None}, {"a": 3.0, "b": {"l": None}}, {"a": 4.0, "b": {"l": []}}]
    array = pa.array(rows, pa.struct([("a", pa.float64()), ("b", pa.struct([("l", pa.list_(point))]))]))
    assert all(sc._values(array.slice(i, n)) == rows[i : i + n] for i in range(5) for n in range(6))


def test_sidecars_are_dealt(spark, sf_dir):
    assert sp.part_settings(spark, sf_dir).rdd.getNumPartitions() > 8


def test_foreign_texts_stay_with_their_parts(spark, tmp_path):
    """Texts were joined to their parts' settings, by a broadcast of all of them; a part that comes twice came four times."""
    parts = spark.createDataFrame([(7, "hot bolt", "Brand#7"), (7, "big nut", "Brand#1"), (9, None, "Brand#2"), (None, "no key", "Brand#3")], "p_partkey long, p_name string, p_brand string")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = sp.foreign(spark, str(tmp_path))
    # without a name there is no file of the other application
    assert sorted(tuple(r)[:7] for r in found.collect()) == [(7, "big nut", "Brand#1", "keep", "x", 1, None), (7, "hot bolt", "Brand#7", "keep", "x", 1, None), (9, None, None, None, None, 3, "green")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_settings_of_a_batch_come_in_parts(spark, sf_dir):
    """Whole batches of settings as Python values took a task's memory."""
    rows = sp.part_settings(spark, sf_dir).limit(100).coalesce(1).withColumns({"existing": F.lit(None).cast("string"), "rating": F.lit(1), "label": F.lit("red"), "masks": F.lit(None).cast("string")})
    assert sc.sidecar_texts(rows).where("text is not null and error is null").count() == 100 and sc.ROWS <= 1_000
