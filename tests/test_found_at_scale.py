"""Faults that only larger tables or other names showed."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from silverframe.functions import geometry
from silverframe.operators import documents, exports, rollups, tiles
from silverframe.plans import registry


def test_first_free_number_of_any_column_name(spark):
    names = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (2, 2), (3, 0), (4, 1), (4, 2)], "u long, k long")
    for number in ("k", "top", "_rank", "free"):
        found = rollups.first_free_number(names.withColumnRenamed("k", number), "u", number)
        assert {tuple(r) for r in found.collect()} == {(1, 2), (2, 1), (3, 1), (4, 3)}


def test_selection_toggle_of_large_keys(spark, tmp_path):
    """Keys beyond a million: the entry that is toggled second may be in the selection."""
    rows = [(1, 1_000_005, 5, 1), (1, 1_000_009, 2, 2), (2, 7, 1, 1), (3, 1_000_003, 3, 1)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    lines.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in registry.queries()["selection_toggle"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(con.sql(registry.oracle_sql()["selection_toggle"]).fetchall())
    assert (1, "1000005", 1_000_005, "1000009") in got


def test_windows_dont_hang_on_the_last_bit(spark):
    """A tile that starts at row 2 of 5 in an image of 15 rows needs the source from row 3 of 15 less a pixel, not two."""
    jobs = spark.createDataFrame([(1441, 23, 15, 2, 5, 5, None)], f"image_id long, width int, height int, orientation int, out_w int, out_h int, crop {tiles.CROP}")
    assert {r.top for r in tiles.output_tiles(jobs, 8, 24).where("y = 2").collect()} == {2}


def test_windows_of_settings_that_are_no_numbers(spark):
    nan = float("nan")
    jobs = spark.createDataFrame([(1, 9, 7, 1, 2, 2, (0.0, 0.0, 1.0, 1.0, nan, 0.0, 0.0, 0.0))], f"image_id long, width int, height int, orientation int, out_w int, out_h int, crop {tiles.CROP}")
    assert {(r.left, r.top, r.right, r.bottom) for r in tiles.output_tiles(jobs).collect()} == {(0, 0, 9, 7)}


def test_small_windows_share_a_group(spark):
    """Tiles of 8 x 8 were a group each; a window of full size still is."""
    jobs = spark.createDataFrame([(i, 16, 16, 1, 16, 16, None) for i in range(-3, 5)], f"image_id long, width int, height int, orientation int, out_w int, out_h int, crop {tiles.CROP}")
    src = spark.createDataFrame([(i, 0, 0, 16, 16, *[[float(i)] * 256] * 3) for i in range(-3, 5)], "image_id long, tx int, ty int, w int, h int, r array<double>, g array<double>, b array<double>")
    drawn = tiles.render(src, jobs, 16, 8, 24)
    assert {(r.image_id, *set(r.r)) for r in drawn.collect()} == {(i, float(i)) for i in range(-3, 5)} and drawn.count() == 32
    assert "_across" in drawn._jdf.queryExecution().toString()


def test_guarded_keys_are_hashed(spark):
    """A task held and sorted its targets for each of the four rules; now they stream past the keys."""
    sources = spark.createDataFrame([("a", "ra", 1, 10, "f", "n", False), ("b", "rb", 1, 11, "f", "m", False), ("b2", "rc", 2, 10, "g", "n", True)], "path string, real_path string, device int, inode int, folder string, name string, selected boolean")
    outputs = spark.createDataFrame([("b",), ("b2",)], "path string")
    rows = [(1, "a", "x", 0, 0, "", ""), (2, "x", "rb", 1, 11, "f", "m"), (3, "x", "rc", 0, 0, "", ""), (4, "x", "x", 1, 10, "", ""), (5, "x", "x", 0, 0, "g", "n"), (5, "b2", "x", 0, 0, "g", "n"), (6, None, None, None, None, None, None)]
    targets = spark.createDataFrame(rows, "target int, path string, real_path string, device int, inode int, folder string, name string")
    found = exports.overwrites_source(targets, sources, outputs)
    assert sorted(r.target for r in found.collect()) == [1, 3, 4, 5]
    joins = [line for line in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftSemi" in line]
    assert len(joins) == 4 and all("ShuffledHashJoin" in line for line in joins)


def test_violations_read_a_document_once(spark):
    kind = "id int, masks array<struct<id string, components array<struct<id string, kind string, asset string, strokes array<struct<points array<int>>>>>>>, assets map<string, string>"
    brush = ("b", "brush", None, [([1, 2],), ([3],), (None,)])
    rows = [
        (1, [("m", [("m", "ai", "x", None), brush]), ("n", [("b", "ai", None, None)])], {"y": "1"}),
        (2, [("m", None), ("m", [brush])], {"y": "1"}),  # components unknown: no rule about ids and assets, limits count nothing
        (3, None, None),
        (4, [("m", [brush, ("c", "brush", None, None)])], {}),
    ]
    found = documents.violations(spark.createDataFrame(rows, kind), max_strokes=2, max_points=2, max_bytes=100)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, "repeated id", "m"), (1, "repeated id", "b"), (1, "missing asset", "x"), (1, "missing asset", None), (1, "unused asset", "y"), (1, "too many strokes", None), (1, "too many points", None), (1, "too large", None)]
        + [(2, "too large", None), (4, "too many strokes", None), (4, "too many points", None), (4, "too large", None)],
        key=str,
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Union" not in plan and plan.count("structstojson") <= 1


def test_rotation_is_worked_out_once(spark):
    """One expression spelled the sine and cosine out some twenty times; columns of the caller's names stay."""
    cases = [(0.1, 0.2, 0.5, 0.4, 30.0, 3000.0, 2000.0), (-0.3, 0.9, 1.2, 0.01, -45.0, 2000.0, 3500.0), (0.4, 0.4, 0.2, 0.2, 0.0, 10.0, 10.0), (0.0, 0.0, 1.0, 1.0, float("nan"), 10.0, 10.0), (0.2, 0.2, 0.3, 0.3, 10.0, 0.0, 10.0), (0.5, 0.5, 0.5, 0.5, None, 9.0, 9.0)]
    rows = spark.createDataFrame([(i, i * 7, *c) for i, c in enumerate(cases)], "_w int, __scale int, x double, y double, w double, h double, angle double, iw double, ih double")
    fitted = geometry.fit_rotation(rows, geometry.Rect(*map(F.col, "xywh")), F.col("angle"), F.col("iw"), F.col("ih"))
    assert fitted.columns == [*rows.columns, "fitted"]
    for r in fitted.collect():
        assert r["__scale"] == r["_w"] * 7
        x, y, w, h, angle, iw, ih = cases[r["_w"]]
        w, h = min(1, max(0.05, w)), min(1, max(0.05, h))
        x, y = max(0, min(1 - w, x)), max(0, min(1 - h, y))
        if angle and not math.isnan(angle) and iw > 0:
            cos, sin = abs(math.cos(math.radians(angle))), abs(math.sin(math.radians(angle)))
            bw, bh = (cos * w * iw + sin * h * ih) / 2, (sin * w * iw + cos * h * ih) / 2
            k = min(1, iw / (2 * bw), ih / (2 * bh))
            x = max(bw * k, min(iw - bw * k, (x + w / 2) * iw)) / iw - w * k / 2
            y = max(bh * k, min(ih - bh * k, (y + h / 2) * ih)) / ih - h * k / 2
            w, h = w * k, h * k
        assert tuple(r.fitted) == pytest.approx((x, y, w, h))
    query = registry.queries()["crop_rotation_fit"](spark, "/root/testdata/sf0.001")
    assert query._jdf.queryExecution().optimizedPlan().toString().count("COS(") == 1
