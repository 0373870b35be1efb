"""Sources, codecs, folds, streams and the cases that comparison SQL doesn't reach."""

import json
import math

import pytest
from pyspark.sql import functions as F

from silverframe.functions import codecs, curves, geometry, settings, sidecars
from silverframe.functions import scalars as sc
from silverframe.operators import document_rules, documents, edits, exports, library, ordered, rasters
from silverframe.operators import sidecars as sidecar_ops
from silverframe.operators.positions import with_position
from silverframe.plans import codec_plans, registry
from silverframe.sources import library_scan as scan
from silverframe.streaming import edits as stream


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalars(spark):
    row = one(spark, sc.round_half_up(F.lit(-2.5)), sc.entry_id(F.lit("a b/é!'()*~.jpg")), sc.to_fixed(F.lit(1.005), F.lit(2)), sc.to_fixed(F.lit(0.125), F.lit(2)), sc.number_property(F.lit("")), sc.number_property(F.lit("0x10")), sc.number_property(F.lit("x")), sc.safe_filename(F.lit(' a/b:c?. ')), sc.shutter(F.lit(0.004)), sc.parent_name(F.lit("a\\b\\c.jpg")))
    assert list(row) == [-2, "a%20b%2F%C3%A9!'()*~.jpg", "1.00", "0.13", 0.0, 16.0, None, "a_b_c_", "1/250 s", "b"]


def test_positions_and_collation(spark):
    df = spark.createDataFrame([(str(i * 7919 % 1000),) for i in range(1000)], "k string").repartition(7)
    rows = with_position(df, F.col("k").cast("int")).collect()
    assert sorted((r.pos, int(r.k)) for r in rows) == [(i, i) for i in range(1000)]
    names = spark.createDataFrame([(n, n) for n in ("b", "A", "a", "_x", "10", "9", "é")], "name string, relative_path string")
    assert [r.name for r in names.orderBy(*library.sort_order("name", "UNICODE")).collect()] == ["_x", "10", "9", "a", "A", "b", "é"]
    assert with_position(df.limit(0), "k").count() == 0


def test_scan_and_sidecars(spark, tmp_path):
    for name in ("a b.JPG", "sub/x.nef", "sub/.hidden.jpg", "notes.txt", "sub/deep/z.webp"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"12345")
    (tmp_path / "sub/x.xmp").write_text(codecs.sidecar_text(4, "red"))
    entries = scan.scan_folder(spark, str(tmp_path))
    assert sorted((r.id, r.folder, r.profile_id, r.size) for r in entries.collect()) == [("a%20b.JPG", None, "standard", 5), ("sub%2Fdeep%2Fz.webp", "sub/deep", "standard", 5), ("sub%2Fx.nef", "sub", "nef", 5)]
    got = scan.read_sidecars(spark, str(tmp_path), entries).select("id", codecs.sidecar("text").alias("s")).select("id", "s.*").collect()
    assert [(r.id, r.rating, r.label) for r in got] == [("sub%2Fx.nef", 4, "red")]
    assert scan.file_heads(spark, str(tmp_path), 2).where("path like '%txt'").first().head == b"12"


def test_catalog_document(spark, tmp_path):
    doc = {"version": 2, "rootPath": "/r", "entries": {"a": {"pick": "pick", "rating": 3, "updatedAt": 5.0}, "b": {"pick": "bad", "rating": 9, "updatedAt": 1.0}}, "albums": [{"id": "1", "name": "x", "entryIds": ["a", "b"]}], "archivedEntryIds": ["b"]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    catalog = scan.read_catalog(spark, str(tmp_path / "c.json"), "/r")
    t = scan.catalog_tables(catalog)
    assert t["album_entries"].count() == 2 and t["archive"].first().id == "b"
    assert {(r.id, r.rule) for r in scan.catalog_problems(catalog).collect()} == {("b", "pick"), ("b", "rating")}
    assert scan.read_catalog(spark, str(tmp_path / "c.json"), "/other").count() == 0
    scan.write_catalog("/r", t["metadata"], t["album_entries"], t["archive"], str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().archivedEntryIds == ["b"]
    (tmp_path / "n.json").write_text(json.dumps({**doc, "version": 3}))
    with pytest.raises(Exception, match="unsupported catalog version"):
        scan.read_catalog(spark, str(tmp_path / "n.json"), "/r").collect()
    s = scan.lenient_settings(spark.createDataFrame([('{"layout":"square","thumbSize":999}',), ("broken",)], "value string")).collect()
    assert [(r.layout, r.sort, r.thumb_size) for r in s] == [("square", "name", 200.0), ("dynamic", "name", 200.0)]


def test_codecs():
    odd = lambda rating, label: codecs.parse_sidecar(codecs.sidecar_text(rating, label))[:4]
    assert [odd(r, None)[:2] for r in ("nan", "inf", "4.0", "1e0", "", "5")] == [(False, None)] * 5 + [(True, 5)]
    assert [odd(1, label)[2:] for label in (" red ", "ReD")] == [(False, None), (True, "red")]
    assert codecs.parse_sidecar("<a") [4] and codecs.parse_sidecar(None)[:4] == (False, None, False, None)
    assert codecs.parse_sidecar(codecs.sidecar_text(7, "mauve"))[:4] == (False, None, False, None)
    assert codecs.parse_sidecar(codecs.sidecar_text(0, None))[:4] == (True, 0, True, None)
    png = codecs.gray_png(3, 2, bytes(range(6)))
    assert codecs.image_size(png) == ("png", 3, 2)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01"
    assert codecs.image_size(jpeg) == ("jpeg", 32, 16)
    assert codecs.image_size(b"RIFF....WEBPVP8X" + bytes(8) + b"\x1f\x00\x00\x0f\x00\x00") == ("webp", 32, 16)
    assert codecs.image_size(b"nothing") == (None, None, None)


def test_command_fold(spark, sf_dir):
    want = {}
    for r in sorted(codec_plans.command_log(spark, sf_dir).collect(), key=lambda r: (r.entry, r.seq)):
        want.setdefault(r.entry, edits.Session()).step(json.loads(r.command))
    rows = registry.queries()["command_fold"](spark, sf_dir).collect()
    assert {r.entry: (json.loads(r.document), r.revision) for r in rows} == {k: (json.loads(json.dumps(s.document)), s.revision) for k, s in want.items()}


def mask(mask_id, *parts, **more):
    return {"id": mask_id, "name": "m", "components": [{"id": i, "operation": op} for i, op in parts], **more}


AI = {"id": "i", "operation": "add", "kind": "ai", "asset": "x1"}
# (command, does it change the document, components of each mask after it); one document, in order
CASES = [
    ({"kind": "insert-mask", "value": mask("m", ("a", "add"), ("b", "subtract"))}, True, {"m": "a+b-"}),
    ({"kind": "insert-mask", "value": mask("m", ("z", "add"))}, False, {"m": "a+b-"}),
    ({"kind": "rename-mask", "mask": "?", "value": "x"}, False, {"m": "a+b-"}),
    ({"kind": "rename-mask", "mask": "m", "value": "  "}, False, {"m": "a+b-"}),
    ({"kind": "rename-mask", "mask": "m", "value": " sky "}, True, {"m": "a+b-"}),
    ({"kind": "duplicate-mask", "mask": "m", "value": "n", "ids": ["c"]}, False, {"m": "a+b-"}),
    ({"kind": "duplicate-mask", "mask": "m", "value": "n", "ids": ["c", "c"]}, False, {"m": "a+b-"}),
    ({"kind": "duplicate-mask", "mask": "m", "value": "n", "ids": ["c", "d"], "index": 0}, True, {"n": "c+d-", "m": "a+b-"}),
    ({"kind": "move-mask", "mask": "n", "value": 99}, True, {"m": "a+b-", "n": "c+d-"}),
    ({"kind": "move-mask", "mask": "n", "value": 7}, False, {"m": "a+b-", "n": "c+d-"}),
    ({"kind": "insert-mask-component", "mask": "m", "value": {"id": "e", "operation": "subtract"}, "index": 0}, False, {"m": "a+b-", "n": "c+d-"}),
    ({"kind": "insert-mask-component", "mask": "m", "value": {"id": "e", "operation": "subtract"}, "index": -3}, False, {"m": "a+b-", "n": "c+d-"}),
    ({"kind": "insert-mask-component", "mask": "m", "value": {"id": "e", "operation": "add"}, "index": -3}, True, {"m": "e+a+b-", "n": "c+d-"}),
    ({"kind": "replace-mask-component", "mask": "m", "value": {"id": "e", "operation": "subtract"}}, False, {"m": "e+a+b-", "n": "c+d-"}),
    ({"kind": "set-mask-component-operation", "mask": "m", "component": "e", "value": "subtract"}, False, {"m": "e+a+b-", "n": "c+d-"}),
    ({"kind": "set-mask-component-operation", "mask": "m", "component": "a", "value": "subtract"}, True, {"m": "e+a-b-", "n": "c+d-"}),
    ({"kind": "remove-mask-component", "mask": "m", "component": "e"}, True, {"m": "a+b-", "n": "c+d-"}),
    ({"kind": "set-mask-assets", "assets": [{"id": "x0"}]}, True, {"m": "a+b-", "n": "c+d-"}),
    ({"kind": "complete-ai-mask", "mask": "m", "value": AI, "asset": {"id": "other"}}, False, {"m": "a+b-", "n": "c+d-"}),
    ({"kind": "complete-ai-mask", "mask": "m", "value": AI, "asset": {"id": "x1"}}, True, {"m": "a+b-i+", "n": "c+d-"}),
    ({"kind": "complete-ai-mask", "value": {**AI, "id": "j"}, "asset": {"id": "x1"}, "new_mask": {"id": "o", "components": [{"id": "j", "kind": "ai"}]}}, True, {"m": "a+b-i+", "n": "c+d-", "o": "j+"}),
    ({"kind": "update-ai-mask", "mask": "m", "component": "i", "value": {**AI, "asset": "x2"}, "asset": {"id": "x2"}}, True, {"m": "a+b-i+", "n": "c+d-", "o": "j+"}),
    ({"kind": "remove-mask", "mask": "o"}, True, {"m": "a+b-i+", "n": "c+d-"}),
    ({"kind": "remove-mask", "mask": "o"}, False, {"m": "a+b-i+", "n": "c+d-"}),
    ({"kind": "replace-global", "plugin": "basic", "value": {"exposure": 1}}, True, {"m": "a+b-i+", "n": "c+d-"}),
    ({"kind": "replace-global", "plugin": "basic", "value": {"contrast": 2}}, True, {"m": "a+b-i+", "n": "c+d-"}),
    ({"kind": "reset-plugin", "plugin": "crop"}, False, {"m": "a+b-i+", "n": "c+d-"}),
    ({"kind": "reset-all"}, True, {}),
]


def test_every_command_with_replay_both_ways():
    doc, states, done = edits.empty_document(), [], []
    for command, changes, want in CASES:
        before = json.dumps(doc, sort_keys=True)
        patches = edits.command_patches(doc, command)
        assert bool(patches) == changes, command
        states.append(doc)
        doc = edits.replay(doc, patches)
        done.append(patches)
        got = {m["id"]: "".join(c["id"] + {"add": "+", "subtract": "-"}[c["operation"]] for c in m["components"]) for m in doc["masks"]}
        assert got == want and list(got) == list(want), command
        assert json.dumps(states[-1], sort_keys=True) == before
        if command["kind"] == "rename-mask" and changes:
            assert doc["masks"][0]["name"] == "sky"
        if command["kind"] == "duplicate-mask" and changes:
            assert doc["masks"][0]["name"] == "sky copy"
        if command["kind"] == "set-mask-assets":
            assert list(doc["assets"]) == ["x0"]
        if command["kind"] == "update-ai-mask":
            assert sorted(doc["assets"]) == ["x1", "x2"]  # x0 isn't used
        if command["kind"] == "remove-mask" and changes:
            assert sorted(doc["assets"]) == ["x2"]
    assert doc == edits.empty_document()
    for patches, state in zip(reversed(done), reversed(states), strict=True):
        doc = edits.replay(doc, patches, forward=False)
        assert json.dumps(doc, sort_keys=True) == json.dumps(state, sort_keys=True)


def test_bad_commands_are_errors(spark):
    bad = ["null", None, "{", "[]", '{"kind": "fly"}', '{"kind": "replace-global", "plugin": "x", "value": {}}', '{"kind": "insert-mask"}', '{"kind": "insert-mask", "value": {"id": "m", "components": [{"id": "m", "operation": "add"}]}}', '{"kind": "insert-mask", "value": {"id": "m", "components": [{"id": "c", "operation": "add", "kind": "ai", "asset": "none"}]}}', '{"kind": "edit-metadata"}']
    good = json.dumps({"kind": "replace-global", "plugin": "basic", "value": {"exposure": 1}})
    log = spark.createDataFrame([(1, k, c) for k, c in enumerate([good, *bad])] + [(2, 0, good)], "entry long, seq long, command string")
    rows = {r.entry: r for r in edits.fold_commands(log).collect()}
    assert (rows[1].n_errors, rows[1].revision, rows[1].n_masks, rows[2].n_errors) == (len(bad), 1, 0, 0)
    assert rows[1].document == rows[2].document and rows[1].last_error
    too_many = mask("m", ("a", "add"))
    too_many["components"][0] |= {"kind": "brush", "strokes": [{"points": [0] * 20_000}] * 4}
    with pytest.raises(edits.Invalid):
        edits.command_patches(edits.empty_document(), {"kind": "insert-mask", "value": too_many})


def test_history():
    s = edits.Session()
    assert s.step({"kind": "insert-mask", "value": mask("m", ("a", "add"))})
    assert s.step({"kind": "undo"}) and s.document["masks"] == [] and s.step({"kind": "redo"}) and not s.step({"kind": "redo"}) and len(s.document["masks"]) == 1
    assert s.step({"kind": "edit-metadata", "value": {"rating": 4}}) and not s.step({"kind": "edit-metadata", "value": {"rating": 4}})
    assert s.step({"kind": "undo"}) and s.metadata["rating"] == 0
    n = len(s.undo)
    for k in range(5):
        s.step({"kind": "replace-global", "plugin": "basic", "value": {"exposure": k}, "group": 1})
    assert len(s.undo) == n + 1 and s.step({"kind": "undo"}) and s.document["global"]["basic"] == {}
    for k in range(150):
        s.step({"kind": "replace-global", "plugin": "crop", "value": {"x": k}})
    assert len(s.undo) == edits.HISTORY
    s.step({"kind": "edit-metadata", "value": {"rating": 2}})
    fresh = edits.empty_document()
    assert not s.step({"kind": "hydrate", "value": fresh})  # unsaved edits
    assert not s.step({"kind": "mark-persisted", "value": s.revision + 1}) and s.step({"kind": "mark-persisted", "value": s.revision}) and not s.step({"kind": "mark-persisted", "value": 3})
    assert s.step({"kind": "hydrate", "value": fresh}) and s.document == fresh and [x["of"] for x in s.undo] == ["metadata"]


def test_export_names_are_unique(spark):
    jobs = [(k, b, s, "jpg") for k, (b, s) in enumerate([("a", None), ("a", ""), ("a-2", None), ("a", None), ("b", "-2"), ("b", None), ("b", None), ("c", None)])] + [(100 + k, "a", None, "png") for k in range(2)]
    df = spark.createDataFrame(jobs, "job long, base string, suffix string, extension string")
    there = spark.createDataFrame([("c.jpg",), ("c-2.jpg",), ("noext",)], "name string")
    taken, want = {"c.jpg", "c-2.jpg", "noext"}, {}
    for job, b, s, e in jobs:
        name = b + (s or "")
        free = next(x for k in range(1, 1000) if (x := f"{name}.{e}" if k == 1 else f"{name}-{k}.{e}") not in taken)
        taken.add(free)
        want[job] = free
    assert {r.job: r.output_name for r in exports.export_names(df, there).collect()} == want
    many = spark.range(1005).select(F.col("id").alias("job"), F.lit("x").alias("base"), F.lit(None).cast("string").alias("suffix"), F.lit("jpg").alias("extension"))
    names = [r.output_name for r in exports.export_names(many).collect()]
    assert names.count(None) == 6 and len(set(names)) == 1000


def test_geometry_invariants(spark):
    cases = [(x, y, w, h, a) for x in (-0.5, 0.2, 0.9) for y in (0.0, 0.7) for w in (0.01, 0.4, 2.0) for h in (0.3, 1.0) for a in (-40.0, 0.0, 12.0)]
    df = spark.createDataFrame(cases, "x double, y double, w double, h double, a double")
    r = geometry.Rect(*(F.col(c) for c in "xywh"))
    for fit in (geometry.clamp_crop(r), geometry.fit_ratio(r, F.lit(1.6))):
        for q in df.select(fit.x.alias("x"), fit.y.alias("y"), fit.width.alias("w"), fit.height.alias("h")).collect():
            assert q.w >= 0.05 - 1e-9 and q.h >= 0.05 - 1e-9 and q.x >= -1e-9 and q.x + q.w <= 1 + 1e-6 and q.y + q.h <= 1 + 1e-6
    assert one(spark, geometry.ratio_from_text(F.lit("4"), F.lit("3")))[0] == pytest.approx(4 / 3)
    assert one(spark, geometry.ratio_from_text(F.lit("0"), F.lit("4")), geometry.ratio_from_text(F.lit("4"), F.lit("nope")))[:] == (None, None)
    assert one(spark, *geometry.oriented_size(F.lit(6000), F.lit(4000), F.lit(5)))[:] == (4000, 6000)


def test_curves(spark):
    bad = F.array(curves.point(float("nan"), 0.2), curves.point(0.5, 0.5))
    row = one(spark, curves.normalize(bad), curves.sample(curves.identity(), F.lit(0.3)), curves.from_sliders(F.lit(10.0), F.lit(None).cast("double"), F.lit(-500.0)))
    assert [tuple(p) for p in row[0]] == [(0.0, 0.0), (1.0, 1.0)] and row[1] == pytest.approx(0.3)
    assert [round(p.y * 255) for p in row[2]] == [0, 74, 128, 0, 255]


def test_bilinear_and_halo(spark):
    img = spark.createDataFrame([(1, [float(v) for v in (0, 3, 6, 9, 12, 15, 18, 21)])], "image_id long, r array<double>").selectExpr("image_id", "r", "r as g", "r as b")
    got = {(p.x, p.y): p.r for p in rasters.bilinear(img, 4, 2, 2, 1).collect()}
    assert got == {(0, 0): 7.5, (1, 0): 13.5}
    tiles = [(1, tx, ty, 2, 2, [10.0 * (2 * ty + y) + 2 * tx + x for y in range(2) for x in range(2)]) for tx in range(2) for ty in range(2)]
    wide = rasters.with_halo(spark.createDataFrame(tiles, "image_id long, tx int, ty int, w int, h int, plane array<double>"), 1).where("tx = 0 and ty = 0").first()
    assert (wide.w, wide.h) == (4, 4)
    assert [int(v) for v in wide.plane] == [0, 0, 1, 1, 0, 0, 1, 2, 10, 10, 11, 12, 10, 20, 21, 22]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00.0", 1, 1.0), (1, "2024-01-01 00:00:00.2", 2, 2.0), (1, "2024-01-01 00:00:01.0", 3, 3.0), (2, "2024-01-01 05:00:00.0", 4, 4.0)]
    log = spark.createDataFrame(rows, "user long, ts string, event_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    log.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    stream.write_each(stream.debounced(src, "user", 300, "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.user, r.n, r.value) for r in got.collect()) == [(1, 1, 3.0), (1, 2, 2.0)]
    batch = stream.debounced(log, "user", 300)
    assert batch.count() == 3 and stream.windowed_counts(log, "user", "1 hour").count() == 2
    gens = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k int, generation int, v string")
    assert {r.v for r in stream.current_results(gens, "k").collect()} == {"new", "x"}


def test_grain_is_centred(spark, sf_dir):
    a, b = (registry.queries()[n](spark, sf_dir).agg(F.avg("r")).first()[0] for n in ("grain", "overlay"))
    assert math.isfinite(a) and math.isfinite(b)


def test_brush_strokes(spark):
    strokes = [(1, 0, 2.0, 0.5, 0.6, [(0.0, 0.2), (0.9, 0.7)]), (1, 1, 1.5, 0.0, 0.5, [(0.5, 0.5)]), (2, 0, 1.0, 1.0, 0.0, [(0.1, 0.1)])]
    w, h = 10, 8
    want = {}
    for _, _, r, feather, alpha, pts in strokes[:2]:
        p = [(x * (w - 1), y * (h - 1)) for x, y in pts]
        stamps = [p[0]]
        for (ax, ay), (bx, by) in zip(p, p[1:], strict=False):
            n = max(1, math.ceil(math.hypot(bx - ax, by - ay) / max(1, r * 0.5)))
            stamps += [(ax + (bx - ax) * k / n, ay + (by - ay) * k / n) for k in range(1, n + 1)]
        for cx, cy in stamps:
            for x in range(max(0, math.floor(cx - r)), min(w - 1, math.ceil(cx + r)) + 1):
                for y in range(max(0, math.floor(cy - r)), min(h - 1, math.ceil(cy + r)) + 1):
                    d, inner = math.hypot(x - cx, y - cy), r * (1 - feather)
                    t = 1.0 if r == inner else max(0, min(1, (d - inner) / (r - inner)))
                    v = math.floor((1 if d <= inner else 1 - t * t * (3 - 2 * t)) * alpha * 255 + 0.5)
                    if v:
                        want[x, y] = min(255, v + math.floor(want.get((x, y), 0) * (255 - v) / 255 + 0.5))
    df = spark.createDataFrame(strokes, "mask_id int, stroke int, radius double, feather double, alpha double, points array<struct<x:double,y:double>>")
    got = {(p.x, p.y): p.coverage for p in rasters.brush_coverage(df, w, h).collect()}
    assert got == want


def test_restore_selection(spark):
    from silverframe.operators import ordered

    rows = spark.createDataFrame([(5, 1), (6, 0), (7, 2)], "id long, pos long")
    old = spark.createDataFrame([(7, 0), (9, 1), (5, 2)], "id long, ord long")
    assert sorted(tuple(r) for r in ordered.restore_selection(rows, old).collect()) == [(5, 2), (7, 0)]
    assert [tuple(r) for r in ordered.restore_selection(rows, old.where("id = 9")).collect()] == [(6, 0)]


def test_crop_handles(spark):
    """Handles keep crops in the image and above the least size, and locked ratios as far as they fit."""
    steps = [-2.0, -0.3, -0.02, 0.0, 0.02, 0.3, 2.0]
    rows = [(h, dx, dy, a) for h in ("move", "n", "ne", "e", "se", "s", "sw", "w", "nw") for dx in steps for dy in steps for a in (None, 0.5, 1.0, 1.5, float("nan"))]
    df = spark.createDataFrame(rows, "handle string, dx double, dy double, a double")
    r = geometry.drag_crop(geometry.Rect(*map(F.lit, (0.2, 0.3, 0.4, 0.3))), *(F.col(c) for c in ("handle", "dx", "dy", "a")))
    for row in df.select("*", r.x.alias("x"), r.y.alias("y"), r.width.alias("w"), r.height.alias("h")).collect():
        assert min(row.x, row.y) >= -1e-9 and max(row.x + row.w, row.y + row.h) <= 1 + 1e-9 and min(row.w, row.h) >= 0.05 - 1e-9
        if row.handle == "move":
            assert (row.w, row.h) == (0.4, 0.3)
        elif row.a and row.a == row.a:
            assert row.w / row.h == pytest.approx(row.a)
        else:
            assert row.handle.strip("we") or (row.y, row.h) == (0.3, 0.3)


def test_presets(spark):
    ratio = lambda p, w, h: geometry.preset_ratio(F.lit(p), F.lit(w), F.lit(h), F.lit(0.0), F.lit(4.0))
    row = one(spark, *(ratio(*v).alias(str(i)) for i, v in enumerate([("original", 30.0, 20.0), ("1:1", 30.0, 20.0), ("free", 30.0, 20.0), ("custom", 30.0, 20.0), ("3:2", 0.0, 20.0)])))
    assert list(row) == [1.0, pytest.approx(2 / 3), None, None, None]


def test_rating_filter():
    assert [library.rating_of(c) for c in ("rating-3", "rating-6", "all", "picked")] == [3, 0, 0, 0]
    assert [library.toggled_rating(*v) for v in (("all", 2), ("rating-2", 2), ("rating-2", 3), ("rating-2", 0), ("picked", 0))] == ["rating-2", "all", "rating-3", "all", "picked"]


PARTS = "array<struct<id:string,components:array<struct<id:string,kind:string,asset:string,strokes:array<struct<points:array<int>>>>>>>"


def test_documents(spark):
    brush = ("c", "brush", None, [([1, 2, 3],), (None,)])
    rows = [
        (1, [("m", [("c", "ai", "a", None)])], {"a": "x"}),
        (2, None, None),
        (3, [("m", [brush, ("m", "ai", "a", None), ("d", "ai", None, [])])], {"b": "y"}),
        (4, [], {}),
    ]
    df = spark.createDataFrame(rows, f"id int, masks {PARTS}, assets map<string,string>")
    found = {tuple(r) for r in documents.violations(df, max_strokes=1, max_points=2).collect()}
    assert found == {(3, "repeated id", "m"), (3, "missing asset", "a"), (3, "missing asset", None), (3, "unused asset", "b"), (3, "too many strokes", None), (3, "too many points", None)}
    assert {r.id for r in documents.violations(df, max_bytes=20).where("rule = 'too large'").collect()} == {1, 3, 4} - {r for r in (4,) if len('{"masks":[],"assets":{}}') <= 20}
    assert {tuple(r) for r in documents.totals(df).collect()} == {(1, 1, 1, 0, 0, 1), (2, 0, 0, 0, 0, 0), (3, 1, 3, 2, 3, 1), (4, 0, 0, 0, 0, 0)}
    assert [r.plain for r in df.orderBy("id").select(documents.is_default_masking().alias("plain")).collect()] == [False, True, False, True]
    assert documents.violations(df.limit(0)).count() == 0


def test_name_parts(spark):
    names = ["a/b", "..", "", None, " . ", "CON", "x" * 300, "a:b. "]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(sc.name_part(F.col("n"), windows=True).alias("v"), sc.strip_known_extension(F.col("n")).alias("s")).collect()
    assert [r.v.value for r in rows] == [None, None, None, None, None, "_CON", "x" * 240, "a_b"]
    assert [r.v.error for r in rows] == ["invalid path"] * 4 + ["empty", None, None, None]


def test_straighten_without_lines(spark):
    """A flat image and one too small for a scored line turn by 0."""
    px = spark.createDataFrame([(1, x, y, 7) for x in range(8) for y in range(8)] + [(2, 0, 0, 1)], "image_id int, x int, y int, level long")
    assert {tuple(r) for r in rasters.straighten_angle(px, 8, 8).collect()} == {(1, 0.0), (2, 0.0)}


def test_sidecar_numbers_and_properties():
    assert [settings.to_fixed(x, 2) for x in (1.005, -1.005, 0.125, -0.125, -0.001, 1.115)] == ["1.00", "-1.00", "0.13", "-0.13", "-0.00", "1.11"]
    assert [settings.whole(x) for x in (2.5, -2.5, 0.49999999999999994, -0.4)] == ["3", "-2", "0", "0"]
    assert [settings.number(t) for t in ("", " 5 ", "+1.5e2", "0x1F", ".5", "5.", "1_0", "inf", "nan", "1e999", "two", None)] == [0, 5, 150, 31, 0.5, 5, None, None, None, None, None, None]
    assert settings.from_properties({}, {}) == settings.DEFAULTS
    read = settings.from_properties({"CropLeft": "0.5", "CropRight": "0.51", "Temperature": "6000", "ToneCurvePV2012Red": "0,0;128,64;128,70;300,300;x,1"}, {"ToneCurvePV2012": ["0, 10"], "Tint": ["4"]})
    assert (read["crop"]["enabled"], read["crop"]["width"], read["basic"]["temperature"], read["basic"]["tint"]) == (True, 0.05, 500, 0)
    assert read["curve"]["rgb"] == settings.LINE and [round(p["y"] * 255) for p in read["curve"]["red"]] == [0, 70, 255]


def test_sidecar_texts_keep_foreign_content():
    # another prefix for our namespace, our prefix for another one
    text = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="{sidecars.RDF}" xmlns:xmp="urn:other"><rdf:Description xmlns:q="{sidecars.XMP}" q:Rating="2" xmp:own="1"><!--c--><![CDATA[d]]></rdf:Description></rdf:RDF></x:xmpmeta>'
    new, error = sidecars.write(text, {"Tint": "3", "ToneCurvePV2012": ["0, 0", "255, 255"]}, 4, "red", "QUJD")
    assert error is None and 'xmp:own="1"' in new and 'q:Rating="4"' in new and "<!--c-->" in new and "<![CDATA[d]]>" in new
    said = sidecars.read(new)
    assert (said["texts"], said["lists"], said["xmp"], said["masks"]) == ({"Tint": "3"}, {"ToneCurvePV2012": ["0, 0", "255, 255"]}, {"Rating": "4", "Label": "red"}, "QUJD")
    again, _ = sidecars.write(new, {"Tint": "5", "ToneCurvePV2012": ["0, 0"]}, 0, None, None)
    assert again.count("ToneCurvePV2012") == 2 and "Label" not in again and sidecars.read(again)["lists"] == {"ToneCurvePV2012": ["0, 0"]}
    assert sidecars.write("<a", {}, 0, None, None)[1] and sidecars.write("<a/>", {}, 0, None, None)[1] == "no description"
    assert sidecars.read("x" * (sidecars.MAX_BYTES + 1))["error"] == "too large"


def test_sidecars_of_untouched_images_masks_and_files(spark, tmp_path):
    none, masks = "CAST(NULL AS STRING)", '{"masks":[{"id":"m"}]}'
    rows = spark.createDataFrame([(1, None, 0, None, None), (2, None, 3, None, None), (3, masks, 0, None, None), (4, None, 0, "blue", None), (5, None, 0, None, "<broken")], "id int, masking string, rating int, color_label string, existing string")
    made = sidecar_ops.sidecar_contents(rows.selectExpr("*", f"{none} AS assets").withColumn("settings", settings.defaults()))
    got = {r.id: r for r in made.collect()}
    assert got[1].contents is None and got[1].error is None and got[5].contents is None and got[5].error
    records = {r.id: r for r in sidecar_ops.sidecar_records(made.where("contents IS NOT NULL").selectExpr("id", "contents AS text")).collect()}
    assert sorted(records) == [2, 3, 4] and records[3].masking == masks and records[2].rating == 3 and records[4].color_label == "blue"
    bad = spark.createDataFrame([("a", "###"), ("b", "W10="), ("c", "eyJ2ZXJzaW9uIjoyfQ=="), ("d", "gICA")], "id string, p string")
    assert [r.e for r in bad.select("id", sidecar_ops.mask_texts(F.col("p"))["error"].alias("e")).orderBy("id").collect()] == ["not base 64", "no object", "incomplete", "no object"]
    files = spark.createDataFrame([("a/x.xmp", "one"), ("y.xmp", "two"), ("z.xmp", None)], "path string, contents string")
    assert sorted(tuple(r) for r in sidecar_ops.write_files(files, str(tmp_path)).collect()) == [("a/x.xmp", 3, None), ("y.xmp", 3, None)]
    assert (tmp_path / "a/x.xmp").read_text() == "one" and not list(tmp_path.rglob("*.part"))


def test_curves_without_points_are_straight():
    assert settings.from_properties({"ToneCurvePV2012": "x;y"}, {})["curve"]["rgb"] == settings.LINE
    assert settings.curve_points([]) == settings.LINE


def test_documents_of_any_json(spark):
    texts = [None, "", "nul", "5", "null", '{"version":NaN}', '{"settings":{}}', "{}", '{"basic":[]}', '{"curve":{"rgb":[]}}', "[" * 20_000, '{"mixer":{"red":null}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: [tuple(p) for p in r.problems] for r in document_rules.parsed_documents(rows).collect()}
    json_, object_ = [("", "json")], [("", "object")]
    assert got == {0: json_, 1: json_, 2: json_, 3: object_, 4: object_, 5: json_, 6: [("version", "number")], 7: [], 8: [("settings.basic", "object")], 9: [], 10: json_, 11: [("settings.mixer.red", "object")]}
    assert document_rules.parsed_documents(rows.limit(0)).count() == 0


def test_row_packing_beside_a_column_of_that_name(spark):
    tiles = spark.createDataFrame([(1, 0, "a", 1.0, "x"), (1, 1, "b", 5.0, "y")], "key int, pos int, id string, aspect double, row string")
    assert [r.row for r in ordered.dynamic_rows(tiles, "key", 300, 100, 4).orderBy("pos").collect()] == [0, 1]
