"""Rendering over tiles against whole images."""

import numpy as np
from pyspark.sql import functions as F

from silverframe.functions.geometry import Rect, output_to_source
from silverframe.operators import tiles

TILE = "image_id long, tx int, ty int, w int, h int, r array<double>, g array<double>, b array<double>"
JOB = f"image_id long, width int, height int, orientation int, out_w int, out_h int, crop {tiles.CROP}"


def split(i, planes, edge):
    h, w = planes[0].shape
    for ty in range(0, h, edge):
        for tx in range(0, w, edge):
            part = [p[ty : ty + edge, tx : tx + edge] for p in planes]
            yield (i, tx // edge, ty // edge, part[0].shape[1], part[0].shape[0], *(p.ravel().tolist() for p in part))


def whole(job, planes):
    """The image drawn at once, from all of its pixels."""
    y, x = np.mgrid[: job["out_h"], : job["out_w"]]
    return tiles.sample(planes, *tiles.source_places(x, y, job), 0, 0, job["width"], job["height"])


def test_tiles_equal_whole_images(spark):
    rng = np.random.default_rng(5)
    crop = ("x", "y", "width", "height", "angle", "perspective_x", "perspective_y", "distortion")
    jobs, parts, want = [], [], {}
    for i in range(16):
        h, w = (int(v) for v in rng.integers(1, 60, 2))
        c = None if i % 4 == 3 else dict(zip(crop, (0.1, 0.2, 0.7, 0.6, *rng.uniform(-45, 45, 1).tolist(), *rng.uniform(-100, 100, 3).tolist()), strict=True))
        job = {"image_id": i, "width": w, "height": h, "orientation": i % 8 + 1, "out_w": int(rng.integers(1, 50)), "out_h": int(rng.integers(1, 50)), "crop": c}
        planes = [rng.uniform(0, 1, (h, w)) for _ in "rgb"]
        jobs.append(tuple(job.values()))
        parts += split(i, planes, 7)
        want[i] = whole(job, planes)
    src, ask = spark.createDataFrame(parts, TILE), spark.createDataFrame(jobs, JOB)
    got = tiles.joined_rows(tiles.render(src, ask, 7, 6, 20)).orderBy("image_id", "y").collect()
    assert len(got) == sum(j[5] for j in jobs)
    for r in got:
        for k, p in enumerate("rgb"):
            np.testing.assert_allclose(r[p], want[r.image_id][k][r.y], atol=1e-12)


def test_places_equal_the_column_transform(spark):
    rows = [(o, a, u, v) for o in range(1, 9) for a in (-30.0, 0.0, 12.5) for u in range(5) for v in range(4)]
    c = F.col
    box = Rect(*(F.lit(v) for v in (0.1, 0.2, 0.7, 0.6)))
    w, h = (F.when(c("o") >= 5, b).otherwise(a) for a, b in ((40, 30), (30, 40)))
    x, y = output_to_source((c("u") + 0.5) / 5, 1 - (c("v") + 0.5) / 4, box, c("a"), w, h, F.lit(20.0), F.lit(-35.0), F.lit(50.0), c("o"))
    for r in spark.createDataFrame(rows, "o int, a double, u int, v int").select("*", x.alias("x"), y.alias("y")).collect():
        crop = {"x": 0.1, "y": 0.2, "width": 0.7, "height": 0.6, "angle": r.a, "perspective_x": 20.0, "perspective_y": -35.0, "distortion": 50.0}
        got = tiles.source_places(np.array(r.u), np.array(r.v), {"width": 40, "height": 30, "orientation": r.o, "out_w": 5, "out_h": 4, "crop": crop})
        np.testing.assert_allclose([(g + 0.5) / n for g, n in zip(got, (40, 30), strict=True)], [r.x, r.y], atol=1e-12)


def test_plain_downscale_and_odd_input(spark):
    a = np.arange(24.0).reshape(2, 4, 3)
    src = spark.createDataFrame([*split(1, [a[..., k] for k in range(3)], 3), (2, 0, 0, 2, 1, None, None, None), (9, 0, 0, 1, 1, [1.0], [1.0], [1.0])], TILE)
    images = spark.createDataFrame([(1, 4, 2, None), (2, 2, 1, 6), (3, 0, 5, 1)], "image_id long, width int, height int, orientation int")
    jobs = tiles.fit_edge(images, 2).withColumn("crop", F.lit(None).cast(tiles.CROP))
    got = {(r.image_id, r.y): [[int(v + 0.5) for v in r[p]] for p in "rgb"] for r in tiles.joined_rows(tiles.render(src, jobs, 3, 1)).collect()}
    assert got == {(1, 0): [[8, 14], [9, 15], [10, 16]], (2, 0): [[0]] * 3, (2, 1): [[0]] * 3}  # no size, no tile; null tiles are zeros
    assert tiles.render(src.limit(0), jobs.limit(0)).count() == 0
    partly = jobs.where("image_id = 1").withColumn("crop", F.struct(F.lit(0.5).alias("x"), *(F.lit(None).cast("double").alias(k) for k in ("y", "width", "height", "angle", "perspective_x", "perspective_y", "distortion"))))
    assert tiles.render(src, partly, 3).select(F.size("r")).first()[0] == 2
