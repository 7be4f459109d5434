"""Suppression, tile and nearest-face operators against plain loops, including a hot image."""

import random

import pytest

from kinframe.operators import detect as dt

SCHEMA = "image_id long, det_seq int, det_score double, x1 double, y1 double, x2 double, y2 double"


def boxes(seed, images, hot):
    rnd = random.Random(seed)
    rows = []
    for img in range(images):
        for k in range(hot if img == 0 else rnd.randint(1, 12)):
            x, y, w, h = rnd.randint(0, 150), rnd.randint(0, 150), rnd.randint(10, 60), rnd.randint(10, 60)
            rows.append((img, k, rnd.randint(0, 40) / 40, float(x), float(y), float(x + w), float(y + h)))
        if img == 0:
            rows += [(0, 1000 + k, 0.5, 10.0, 10.0, 50.0, 50.0) for k in range(20)]
    return rows


def iou(a, b, pixel):
    w = max(0.0, min(a[5], b[5]) - max(a[3], b[3]) + pixel)
    h = max(0.0, min(a[6], b[6]) - max(a[4], b[4]) + pixel)
    area = lambda r: (r[5] - r[3] + pixel) * (r[6] - r[4] + pixel)
    return w * h / (area(a) + area(b) - w * h)


def greedy(rows, limit, pixel):
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if all(k[0] != r[0] or iou(k, r, pixel) <= limit for k in kept):
            kept.append(r)
    return {(k[0], k[1]) for k in kept}


@pytest.mark.parametrize("image_rows", [4096, 25])
@pytest.mark.parametrize("preset", ["cross_source", "detector"])
def test_nms(spark, preset, image_rows):
    rows = boxes(11, 12, 90)
    got = dt.nms(spark.createDataFrame(rows, SCHEMA), preset, image_rows=image_rows).collect()
    assert {(r["image_id"], r["det_seq"]) for r in got} == greedy(rows, *dt.NMS_PRESETS[preset])


def test_nearest(spark):
    rnd = random.Random(5)
    refs = [(i % 3, i, rnd.uniform(0, 300), rnd.uniform(0, 300), rnd.uniform(5, 90)) for i in range(60)]
    dets = [(i % 3, i, rnd.uniform(0, 300), rnd.uniform(0, 300)) for i in range(80)]
    got = {
        r["det_id"]: r["ref_id"]
        for r in dt.nearest_detection(
            spark.createDataFrame(refs, "image_id long, ref_id long, cx double, cy double, side double"),
            spark.createDataFrame(dets, "image_id long, det_id long, cx double, cy double"),
        ).collect()
    }
    want = {}
    for img, d, x, y in dets:
        dist, ref, side = min((((x - r[2]) ** 2 + (y - r[3]) ** 2) ** 0.5, r[1], r[4]) for r in refs if r[0] == img)
        if dist <= max(12, 0.4 * side):
            want[d] = ref
    assert got == want
