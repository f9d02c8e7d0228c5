"""Equalisation by tiles and degradations against plain loops; overlapping boxes."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.config import DEFAULT
from daftar.functions import degrade as G
from daftar.operators import boxes as B
from daftar.operators import pixels as P
from daftar.stages import settings
from daftar.vision import shapes as S
from daftar.vision.preprocess import crop_rotate


def _plain_tiles(px, tiles, clip):
    h, w = px.shape
    tw, th = -(-w // tiles[0]), -(-h // tiles[1])
    nx, ny = -(-w // tw), -(-h // th)
    curves = {}
    for ty in range(ny):
        for tx in range(nx):
            part = px[ty * th : ty * th + th, tx * tw : tx * tw + tw]
            n = np.bincount(part.ravel(), minlength=256)
            most = max(1, int(clip * part.size / 256))
            over = int(np.maximum(n - most, 0).sum())
            n = np.minimum(n, most) + over // 256
            rest = over % 256
            for i in range(rest):
                n[i * max(1, 256 // rest)] += 1
            curves[tx, ty] = np.minimum(255, np.floor(np.cumsum(n) * 255 / part.size + 0.5))
    out = np.zeros(px.shape, int)
    for y in range(h):
        for x in range(w):
            fx, fy = x / tw - 0.5, y / th - 0.5
            x0, y0 = math.floor(fx), math.floor(fy)
            total = 0.0
            for dx in (0, 1):
                for dy in (0, 1):
                    share = (fx - x0 if dx else 1 - fx + x0) * (fy - y0 if dy else 1 - fy + y0)
                    total += share * curves[min(max(x0 + dx, 0), nx - 1), min(max(y0 + dy, 0), ny - 1)][px[y, x]]
            out[y, x] = math.floor(round(total, 6) + 0.5)
    return out


@pytest.mark.parametrize("size,tiles,clip", [((24, 16), (4, 2), 3.0), ((21, 17), (4, 4), 40.0), ((9, 5), (1, 1), 1.0)])
def test_tiles_equal_a_plain_loop(spark, size, tiles, clip):
    w, h = size
    rng = np.random.default_rng(w)
    images = {k: rng.normal(m, s, (h, w)).clip(0, 255).astype(int) for k, m, s in (("flat", 120, 4), ("wide", 128, 90), ("one", 7, 0))}
    rows = [(k, x, y, int(px[y, x])) for k, px in images.items() for y in range(h) for x in range(w)]
    got = P.equalise_tiles(spark.createDataFrame(rows, "image_id string, x int, y int, v int"), w, h, tiles, clip).collect()
    assert len(got) == len(rows)
    want = {k: _plain_tiles(px, tiles, clip) for k, px in images.items()}
    assert all(r.v == want[r.image_id][r.y, r.x] for r in got)


def test_blocks_at_qualities(spark):
    rng = np.random.default_rng(3)
    c = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1) / 2 for x in range(8)] for u in range(8)])
    blocks = [rng.integers(0, 256, (8, 8)) for _ in range(12)] + [np.zeros((8, 8), int), np.full((8, 8), 255)]
    rows = [(i, q, b.ravel().tolist()) for i, b in enumerate(blocks) for q in (1, 30, 75, 100)]
    frame = spark.createDataFrame(rows, "i int, q int, px array<int>")
    for r in frame.withColumn("out", G.requantise(F.col("px"), F.col("q"))).collect():
        scale = 5000 // r.q if r.q < 50 else 200 - 2 * r.q
        steps = np.clip((np.array(G.LUMINANCE).reshape(8, 8) * scale + 50) // 100, 1, 255)
        coded = np.floor(np.round(c @ (np.array(r.px).reshape(8, 8) - 128.0) @ c.T / steps, 6) + 0.5) * steps
        want = np.clip(np.floor(np.round(c.T @ coded @ c + 128, 6) + 0.5), 0, 255).astype(int)
        assert r.out == want.ravel().tolist()
        assert r.q < 100 or np.abs(np.array(r.out) - np.array(r.px)).max() <= 3


def test_spots_and_moves(spark):
    px = np.random.default_rng(1).integers(0, 200, (5, 7))
    frame = spark.createDataFrame([(px.ravel().tolist(),)], "px array<int>")
    lit = lambda *a: F.lit(float(a[0]))
    same = [lit(1), lit(0), lit(0), lit(0), lit(1), lit(0)]
    moved = [lit(1), lit(0), lit(2), lit(0), lit(1), lit(-1)]
    r = frame.select(G.affine(F.col("px"), 7, 5, same).alias("same"), G.affine(F.col("px"), 7, 5, moved).alias("moved"), G.glare(F.col("px"), 7, lit(3), lit(2), lit(2), lit(60)).alias("spot")).first()
    assert r.same == px.ravel().tolist()
    want = np.full((5, 7), 255)
    want[1:, :5] = px[:4, 2:]
    assert r.moved == want.ravel().tolist()
    y, x = np.mgrid[0:5, 0:7]
    assert r.spot == np.clip(np.floor(np.round(px + 60 * np.exp(-((x - 3.0) ** 2 + (y - 2.0) ** 2) / 2), 6) + 0.5), 0, 255).astype(int).ravel().tolist()


def test_overlapping_boxes_go_in_order(spark):
    rng = np.random.default_rng(5)
    rows = [(f"i{k}", int(s), *map(int, rng.integers(1, 60, 4)), f"n{s}") for k in range(6) for s in rng.permutation(40)] + [("flat", 1, 5, 5, 0, 0, "a"), ("flat", 2, 5, 5, 0, 0, "b")]
    boxes = spark.createDataFrame(rows, "image_id string, seq int, x int, y int, width int, height int, name string")
    want = []
    for k in {r[0] for r in rows}:
        kept = []
        for r in sorted(r for r in rows if r[0] == k):
            def over(o):
                w = min(r[2] + r[4], o[2] + o[4]) - max(r[2], o[2])
                h = min(r[3] + r[5], o[3] + o[5]) - max(r[3], o[3])
                both = max(w, 0) * max(h, 0)
                union = r[4] * r[5] + o[4] * o[5] - both
                return union > 0 and both / union > 0.6

            if not any(map(over, kept)):
                kept.append(r)
        want += kept
    found = B.suppress_overlaps(boxes)
    assert found.schema == boxes.schema
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert B.suppress_overlaps(boxes.limit(0)).count() == 0


def test_slices_of_sheets():
    """Ink bands, slants, clusters and classes of glyphs."""
    sheet = np.full((30, 60), 255, np.uint8)
    sheet[8:20, 5:9] = 0
    assert S.ink_band(sheet, DEFAULT) == S.ink_band(255 - sheet, DEFAULT) == (8, 20)
    assert S.ink_band(np.full((30, 60), 255, np.uint8), DEFAULT) == (0, 30)
    slash, bar = np.full((12, 12), 255, np.uint8), np.full((12, 12), 255, np.uint8)
    for i in range(12):
        slash[i, 11 - i], bar[i, 5] = 0, 0
    assert S.is_slash(slash, DEFAULT) and not S.is_slash(bar, DEFAULT) and not S.is_slash(np.full((12, 12), 255, np.uint8), DEFAULT)
    # widths 10, so gaps over 5 part; a wide box reaches over a small one
    boxes = [(40, 0, 10, 9), (0, 0, 10, 9), (12, 0, 10, 9), (13, 2, 2, 2), (28, 0, 10, 9), (29, 0, 10, 9)]
    assert S.gap_clusters(boxes) == [[1, 2, 3], [4, 5, 0]] and S.gap_clusters([]) == []
    kinds = [(1, 0.5, 8, 9, False, "hollow"), (0, 0.95, 9, 20, True, "slash"), (0, 0.95, 9, 20, False, "other"), (0, 0.9, 5, 20, True, "narrow"), (1, 0.9, 12, 20, False, "looped"), (2, 0.5, 8, 9, False, "other")]
    assert [S.shape_class(n, ratio, w, h, 10, 20, slanted) for n, ratio, w, h, slanted, _ in kinds] == [k[-1] for k in kinds]


def test_crops_of_turned_images():
    image = np.random.default_rng(2).integers(0, 256, (9, 14)).astype(np.uint8)
    assert np.array_equal(crop_rotate(image, (2, 3, 5, 4), 0), image[3:7, 2:7])
    assert np.array_equal(crop_rotate(image, (0, 0, 99, 99), 90), np.rot90(image, -1))
    assert np.array_equal(crop_rotate(image, (-5, 1, 8, 3), 180), np.rot90(image, 2)[1:4, :3])
    turned = crop_rotate(image, (0, 0, 99, 99), 30)
    assert turned.shape == (15, 17) and turned[0, 0] == 255


def test_curves_meet_pixels_by_tile(spark):
    """A row for each level of each tile isn't shuffled: only the counts are dealt by level."""
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        pixels = spark.createDataFrame([("a", 0, 0, 7)], "image_id string, x int, y int, v int")
        plan = P.equalise_tiles(pixels, 8, 8, (2, 2), 40.0)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)", plan)
    assert sum("v#" in keys for keys in dealt) == 1, dealt
