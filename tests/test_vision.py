"""Kernels and shape rules on small drawn images."""

import numpy as np
import pytest

from daftar import queries as Q
from daftar.config import DEFAULT
from daftar.sources import scenes as Z
from daftar.sources.images import png, read_images
from daftar.vision import kernels as K
from daftar.vision import network as N
from daftar.vision import preprocess as P
from daftar.vision import shapes as S


def draw(*rows):
    return np.array([[0 if c == "#" else 255 for c in r] for r in rows], np.uint8)


RING = draw("        ", " ###### ", " #    # ", " #    # ", " ###### ", "        ")


def test_holes():
    assert len(S.holes(RING, DEFAULT)) == 1
    speck = RING.copy()
    speck[2:4, 2:6] = 0
    speck[2, 3] = 255
    assert len(S.holes(speck, DEFAULT)) == 0 and S.holes_by_threshold(speck) == 1
    assert S.holes(np.full((6, 6), 255, np.uint8), DEFAULT) == [] and S.holes(np.zeros((6, 6), np.uint8), DEFAULT) == []


def test_equal_variances_give_the_lowest_threshold():
    """Two thresholds whose variances are the same number, but for the last bits of their floats."""
    px = [131, 98, 110, 110, 160, 110, 135, 108, 119, 103, 122, 142, 140, 127, 90, 79, 119, 127, 139, 96, 147, 142, 75, 156, 154, 129, 102, 114, 131, 145, 129, 109,
          211, 125, 141, 134, 129, 113, 159, 134, 123, 154, 141, 109, 134, 192, 121, 176, 105, 146, 114, 159, 200, 145, 72, 161, 175, 192, 74, 153, 167, 135, 158, 34]
    assert K.otsu(np.array(px, np.uint8).reshape(8, 8)) == 129


def test_holes_where_variances_are_equal():
    px = [197, 181, 98, 101, 110, 105, 125, 60, 87, 109, 121, 169, 124, 97, 132, 149, 143, 163, 89, 134, 72, 198, 114, 106, 143, 125, 88, 90, 146, 129, 152, 103,
          65, 131, 93, 117, 85, 103, 127, 151, 99, 133, 185, 154, 141, 146, 116, 127, 101, 116, 136, 139, 107, 124, 152, 105, 164, 169, 153, 86, 168, 85, 74, 156]
    image = np.array(px, np.uint8).reshape(8, 8)
    assert K.otsu(image) == 121 and S.holes_by_threshold(image) == 1


def test_kernels_get_few_images_at_once(spark, tmp_path):
    """An Arrow batch holds thousands of rows; the lines made of them would fill a worker's memory."""
    rows = [(i, 0, [(i % 7 - 3) / 8] * 64) for i in range(1000)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = Q._kernel(spark, str(tmp_path), lambda px: ([len(px)] * len(px), px[:, 0, 0].tolist()), "n int, v int").collect()
    assert sorted((r.vec_id, r.v) for r in found) == [(i, 128 + int(255 * (i % 7 - 3) / 8 // 1)) for i in range(1000)]
    assert max(r.n for r in found) <= 256


def test_topology():
    assert S.topology_reasons(RING, "0", DEFAULT) == []
    assert S.topology_reasons(RING, "8", DEFAULT) == ["8-holes-1"]
    bar = np.full((10, 10), 255, np.uint8)
    bar[:, 4:6] = 0
    assert S.topology_reasons(bar, "1", DEFAULT) == ["1-aspect-1.00"] and S.topology_reasons(bar[:, 3:7][:, :4].repeat(2, 0), "1", DEFAULT) == []


def test_strip_gives_ten_runs_and_eight_digits():
    line = Z.strip("1375/05/12", 28)
    assert len(S.column_runs(line, DEFAULT)) >= 10
    boxes = S.digit_boxes(line, DEFAULT)
    assert boxes is None or len(boxes) == 8


def test_polarity_edge():
    assert P.dark_ink(np.full((2, 2), 110, np.uint8), DEFAULT)[0, 0] == 110
    assert P.dark_ink(np.full((2, 2), 109, np.uint8), DEFAULT)[0, 0] == 146


def test_components_and_boxes():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert K.components(m, True)[1] == 4 and K.components(m, False)[1] == 5
    label, n = K.components(m, True)
    assert K.component_boxes(label, n).tolist() == [[0, 0, 2, 2, 2], [3, 0, 1, 2, 2], [0, 3, 2, 1, 2], [3, 3, 1, 1, 1]]


def test_resample_keeps_flat_images_and_means():
    flat = np.full((7, 9), 77, np.uint8)
    for how in ("area", "linear", "cubic", "nearest"):
        assert (K.resize(flat, 4, 3, how) == 77).all()
    assert K.resize(np.array([[0, 100], [100, 200]], np.uint8), 1, 1, "area")[0, 0] == 100


def test_perspective_maps_corners():
    a, b = np.array([[0, 0], [9, 0], [9, 9], [0, 9]], float), np.array([[1, 2], [8, 1], [9, 9], [0, 7]], float)
    h = K.perspective(a, b) @ np.append(a, np.ones((4, 1)), axis=1).T
    assert np.allclose((h[:2] / h[2]).T, b)


def test_card_is_found_and_straightened():
    shot = Z.photograph(Z.card("1375/05/12", "1402/01/01"), 1)
    card, rectified = P.fit_card(shot, DEFAULT)
    assert rectified and card.shape == (756, 1200) and card[:60].mean() > 200


def test_hu_moments_ignore_place():
    big = np.full((20, 20), 255, np.uint8)
    big[3:9, 5:13] = RING
    assert np.allclose(S.hu_moments(RING, DEFAULT), S.hu_moments(big, DEFAULT))
    assert S.hu_moments(np.full((4, 4), 255, np.uint8), DEFAULT).tolist() == [0] * 7


def test_network_round_trip_and_shapes():
    net = N.synthetic()
    again = N.load(N.dump(net))
    x = np.random.default_rng(0).normal(size=(3, 32, 160)).astype(np.float32)
    (a, da), (b, db) = N.probabilities(net, x), N.probabilities(again, x)
    assert a.shape == (3, 80) and np.allclose(a.reshape(3, 8, 10).sum(2), 1) and np.abs(a - b).max() < 0.15 and np.abs(da - db).max() < 0.15
    with pytest.raises(ValueError):
        N.load(N.dump(net)[:-1])


def test_png_is_read_by_spark(spark, tmp_path):
    px = (np.arange(48).reshape(6, 8) * 5).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(px))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = read_images(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and (rows[0].image.w, rows[0].image.h) == (8, 6) and np.frombuffer(rows[0].image.px, np.uint8).tolist() == px.ravel().tolist()


def test_overlap_suppression_is_greedy_in_order(spark):
    from daftar.operators.boxes import suppress_overlaps

    rows = [(1, 1, 0, 0, 100, 20), (1, 2, 10, 0, 100, 20), (1, 3, 20, 0, 100, 20), (2, 1, 0, 0, 100, 20)]
    boxes = spark.createDataFrame(rows, "image_id long, seq long, x int, y int, width int, height int")
    assert sorted((r.image_id, r.seq) for r in suppress_overlaps(boxes).collect()) == [(1, 1), (2, 1)]
