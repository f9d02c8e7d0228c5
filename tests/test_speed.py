"""Kernels over photographs do no more work than their pixels ask for, and give what plain versions of them give."""

import time

import numpy as np
import pytest

from daftar.config import DEFAULT
from daftar.sources import scenes as Z
from daftar.vision import kernels as K
from daftar.vision import preprocess as P


def _seconds(f, n=4):
    took = []
    for _ in range(n):
        began = time.thread_time()
        f()
        took.append(time.thread_time() - began)
    return min(took)


@pytest.fixture(scope="module")
def unit():
    """Seconds in which this machine draws a photograph's noise."""
    return _seconds(lambda: np.random.default_rng(0).normal(0, 2, (1000, 1500)))


def test_a_photograph_is_drawn_and_straightened_quickly(unit):
    """It took some thirty times as long as its noise."""
    card = Z.card("1375/05/12", "1455/05/01")
    assert _seconds(lambda: P.fit_card(P.lift(Z.photograph(card, 1), DEFAULT), DEFAULT)) < 12 * unit


def _plain_warp(image, matrix, width, height):
    x, y = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    w, u, v = (b[0] * x + b[1] * y + b[2] for b in np.linalg.inv(matrix)[[2, 0, 1]])
    u, v, out = u / w, v / w, np.zeros((height, width))
    across, down = np.floor(u).astype(int), np.floor(v).astype(int)
    for j in range(-1, 3):
        for i in range(-1, 3):
            level = image[np.clip(down + j, 0, image.shape[0] - 1), np.clip(across + i, 0, image.shape[1] - 1)]
            out += K._cubic(np.abs(u - across - i)) * K._cubic(np.abs(v - down - j)) * level
    return K.saturate(out)


@pytest.mark.parametrize("seed", range(6))
def test_warp_skips_flat_tiles_and_changes_no_level(seed):
    rng = np.random.default_rng(seed)
    image = np.full((130, 170), 235, np.uint8)
    if seed % 2:
        image[:, 90:] = 40
    image[50:70, 60:100] = rng.integers(0, 256, (20, 40))
    square = np.array([[0, 0], [169, 0], [169, 129], [0, 129]], float)
    matrix = K.perspective(square, square * 1.2 + rng.uniform(-25, 25, (4, 2)))
    assert np.array_equal(K.warp(image, matrix, 220, 180), _plain_warp(image, matrix, 220, 180))


def test_components_of_noise_equal_a_plain_search():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        mask = rng.random((23, 31)) < share
        for diagonal in (True, False):
            label, n = K.components(mask, diagonal)
            seen, want = np.zeros(mask.shape, int), 0
            for y, x in np.argwhere(mask):
                if not seen[y, x]:
                    want, stack = want + 1, [(y, x)]
                    while stack:
                        a, b = stack.pop()
                        if 0 <= a < 23 and 0 <= b < 31 and mask[a, b] and not seen[a, b]:
                            seen[a, b] = want
                            stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not i or not j]
            assert n == want and np.array_equal(label, seen)
            assert K.runs(mask, diagonal).boxes().tolist() == K.component_boxes(label, n).tolist()


def test_small_blurs_in_whole_numbers_equal_the_convolution():
    image = np.random.default_rng(2).integers(0, 256, (75, 140)).astype(np.uint8)
    for size in (3, 5, 7):
        assert np.array_equal(K.blur(image, size), K.saturate(K.convolve(image, K.gaussian_kernel(size))))


def test_lines_of_a_card_are_found_quickly(unit):
    card = np.clip(np.random.default_rng(3).normal(235, 4, (756, 1200)), 0, 255).astype(np.uint8)
    assert _seconds(lambda: P.line_blobs(card, DEFAULT)) < 2.2 * unit


def test_ink_against_a_local_mean_equals_the_definition():
    rng = np.random.default_rng(4)
    for shape in ((90, 130), (64, 64), (20, 40)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        pad, kernel = np.pad(image.astype(float), 15, mode="reflect"), K.gaussian_kernel(31)
        local = sum(w * pad[i : i + shape[0]] for i, w in enumerate(kernel))
        local = np.rint(sum(w * local[:, i : i + shape[1]] for i, w in enumerate(kernel)))
        assert np.array_equal(K.adaptive_ink(image, 31, 12.0), image <= local - 12)
