"""What a poor camera does to a line, as Column functions of gray images: arrays of whole levels, row by row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.functions.let import let

SIDE = 8
#: The quantisation table for luminance of the JPEG standard, row by row.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)


def _level(v: Column) -> Column:
    """The nearest level; what sums leave after six places doesn't decide."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(v, 6) + 0.5))).cast("int")


def product(a: Column, b: Column, n: int = SIDE) -> Column:
    """The product of two square matrices, each an array row by row; both are made once, not for each of their uses."""

    def made(p: Column, q: Column) -> Column:
        inner = lambda k: F.aggregate(
            F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda s, i: s + F.get(p, (F.floor(k / n) * n).cast("int") + i) * F.get(q, i * n + k % n)
        )
        return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), inner)

    return let(a, lambda p: let(b, lambda q: made(p, q)))


def cosines(turned: bool = False) -> Column:
    """The matrix of the cosine transform of eight values, or its transpose."""
    at = lambda u, x: math.cos((2 * x + 1) * u * math.pi / (2 * SIDE)) * (math.sqrt(0.5) if u == 0 else 1.0) / 2
    return F.array(*(F.lit(at(x, u) if turned else at(u, x)) for u in range(SIDE) for x in range(SIDE)))


def steps_at(quality: Column) -> Column:
    """Quantisation steps at a quality from 1 to 100."""
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)
    return F.transform(F.array(*map(F.lit, LUMINANCE)), lambda t: F.greatest(F.lit(1), F.least(F.lit(255), F.floor((t * scale + 50) / 100))))


def requantise(block: Column, quality: Column) -> Column:
    """An 8x8 block after its cosine transform was rounded to the steps of a quality, as JPEG does."""
    centred = F.transform(block, lambda v: v.cast("double") - 128)
    kept = lambda c, t: F.floor(F.round(c / t, 6) + 0.5) * t.cast("double")
    coded = let(product(product(cosines(), centred), cosines(True)), lambda c: F.zip_with(c, steps_at(quality), kept))
    back = let(coded, lambda c: product(product(cosines(True), c), cosines()))
    return F.transform(back, lambda v: _level(v + 128))


def glare(px: Column, width: int, cx: Column, cy: Column, radius: Column, gain: Column) -> Column:
    """A bright spot whose light falls off as a bell of half its radius."""

    def lit(v: Column, i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        return _level(v + gain * F.exp(-(F.pow(x - cx, F.lit(2.0)) + F.pow(y - cy, F.lit(2.0))) / (2 * F.pow(radius / 2, F.lit(2.0)))))

    return F.transform(px, lit)


def affine(px: Column, width: int, height: int, m: list[Column], ground: int = 255) -> Column:
    """The image whose pixel (x, y) is that of the given one at (m0 x + m1 y + m2, m3 x + m4 y + m5), mixed of the four around it.

    Outside the image is ground.
    """

    def at(x: Column, y: Column) -> Column:
        inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
        return F.when(inside, F.get(px, (y * width + x).cast("int"))).otherwise(F.lit(ground)).cast("double")

    def mixed(i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        place = F.struct(F.round(m[0] * x + m[1] * y + m[2], 6).alias("x"), F.round(m[3] * x + m[4] * y + m[5], 6).alias("y"))

        def of(p: Column) -> Column:
            x0, y0 = F.floor(p["x"]), F.floor(p["y"])
            a, b = p["x"] - x0, p["y"] - y0
            return _level((1 - b) * ((1 - a) * at(x0, y0) + a * at(x0 + 1, y0)) + b * ((1 - a) * at(x0, y0 + 1) + a * at(x0 + 1, y0 + 1)))

        return let(place, of)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), mixed)
