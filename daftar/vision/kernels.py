"""Image kernels on uint8 arrays (rows, columns), written for clarity on specification level.

Resampling, thresholds and morphology follow their textbook definitions; bit-for-bit
equality with any image library on photographs isn't claimed.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np


def half_up(x: float) -> int:
    return int(np.floor(x + 0.5))


def to_gray(image: np.ndarray) -> np.ndarray:
    """Gray from red, green, blue (a fourth channel is ignored); gray passes through."""
    if image.ndim == 2:
        return image
    return ((image[..., :3].astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(np.uint8)


def saturate(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def _spread(size: int, new: int) -> np.ndarray:
    """Area weights: a row for each new pixel over the old ones."""
    edge = np.arange(new + 1) * (size / new)
    lo, hi = edge[:-1, None], edge[1:, None]
    cell = np.arange(size)[None, :]
    return np.clip(np.minimum(hi, cell + 1) - np.maximum(lo, cell), 0, None) / (size / new)


def _taps(size: int, new: int, kernel, reach: int) -> np.ndarray:
    """Interpolation weights of pixel centres, edges repeated."""
    at = (np.arange(new) + 0.5) * (size / new) - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((new, size))
    for k in range(1 - reach, reach + 1):
        np.add.at(out, (np.arange(new), np.clip(base + k, 0, size - 1)), kernel(np.abs(at - base - k)))
    return out


def _linear(t: np.ndarray) -> np.ndarray:
    return np.clip(1 - t, 0, None)


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return np.where(t <= 1, near, np.where(t < 2, far, 0))


def resize(image: np.ndarray, width: int, height: int, how: str = "linear") -> np.ndarray:
    """Resample to ``width`` x ``height`` by area, linear, cubic or nearest."""
    rows, cols = image.shape
    if how == "nearest":
        return image[np.arange(height) * rows // height][:, np.arange(width) * cols // width]
    if how == "area":
        v, h = _spread(rows, height), _spread(cols, width)
    else:
        kernel, reach = (_linear, 1) if how == "linear" else (_cubic, 2)
        v, h = _taps(rows, height, kernel, reach), _taps(cols, width, kernel, reach)
    return saturate(v @ image.astype(float) @ h.T)


def _mirror(image: np.ndarray, pad: int) -> np.ndarray:
    return np.pad(image, pad, mode="reflect" if min(image.shape) > pad else "edge")


#: Weights of small blurs; their sums are powers of two.
_BINOMIAL = {1: [1], 3: [1, 2, 1], 5: [1, 4, 6, 4, 1], 7: [2, 7, 14, 18, 14, 7, 2]}


def gaussian_kernel(size: int, sigma: float = 0.0) -> np.ndarray:
    """Weights of a blur; small sizes without a sigma are binomial."""
    if sigma <= 0 and size in _BINOMIAL:
        k = np.array(_BINOMIAL[size], float)
    else:
        sigma = sigma if sigma > 0 else 0.3 * ((size - 1) / 2 - 1) + 0.8
        k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return k / k.sum()


#: A level that is averaged or interpolated in single precision errs by far less than this (about 1e-4).
_UNSURE = 2e-3
#: Rows, then columns, that are convolved at once: as a product with a narrow band of weights.
_BAND = 64


def convolve(image: np.ndarray, kernel: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Separable convolution with one symmetric kernel in both directions."""
    r, (rows, cols) = len(kernel) // 2, image.shape
    p = _mirror(image.astype(kind), r)
    if len(kernel) < 16 or min(rows, cols) < _BAND:
        kernel = kernel.astype(kind)
        down = sum(w * p[i : i + rows] for i, w in enumerate(kernel))
        return sum(w * down[:, i : i + cols] for i, w in enumerate(kernel))
    band = np.zeros((_BAND, _BAND + 2 * r), kind)
    for i, w in enumerate(kernel):
        band[np.arange(_BAND), np.arange(_BAND) + i] = w
    out = np.empty((rows, cols), kind)
    for top in range(0, rows, _BAND):
        n = min(_BAND, rows - top)
        down = band[:n, : n + 2 * r] @ p[top : top + n + 2 * r]
        for left in range(0, cols, _BAND):
            m = min(_BAND, cols - left)
            out[top : top + n, left : left + m] = down[:, left : left + m + 2 * r] @ band[:m, : m + 2 * r].T
    return out


def blur(image: np.ndarray, size: int = 0, sigma: float = 0.0) -> np.ndarray:
    size = size or (2 * int(np.ceil(3 * sigma)) + 1)
    if sigma <= 0 and size in _BINOMIAL and image.dtype == np.uint8:
        return _binomial_blur(image, _BINOMIAL[size])
    return saturate(convolve(image, gaussian_kernel(size, sigma)))


def _binomial_blur(image: np.ndarray, weights: list[int]) -> np.ndarray:
    """The same in whole numbers, which hold these sums exactly; halves go to the even level, as in ``saturate``."""
    r, bits, (rows, cols) = len(weights) // 2, 2 * (sum(weights).bit_length() - 1), image.shape
    kind = np.uint16 if bits <= 8 else np.uint32
    padded, out = _mirror(image, r), np.empty(image.shape, np.uint8)
    for top in range(0, rows, _BAND):  # in strips that fit a cache
        p = padded[top : top + _BAND + 2 * r].astype(kind)
        for n, axis in ((len(p) - 2 * r, 0), (cols, 1)):
            at = lambda i, n=n, axis=axis, p=p: p[i : i + n] if axis == 0 else p[:, i : i + n]
            total = at(r) * kind(weights[r])
            for i in range(r):
                both = at(i) + at(2 * r - i)
                total += both if weights[i] == 1 else np.multiply(both, kind(weights[i]), out=both)
            p = total
        if bits:
            odd = p >> bits
            odd &= 1
            odd += kind((1 << bits - 1) - 1)
            p += odd
            p >>= bits
        out[top : top + _BAND] = p
    return out


def adaptive_ink(image: np.ndarray, block: int, offset: float) -> np.ndarray:
    """True where a pixel is darker than its Gaussian neighbourhood by more than ``offset``.

    Levels are averaged in single precision, and once more in double where it matters and that can't tell to which level they round.
    """
    kernel, r = gaussian_kernel(block), block // 2
    local = convolve(image, kernel, np.float32)
    level = np.rint(local)
    out = image <= level - np.float32(offset)
    local -= level
    y, x = np.divmod(_places(np.abs(local) > 0.5 - _UNSURE), image.shape[1])
    other = level[y, x] + np.sign(local[y, x])
    matters = (image[y, x] <= other - offset) != out[y, x]
    y, x = y[matters], x[matters]
    if len(y):
        near = np.lib.stride_tricks.sliding_window_view(_mirror(image, r), (len(kernel), len(kernel)))[y, x].astype(float)
        out[y, x] = image[y, x] <= np.rint(np.einsum("i,nij,j->n", kernel, near, kernel)) - offset
    return out


def otsu(image: np.ndarray) -> int:
    """The threshold that parts the histogram with the most variance between its sides, to six decimals; the lowest of equal ones."""
    h = np.bincount(image.ravel(), minlength=256).astype(float)
    n, s = np.cumsum(h), np.cumsum(h * np.arange(256))
    below, above = n, n[-1] - n
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (s / below - (s[-1] - s) / above) ** 2
    between[~np.isfinite(between)] = -1
    return int(np.argmax(np.floor(between * 1e6 + 0.5)))  # equal variances may differ in their last bits


def _slide(mask: np.ndarray, height: int, width: int, fold, outside: int) -> np.ndarray:
    """Maxima or minima of windows, by folding shifted copies of doubling width."""
    out = mask
    for axis, size in ((0, height), (1, width)):
        before, after = size // 2, size - 1 - size // 2
        pad = [(0, 0), (0, 0)]
        pad[axis] = (before, after)
        p = np.pad(out, pad, constant_values=outside)
        part = lambda x, lo, n, axis=axis: x[lo : lo + n] if axis == 0 else x[:, lo : lo + n]
        n, have = mask.shape[axis], 1
        while 2 * have <= size:
            p = fold(part(p, 0, p.shape[axis] - have), part(p, have, p.shape[axis] - have))
            have *= 2
        out = fold(part(p, 0, n), part(p, size - have, n))
    return out


def dilate(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return _slide(mask, height, width, np.maximum, 0)


def erode(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return _slide(mask, height, width, np.minimum, 255 if mask.dtype != bool else 1)


def close(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    # the second window is turned round, so that even sizes don't shift the image
    return erode(dilate(mask, width, height)[::-1, ::-1], width, height)[::-1, ::-1]


def open_(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return dilate(erode(mask, width, height)[::-1, ::-1], width, height)[::-1, ::-1]


def _places(mask: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a mask with few true values: eight at a time, then those of eights that hold one."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    k = np.flatnonzero(flat[:whole].reshape(-1, 8)[eights])
    return np.concatenate([eights[k >> 3] * 8 + (k & 7), whole + np.flatnonzero(flat[whole:])])


def edges(image: np.ndarray, low: float, high: float) -> np.ndarray:
    """Canny edges: Sobel gradients (sum of absolutes), thinning, hysteresis."""
    p = np.pad(image, 1, mode="edge")
    kind, places = np.int16 if image.dtype == np.uint8 else int, []
    m = np.zeros(p.shape, kind)
    for top in range(0, image.shape[0], 64):  # in strips that fit a cache
        q = p[top : top + 66].astype(kind)
        col, row = q[:-2] + q[2:], q[:, :-2] + q[:, 2:]
        q += q
        col += q[1:-1]
        row += q[:, 1:-1]
        dx, dy = col[:, 2:] - col[:, :-2], row[2:] - row[:-2]
        size = np.abs(dx) + np.abs(dy)
        m[top + 1 : top + 1 + len(size), 1:-1] = size
        r, c = np.divmod(_places(size > low), image.shape[1])  # only these can be edges
        places.append((r + top, c, dx[r, c], dy[r, c]))
    r, c, dx, dy = (np.concatenate(x) for x in zip(*places, strict=True))
    across, down, slope = np.abs(dx), np.abs(dy), math.tan(math.pi / 8)
    step = np.where((dx > 0) == (dy > 0), 1, 3)  # gradients along one diagonal or the other, unless they are nearly level or upright
    step[across < slope * down] = 2
    step[down <= slope * across] = 0
    sy, sx = np.array([0, 1, 1, 1])[step], np.array([1, 1, 0, -1])[step]
    own = m[r + 1, c + 1]
    crest = (own > m[r + 1 - sy, c + 1 - sx]) & (own >= m[r + 1 + sy, c + 1 + sx])
    r, c, own = r[crest], c[crest], own[crest]
    weak = np.zeros(image.shape, bool)
    weak[r, c] = True
    found = runs(weak, diagonal=True)
    of = found.part[np.searchsorted(found.y * image.shape[1] + found.x0, r * image.shape[1] + c, side="right") - 1]
    keep = np.zeros(found.n, bool)
    keep[of[own > high]] = True
    weak[r, c] = keep[of]
    return weak


class Runs(NamedTuple):
    """Stretches of true pixels in a row (columns x0 to x1, exclusive), in order, with their component, 0.. in order of its first pixel, and the number of components."""

    y: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    part: np.ndarray
    n: int

    def boxes(self) -> np.ndarray:
        """A row of x, y, width, height, pixels for each component."""
        low, high = np.full((self.n, 2), np.iinfo(int).max), np.full((self.n, 2), -1)
        for axis, least, most in ((0, self.x0, self.x1), (1, self.y, self.y + 1)):
            np.minimum.at(low[:, axis], self.part, least)
            np.maximum.at(high[:, axis], self.part, most)
        pixels = np.bincount(self.part, self.x1 - self.x0, self.n).astype(int)
        return np.concatenate([low, high - low, pixels[:, None]], axis=1)

    def only(self, part: int, box: tuple[int, int, int, int]) -> np.ndarray:
        """A component alone, cut out by its box."""
        x, y, w, h = box
        own = self.part == part
        first, length = (self.y[own] - y) * w + self.x0[own] - x, self.x1[own] - self.x0[own]
        out = bytearray(w * h)
        for at, n in zip(first.tolist(), length.tolist(), strict=True):
            out[at : at + n] = b"\1" * n
        return np.frombuffer(out, bool).reshape(h, w)


def runs(mask: np.ndarray, diagonal: bool = True) -> Runs:
    """Runs of true pixels; those that touch in neighbouring rows are of one component."""
    rows, cols = mask.shape
    p = np.zeros((rows, cols + 1), bool)  # a row ends with a false pixel, so no run goes on in the next
    p[:, :-1] = mask
    p = p.ravel()
    turn = _places(p[1:] != p[:-1]) + 1
    turn = np.concatenate([[0], turn]) if len(p) and p[0] else turn
    y, x0 = np.divmod(turn[::2], cols + 1)
    x1, n, reach = turn[1::2] - y * (cols + 1), len(y), int(diagonal)
    if n == 0:
        return Runs(y, x0, x1, y, 0)
    wide = cols + 3  # the runs of the row before that a run touches follow each other
    above = (y - 1) * wide + 1
    lo = np.searchsorted(y * wide + x1 + 1, above + x0 - reach, side="right")
    count = np.maximum(np.searchsorted(y * wide + x0 + 1, above + x1 + reach) - lo, 0)
    own = np.repeat(np.arange(n), count)
    other = np.arange(len(own)) + np.repeat(lo - np.cumsum(count) + count, count)
    parent = np.arange(n)
    while True:
        a, b = parent[own], parent[other]
        apart = a != b
        if not apart.any():
            break
        own, other, a, b = own[apart], other[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    first, part = np.unique(parent, return_inverse=True)
    return Runs(y, x0, x1, part, len(first))


def components(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Labels of connected true pixels, 1.. in order of their first pixel, and their number."""
    found = runs(mask, diagonal)
    label = np.zeros(mask.shape, np.int32)
    length = found.x1 - found.x0
    flat = np.repeat(found.y * mask.shape[1] + found.x0 - np.cumsum(length) + length, length) + np.arange(length.sum())
    label.ravel()[flat] = np.repeat(found.part + 1, length)
    return label, found.n


def component_boxes(label: np.ndarray, n: int) -> np.ndarray:
    """Rows of x, y, width, height, pixels for labels 1..n."""
    out = np.zeros((n, 5), int)
    y, x = np.nonzero(label)
    if n == 0:
        return out
    k = label[y, x] - 1
    low = np.full((n, 2), np.iinfo(int).max)
    high = np.full((n, 2), -1)
    for axis, v in ((0, x), (1, y)):
        np.minimum.at(low[:, axis], k, v)
        np.maximum.at(high[:, axis], k, v)
    out[:, :2], out[:, 2:4] = low, high - low + 1
    out[:, 4] = np.bincount(k, minlength=n)
    return out


#: Neighbours clockwise from the left: (dy, dx).
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def border(mask: np.ndarray) -> np.ndarray:
    """Outer border of the component of the first true pixel, as (x, y) points in order."""
    p = np.pad(mask, 1)
    wide, px = p.shape[1], p.tobytes()
    start = px.find(1)
    around = [dy * wide + dx for dy, dx in _AROUND]
    # for each way to begin with: steps to the neighbours in turn, and where to begin after each
    turns = [[(around[way], (way + 5) % 8 if way % 2 else (way + 6) % 8) for way in (*range(k, 8), *range(k))] for k in range(8)]
    points, at, came = [start], start, 0
    for _ in range(4 * p.size):
        for step, then in turns[came]:
            if px[at + step]:
                break
        else:
            break
        at += step
        if at == start and len(points) > 2:
            break
        points.append(at)
        came = then
        if at == start:
            break
    y, x = np.divmod(np.array(points), wide)
    return np.stack([x - 1, y - 1], axis=1)


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed polygon with the points that lie within ``tolerance`` of its chords left out."""

    def chain(lo: int, hi: int) -> list[int]:
        stack, kept = [(lo, hi)], set()
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            p, q = points[a].astype(float), points[b % len(points)].astype(float)
            mid = points[a + 1 : b].astype(float)
            d = q - p
            size = np.hypot(*d)
            off = np.hypot(*(mid - p).T) if size == 0 else np.abs(d[0] * (mid[:, 1] - p[1]) - d[1] * (mid[:, 0] - p[0])) / size
            k = int(np.argmax(off))
            if off[k] > tolerance:
                kept.add(a + 1 + k)
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return sorted(kept)

    n = len(points)
    if n < 3:
        return points
    far = int(np.argmax(np.hypot(*(points - points[0]).T.astype(float))))
    start = int(np.argmax(np.hypot(*(points - points[far]).T.astype(float))))
    points = np.roll(points, -start, axis=0)
    far = int(np.argmax(np.hypot(*(points - points[0]).T.astype(float))))
    return points[[0, *chain(0, far), far, *chain(far, n)]]


def perspective(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3x3 map that takes four points to four others."""
    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


#: Columns of a tile of ``warp``, and the side of the squares of its source that are asked whether they are of one level.
_TILE, _SQUARE = 32, 16


def _weights(t: np.ndarray) -> list[np.ndarray]:
    """``_cubic`` of the four neighbours (-1, 0, 1, 2) at a distance of t to the second."""
    a = t.dtype.type(-0.75)
    near = lambda t: ((a + 2) * t - (a + 3)) * t * t + 1
    far = lambda t: ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def _interpolated(four: np.ndarray, wide: int, u: np.ndarray, v: np.ndarray, kind: type) -> np.ndarray:
    """Bicubic levels at columns u and rows v; ``four`` holds at each place of the padded source its level and the next three, a byte each."""
    fu, fv = np.floor(u), np.floor(v)
    wx, wy = _weights((u - fu).astype(kind)), _weights((v - fv).astype(kind))
    at = (fv + 3).astype(np.int64)
    at *= wide
    at += (fu + 3).astype(np.int64)
    total = np.zeros(u.shape, kind)
    for j in range(4):
        levels = four.take(at if j == 0 else at + j * wide, mode="clip")
        line = wx[0] * (levels & 255).view(np.int32).astype(kind)
        for i in range(1, 4):
            line += wx[i] * ((levels >> 8 * i) & 255).view(np.int32).astype(kind)
        line *= wy[j]
        total += line
    return total


def _flat_tiles(image: np.ndarray, back: np.ndarray, width: int, tops: np.ndarray, bottoms: np.ndarray) -> np.ndarray:
    """The level of each tile of the result whose source is of one level; -1 of all others."""
    rows, cols = image.shape
    squares = np.pad(image, ((0, -rows % _SQUARE), (0, -cols % _SQUARE)), mode="edge").reshape(-(-rows // _SQUARE), _SQUARE, -1)
    least, most = (f(f(squares, axis=1).reshape(len(squares), -1, _SQUARE), axis=2).astype(np.int64) for f in (np.min, np.max))
    left = np.arange(0, width, _TILE)
    x, y = np.stack([left, np.minimum(left + _TILE, width) - 1])[None, :, None, :], np.stack([tops, bottoms - 1])[:, None, :, None]
    w, p, q = (back[k, 0] * x + back[k, 1] * y + back[k, 2] for k in (2, 0, 1))
    sound = (w > 0).all((0, 1)) | (w < 0).all((0, 1))  # then a tile's source lies between those of its corners
    w = np.where(sound, w, 1)
    (u0, u1), (v0, v1) = (
        [np.clip(np.floor(end + reach), 0, n - 1).astype(int) // _SQUARE for end, reach in ((t.min((0, 1)), -2), (t.max((0, 1)), 3))] for t, n in ((p / w, cols), (q / w, rows))
    )

    def total(squares: np.ndarray) -> np.ndarray:
        sums = np.pad(squares.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return sums[v1 + 1, u1 + 1] - sums[v0, u1 + 1] - sums[v1 + 1, u0] + sums[v0, u0]

    n, levels = (v1 + 1 - v0) * (u1 + 1 - u0), total(least)
    flat = sound & (total(most - least) == 0) & (n * total(least**2) == levels**2)  # no square has two levels, and theirs don't vary
    return np.where(flat, levels // n, -1)


def warp(image: np.ndarray, matrix: np.ndarray, width: int, height: int, strip: int = 32) -> np.ndarray:
    """Bicubic perspective warp of levels; ``matrix`` maps the source to the result, edges are repeated.

    Made in strips of rows that fit a cache; tiles whose source is of one level are that level.  Levels are
    interpolated in single precision, and once more in double where that can't tell to which level they round.
    """
    back, out = np.linalg.inv(matrix), np.empty((height, width), np.uint8)
    rows, cols = image.shape
    padded, wide = np.pad(image, 4, mode="edge"), cols + 8
    four = np.ndarray(padded.size - 3, "<u4", padded, strides=(1,)).copy()
    tops = np.arange(0, height, strip)
    level = _flat_tiles(image, back, width, tops, np.minimum(tops + strip, height))
    for top, flat in zip(tops.tolist(), level, strict=True):
        part = out[top : top + strip]
        part[:] = np.repeat(flat.clip(0), _TILE)[:width]
        mixed = np.flatnonzero(np.repeat(flat < 0, _TILE)[:width])
        if not len(mixed):
            continue
        x, y = mixed.astype(float)[None, :], np.arange(top, top + len(part), dtype=float)[:, None]
        w, u, v = (back[k, 0] * x + back[k, 1] * y + back[k, 2] for k in (2, 0, 1))
        u /= w
        v /= w
        np.clip(u, -3, cols + 1, out=u)  # all neighbours of what lies farther out are the edge
        np.clip(v, -3, rows + 1, out=v)
        made = _interpolated(four, wide, u, v, np.float32)
        whole = np.rint(made)
        again = np.nonzero(np.abs(made - whole) > 0.5 - _UNSURE)
        whole[again] = np.rint(_interpolated(four, wide, u[again], v[again], np.float64))
        part[:, mixed] = np.clip(whole, 0, 255, out=whole)
    return out


def match(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised correlation coefficients of a template at every place; 0 without variance."""
    t = template.astype(float) - template.mean()
    v = np.lib.stride_tricks.sliding_window_view(image.astype(float), template.shape)
    v = v - v.mean(axis=(2, 3), keepdims=True)
    size = np.sqrt((v**2).sum((2, 3)) * (t**2).sum())
    return np.where(size > 1e-12, (v * t).sum((2, 3)) / np.maximum(size, 1e-12), 0.0)
