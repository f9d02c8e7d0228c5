"""Arrow batches of text as byte arrays, and words of such arrays as hashes.

A word is a maximal run of ``0-9 A-Z a-z`` and non-ASCII characters, compared
with A-Z lowered.  In UTF-8 every byte of a non-ASCII character is >= 0x80, so
words can be cut on bytes with numpy, without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; a longer document is a slice alone.
SLICE_BYTES = 1 << 20
#: Values of a table of powers that a worker keeps (32 MB).
_KEPT = 4 << 20

_BYTES = np.arange(256)
_IS_WORD = (
    ((_BYTES >= 48) & (_BYTES <= 57))
    | ((_BYTES >= 65) & (_BYTES <= 90))
    | ((_BYTES >= 97) & (_BYTES <= 122))
    | (_BYTES >= 128)
)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
_CODE = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64)
#: Value of each byte in a word's hash: 0 outside words, A-Z as a-z.
_BYTE_VALUE = np.where(_IS_WORD, _CODE[_LOWER], np.uint64(0))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_powers: dict[np.uint64, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is not None and len(have) >= n:
        return have[:n]
    full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
    full[0] = 1
    table = np.cumprod(full, dtype=np.uint64)
    if n <= _KEPT:
        _powers[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Slice:
    """Rows first..last of a batch: their bytes, and where each row begins (one more for the end)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column into runs of whole rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = _buffers(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        lo, hi = int(offsets[first]), int(offsets[last])
        yield Slice(first, last, data[lo:hi], offsets[first : last + 1] - lo)
        first = last


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes, and the first word of each row (one more for the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    rows: np.ndarray


def words(part: Slice) -> Words:
    data, n = part.data, len(part.data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, np.uint64), np.zeros(len(part.offsets), np.int64))
    is_word = _IS_WORD[data]
    opens = is_word.copy()
    opens[1:] &= ~is_word[:-1]
    cut = part.offsets[:-1]
    cut = cut[cut < n]
    opens[cut] = is_word[cut]
    closes = is_word.copy()
    closes[:-1] &= ~is_word[1:]
    cut = cut[cut > 0] - 1
    closes[cut] = is_word[cut]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if len(start):
        # each byte counts by its place in its word, so a table as long as the longest word will do
        inside = np.zeros(n, np.int32)
        inside[start] = start
        inside = np.arange(n, dtype=np.int32) - np.maximum.accumulate(inside)
        inside[~is_word] = 0
        value = _BYTE_VALUE[data] * _power_table(_BASE, int((end - start).max()))[inside]
        total = np.add.reduceat(value, start)
        hashes = mix(total ^ ((end - start).astype(np.uint64) << np.uint64(40))) | np.uint64(1)
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(start, end, hashes, np.searchsorted(start, part.offsets))


def hash_words(texts: list[bytes]) -> np.ndarray:
    """The hash that ``words`` gives each text, for texts that are one word each."""
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        w = words(Slice(0, 1, np.frombuffer(t, np.uint8), np.array([0, len(t)], np.int64)))
        out[i] = w.hash[0]
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row from each word on; the last k-1 entries are unused zeros."""
    out = np.zeros(len(hashes), np.uint64)
    n = len(hashes) - k + 1
    if n <= 0:
        return out
    acc = hashes[:n].copy()
    for i in range(1, k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    out[:n] = mix(acc)
    return out


def prefix_hashes(seq: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... values of a sequence, from which those of its parts follow."""
    out = np.zeros(len(seq) + 1, np.uint64)
    np.cumsum(mix(seq) * _power_table(_BASE, len(seq)), out=out[1:])
    return out


def same_length(one: np.ndarray, i: np.ndarray, two: np.ndarray, j: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many values from i of one sequence equal those from j of another, given prefix hashes; ``least`` are known to, ``most`` may."""
    powers = _power_table(_BASE, max(len(one), len(two)))
    lo, hi = least.copy(), most.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi + 1) >> 1
        equal = (one[i + mid] - one[i]) * powers[j] == (two[j + mid] - two[j]) * powers[i]
        lo = np.where(open_ & equal, mid, lo)
        hi = np.where(open_ & ~equal, mid - 1, hi)
    return lo
