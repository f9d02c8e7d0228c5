"""Long repeats in a bounded heap of strings, by backward extension on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

_END = -1


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse; ``ends`` are places of separators, each less than all bytes and than later ones."""
    n = len(data)
    rank = data.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    width, step = int(rank.max()) + 1, 1
    while step < 4 and width < 1 << 15:  # a few bytes at once
        key = rank * width
        key[:-step] += rank[step:]
        key[ends] = rank[ends] * width
        rank, width, step = key, width * width, step * 2
    order = np.argsort(rank)  # equal ranks may come in any order
    sorted_ = rank[order]
    new = np.ones(n, bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    # only groups that share a rank are sorted on; a rank is the row where its group begins
    twin = ~new
    twin[:-1] |= ~new[1:]
    rows = np.flatnonzero(twin)
    while len(rows):
        places = order[rows]
        after = places + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        both = rank[places] * (n + 1) + second + 1
        by = np.argsort(both)
        places, both = places[by], both[by]
        order[rows] = places
        new = np.ones(len(rows), bool)
        new[1:] = both[1:] != both[:-1]
        head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rank[places] = head
        twin = ~new
        twin[:-1] |= ~new[1:]
        rows = rows[twin]
        step *= 2
    return order, rank


def repeated_starts(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Places where a string of ``length`` bytes begins that begins at another place too.

    ``data`` holds strings, each followed by a place of ``ends``.  Intervals of the
    transform are extended to the left breadth-first: level by level this fixes the
    boundaries between suffixes whose common prefix has 0, 1, 2, ... bytes.  It
    stops before ``length``; the boundaries still open then have longer prefixes.
    """
    n = len(data)
    order, rank = (x.astype(np.int32) for x in suffix_array(data, ends))  # half as much to sort and gather
    separator = np.zeros(n, bool)
    separator[ends] = True
    previous = order - 1
    stop = separator[previous]  # of the first place this is the last one, a separator
    step = np.where(stop, np.int32(_END), rank[previous])  # where a row goes on extension to the left
    symbol = np.where(stop, np.int16(_END), data[previous].astype(np.int16))
    # the next and previous rows with the same symbol
    goes = np.flatnonzero(~stop).astype(np.int32)
    back = np.full(n + 1, n, np.int32)
    back[step[goes]] = goes
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    near = back[step[goes] + 1]
    same = (near < n) & (symbol[np.minimum(near, n - 1)] == symbol[goes])
    following[goes[same]] = near[same]
    preceding[near[same]] = goes[same]
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    m = len(ends)
    open_[1 : m + 1] = False  # rows of separators stand alone
    first = data[order[m:]]
    cuts = np.flatnonzero(first[1:] != first[:-1]) + 1 + m
    open_[cuts] = False
    bounds = np.concatenate([np.arange(m), [m], cuts, [n]])
    bounds = np.unique(bounds).astype(np.int32)
    low, high = bounds[:-1], bounds[1:]
    for _ in range(1, length):
        size = high - low
        if len(size) == 0:
            break
        upto = np.cumsum(size, dtype=np.int32)
        rows = np.repeat(low - upto + size, size) + np.arange(upto[-1], dtype=np.int32)
        lasts = rows[(following[rows] >= np.repeat(high, size)) & ~stop[rows]]
        firsts = rows[(preceding[rows] < np.repeat(low, size)) & ~stop[rows]]
        new_high, new_low = np.sort(step[lasts]) + 1, np.sort(step[firsts])
        fresh = open_[new_high]
        low, high = new_low[fresh], new_high[fresh]
        open_[high] = False
    deep = open_[:-1] | open_[1:]
    return np.sort(order[deep]).astype(np.int64)
