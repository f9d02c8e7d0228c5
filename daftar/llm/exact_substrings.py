"""Removal of long byte strings that occur more than once in a corpus.

Windows of ``LENGTH`` bytes that are equal have equal contents, so they have the same
smallest hash of a short gram.  Runs of windows with one smallest hash form segments
of some 280 bytes, and equal windows can only lie in segments with that hash.

1.  Segments whose hash stands alone are dropped by a count of hashes.
2.  Segments that are equal as a whole, say inside copied passages, are collapsed:
    all their windows repeat.
3.  What is left are the variants of a hash: segments at the borders of copied
    passages.  Groups of them are put together into heaps of bounded size, and in
    each heap backward extension on a Burrows-Wheeler transform, breadth-first and
    bounded by ``LENGTH``, finds the places whose next ``LENGTH`` bytes occur again.
4.  A group too large for a heap (a passage in very many documents, or a very long
    periodic text) is split exactly: its windows are cut into narrower classes by where
    they hold their smallest gram, and windows of a class share a core of bytes, whose
    hash is the finer key.  Steps 2 to 4 follow for the pieces, down to single windows.
5.  Each distinct text gets its covered places, and its copies with it.

Counts are summed in the task before any shuffle, and every large table meets a
table with one row a key, so that one passage or text with a third of all rows can be split.
Nothing is sampled or capped.  Texts, segments and windows are told apart by 64-bit hashes.

Defined cases: null text is empty; texts shorter than ``LENGTH`` lose nothing; exact
copies lose everything from ``LENGTH`` bytes on; documents are matched by text, so
repeated rows are copies of each other and null or repeated ids do no harm; a very long text is
cut into segments like any other; an empty table gives an empty one.  Extra columns of any name
are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.arrowtext import _BASE, _BASE_INVERSE, Slice, _power_table, mix, slices
from daftar.llm.bwt import repeated_starts
from daftar.llm.scratch import Scratch

LENGTH = 200
GRAM = 20
SLICE = 2 << 20
#: Bytes of a heap, and of one group of variants at most before it counts as large.
HEAP_BYTES, GROUP_BYTES = 1 << 20, 256 << 10
#: Distances to the smallest gram in a class when a large group is split, and split again.
WIDTHS = (64, 16, 4, 1)

_CODE = np.random.default_rng(77001).integers(1, 2**63, 256, dtype=np.uint64)
_PLACE_BITS = np.uint64(23)
_PLACE_MASK = np.uint64((1 << 23) - 1)


def _prefix(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * _power_table(_BASE, len(data)), out=out[1:])
    return out


def _hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], as signed numbers."""
    raw = (prefix[end] - prefix[start]) * _power_table(_BASE_INVERSE, len(prefix))[start]
    return mix(mix(raw) + (end - start).astype(np.uint64)).view(np.int64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _places(prefix: np.ndarray) -> np.ndarray:
    """For each window its smallest gram's first place."""
    n = len(prefix) - 1
    grams, w = _grams(prefix), LENGTH - GRAM + 1
    step = int(_PLACE_MASK) - LENGTH
    found = []
    for lo in range(0, n - LENGTH + 1, step):  # more places than the bits hold: in overlapping stretches
        own = grams[lo : lo + step + w - 1]
        # the hash's upper bits, then the place: the leftmost of the smallest in each window
        packed = (own & ~_PLACE_MASK) | np.arange(len(own), dtype=np.uint64)
        found.append((_sliding_min(packed, w) & _PLACE_MASK).astype(np.int64) + lo)
    return np.concatenate(found)


def _grams(prefix: np.ndarray) -> np.ndarray:
    return mix((prefix[GRAM:] - prefix[:-GRAM]) * _power_table(_BASE_INVERSE, len(prefix) - GRAM))


def _runs(part: Slice, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows inside a row with one value: row, first and last window."""
    n, off = len(part.data), part.offsets
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.maximum(off[:-1], off[1:] - LENGTH + 1), 1)
    np.add.at(edge, off[1:], -1)
    inside = (np.cumsum(edge[:-1]) == 0)[: len(value)]
    starts = off[:-1][off[:-1] < len(value)]
    turn = np.ones(len(value), bool)
    turn[1:] = ~inside[:-1] | (value[1:] != value[:-1])
    turn[starts] = True
    opens = np.flatnonzero(inside & turn)
    closes = np.flatnonzero(inside & np.append(turn[1:] | ~inside[1:], True))
    return np.searchsorted(off, opens, side="right") - 1, opens, closes


def segments(part: Slice) -> dict[str, np.ndarray]:
    """Segments of a slice's rows: row, hash of their smallest gram, hash of their bytes, first window, windows, several.

    ``several`` tells that a window may be found again inside its own segment.
    """
    if len(part.data) < LENGTH:
        names = ("row", "gram", "whole", "start", "windows", "several")
        return {k: np.zeros(0, bool if k == "several" else np.int64) for k in names}
    prefix = _prefix(part.data)
    place = _places(prefix)
    value = _grams(prefix)[place]
    row, first, last = _runs(part, value)
    return {
        "row": row,
        "gram": value[first].view(np.int64),
        "whole": _hashes(prefix, first, last + LENGTH),
        "start": first - part.offsets[row],
        "windows": last - first + 1,
        "several": place[first] != place[last],
    }


def _pieces(part: Slice, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one place of the smallest gram, in one class of ``width`` distances to it."""
    distance = place - np.arange(len(place))
    return _runs(part, place * (LENGTH + 1) + distance // width)


def _segment_rows(texts: DataFrame) -> DataFrame:
    """Segments of each batch's distinct texts, with the number of their copies in the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ref, first, times = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
            for part in slices(batch.column(1).take(pa.array(first)), SLICE):
                s = segments(part)
                at = part.first + s["row"]
                arrays = [s["gram"], s["whole"], ref[at], s["start"], s["windows"], s["several"], times[at]]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["gram", "whole", "ref", "start", "windows", "several", "times"])

    return texts.select("ref", "text").mapInArrow(run, "gram long, whole long, ref long, start long, windows long, several boolean, times long")


def _cut(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` segments (ref, start, windows, ...) with their bytes."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a text with very many copies then has one row a batch
            _, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
            yield batch.take(pa.array(first))

    one = texts.select("ref", F.encode("text", "UTF-8").alias("data")).mapInArrow(distinct, "ref long, data binary")
    kept = [c for c in wanted.columns if c not in ("ref", "start", "windows")]
    per_text = wanted.groupBy("ref").agg(F.collect_list(F.struct("start", "windows", *kept)).alias("parts"))
    # copies of a text are equal: any one of them will do
    with_data = one.join(per_text, "ref").groupBy("ref").agg(F.first("data").alias("data"), F.first("parts").alias("parts"))
    return with_data.select("ref", "data", F.explode("parts").alias("p")).select(
        "ref", "p.*", F.substring("data", F.col("p.start").cast("int") + 1, (F.col("p.windows") + LENGTH - 1).cast("int")).alias("bytes")
    )


def _search_heap(heap: pd.DataFrame) -> pd.DataFrame:
    """Covered places of the segments of one heap that aren't covered as a whole."""
    heap = heap.sort_values(["gram", "whole"], kind="stable").reset_index(drop=True)
    size = heap["bytes"].map(len).to_numpy()
    ends = np.cumsum(size + 1) - 1
    begin = ends - size
    data = np.frombuffer(b"".join(b + b"\0" for b in heap["bytes"]), np.uint8)
    found = repeated_starts(data, ends, LENGTH)
    at = np.searchsorted(ends, found, side="left")
    out = pd.DataFrame({"ref": heap["ref"].to_numpy()[at], "a": heap["start"].to_numpy()[at] + found - begin[at], "s": at})
    out = out[(heap["times"].to_numpy() == 1)[at]]
    if out.empty:
        return pd.DataFrame({"ref": np.zeros(0, np.int64), "a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    run = ((out["s"].diff() != 0) | (out["a"].diff() != 1)).cumsum()
    ends_ = out.groupby(run).agg(ref=("ref", "first"), a=("a", "first"), b=("a", "last"))
    ends_["b"] += LENGTH
    return ends_.reset_index(drop=True)


def _split(cut: DataFrame, width: int) -> DataFrame:
    """Pieces of segments with their bytes: runs of windows of one class of ``width`` places of the smallest gram.

    Equal windows hold it at one place, so they are of one class and have the bytes in common that
    all windows of the class have; these make the new key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, ref, start, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for part in slices(batch.column(4), SLICE):
                if len(part.data) < LENGTH:
                    continue
                prefix = _prefix(part.data)
                place = _places(prefix)
                row, first, last = _pieces(part, place, width)
                core = place[first] - (place[first] - first) // width * width
                key = _hashes(prefix, core, core + LENGTH - width + 1).view(np.uint64) ^ mix(((place[first] - first) // width).astype(np.uint64))
                at = part.first + row
                size = last - first + LENGTH
                flat = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(row),
                    [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(part.data[flat])],
                ).cast(pa.binary())
                arrays = [
                    mix(key + old[at].view(np.uint64)).view(np.int64), _hashes(prefix, first, last + LENGTH),
                    ref[at], start[at] + first - part.offsets[row], last - first + 1, times[at],
                ]
                yield pa.RecordBatch.from_arrays([*(pa.array(a) for a in arrays), data], ["gram", "whole", "ref", "start", "windows", "times", "bytes"])

    kinds = "gram long, whole long, ref long, start long, windows long, times long, bytes binary"
    return cut.select("gram", "ref", "start", "times", "bytes").mapInArrow(run, kinds)


def _heaps(rows: DataFrame) -> DataFrame:
    """Covered ranges of the segments in small groups (gram, size of the group), heap by heap."""
    total = rows.select("gram", "size").distinct().agg(F.sum("size")).first()[0] or 0
    heap = F.pmod(F.xxhash64("gram"), F.lit(1 + int(total) // HEAP_BYTES))
    return rows.withColumn("heap", heap).groupBy("heap").applyInPandas(_search_heap, "ref long, a long, b long")


def _range() -> list[F.Column]:
    return [F.col("ref"), F.col("start").alias("a"), (F.col("start") + F.col("windows") + LENGTH - 1).alias("b")]


def _open_groups(variant: DataFrame, inner: F.Column) -> DataFrame:
    """``(gram, size)`` of the groups that may hold further repeats: of several variants, or of one that repeats in itself."""
    groups = variant.groupBy("gram").agg(
        F.count("*").alias("n"), F.max(inner & (F.col("times") == 1)).alias("inner"),
        F.count_if(F.col("times") == 1).alias("single"), F.sum(F.col("at.windows") + LENGTH).alias("size"),
    )
    return groups.where("single > 0 and (n > 1 or inner)").select("gram", "size")


def covered(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(ref, a, b)``: byte ranges of distinct texts (ref, text) that repeated windows cover."""
    rows = _segment_rows(texts)
    counted = rows.groupBy("gram").agg(F.sum("times").alias("n"), F.max("several").alias("several"))
    shared = counted.where((F.col("n") > 1) | F.col("several")).select("gram")
    near = scratch.write(rows.join(shared, "gram", "left_semi"))
    variant = near.groupBy("gram", "whole").agg(
        F.sum("times").alias("times"), F.max("several").alias("several"), F.min(F.struct("ref", "start", "windows")).alias("at")
    )
    variant = scratch.write(variant)
    again = near.join(variant.where("times > 1").select("gram", "whole"), ["gram", "whole"], "left_semi")
    found = again.select(*_range()).distinct()
    wanted = variant.join(_open_groups(variant, F.col("several")), "gram").select("gram", "whole", "times", "size", "at.*")
    cut = scratch.write(_cut(texts, wanted))
    found = found.unionByName(_heaps(cut.where(F.col("size") <= GROUP_BYTES)))
    large = cut.where(F.col("size") > GROUP_BYTES)
    for width in WIDTHS:
        if large.isEmpty():
            break
        pieces = scratch.write(_split(large, width))
        variant = pieces.groupBy("gram", "whole").agg(F.sum("times").alias("times"), F.min(F.struct("ref", "start", "windows")).alias("at"))
        variant = scratch.write(variant)
        again = pieces.join(variant.where("times > 1").select("gram", "whole"), ["gram", "whole"], "left_semi")
        found = found.unionByName(again.select(*_range()).distinct())
        wanted = variant.join(_open_groups(variant, F.lit(False)), "gram").select("gram", "whole", "times", "size", "at.ref", "at.start")
        cut = scratch.write(pieces.drop("times").join(wanted, ["gram", "whole", "ref", "start"]))
        found = found.unionByName(_heaps(cut.where(F.col("size") <= GROUP_BYTES)))
        large = cut.where(F.col("size") > GROUP_BYTES)
    return found


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept binary)`` for every row."""
    scratch = Scratch(docs.sparkSession, "repeats")
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("ref", F.xxhash64("text"))
    ranges = covered(own.select("ref", "text"), scratch).groupBy("ref").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lost, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer()
                data = b"" if data is None else data.to_pybytes()
                size.append(len(data))
                if not found.is_valid:
                    lost.append(0)
                    spans.append(0)
                    kept.append(data)
                    continue
                places = found.values
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, places.field("a").to_numpy(), 1)
                np.add.at(edge, places.field("b").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                lost.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip((size, lost, spans, kept), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = own.join(ranges, "ref", "left").select(id_col, "text", "ranges")
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: sizes and a digest of the bytes that stay."""
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
