"""Fill-in-middle transformation over an index of distinct texts.

Texts are grouped by themselves, so equal means equal content, and copies meet before anything is shuffled.
Of each distinct text the ends of its lines, in code points, are computed once and kept as an
Elias-Fano list: the low bits of every end in a row, the high bits as gaps in unary.  Documents
join the list of their text by its SHA-256, and each one's seeded cut is two selections from the list.  Splitting,
marking and restoring are built-in functions.

The join's other side has one row per distinct text, so a text that very many documents share is a
skewed key of the documents alone, which adaptive execution splits; no task holds a group of copies.

Defined cases: null text is empty, and so plain, without lines; null id counts as an empty
number in the seed; a very long text is cut whole; repeated rows are cut alike, and none is dropped; equal
cuts give an empty middle; a text that holds a mark is plain; an empty table gives an empty one.
Extra columns of any name are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.arrowtext import slices
from daftar.llm.scratch import Scratch


@dataclass(frozen=True)
class Marks:
    """Strings before the parts of a text; they must be no parts of each other."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


MARKS = Marks()
LISTS = "key binary, n long, width int, low binary, high binary"

_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)
#: Place of the k-th one of a byte, lowest bit first.
_PLACE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


def pack(ends: np.ndarray) -> tuple[int, bytes, bytes]:
    """Elias-Fano list of rising numbers: bits of the low parts, low parts, high parts."""
    n = len(ends)
    if n == 0:
        return 0, b"", b""
    width = max(0, (int(ends[-1]) // n).bit_length() - 1)
    low = np.packbits((ends[:, None] >> np.arange(width)) & 1, bitorder="little").tobytes() if width else b""
    high = np.zeros((int(ends[-1]) >> width) + n, np.uint8)
    high[(ends >> width) + np.arange(n)] = 1
    return width, low, np.packbits(high, bitorder="little").tobytes()


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data of a binary column and where each row begins."""
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    begin = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)), begin


def select(width: pa.Array, low: pa.Array, high: pa.Array, k: np.ndarray) -> np.ndarray:
    """The k-th number, from 1 on, of each row's list; 0 for k = 0."""
    width, (high, at), (low, low_at) = np.asarray(width, np.int64), _bytes(high), _bytes(low)
    ones = np.concatenate([[0], np.cumsum(_ONES[high])])
    due = ones[at[:-1]] + k  # the number of ones up to and with the one that is sought
    byte = np.maximum(np.searchsorted(ones, due) - 1, 0)
    place = (byte - at[:-1]) * 8 + _PLACE[high[byte], np.clip(due - ones[byte] - 1, 0, 7)]
    out = (place - (k - 1)) << width
    for i in range(int(width.max(initial=0))):
        bit = np.where(k > 0, (k - 1) * width + i, 0)
        own = low[np.minimum(low_at[:-1] + (bit >> 3), len(low) - 1)] >> (bit & 7).astype(np.uint8) & 1
        out |= np.where(i < width, own.astype(np.int64) << i, 0)
    return np.where(k > 0, out, 0)


def line_ends(data: np.ndarray) -> np.ndarray:
    """Ends, in code points, of the lines of a text's UTF-8 bytes; a line has its line feed with it."""
    starts = np.cumsum((data & 0xC0) != 0x80)
    ends = starts[data == 10]
    return np.append(ends, starts[-1]) if len(data) and data[-1] != 10 else ends


def line_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(key, n, width, low, high)``: one row per distinct text with the list of its line ends."""
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                lists = [line_ends(part.data[a:b]) for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True)]
                packed = [pack(x) for x in lists]
                columns = [pa.array([x[i] for x in packed], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))]
                key = batch.column(0).slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_arrays([key, pa.array([len(x) for x in lists], pa.int64()), *columns], ["key", "n", "width", "low", "high"])

    return texts.select(_key(F.col("t")), "t").mapInArrow(run, LISTS)


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256)).alias("key")


def _cuts(width: pa.Array, low: pa.Array, high: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    places = [select(width, low, high, np.asarray(k, np.int64)) for k in (first, second)]
    return pa.StructArray.from_arrays([pa.array(p) for p in places], ["a", "b"])


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, marks: Marks = MARKS
) -> DataFrame:
    """``(id_col, n, form, prefix_chars, middle_chars, output)`` for every row.

    ``rate`` of a hundred texts are cut, ``spm`` of a hundred of these put the suffix first; which ones, and where, follows
    from the seed and the id alone.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lists = scratch.write(line_index(docs, text_col))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"), _key(text), *(draw(i) for i in range(4))).join(lists, "key")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cuts = F.arrow_udf(_cuts, "a long, b long")
    rows = rows.withColumn("cut", cuts("width", "low", "high", F.least(one, two), F.greatest(one, two)))
    marked = F.contains("t", F.lit(marks.prefix)) | F.contains("t", F.lit(marks.suffix)) | F.contains("t", F.lit(marks.middle))
    plain = (F.col("t") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    a, b = F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    t = F.col("t")
    prefix, middle, suffix = t.substr(F.lit(1), a), t.substr(a + 1, b - a), t.substr(b + 1, F.length(t) - b)
    p, s, m = (F.lit(x) for x in (marks.prefix, marks.suffix, marks.middle))
    rows = rows.withColumn("form", form)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
    cut = F.col("form") != "plain"
    return rows.select(
        F.col("id").alias(id_col), "n", "form", F.when(cut, F.col("cut.a")).alias("prefix_chars"),
        F.when(cut, F.col("cut.b") - F.col("cut.a")).alias("middle_chars"), F.coalesce(output, t).alias("output"),
    )


def restore(output: Column, form: Column, marks: Marks = MARKS) -> Column:
    """The text that an output was made of."""
    quoted = "|".join(rf"\Q{x}\E" for x in (marks.prefix, marks.suffix, marks.middle))
    part = lambda i: F.get(F.split(output, quoted, -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: lines, form, lengths of the parts, and digests of the output and of the text restored from it."""
    rows = transform(docs)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
