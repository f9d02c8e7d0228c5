"""Benchmark decontamination with suffix arrays over the words of the training text.

Each task builds the suffix array of each shard of its documents: all word positions of
some megabytes of text in the order of the words that follow, up to the document's end.
Every test suffix that begins a window is binary-searched in every shard, word by word,
which gives the range of the positions whose words begin with the window.  Each position in
such a range then gives the length of its verbatim match, by comparing prefix hashes.

Documents aren't shuffled.  Test items are dealt to blocks of bounded size by a hash.  One
block at a time is fetched, broadcast and searched in a pass over the documents; between
passes the documents are written with what they matched so far, and the block is freed.
So neither the driver nor a task holds more than a block, however many there are; most
test sets are one block, which takes one pass and writes nothing.

Defined cases: null or empty text has no words, is never hit and never contaminated; an item
without words has no window; items of one id count once, whatever their texts; an item
with a null id makes hits but has no name in ``items``; repeated documents are judged one by one
and get equal results; a very long text is a shard by itself; an empty table gives an empty
one, and with an empty test set nothing is hit.  Extra columns of any name pass through
``remove`` unread and don't reach ``contamination``.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.llm.arrowtext import Slice, Words, prefix_hashes, same_length, slices, words
from daftar.llm.scratch import Scratch

WINDOW = 13
#: Bytes of item text in one broadcast block, about, and bytes of text in a shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 4 << 20
#: Occurrences that are looked at together inside a task.
TOGETHER = 1 << 20
_SPAN = T.StructType().add("start", "long").add("end", "long")
FOUND = (
    T.StructType().add("n_words", "long").add("n_hit", "long").add("longest", "long")
    .add("items", T.ArrayType(T.StringType())).add("hits", T.ArrayType(_SPAN))
)
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class TestBlock:
    """The words of some items one after another, and the suffixes of items that begin a window."""

    words: np.ndarray
    start: np.ndarray  # place of each suffix in ``words``
    length: np.ndarray  # words of its window
    left: np.ndarray  # words from its place to the item's end
    item: np.ndarray
    items: list[str | None]


def test_block(rows: list[tuple[str | None, str | None]], window: int = WINDOW) -> TestBlock | None:
    """The suffixes of items ``(id, text)``; None if no item has a word."""
    texts = pa.array([text for _, text in rows], pa.large_string())
    found = [words(part) for part in slices(texts, 1 << 62)]
    w = found[0] if found else None
    if w is None or len(w.hash) == 0:
        return None
    n = np.diff(w.rows)
    item = np.repeat(np.arange(len(n)), n)
    left = np.repeat(w.rows[1:], n) - np.arange(len(item))
    length = np.minimum(window, n)[item]
    start = np.flatnonzero(left >= length)
    return TestBlock(w.hash, start, length[start], left[start], item[start], [i for i, _ in rows])


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions of a sequence in the order of what follows them, by doubling the length that is sorted."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    new = np.ones(n, bool)
    new[1:] = seq[order][1:] != seq[order][:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = 1
    while True:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if len(tied) == 0:
            return order
        place = order[tied]
        follow = place + size
        after = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        key = (rank[place].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        by_key = np.argsort(key, kind="stable")
        key, order[tied] = key[by_key], place[by_key]
        first = np.ones(len(tied), bool)
        first[1:] = key[1:] != key[:-1]
        new[tied] = first
        rank[order[tied]] = np.maximum.accumulate(np.where(first, tied, 0))
        size *= 2


def _narrowed(seq: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range of the suffix array, the part whose suffixes have ``word`` at ``depth``, by binary search."""
    sides = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            at = seq[order[np.minimum(mid, len(order) - 1)] + depth]
            less = (at <= word) if right else (at < word)
            a = np.where(open_ & less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        sides.append(a)
    return sides[0], sides[1]


def _ranges(seq: np.ndarray, order: np.ndarray, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test suffixes whose window occurs, and the range of its occurrences in the suffix array."""
    which = np.arange(len(block.start))
    lo, hi = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = 0
    while len(which):
        lo, hi = _narrowed(seq, order, lo, hi, depth, block.words[block.start[which] + depth])
        depth += 1
        some = lo < hi
        full = some & (block.length[which] == depth)
        done.append((which[full], lo[full], hi[full]))
        some &= ~full
        which, lo, hi = which[some], lo[some], hi[some]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (which, lo, hi)


@dataclass
class Matches:
    """What a block's items match in a shard: hit words, longest match of each row, and (row, item) pairs."""

    hit: np.ndarray
    longest: np.ndarray
    pairs: np.ndarray


def search(w: Words, block: TestBlock, depth: int = WINDOW) -> Matches:
    n_rows, n_words = len(w.rows) - 1, len(w.hash)
    row = np.repeat(np.arange(n_rows), np.diff(w.rows))
    # each row ends with a mark of its own, so no match goes beyond it
    seq = np.zeros(n_words + n_rows + depth, np.uint64)
    seq[np.arange(n_words) + row] = w.hash
    seq[w.rows[1:] + np.arange(n_rows)] = np.arange(n_rows)
    order = suffix_array(seq[: n_words + n_rows])
    which, lo, hi = _ranges(seq, order, block)
    edge, longest = np.zeros(n_words + 1, np.int64), np.zeros(n_rows, np.int64)
    pairs = np.zeros(0, np.int64)
    total = np.cumsum(hi - lo)
    own, other = prefix_hashes(seq), prefix_hashes(block.words)
    spot = np.append(row, np.zeros(n_rows, np.int64))
    spot[w.rows[1:] + np.arange(n_rows)] = np.arange(n_rows)
    spot[np.arange(n_words) + row] = row
    begin = 0
    while begin < len(which):
        upto = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + TOGETHER, side="right")))
        count = (hi - lo)[begin:upto]
        each = np.repeat(np.arange(begin, upto), count)
        inside = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        place, suffix = order[lo[each] + inside], which[each]
        r = spot[place]
        word = place - r
        edge += np.bincount(word, minlength=n_words + 1)
        edge -= np.bincount(word + block.length[suffix], minlength=n_words + 1)
        most = np.minimum(block.left[suffix], w.rows[r + 1] - word)
        np.maximum.at(longest, r, same_length(own, place, other, block.start[suffix], block.length[suffix], most))
        pairs = np.unique(np.concatenate([pairs, r * len(block.items) + block.item[suffix]]))
        begin = upto
    return Matches(np.cumsum(edge[:-1]) > 0, longest, pairs)


def _spans(hit: np.ndarray) -> list[dict]:
    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]


def _found(part: Slice, block: TestBlock | None, depth: int, before: list | None) -> list[pa.Array]:
    """Columns of FOUND for the rows of a shard; ``before`` are those that earlier blocks gave them."""
    w = words(part)
    n_rows = len(w.rows) - 1
    if block is not None and len(w.hash):
        m = search(w, block, depth)
    else:
        m = Matches(np.zeros(len(w.hash), bool), np.zeros(n_rows, np.int64), np.zeros(0, np.int64))
    names: dict[int, set[str]] = {}
    for pair in m.pairs.tolist():
        r, i = divmod(pair, len(block.items))
        if block.items[i] is not None:
            names.setdefault(r, set()).add(block.items[i])
    if before is not None:
        _, _, longest, items, hits = before
        m.longest = np.maximum(m.longest, longest.to_numpy())
        for r in np.flatnonzero(longest.to_numpy() > 0).tolist():
            names.setdefault(r, set()).update(items[r].as_py())
            for span in hits[r].as_py():
                m.hit[w.rows[r] + span["start"] : w.rows[r] + span["end"]] = True
    sums = np.concatenate([[0], np.cumsum(m.hit)])
    n_hit = sums[w.rows[1:]] - sums[w.rows[:-1]]
    spans = [_spans(m.hit[w.rows[r] : w.rows[r + 1]]) if n_hit[r] else [] for r in range(n_rows)]
    listed = [sorted(names.get(r, ())) for r in range(n_rows)]
    return [pa.array(np.diff(w.rows)), pa.array(n_hit), pa.array(m.longest), pa.array(listed, pa.list_(pa.string())), pa.array(spans, _HITS)]


def _searcher(shared: Broadcast, text_col: str, fields: list[str], first: bool, depth: int, clean: bool) -> Callable:
    """A pass over batches of (row, and FOUND after the first pass); returns ``fields`` of the rows, and FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for part in slices(rows.field(text_col), SHARD_BYTES):
                n = part.last - part.first
                before = None if first else [batch.column(1 + i).slice(part.first, n) for i in range(len(FOUND))]
                found = _found(part, shared.value, depth, before)
                own = [rows.field(f).slice(part.first, n) for f in fields]
                out = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(own, fields), *found], ["row", *FOUND.names])
                if clean:
                    n_words, n_hit = found[0].to_numpy(), found[1].to_numpy()
                    out = out.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words)))).select(["row"])
                yield out

    return run


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[TestBlock | None]:
    """The test items in blocks of bounded size, fetched one by one; at least one."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    many = -(-size // BLOCK_BYTES)
    if many <= 1:
        yield test_block([tuple(r) for r in rows.collect()], window)
        return
    # equal rows are one, else they would all fall into one block
    rows = rows.distinct()
    for k in range(many):
        yield test_block([tuple(r) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(many)) == k).collect()], window)


def _marked(docs: DataFrame, benchmark: DataFrame, fields: list[str], item_col: str, text_col: str, window: int, clean: bool) -> DataFrame:
    """``row`` (``fields`` of the columns of docs) and FOUND; with ``clean`` the row alone, if it isn't contaminated."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    rows, written = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), None
    blocks = _blocks(benchmark, item_col, text_col, window)
    block, first = next(blocks), True
    while True:
        following = next(blocks, False)
        last = following is False
        kept = fields if last else docs.columns
        kind = T.StructType().add("row", T.StructType([docs.schema[c] for c in kept]))
        kind = kind if last and clean else T.StructType(kind.fields + FOUND.fields)
        shared = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(_searcher(shared, text_col, kept, first, window, last and clean), kind)
        if last:
            return rows
        rows = scratch.write(rows)
        shared.destroy()
        scratch.drop(written)
        written, block, first = rows, following, False


def is_contaminated(n_words: F.Column, n_hit: F.Column) -> F.Column:
    """At least a twentieth of the document's words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """``(id_col, n_words, n_hit, longest, items, hits)`` for every document.

    ``hits`` are the maximal runs of hit words (numbers of words, end exclusive),
    ``longest`` is the length in words of the longest verbatim match with one item.
    """
    found = _marked(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), benchmark, ["id"], item_col, "text", window, False)
    return found.select(F.col("row.id").alias(id_col), *FOUND.names)


def remove(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    return _marked(docs, benchmark, docs.columns, item_col, text_col, window, True).select("row.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with counts, a digest of its items and the verdict."""
    c = contamination(docs, benchmark)
    return c.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )
