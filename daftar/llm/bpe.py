"""Byte-level BPE encoding and decoding by merge replay over the words of a batch.

Spark cuts texts into pieces with a built-in regular expression.  Each task
then takes the distinct pieces of an Arrow batch as one corpus: an inverted
index leads from a token pair to the places where it stands, merges are applied
to all places at once, lowest rank first, and only the neighbours of merged
places enter the index anew.  No rows are shuffled, memory is bounded by the batch,
and a lost task is simply run again.

Defined cases: null text is empty; empty text has no ids and decodes to no
bytes; a very long text is encoded whole; repeated rows are encoded each for itself; no row is
dropped; an empty table gives an empty one.  Extra columns of any name are left aside.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The public pre-tokenisation pattern in Java's notation; white space is the Unicode property, which Java's \s is not.
JAVA_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Pieces that a task turns into ids at once.
PIECES_AT_ONCE = 1 << 20


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)}


class MergeReplay:
    """Encodes many distinct words together; decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.token_len = lengths
        self.token_at = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        self.token_data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.shift = int(size).bit_length()
        self.pair_rank: dict[int, int] = {}

    def _rank(self, pair: int) -> int:
        """Rank of the token that a pair makes, -1 if none."""
        found = self.pair_rank.get(pair)
        if found is None:
            a, b = pair >> self.shift, pair & ((1 << self.shift) - 1)
            found = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
            if len(self.pair_rank) > 4_000_000:
                self.pair_rank.clear()
            self.pair_rank[pair] = found
        return found

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids begin (one more for the end)."""
        whole = [self.ranks.get(w, -1) for w in words]
        todo = [i for i, r in enumerate(whole) if r < 0]
        ids, begin = self._replay([words[i] for i in todo])
        counts = np.ones(len(words), np.int64)
        counts[todo] = np.diff(begin)
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(at[-1], np.int32)
        single = np.ones(len(words), bool)
        single[todo] = False
        out[at[:-1][single]] = np.array(whole, np.int32)[single]
        mask = np.ones(len(out), bool)
        mask[at[:-1][single]] = False
        out[mask] = ids
        return out, at

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        n = int(begin[-1])
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[begin[1:][lengths > 0] - 1] = -1
        before[begin[:-1][lengths > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[tuple[int, int]] = []

        def enter(places: np.ndarray) -> None:
            """Put the pairs that begin at these places into the index."""
            pairs = (symbol[places] << self.shift) | symbol[after[places]]
            if len(places) > 1:
                order = np.argsort(pairs, kind="stable")
                pairs, places = pairs[order], places[order]
                cuts = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
                heads, groups = pairs[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)
            else:
                heads, groups = pairs.tolist(), [places]
            for pair, group in zip(heads, groups, strict=True):
                have = index.get(pair)
                if have is not None:
                    have.append(group)
                elif (rank := self._rank(pair)) >= 0:
                    index[pair] = [group]
                    heapq.heappush(queue, (rank, pair))

        enter(np.flatnonzero(after >= 0))
        low = (1 << self.shift) - 1
        while queue:
            rank, pair = heapq.heappop(queue)
            groups = index.pop(pair)
            a, b = pair >> self.shift, pair & low
            i = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            j = after[i]
            good = alive[i] & (symbol[i] == a) & (j >= 0)
            good &= symbol[j] == b
            if not good.all():
                i, j = i[good], j[good]
            if len(i) == 0:
                continue
            if a == b and len(i) > 1:  # in a run of equal tokens, take the leftmost pairs that do not overlap
                taken, last = [], -1
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if x != last:
                        taken.append(x)
                        last = y
                if len(taken) < len(i):
                    i = np.array(taken, np.int64)
                    j = after[i]
            symbol[i] = rank
            alive[j] = False
            k = after[j]
            after[i] = k
            has = k >= 0
            before[k[has]] = i[has]
            p = before[i]
            p = p[p >= 0]
            near = np.concatenate([p, i[has]])
            if a == b or len(near) > 1:
                near = np.unique(near)
            if len(near):
                enter(near)
        ids = symbol[alive].astype(np.int32)
        kept = np.concatenate([[0], np.cumsum(alive)])
        return ids, kept[begin]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids in a row."""
        length = self.token_len[ids]
        total = int(length.sum())
        if total == 0:
            return np.zeros(0, np.uint8)
        return self.token_data[_ranges(self.token_at[ids], length, total)]


def _ranges(start: np.ndarray, length: np.ndarray, total: int) -> np.ndarray:
    """start[0], start[0]+1, ..., start[1], ...: as many of each as its length."""
    shift = start - np.concatenate([[0], np.cumsum(length)[:-1]])
    return np.repeat(shift, length) + np.arange(total)


@lru_cache(maxsize=2)
def _replay_for(content: bytes) -> MergeReplay:
    return MergeReplay(parse_ranks(content))


def _encode_part(replay: MergeReplay, pieces: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Ids and decoded bytes of each row."""
    offsets = pieces.offsets.to_numpy().astype(np.int64)
    coded = pieces.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, at = replay.encode([w.encode() for w in coded.dictionary.to_pylist()])
    count = np.diff(at)[index]
    ends = np.concatenate([[0], np.cumsum(count)])
    total = int(ends[-1])
    flat = ids[_ranges(at[:-1][index], count, total)] if total else np.zeros(0, np.int32)
    rows = ends[offsets - offsets[0]]
    length = np.concatenate([[0], np.cumsum(replay.token_len[flat])])
    data = replay.decode(flat)
    id_list = pa.LargeListArray.from_arrays(pa.array(rows), pa.array(flat)).cast(pa.list_(pa.int32()))
    decoded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(length[rows]), pa.py_buffer(data)]
    ).cast(pa.binary())
    return id_list, decoded


def encode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>, decoded binary)`` for every row, in one pass without a shuffle.

    ``rank_file`` is the content of a file of token ranks; its size is fixed by
    the vocabulary, not by the documents, and it travels with the tasks.
    ``pattern`` is the vocabulary's own, for the texts that Java can't cut.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Characters that Java doesn't know yet are cut by the regex library in the task.
    unknown = text.rlike(r"\p{Cn}")
    cut = docs.select(
        F.col(id_col),
        F.when(~unknown, F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))).alias("pieces"),
        F.when(unknown, text).alias("rest"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern)
        replay = _replay_for(shared.value)
        for batch in batches:
            pieces, rest = batch.column(1), batch.column(2)
            if rest.null_count < len(rest):
                pieces = pa.array(
                    [p if r is None else split.findall(r) for p, r in zip(pieces.to_pylist(), rest.to_pylist(), strict=True)],
                    pieces.type,
                )
            pieces = pieces if pieces.null_count == 0 else pc.fill_null(pieces, [])
            ends, first = pieces.offsets.to_numpy(), 0
            while first < len(pieces):
                last = int(np.searchsorted(ends, ends[first] + PIECES_AT_ONCE, side="right")) - 1
                last = min(len(pieces), max(last, first + 1))
                part = pieces.slice(first, last - first)
                ids, decoded = _encode_part(replay, part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), ids, decoded], ["id", "ids", "decoded"])
                first = last

    kind = docs.schema[id_col].dataType.simpleString()
    return cut.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, rank_file: bytes, ids_col: str = "ids") -> DataFrame:
    """Add ``bytes``: the decoded bytes of each row's ids (null ids: no bytes)."""
    shared = encoded.sparkSession.sparkContext.broadcast(rank_file)

    @F.pandas_udf("binary")
    def run(column):
        replay = _replay_for(shared.value)
        return column.map(lambda ids: b"" if ids is None else replay.decode(np.asarray(ids, np.int64)).tobytes())

    return encoded.withColumn("bytes", run(F.col(ids_col)))


def digests(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """One row per document: number of ids, and digests of the ids and of the decoded bytes."""
    e = encode(docs, rank_file, pattern)
    return e.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
