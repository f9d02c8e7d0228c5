"""Byte-level BPE encoding and decoding by contiguous rank arrays, for vocabularies with a list of merges.

Spark cuts texts into pieces with a built-in regular expression; added tokens are taken out of
the text first, as the vocabulary's library does.  A task encodes the distinct pieces of an Arrow batch.
Short words of one length lie in one matrix, a row each: the ids of a word's parts stand side by side,
and beside them the ranks of adjacent parts.  The least rank of every row is found by a scan, its
boundary is deleted by moving the rest of the row up, and the ranks at both sides are looked up anew; a row
leaves when it has no rank left.  Words longer than ``SHORT`` bytes, for which a scan for each merge would
be quadratic, take the same merges from a queue.  No rows are shuffled, memory is bounded by the
batch, and a lost task is simply run again.

Only pairs in the list of merges are joined, so a token that exists but whose parts are not
listed is never made; that is where this differs from ``bpe``, whose ranks are those of whole tokens.

Defined cases: null text is empty; empty text has no ids and decodes to empty text; a very long text is
encoded whole; of equal ranks the leftmost goes first; repeated rows are encoded each for itself; no row is dropped;
an empty table gives an empty one.  Extra columns of any name are left aside.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.bpe import JAVA_PATTERN, PIECES_AT_ONCE, _ranges

#: Bytes of a word that is merged by scans, and words of one length that are merged together.
SHORT, WORDS_AT_ONCE = 48, 1 << 16
_NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it is printable, else one from 256 on."""
    plain = [b for lo, hi in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(lo), ord(hi) + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


def parse(content: bytes) -> dict:
    """What encoding needs of a tokenizer file; anything but plain byte-level BPE is refused."""
    file = json.loads(content)
    model, before = file["model"], file["pre_tokenizer"] or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    odd += [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["normalizer"] * bool(file.get("normalizer")) + ["prefix space"] * bool(before.get("add_prefix_space"))
    if odd or model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True):
        raise ValueError(f"not plain byte-level BPE: {', '.join(odd) or before.get('type')}")
    added = file.get("added_tokens") or []
    if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
        raise ValueError("added tokens that take white space or stand alone are not supported")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return {"vocab": model["vocab"], "merges": merges, "added": {t["content"]: t["id"] for t in added}}


class RankArrays:
    """Encodes many distinct words together; decodes ids."""

    def __init__(self, content: bytes):
        file = parse(content)
        vocab, letters = file["vocab"], byte_alphabet()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.added = {t.encode(): i for t, i in file["added"].items()}
        size = max([*vocab.values(), *file["added"].values()]) + 1
        tokens = [b""] * size
        for t, i in vocab.items():
            tokens[i] = bytes(byte_of[c] for c in t)
        for t, i in self.added.items():
            tokens[i] = t
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)])[:-1]
        self.token_data = np.frombuffer(b"".join(tokens), np.uint8)
        ranks: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(file["merges"]):
            ranks[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])  # of a merge listed twice the later counts
        self.pairs = ranks
        codes = sorted(ranks)
        self.codes = np.array([*codes, 2**62], np.int64)
        self.rank_of = np.array([*(ranks[c][0] for c in codes), _NONE], np.int32)
        self.made = np.empty(len(file["merges"]) + 1, np.int32)
        for rank, token in ranks.values():
            self.made[rank] = token

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``_NONE`` where there is no merge."""
        code = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.rank_of[at], _NONE)

    def _short(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, a row each, and how many of each row count."""
        n, width = part.shape
        out, count = np.zeros((n, width), np.int32), np.full(n, width, np.int64)
        rank = self.ranks(part[:, :-1], part[:, 1:])
        row = np.arange(n)
        while True:
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(row)), at]
            done = least == _NONE
            if done.any():
                out[row[done], : part.shape[1]], count[row[done]] = part[done], part.shape[1]
                part, rank, row, at, least = part[~done], rank[~done], row[~done], at[~done], least[~done]
            if len(row) == 0:
                return out, count
            # every row that is left loses one boundary in a round, so all have the same number of parts
            keep = np.ones(part.shape, bool)
            own = np.arange(len(row))
            keep[own, at + 1] = False
            part[own, at] = self.made[least]
            part = part[keep].reshape(len(row), -1)
            keep = np.ones(rank.shape, bool)
            keep[own, at] = False
            rank = rank[keep].reshape(len(row), -1)
            if rank.shape[1] == 0:
                out[row, :1], count[row] = part, 1
                return out, count
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < rank.shape[1])
            i = at[left]
            rank[left, i - 1] = self.ranks(part[left, i - 1], part[left, i])
            i = at[right]
            rank[right, i] = self.ranks(part[right, i], part[right, i + 1])

    def _long(self, word: bytes) -> list[int]:
        """Ids of one word by a queue of ranks over linked parts."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before, pairs = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1)), self.pairs
        queue = [(pairs[c][0], i, c) for i in range(len(ids) - 1) if (c := ids[i] << 32 | ids[i + 1]) in pairs]
        heapq.heapify(queue)
        while queue:
            _, i, code = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0 or ids[i] << 32 | ids[j] != code:
                continue
            ids[i], ids[j] = pairs[code][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (c := ids[i] << 32 | ids[k]) in pairs:
                    heapq.heappush(queue, (pairs[c][0], i, c))
            if (h := before[i]) >= 0 and (c := ids[h] << 32 | ids[i]) in pairs:
                heapq.heappush(queue, (pairs[c][0], h, c))
        return [x for x in ids if x >= 0]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids begin (one more for the end)."""
        length = np.array([len(w) for w in words], np.int64)
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, ids of each in a row, how many of them
        whole = np.array([w in self.added for w in words], bool)
        for size in np.unique(length[~whole & (length > 0) & (length <= SHORT)]).tolist():
            own = np.flatnonzero((length == size) & ~whole)
            for i in range(0, len(own), WORDS_AT_ONCE):
                some = own[i : i + WORDS_AT_ONCE]
                data = np.frombuffer(b"".join([words[k] for k in some.tolist()]), np.uint8).reshape(len(some), size)
                ids, n = self._short(self.byte_ids[data]) if size > 1 else (self.byte_ids[data], np.ones(len(some), np.int64))
                counts[some] = n
                parts.append((some, ids, n))
        for k in np.flatnonzero(whole | (length > SHORT)).tolist():
            ids = np.array([self.added[words[k]]] if whole[k] else self._long(words[k]), np.int32)
            counts[k] = len(ids)
            parts.append((np.array([k]), ids[None, :], np.array([len(ids)])))
        begin = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(begin[-1]), np.int32)
        for some, ids, n in parts:
            out[_ranges(begin[some], n, int(n.sum()))] = ids[np.arange(ids.shape[1]) < n[:, None]]
        return out, begin

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids in a row."""
        length = self.token_len[ids]
        total = int(length.sum())
        return self.token_data[_ranges(self.token_at[ids], length, total)].tobytes() if total else b""


@lru_cache(maxsize=2)
def _arrays(content: bytes) -> RankArrays:
    return RankArrays(content)


def pieces(text: Column, added: list[str]) -> Column:
    """The pieces of a text, added tokens as pieces of their own."""
    cut = lambda t: F.regexp_extract_all(t, F.lit(JAVA_PATTERN), F.lit(0))
    if not added:
        return cut(text)
    apart = F.lit("|".join(_quoted(t) for t in sorted(added, key=len, reverse=True)))
    found = F.regexp_extract_all(text, apart, F.lit(0))
    between = F.split(text, apart, -1)
    each = F.transform(between, lambda t, i: F.when(i == 0, cut(t)).otherwise(F.concat(F.slice(found, i, F.lit(1)), cut(t))))
    return F.when(F.rlike(text, apart), F.flatten(each)).otherwise(cut(text))


def _quoted(token: str) -> str:
    """A literal in the notation that Java's and Python's regular expressions share."""
    return "".join(c if c.isalnum() or c == "_" else f"\\{c}" if c.isascii() else c for c in token)


def _cut_here(text: str, added: list[str]) -> list[str]:
    """``pieces`` in the task, for characters that Java doesn't know yet."""
    import regex

    split = regex.compile(JAVA_PATTERN)
    if not added:
        return split.findall(text)
    out: list[str] = []
    for i, part in enumerate(regex.split(f"({'|'.join(_quoted(t) for t in sorted(added, key=len, reverse=True))})", text)):
        out += [part] if i % 2 else split.findall(part)
    return out


def encode(docs: DataFrame, tokenizer_file: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>, decoded string)`` for every row, in one pass without a shuffle; ``decoded`` is made from the ids alone.

    ``tokenizer_file`` is the content of a tokenizer's JSON file; its size is fixed by the vocabulary, not by
    the documents, and it travels with the tasks.
    """
    added = list(parse(tokenizer_file)["added"])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    unknown = text.rlike(r"\p{Cn}")
    cut = docs.select(F.col(f"`{id_col}`").alias("id"), F.when(~unknown, pieces(text, added)).alias("pieces"), F.when(unknown, text).alias("rest"))
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = _arrays(shared.value)
        for batch in batches:
            column, rest = batch.column(1), batch.column(2)
            if rest.null_count < len(rest):
                rows = zip(column.to_pylist(), rest.to_pylist(), strict=True)
                column = pa.array([p if r is None else _cut_here(r, added) for p, r in rows], column.type)
            ends, first = column.offsets.to_numpy(), 0
            while first < len(column):
                last = int(np.searchsorted(ends, ends[first] + PIECES_AT_ONCE, side="right")) - 1
                last = min(len(column), max(last, first + 1))
                ids, decoded = _encode_rows(arrays, column.slice(first, last - first))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), ids, decoded], ["id", "ids", "decoded"])
                first = last

    kind = docs.schema[id_col].dataType.simpleString()
    return cut.mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def _encode_rows(arrays: RankArrays, rows: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """Ids and decoded text of each row of pieces."""
    offsets = rows.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(rows.flatten())
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, at = arrays.encode([w.encode() for w in coded.dictionary.to_pylist()])
    count = np.diff(at)[index]
    ends = np.concatenate([[0], np.cumsum(count)])
    flat = ids[_ranges(at[:-1][index], count, int(ends[-1]))] if ends[-1] else np.zeros(0, np.int32)
    begin = ends[offsets - offsets[0]]
    places = np.concatenate([[0], np.cumsum(arrays.token_len[flat])])[begin]
    data = arrays.decode(flat)
    texts = [data[a:b].decode(errors="replace") for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
    return pa.LargeListArray.from_arrays(pa.array(begin), pa.array(flat)).cast(pa.list_(pa.int32())), pa.array(texts, pa.string())


def decode(encoded: DataFrame, tokenizer_file: bytes, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded``: the text of each row's ids (null ids: empty); bytes that are no UTF-8 become U+FFFD."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_file)

    @F.pandas_udf("string")
    def run(column):
        arrays = _arrays(shared.value)
        return column.map(lambda ids: "" if ids is None else arrays.decode(np.asarray(ids, np.int64)).decode(errors="replace"))

    return encoded.withColumn("decoded", run(F.col(f"`{ids_col}`")))


def digests(docs: DataFrame, tokenizer_file: bytes) -> DataFrame:
    """One row per document: number of ids, and digests of the ids and of the decoded text."""
    return encode(docs, tokenizer_file).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
