"""Near-duplicates by BagMinHash signatures of word shingles, banded and verified exactly.

A document is the multiset of its five-word shingles (words as in ``arrowtext``; a text
of fewer words is one shingle).  Similarity is the weighted Jaccard coefficient of
multisets.  BagMinHash draws, for each shingle, points of Poisson processes over
discretised weights: one process for weights up to 1, one for each further doubling,
whose points are then placed within the doubling and dropped above the shingle's
own weight.  Each point falls into one of ``REGISTERS`` registers, the earliest point of
a register is its signature value, and two signatures agree in a register with
the probability of the similarity.  A process ends when it is later than every register.

Registers are banded; documents that agree in a band are candidates.  No bucket is expanded into
all its pairs.  Its members are compared with one hub, the member nearest to what most of
them agree on, and components are formed.  Only members outside a bucket's main component
are looked at further: their sketches meet the bucket's others in blocks of bounded size,
inside tasks.  Members whose sketches leave a link possible meet once more, now with their texts,
and are compared there, the likeliest first, until each is linked to each other component or
can't be.  So rows are made for members and links, never for pairs.  A link counts only after
whole multisets have been compared, and none between components is left out but by chance: a pair
at the threshold misses all bands, or is ruled out by sketches, with a chance of 6e-8, and pairs
above it more seldom.

Exact copies are one node from the start, so is any text however often it occurs.
Large tables always meet tables with one row a key, which lets hot keys be split.
Texts, shingles and bands are told apart by 64-bit hashes (shingles within a task by 48 bits).

Defined cases: texts that are equal, empty ones too, share a class; otherwise a text without
words has no links; null text is a class by itself; repeated rows are copies; a very long text
counts whole; an empty table gives an empty one.  Of a class the row with the smallest id stays, of
equal ids the text with the smallest hash, of equal rows any one; a null id comes last.  Extra
columns of any name pass through ``keep_one`` and don't reach ``report``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.arrowtext import Slice, grams, mix, slices, words
from daftar.llm.components import connected_components
from daftar.llm.scratch import Scratch, settings

SHINGLE = 5
REGISTERS, ROWS = 128, 4
#: At 0.8 a pair misses all 32 bands with a chance of 5e-8.
BANDS = REGISTERS // ROWS
#: Similarity from which documents are near-duplicates, in tenths.
TENTHS = 8
#: Registers of the sketches of documents that share a band; a byte of each is kept.
FINE_REGISTERS = 512
#: A pair whose sketches agree in fewer registers isn't compared.  It lies 5.7 standard errors below the
#: threshold, so a pair at 0.8 is lost with a chance of 1e-8, less than the bands lose.
LEAST_AGREEING = 0.70
#: Members of a bucket in a block, and bytes of their texts where it holds texts (a longer text is a block alone, about).
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Rows given to Python at once: texts to sign, pairs of blocks of sketches (0.8 MB each) or of texts, and pairs of texts.
#: ``Scratch.write`` bounds the bytes of these too: a long hub beside each of 256 members is far more than a batch.
SIGNED_ROWS, BLOCK_ROWS, TEXT_BLOCK_ROWS, TEXT_ROWS = 2048, 16, 2, 256
#: Blocks with texts that a task gathers side by side in memory; beyond that it sorts rows and gathers one block at a time.
HELD_BLOCKS = 8
_ELEMENT_BITS = np.uint64(48)


def shingles(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a slice's rows: row, element, times.  A slice has fewer than 65,536 rows."""
    w = words(part)
    n = np.diff(w.rows)
    row = np.repeat(np.arange(len(n)), n)
    g = grams(w.hash, SHINGLE)
    last = np.repeat(w.rows[1:], n) - SHINGLE
    full = np.arange(len(row)) <= last
    for r in np.flatnonzero((n > 0) & (n < SHINGLE)):
        at = w.rows[r]
        g[at] = grams(w.hash[at : at + n[r]], int(n[r]))[0]
        full[at] = True
    key = (row[full].astype(np.uint64) << _ELEMENT_BITS) | (g[full] >> (np.uint64(64) - _ELEMENT_BITS))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> _ELEMENT_BITS).astype(np.int64), key & ((np.uint64(1) << _ELEMENT_BITS) - np.uint64(1)), times


def signatures(row: np.ndarray, element: np.ndarray, times: np.ndarray, n_rows: int, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash of weighted sets: for each row and register the hash of its earliest point (0 if the row is empty)."""
    first = np.full(n_rows * registers, np.inf)
    winner = np.zeros(n_rows * registers, np.uint64)
    latest = np.full(n_rows, np.inf)
    # one process for weights (0, 1], one for each (2**(b-1), 2**b]
    top = np.ceil(np.log2(times)).astype(np.int64)
    which = np.repeat(np.arange(len(row)), top + 1)
    block = np.arange(len(which)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    row, weight = row[which], times[which]
    below = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)  # weights of the block are below+1 .. below+width
    width = np.maximum(below, 1)
    state = mix(element[which] * np.uint64(0x9E3779B97F4A7C15) + block.astype(np.uint64) + np.uint64(1))
    time = np.zeros(len(row))
    while len(row):
        state = mix(state + np.uint64(0xD1B54A32D192ED03))
        time = time - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        alive = time < latest[row]
        if not alive.all():
            row, weight, below, width, state, time = (x[alive] for x in (row, weight, below, width, state, time))
        if len(row) == 0:
            break
        draw = mix(state ^ np.uint64(0x2545F4914F6CDD1D))
        register = row * registers + (draw % np.uint64(registers)).astype(np.int64)
        # halving the block again and again picks one of its unit weights
        level = below + 1 + ((draw >> np.uint64(16)) & (width - 1).astype(np.uint64)).astype(np.int64)
        within = level <= weight
        at, t, s = (register, time, state) if within.all() else (register[within], time[within], state[within])
        np.minimum.at(first, at, t)
        won = t == first[at]
        winner[at[won]] = s[won]
        latest = first.reshape(n_rows, registers).max(axis=1)
    return winner.reshape(n_rows, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.shape[1] // ROWS
    parts = signature.reshape(len(signature), bands, ROWS)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return acc.view(np.int64)


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
    return batch.take(pa.array(first))


def _signatures_of(batches: Iterator[pa.RecordBatch], registers: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Signatures of the distinct texts with words in batches of (ref, text): refs and registers."""
    for whole in batches:
        for lo in range(0, len(whole), 1 << 13):
            batch = _distinct(whole.slice(lo, 1 << 13))
            for part in slices(batch.column(1)):
                row, element, times = shingles(part)
                some = np.unique(row)
                if len(some):
                    yield batch.column(0).take(pa.array(part.first + some)), signatures(np.searchsorted(some, row), element, times, len(some), registers)


def _signed(texts: DataFrame) -> DataFrame:
    """``(ref, bands)``: the band keys of each batch's distinct texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for refs, sig in _signatures_of(batches, REGISTERS):
            at = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([refs, pa.ListArray.from_arrays(at, pa.array(band_keys(sig).ravel()))], ["ref", "bands"])

    return texts.select("ref", "text").mapInArrow(run, "ref long, bands array<long>")


def _sketched(texts: DataFrame) -> DataFrame:
    """``(ref, sketch)``: a byte of each register of a finer signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for refs, sig in _signatures_of(batches, FINE_REGISTERS):
            low = (sig & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([refs, pa.array([x.tobytes() for x in low], pa.binary())], ["ref", "sketch"])

    return texts.select("ref", "text").mapInArrow(run, "ref long, sketch binary")


def _agreeing(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule out the threshold."""
    left = sketches.select(F.col("ref").alias("a"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col("ref").alias("b"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(batch), -1) for i in (2, 3))
            keep = (one == two).mean(axis=1) >= LEAST_AGREEING
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


Bag = tuple[np.ndarray, np.ndarray]


def _bag(text: str) -> Bag:
    raw = np.frombuffer(text.encode(), np.uint8)
    _, element, times = shingles(Slice(0, 1, raw, np.array([0, len(raw)], np.int64)))
    return element, times


def _overlap_enough(one: Bag, two: Bag) -> bool:
    (x, nx), (y, ny) = one, two
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(nx[i], ny[j]).sum())
    union = int(nx.sum() + ny.sum()) - both
    return 10 * both >= TENTHS * union and union > 0


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle multisets overlap enough, by comparing them whole."""
    left = texts.select(F.col("ref").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("ref").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[int, Bag]] = {}
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(*(batch.column(side).to_pylist() for side in "ab"), strict=True)):
                for side, ref in (("a", a), ("b", b)):  # a hub comes many times in a row
                    if side not in held or held[side][0] != ref:
                        held[side] = (ref, _bag(batch.column("t" + side)[i].as_py()))
                keep.append(_overlap_enough(held["a"][1], held["b"][1]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, known: DataFrame, fields: list[str]) -> DataFrame:
    """Members of buckets (key, ref, component, weight), with fields of ``known``, in blocks (key, block, rows) of a weight of about 1."""
    counts = members.groupBy("key").agg(F.ceil(F.sum("weight")).alias("n"))
    block = F.pmod(F.xxhash64("ref"), F.col("n"))
    rows = members.join(counts, "key").select("key", "ref", "component", block.alias("block")).join(known.select("ref", *fields), "ref")
    return rows.groupBy("key", "block").agg(F.collect_list(F.struct("ref", "component", *fields)).alias("rows"))


def _sketches(members: pa.StructArray) -> np.ndarray:
    return np.frombuffer(b"".join(members.field("sketch").to_pylist()), np.uint8).reshape(len(members), -1)


def _hubs(blocks: DataFrame) -> DataFrame:
    """``(key, hub, component)``: in a block of each bucket, the member that agrees most with what most members have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hubs, parts = [], []
            for rows in batch.column(1):
                members = rows.values
                sketch, refs = _sketches(members), members.field("ref").to_numpy()
                common = np.zeros(sketch.shape[1], np.uint8)
                for r in range(sketch.shape[1] if len(sketch) > 2 else 0):
                    common[r] = np.bincount(sketch[:, r], minlength=256).argmax()
                near = (sketch == common).sum(1) if len(sketch) > 2 else np.zeros(len(sketch))
                best = np.lexsort((refs, -near))[0]
                hubs.append(int(refs[best]))
                parts.append(members.field("component")[int(best)].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hubs, pa.int64()), pa.array(parts, pa.int64())], ["key", "hub", "hub_component"])

    return blocks.where("block = 0").select("key", "rows").mapInArrow(run, "key long, hub long, hub_component long")


class _Met:
    """Two blocks of a bucket that meet: which pairs of different components their sketches leave possible.

    A pair comes from the first band in which it agrees.
    """

    def __init__(self, key: int, left: pa.ListScalar, right: pa.ListScalar):
        self.one, self.two = left.values, right.values
        self.refs, self.others = (m.field("ref").to_numpy() for m in (self.one, self.two))
        self.component, self.of = (m.field("component").to_numpy() for m in (self.one, self.two))
        self.sketch, self.sketches = _sketches(self.one), _sketches(self.two)
        self.bands, self.in_bands = (np.stack(m.field("bands").to_numpy(zero_copy_only=False)) for m in (self.one, self.two))
        self.band = int(np.flatnonzero(self.bands[0] == key)[0])

    def possible(self, i: int) -> np.ndarray:
        """Places of the other block that may be linked to member i, the likeliest first."""
        agree = (self.sketches == self.sketch[i]).mean(1)
        ok = (agree >= LEAST_AGREEING) & (self.of != self.component[i])
        ok[ok] &= ~(self.in_bands[ok, : self.band] == self.bands[i, : self.band]).any(1)
        at = np.flatnonzero(ok)
        return at[np.lexsort((self.others[at], -agree[at]))]


def _meeting(outside: DataFrame, every: DataFrame) -> DataFrame:
    return outside.select("key", F.col("rows").alias("left")).join(every.select("key", F.col("rows").alias("right")), "key")


def _possible(outside: DataFrame, every: DataFrame) -> DataFrame:
    """Members (key, ref) of buckets that sketches leave a link possible for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                met = _Met(key, left, right)
                found = [met.possible(i) for i in range(len(met.refs))]
                refs = np.concatenate([met.refs[[len(x) > 0 for x in found]], met.others[np.unique(np.concatenate(found))]])
                if len(refs):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(refs), key)), pa.array(refs)], ["key", "ref"])

    return _meeting(outside, every).mapInArrow(run, "key long, ref long").distinct()


def _linked(outside: DataFrame, every: DataFrame) -> DataFrame:
    """Links (a, b) from members of blocks with texts to others, at least one to each component that there is one to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                met, found = _Met(key, left, right), []
                texts, bags = met.two.field("text"), {}
                for i in range(len(met.refs)):
                    own, done = None, set()
                    for j in met.possible(i).tolist():
                        if met.of[j] in done:  # its component is joined to this member already
                            continue
                        own = own or _bag(met.one.field("text")[i].as_py())
                        if j not in bags:
                            bags[j] = _bag(texts[j].as_py())
                        if _overlap_enough(own, bags[j]):
                            done.add(met.of[j])
                            found.append(sorted((int(met.refs[i]), int(met.others[j]))))
                if found:
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _meeting(outside, every).mapInArrow(run, "a long, b long").distinct()


def links(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of the distinct texts (ref, text) that have a near-duplicate; every other table of ``scratch`` is dropped."""
    found = _links(texts, scratch)
    scratch.drop_all_but()
    return found


def _links(texts: DataFrame, scratch: Scratch) -> DataFrame:
    signed = scratch.write(_signed(texts), SIGNED_ROWS)
    bands = signed.select("ref", F.explode("bands").alias("key"))
    crowded = bands.groupBy("key").agg(F.min("ref").alias("low"), F.max("ref").alias("high")).where("low != high")
    members = scratch.write(bands.join(crowded.select("key"), "key", "left_semi").distinct())
    involved = members.select("ref").distinct()
    known = texts.join(involved, "ref", "left_semi").mapInArrow(lambda it: (_distinct(b) for b in it), "ref long, text string")
    known = scratch.write(known.groupBy("ref").agg(F.min("text").alias("text")), SIGNED_ROWS)
    one_each = signed.join(involved, "ref", "left_semi").groupBy("ref").agg(F.first("bands").alias("bands"))
    sketched = scratch.write(_sketched(known).join(one_each, "ref"), SIGNED_ROWS)
    scratch.drop(signed)

    alone = members.withColumn("component", F.col("ref")).withColumn("weight", F.lit(1 / BLOCK))
    hubs = _hubs(_blocks(alone, sketched, ["sketch"]))
    pairs = members.join(hubs, "key").where("ref != hub").select(F.least("ref", "hub").alias("a"), F.greatest("ref", "hub").alias("b"))
    pairs = scratch.write(_agreeing(pairs.distinct(), sketched))
    near_hub = scratch.write(_alike(pairs, known), TEXT_ROWS)
    scratch.drop(pairs)
    found = connected_components(near_hub, "a", "b")

    # buckets that still hold several components: members outside the main one may be linked to others
    placed = members.join(found.withColumnRenamed("node", "ref"), "ref", "left").withColumn("component", F.coalesce("component", "ref"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("several")).where("several > 1")
    placed = scratch.write(placed.join(main, "key").select("key", "ref", "component", (F.col("component") != F.col("main")).alias("outside")))
    if placed.isEmpty():
        return found
    light = placed.withColumn("weight", F.lit(1 / BLOCK))
    fields = ["sketch", "bands"]
    left = scratch.write(_possible(_blocks(light.where("outside"), sketched, fields), _blocks(light, sketched, fields)), BLOCK_ROWS)
    if left.isEmpty():
        return found
    sized = known.select("ref", F.greatest(F.lit(1 / BLOCK), F.octet_length("text") / BLOCK_BYTES).alias("weight"))
    heavy = scratch.write(placed.join(left, ["key", "ref"]).join(sized, "ref"))
    whole = sketched.join(known, "ref")
    fields.append("text")
    with settings(texts.sparkSession, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(HELD_BLOCKS)}):
        more = scratch.write(_linked(_blocks(heavy.where("outside"), whole, fields), _blocks(heavy, whole, fields)), TEXT_BLOCK_ROWS)
    return connected_components(near_hub.unionByName(more), "a", "b")


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``ref``, and a row a distinct text: (ref, first, size, class_id, class_size, kept_ref)."""
    own = docs.withColumn("ref", F.xxhash64(F.col(text_col)))
    some = own.where(F.col(text_col).isNotNull())
    found = links(some.select("ref", F.col(text_col).alias("text")), Scratch(docs.sparkSession, "near"))
    each = some.groupBy("ref").agg(F.min(id_col).alias("first"), F.count("*").alias("size"))
    each = each.join(found.withColumnRenamed("node", "ref"), "ref", "left").withColumn("component", F.coalesce("component", "ref"))
    order = F.struct(F.col("first").isNull(), F.col("first"), F.col("ref"))
    whole = each.groupBy("component").agg(
        F.min("first").alias("class_id"), F.sum("size").alias("class_size"), F.min_by("ref", order).alias("kept_ref")
    )
    return own, each.join(whole, "component").drop("component")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, class_id, class_size)`` for every row: the smallest id of its class of near-duplicates, and its rows."""
    own, classes = _classes(docs.select(id_col, text_col), id_col, text_col)
    rows = own.select(id_col, F.when(F.col(text_col).isNotNull(), F.col("ref")).alias("ref"))
    joined = rows.where("ref is not null").join(classes.select("ref", "class_id", "class_size"), "ref")
    alone = rows.where("ref is null").select(id_col, F.col(id_col).alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return joined.select(id_col, "class_id", "class_size").unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: the one with the smallest id.  Rows with null text all stay."""
    columns = docs.columns
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own, classes = _classes(inner, "id", "text")
    best = classes.where("ref = kept_ref").select(F.col("ref").alias("r"), F.col("first").alias("f"))
    texts = own.where("text is not null")
    chosen = texts.join(best, (F.col("ref") == F.col("r")) & F.col("id").eqNullSafe(F.col("f"))).drop("r", "f")
    again = texts.groupBy("ref", "id").count().where("count > 1").select(F.col("ref").alias("r"), F.col("id").alias("f"))
    same = (F.col("ref") == F.col("r")) & F.col("id").eqNullSafe(F.col("f"))
    single = chosen.join(again, same, "left_anti")
    repeated = chosen.join(again, same, "left_semi").dropDuplicates(["ref"])
    out = single.unionByName(repeated).unionByName(own.where("text is null"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
