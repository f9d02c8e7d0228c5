"""Prefix trie of conversations, its subtrees summed by heavy-path decomposition.

``rebuild`` gives conversations their turns; ``trie`` turns any table of numbered turns into one row per node.

* Turns are numbered by a sort in ranges, so a conversation may lie in many tasks; only a row for each
  conversation and task is then added up.  Texts stay where they are: a turn is its role and the digest of its text.
* A node is named by sums of 64-bit hashes of (place, role, digest) over its prefix, 128 bits in all.  Such sums
  run in blocks of ``BLOCK`` turns with the blocks before added, so the longest conversation is no longer group than that.
* The heavy child of a node is the one with most members.  A path of heavy children runs down to one
  leaf and is a stretch of the turns of that leaf's smallest member, so paths are found by one join and a maximum;
  the path's level is the number of light steps above it, at most log2 of the conversations.
* Level by level from below, sums of whole paths are attached to the parents of their tops; then suffix
  sums along each path, in blocks, give every node its subtree.
* Ids of conversations that end at one node are hashed as a stream of chunks that tasks have joined in order before.

Defined cases: rows without conv_id take no part; null turn is first, turns of equal number are ordered by role, then by
the text's digest, and repeated rows are turns of their own; null role or text is empty; very long texts and
conversations count whole; equal members go to the child with the smallest conversation; an empty table has
no members, so not even a root.  Extra columns of any name are left aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.llm.scratch import Scratch

#: Conversations whose first one lends turns to the others, and the number of turns lent is below ``LENT``.
TOGETHER, LENT = 5, 9
#: Turns of a conversation, or nodes of a path, that are one group.
BLOCK = 4096
#: Bytes of joined ids in a chunk, and chunks that Python is given at once.
CHUNK_BYTES, CHUNK_ROWS = 1 << 16, 256

_SUMS = ("s1", "s2", "s3", "s4")
_KEY = ("ka", "kb")


def numbered(scratch: Scratch, conversations: DataFrame) -> DataFrame:
    """``(conv_id, i, role, digest, bytes)``: turns of each conversation in order, i from 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.unhex(F.md5(text)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )
    narrow = scratch.write(turns)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]
    laid = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = scratch.write(laid.drop("turn").withColumn("task", F.shiftright("at", 33)))
    scratch.drop(narrow)
    parts = laid.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = scratch.write(parts.withColumn("before", before).where("before > 0").drop("n"))  # as many rows as tasks at most
    own = F.row_number().over(Window.partitionBy("conv_id", "task").orderBy("at")) - 1
    rows = laid.withColumn("own", own).join(later, ["conv_id", "task"], "left")
    out = scratch.write(rows.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("i"), "role", "digest", "bytes"))
    scratch.drop(laid, later)
    return out


def lent(conv_id: Column) -> Column:
    """How many turns a conversation gets from the first of its group."""
    return F.crc32(conv_id.cast("string").cast("binary")) % LENT


def rebuild(scratch: Scratch, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, size)`` and ``(conv_id, place, role, digest, bytes)``: conversations with the head of their group's first one."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = scratch.write(sizes.withColumn("first", F.col("conv_id") - F.col("conv_id") % TOGETHER).withColumn("h", lent(F.col("conv_id"))))
    has = sizes.where("conv_id = first").select("first", F.col("n").alias("n_first"))
    sizes = sizes.join(has, "first", "left").withColumn("got", F.least("h", F.coalesce("n_first", F.lit(0))))
    sizes = sizes.withColumn("size", F.col("got") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    sizes = scratch.write(sizes.select("conv_id", "first", "h", "got", "size"))
    heads = turns.where((F.col("i") < LENT - 1) & (F.col("conv_id") % TOGETHER == 0)).withColumnRenamed("conv_id", "first")
    own = turns.where(F.col("i") >= lent(F.col("conv_id")))
    moved = sizes.where("got != h").select("conv_id", (F.col("h") - F.col("got")).alias("up"))
    of = ["role", "digest", "bytes"]
    rows = own.join(moved, "conv_id", "left").select("conv_id", (F.col("i") - F.coalesce("up", F.lit(0))).alias("place"), *of)
    head = heads.join(sizes.select("first", "conv_id", "got"), "first").where("i < got").select("conv_id", F.col("i").alias("place"), *of)
    return sizes.select("conv_id", "size"), rows.union(head)


def _running(rows: DataFrame, by: list[str], order: Column, block: Column, names: tuple[str, ...], upwards: bool = False) -> DataFrame:
    """Sums of columns up to each row in the order of a group, blocks of it being groups of their own; no group is held whole."""
    rows = rows.withColumn("block", block)
    inside = Window.partitionBy(*by, "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(F.desc("block") if upwards else F.asc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "block").agg(*(F.sum(c).alias(c) for c in names), F.count("*").alias("n"))
    sums = sums.select(*by, "block", F.sum("n").over(earlier).alias("n"), *(F.sum(c).over(earlier).alias(f"{c}_before") for c in names)).where("n > 0").drop("n")
    out = rows.withColumns({c: F.sum(c).over(inside) for c in names}).join(sums, [*by, "block"], "left")
    return out.withColumns({c: F.col(c) + F.coalesce(f"{c}_before", F.lit(0)) for c in names}).drop("block", *(f"{c}_before" for c in names))


def _name(sums: list[Column], depth: Column) -> list[Column]:
    return [F.xxhash64(depth, sums[0], sums[1]), F.xxhash64(depth, sums[2], sums[3])]


def prefixes(scratch: Scratch, sizes: DataFrame, turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, ka, kb, pa, pb, bytes, ends)``: a row for each conversation and prefix, with names of the node and its parent."""
    own = [F.xxhash64(F.lit(k), "place", "role", "digest") for k in (1, 2)]
    halves = [x for c in own for x in (F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF)))]
    rows = turns.withColumns({**dict(zip(_SUMS, halves, strict=True)), **{f"own_{s}": h for s, h in zip(_SUMS, halves, strict=True)}}).drop("role", "digest")
    rows = _running(rows, ["conv_id"], F.col("place"), F.floor(F.col("place") / BLOCK), _SUMS)
    depth = F.col("place") + 1
    here, above = _name([F.col(s) for s in _SUMS], depth), _name([F.col(s) - F.col(f"own_{s}") for s in _SUMS], depth - 1)
    names = [c.alias(k) for c, k in zip([*here, *above], ("ka", "kb", "pa", "pb"), strict=True)]
    out = rows.join(sizes, "conv_id").select("conv_id", depth.alias("depth"), *names, "bytes", (depth == F.col("size")).alias("ends"))
    zero, none = _name([F.lit(0).cast("long")] * 4, F.lit(0).cast("long")), F.lit(None).cast("long")
    root = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), *(c.alias(k) for c, k in zip(zero, _KEY, strict=True)),
                        none.alias("pa"), none.alias("pb"), F.lit(0).cast("long").alias("bytes"), (F.col("size") == 0).alias("ends"))
    return scratch.write(out.union(root))


def _with_parents(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Nodes (conv_id, depth, ka, kb, n_convs, bytes) with their parent's conv_id, number of children, and whether they are the heavy child."""
    nodes = rows.groupBy("depth", *_KEY, "pa", "pb").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("bytes").alias("bytes"))
    nodes = scratch.write(nodes)
    best = F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id")))
    below = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"), best.alias("heavy_id"))
    nodes = nodes.join(below, list(_KEY), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy_id").alias("chosen"))
    out = nodes.drop("heavy_id").join(parents, ["pa", "pb"], "left")
    return scratch.write(out.withColumn("heavy", F.coalesce(F.col("chosen") == F.col("conv_id"), F.lit(False))).drop("pa", "pb", "chosen"))


def _with_paths(scratch: Scratch, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with the heavy path that they lie on, named by the smallest conversation of its leaf, the depth of its top, and its level."""
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"))
    walk = rows.select(F.col("conv_id").alias("path"), "depth", *_KEY).join(leaves, "path", "left_semi")
    values = nodes.select(*_KEY, F.col("conv_id").alias("conv_id"), "heavy")
    deep, root = walk.where("depth > 0").join(values, list(_KEY)), walk.where("depth = 0").crossJoin(F.broadcast(values.join(rows.where("depth = 0").select(*_KEY).limit(1), list(_KEY)).select("conv_id", "heavy")))
    walk = scratch.write(deep.select("path", "depth", "conv_id", "heavy").unionByName(root.select("path", "depth", "conv_id", "heavy")))
    light = F.when(~F.col("heavy"), F.col("depth"))
    tops = walk.groupBy("path").agg(F.max(light).alias("top"), (F.count(light) - 1).alias("level"))
    on = walk.drop("heavy").join(tops, "path").where("depth >= top")
    out = scratch.write(nodes.join(on, ["conv_id", "depth"]).drop(*_KEY, "heavy"))
    scratch.drop(walk)
    return out


def _with_subtrees(scratch: Scratch, nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Nodes with sums of the given values over their subtrees."""
    names = tuple(values)
    nodes = nodes.withColumns(values)
    totals = nodes.groupBy("path").agg(*(F.sum(c).alias(c) for c in names))
    on = nodes.select(F.col("conv_id").alias("up_id"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
    tops = nodes.where("depth = top and depth > 0").select("path", "level", F.col("parent_conv_id").alias("up_id"), (F.col("depth") - 1).alias("up_depth"))
    paths = scratch.write(tops.join(on, ["up_id", "up_depth"]).join(totals, "path"))
    deepest = paths.agg(F.max("level").alias("level")).first().level or 0
    rounds: list[DataFrame] = []
    for level in range(deepest, 0, -1):  # at most log2 of the conversations
        own = paths.where(F.col("level") == level)
        if rounds:
            got = rounds[-1].groupBy(F.col("up_path").alias("path")).agg(*(F.sum(c).alias(f"{c}_got") for c in names))
            own = own.join(got, "path", "left").withColumns({c: F.col(c) + F.coalesce(f"{c}_got", F.lit(0)) for c in names})
        rounds.append(scratch.write(own.select("up_id", "up_depth", "up_path", *names)))
    if rounds:
        attached = reduce(DataFrame.union, rounds).groupBy(F.col("up_id").alias("conv_id"), F.col("up_depth").alias("depth"))
        nodes = nodes.join(attached.agg(*(F.sum(c).alias(f"{c}_got") for c in names)), ["conv_id", "depth"], "left")
        nodes = nodes.withColumns({c: F.col(c) + F.coalesce(f"{c}_got", F.lit(0)) for c in names}).drop(*(f"{c}_got" for c in names))
    return _running(nodes, ["path"], F.desc("depth"), F.floor(F.col("depth") / BLOCK), names, upwards=True)


def id_digests(scratch: Scratch, ends: DataFrame) -> DataFrame:
    """``(ka, kb, ends_sha256)``: SHA-256 of the comma-joined, ascending ids of the rows (ka, kb, conv_id) of each key.

    Tasks of a sort in ranges join runs of ids to chunks; a key's chunks are then hashed in order, as they come.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb, ids = (np.asarray(batch.column(i)) for i in range(3))
            cuts = np.flatnonzero((ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])) + 1 if len(ids) else []
            keys, firsts, chunks = [], [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                for i in range(lo, hi, CHUNK_BYTES // 20):
                    keys.append(i)
                    firsts.append(ids[i])
                    chunks.append(",".join(map(str, ids[i : min(hi, i + CHUNK_BYTES // 20)].tolist())).encode())
            columns = [pa.array(ka[keys]), pa.array(kb[keys]), pa.array(firsts, pa.int64()), pa.array(chunks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*_KEY, "first", "chunk"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for *own, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(chunk)
                else:
                    state.update(b"," + chunk)
            yield _digest_rows(done)
        if key is not None:
            yield _digest_rows([(*key, state.hexdigest())])

    order = [*_KEY, "conv_id"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "ka long, kb long, first long, chunk binary")
    runs = scratch.write(runs)
    laid = runs.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return scratch.write(laid.mapInArrow(hashed, "ka long, kb long, ends_sha256 string"), CHUNK_ROWS)


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*_KEY, "ends_sha256"])


def trie(scratch: Scratch, sizes: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, size) with turns (conv_id, place, role, digest, bytes)."""
    rows = prefixes(scratch, sizes, turns)
    nodes = _with_parents(scratch, rows)
    digests = id_digests(scratch, rows.where("ends"))
    none = hashlib.sha256(b"").hexdigest()
    ended = nodes.select("conv_id", "depth", *_KEY).join(digests, list(_KEY)).drop(*_KEY)
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    summed = _with_subtrees(scratch, _with_paths(scratch, rows, nodes), {"n_leaves": leaf, "saved_tokens": saved})
    out = summed.join(ended, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
    out = scratch.write(out)
    scratch.drop_all_but(out)
    return out


def report(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    scratch = Scratch(conversations.sparkSession, "trie")
    sizes, turns = rebuild(scratch, numbered(scratch, conversations))
    return trie(scratch, sizes, turns)
