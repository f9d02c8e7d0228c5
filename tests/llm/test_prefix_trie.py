"""The trie of rebuilt conversations against one plain loop over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from daftar.llm import oracle
from daftar.llm import prefix_trie as T
from daftar.llm.scratch import Scratch

SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), r or "", hashlib.md5((x or "").encode()).digest(), x or ""))
    known = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in known.items():
        h, rest = zlib.crc32(str(c).encode()) % 9, c % 5 if c >= 0 else -(-c % 5)
        rebuilt[c] = known.get(c - rest, [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in children[k])
    ends = lambda k, m: ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends(k, m).encode()).hexdigest())
        for k, m in members.items()
    )


def _found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[:2])


def _rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(40), -1, -3, -7, 63, 64, 1009]:  # 60 and 1005 are absent
        for i in range(rng.choice([1, 2, 5, 9, 14, 30])):
            turn = rng.choice([i, i, i, 3, None])
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]), rng.choice(["yes", "no", "", None, "é🙂", "x" * 50])))
    rows += rows[:25] * 2 + [(None, 1, "user", "lost"), (2, 1000, "user", "long " * 100_000)]
    rows += [(c, i, "user", f"same {i}") for c in range(100, 180) for i in range(12)]  # one large group of copies
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_rebuilt_conversations_equal_a_plain_loop(spark, monkeypatch, block):
    """With small blocks and chunks, so that groups are split everywhere."""
    monkeypatch.setattr(T, "BLOCK", block)
    if block == 3:
        monkeypatch.setattr(T, "CHUNK_BYTES", 60)
        monkeypatch.setattr(T, "CHUNK_ROWS", 2)
    rows = _rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7).selectExpr("*", "1 as at", "2 as i", "3 as depth", "4 as ka", "5 as path", "6 as first", "7 as n")
    assert _found(T.report(frame)) == _plain(rows)


def test_sql_of_ties_nulls_and_repeated_rows(spark):
    rows = [r for r in _rows() if r[0] is None or r[0] < 100]
    conversations = spark.createDataFrame(rows, SCHEMA).toArrow()
    con = duckdb.connect()
    con.register("conversations", conversations)
    found = con.execute(oracle.PREFIX_TRIE)
    names = [c[0] for c in found.description]
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[names.index(c)] for c in order) for r in found.fetchall()), key=lambda r: r[:2]) == _plain(rows)


def test_conversations_without_turns_and_an_empty_table(spark):
    # 7 is shorter than its head of 5, which is absent, so it is rebuilt without turns
    rows = [(7, 0, "user", "a")]
    assert zlib.crc32(b"7") % 9 > 0
    assert _found(T.report(spark.createDataFrame(rows, SCHEMA))) == _plain(rows) == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]
    assert T.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trie_of_given_turns_and_its_light_levels(spark):
    """A balanced tree has as many levels of light paths as it is deep; all are attached."""
    depth = 6
    rows = [(c, d, "r", str(c >> (depth - 1 - d)), 1) for c in range(1 << depth) for d in range(depth)]
    turns = spark.createDataFrame(rows, "conv_id long, place long, role string, text string, bytes long").selectExpr(
        "conv_id", "place", "role", "unhex(md5(text)) as digest", "bytes"
    )
    sizes = turns.groupBy("conv_id").count().withColumnRenamed("count", "size")
    got = {(r.conv_id, r.depth): r for r in T.trie(Scratch(spark, "tree"), sizes, turns).collect()}
    assert len(got) == 2 ** (depth + 1) - 1
    for (_, d), r in got.items():
        assert r.n_leaves == 1 << (depth - d)
        assert r.n_convs == 1 << (depth - d)
        own = (r.n_convs - 1 if d else 0) + sum((1 << (e - d)) * ((1 << (depth - e)) - 1) for e in range(d + 1, depth + 1))
        assert r.saved_tokens == own
