"""Near-duplicates: every link of a whole table, links outside a bucket's hub, texts in several blocks, and clashing names."""

import collections
import random
import re

import numpy as np

from daftar.llm import near_duplicates as N

DATA = "/root/testdata/sf0.01/documents.parquet"


def _bag(text: str) -> collections.Counter:
    w = re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text.lower())
    return collections.Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def links(texts: list[str | None]) -> list[tuple[int, int]]:
    """All pairs of different places whose texts are equal or at 0.8 or more, by comparing whole multisets."""
    bags = [_bag(t) if t is not None else None for t in texts]
    size = [sum(b.values()) if b else 0 for b in bags]
    holders = collections.defaultdict(list)
    out = []
    for i, b in enumerate(bags):
        shared = collections.Counter()
        for s, n in (b or {}).items():
            for j, m in holders[s]:
                shared[j] += min(n, m)
            holders[s].append((i, n))
        out += [(j, i) for j, both in shared.items() if 10 * both >= 8 * (size[i] + size[j] - both)]
    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        if t is not None:
            out += [(first[t], i)] if t in first else []
            first.setdefault(t, i)
    return out


def _components(n: int, edges: list[tuple[int, int]]) -> list[int]:
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def _classes(spark, texts: list[str | None]) -> list[int]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in N.report(rows).collect()}
    return [got[i] for i in range(len(texts))]


def test_every_link_of_a_whole_table_is_found(spark):
    rows = spark.read.parquet(DATA).orderBy("doc_id").collect()
    texts = [r.text for r in rows]
    edges = links(texts)
    got = {r.doc_id: r.class_id for r in N.report(spark.read.parquet(DATA)).collect()}
    found = sum(got[rows[a].doc_id] == got[rows[b].doc_id] for a, b in edges)
    assert len(edges) > 100 and found / len(edges) >= 0.99
    want = _components(len(texts), edges)
    assert [got[r.doc_id] for r in rows] == [rows[want[i]].doc_id for i in range(len(rows))]


def test_links_outside_a_bucket_s_main_component(spark, monkeypatch):
    """Chains of variants: neighbours are linked, the ends aren't, in blocks of a few members and a few texts each."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "BLOCK_BYTES", 3000)
    rng = random.Random(8)
    texts: list[str | None] = [None, "", "a b"]
    for chain in range(6):
        words = [f"c{chain}w{i}" for i in range(150)]
        for _ in range(12):
            texts.append(" ".join(words))
            for at in rng.sample(range(150), 2):
                words[at] = f"new{rng.randrange(10**6)}"
    assert _classes(spark, texts) == _components(len(texts), links(texts))


def test_sketches_lose_no_link_at_the_threshold():
    """The cut lies more than five standard errors below the threshold."""
    error = np.sqrt(0.8 * 0.2 / N.FINE_REGISTERS)
    assert 0.8 - N.LEAST_AGREEING > 5 * error


def test_columns_of_clashing_names_and_empty_tables(spark):
    names = "doc_id int, text string, ref int, row int, id int, class_id int, `a.b` int"
    rows = spark.createDataFrame([(2, "x y z", 3, 4, 5, 6, 7), (1, "x y z", 8, 9, 10, 11, 12), (3, None, 0, 0, 0, 0, 0)], names)
    out = N.keep_one(rows)
    assert out.columns == rows.columns and sorted(map(tuple, out.collect())) == [(1, "x y z", 8, 9, 10, 11, 12), (3, None, 0, 0, 0, 0, 0)]
    assert N.keep_one(rows.limit(0)).count() == 0


def test_written_tables_are_dropped_but_for_the_components(spark):
    import glob

    from daftar.stages import shared_dir

    place = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{place}/near-*/*"))
    rows = spark.createDataFrame([(i, f"one two three four five six seven {i // 2}") for i in range(8)], "doc_id int, text string")
    assert N.report(rows).count() == 8
    assert set(glob.glob(f"{place}/near-*/*")) == before


def test_batches_of_large_rows_are_bounded_by_bytes(spark):
    """Pairs of one long text with many: Python gets few of them at once, whatever their number."""
    import pyarrow as pa

    from daftar.stages import BATCH_BYTES, Scratch

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    rows = spark.sql("select id, repeat('long text ', 60000) as text from range(0, 60, 1, 1)")
    made = Scratch(spark, "bytes").write(rows.mapInArrow(sizes, "n long, bytes long"), N.TEXT_ROWS).collect()
    assert sum(r.n for r in made) == 60 and max(r.bytes for r in made) < 2 * BATCH_BYTES
