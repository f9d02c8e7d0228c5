"""Decontamination: suffix arrays, test sets of many blocks, longest matches, and clashing names."""

import random

import numpy as np
import pytest

from daftar.llm import decontaminate as D


def test_suffix_array_sorts_all_suffixes():
    rng = np.random.default_rng(3)
    for n, values in ((0, 2), (1, 1), (50, 1), (300, 2), (500, 50)):
        seq = rng.integers(0, values, n).astype(np.uint64)
        assert D.suffix_array(seq).tolist() == sorted(range(n), key=lambda i: seq[i:].tolist())


def _texts(seed: int, n: int, most: int) -> list[str]:
    """Texts over few words, so that matches of every length occur."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(8, 60))] for _ in range(6)]
    out = []
    for _ in range(n):
        words: list[str] = []
        while len(words) < rng.randrange(1, most):
            words += rng.choice(passages) if rng.random() < 0.4 else [rng.choice("abcdefgh") + str(rng.randrange(30)) for _ in range(rng.randrange(12))]
        out.append(" ".join(words))
    return out


def _brute(text: str, items: list[tuple[str | None, str]]) -> tuple:
    """n_words, n_hit, longest, items and hits by comparing everything with everything."""
    w, hit, own, longest = text.split(), set(), set(), 0
    for name, item in items:
        v = item.split()
        size = min(13, len(v))
        for p in range(len(v) - size + 1 if v else 0):
            for q in range(len(w) - size + 1):
                if w[q : q + size] == v[p : p + size]:
                    hit |= set(range(q, q + size))
                    if name is not None:
                        own.add(name)
                    n = size
                    while q + n < len(w) and p + n < len(v) and w[q + n] == v[p + n]:
                        n += 1
                    longest = max(longest, n)
    return len(w), len(hit), longest, sorted(own), sorted(hit)


@pytest.mark.parametrize("block_bytes,together", [(16 << 20, 1 << 20), (600, 7)])
def test_matches_equal_a_comparison_of_all(spark, monkeypatch, block_bytes, together):
    monkeypatch.setattr(D, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(D, "TOGETHER", together)
    texts, items = _texts(1, 60, 120), _texts(1, 25, 50)
    named = [(None if i == 3 else str(i % 20), t) for i, t in enumerate(items)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*named, ("none", None), (None, None), ("blank", " , ")], "item_id string, text string")
    got = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    hits = 0
    for i, t in enumerate(texts):
        r = got[i]
        covered = [x for s in r.hits for x in range(s.start, s.end)]
        assert (r.n_words, r.n_hit, r.longest, r["items"], covered) == _brute(t, named)
        hits += r.n_hit > 0
    assert 10 < hits
    kept = {r.doc_id for r in D.remove(docs, bench).collect()}
    assert kept == {i for i, r in got.items() if not (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)}


def test_many_copies_and_long_texts_in_one_shard(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(i, passage) for i in range(500)] + [(500, "x " * 100_000 + passage), (501, None), (502, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    bench = spark.createDataFrame([(1, passage + " more")], "item_id int, text string")
    got = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    assert all(got[i].n_hit == 40 and got[i].longest == 40 for i in range(501))
    assert got[500]["hits"] == [(100_000, 100_040)] and got[501].n_words == got[502].n_words == 0
    assert {r.doc_id for r in D.remove(docs, bench).collect()} == {500, 501, 502}


def test_columns_of_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, [6], 7, 8)], "doc_id int, text string, row int, hits array<int>, n_words int, `a.b` int")
    bench = spark.createDataFrame([(1, "x y", 2)], "item_id int, text string, row int")
    out = D.remove(docs, bench)
    assert out.columns == docs.columns and tuple(out.first()) == (1, "a b c", 5, [6], 7, 8)
    assert D.remove(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).first().n_words == 3
