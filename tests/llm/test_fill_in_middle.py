"""Fill-in-middle cuts against plain slices of each text."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daftar.llm import fill_in_middle as M

SCHEMA = "doc_id long, text string"


def _plain(doc_id, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, m, y = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(k in text for k in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    p, s, q = marks
    return (n, "spm", len(x), len(m), s + y + p + x + q + m) if h[3] % 100 < spm else (n, "psm", len(x), len(m), p + x + s + y + q + m)


def _texts():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab é漢🙂\n\n\r\t", k=rng.randrange(80))) for _ in range(120)]
    texts += ["", None, "\n", "\n\n\n", "no feed", "one\n", "a <P> b\nc", "<M>", "< P>\nx", "x\n" * 5000, ("é" * 700 + "\n") * 300, "long line " * 200_000]
    return texts + ["shared\ntext\nof\nmany"] * 60


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_equals_plain_slices(spark):
    rows = [*enumerate(_texts()), (3, "again\nthe same id"), (None, "no\nid"), (5, None), (5, None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as key", "2 as n", "3 as t", "4 as h1", "5 as cut", "6 as low", "7 as form", "8 as `a.b`")
    want = []
    for i, t in rows:
        n, form, x, m, out = _plain(i, t)
        want.append((i, n, form, x, m, _sha(out), _sha(t or "")))
    got = [tuple(r) for r in M.digests(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert M.digests(frame.limit(0)).count() == 0


def test_other_rates_and_marks(spark):
    marks = M.Marks("[pre]", "[suf]", "[mid].*")
    rows = list(enumerate([*_texts()[:60], "has [mid].* in it", "has <P> only"]))
    made = M.transform(spark.createDataFrame(rows, SCHEMA), seed=11, rate=70, spm=20, marks=marks)
    made = made.withColumn("back", M.restore(F.col("output"), F.col("form"), marks))
    forms = set()
    for r in made.collect():
        text = rows[r.doc_id][1]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _plain(r.doc_id, text, 11, 70, 20, (marks.prefix, marks.suffix, marks.middle))
        assert r.back == (text or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}


def test_one_list_for_each_distinct_text(spark):
    texts = _texts()
    lists = M.line_index(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    assert lists.count() == len({t or "" for t in texts})


@pytest.mark.parametrize("ends", [[], [0], [1], [5], [0, 1, 2, 3], [1, 2, 1000, 10**9], list(range(3, 40_000, 7)), [2**40, 2**40 + 1]])
def test_lists_give_back_their_numbers(ends):
    width, low, high = M.pack(np.array(ends, np.int64))
    assert len(low) + len(high) <= (2 + max(1, (max([*ends, 1]) // max(1, len(ends))).bit_length()) * len(ends) // 8 + 4 + len(ends)) * 2
    other = M.pack(np.array([4, 9], np.int64))
    for k in {0, 1, len(ends) // 2, len(ends)} - ({1} if not ends else set()):
        if k > len(ends):
            continue
        columns = [pa.array([other[i], (width, low, high)[i], other[i]], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))]
        assert M.select(*columns, np.array([1, k, 2])).tolist() == [4, ends[k - 1] if k else 0, 9]
