"""Language identification: any number of languages, against one plain loop over all dictionaries."""

import random

import pytest
import zstandard
from pyspark.sql import functions as F

from daftar.llm import langid as L


def _plain(text: str, dictionaries: list[tuple[str, bytes]]) -> tuple[str, float]:
    """The smallest size by one compressor after the other."""
    sizes = []
    for name, raw in dictionaries:
        content = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data = text.encode()
        made = [zstandard.ZstdCompressor(level=L.LEVEL, dict_data=content, write_content_size=False, write_dict_id=False) for _ in range(1)]
        sizes.append((sum(len(made[0].compress(data[i : i + L.BLOCK_BYTES])) for i in range(0, len(data), L.BLOCK_BYTES)), name))
    ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i][0], i))
    margin = 1 - sizes[ranked[0]][0] / sizes[ranked[1]][0]
    return sizes[ranked[0]][1], margin / (margin + L.MARGIN)


def _rows(languages: int, docs: int) -> list[tuple]:
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = {f"l{k:03}": ["".join(rng.choices(letters, k=6)) for _ in range(12)] for k in range(languages)}
    return [(i, " ".join(rng.choices(words, k=60)), name) for i, (name, words) in enumerate((n, w) for n, w in lexicon.items() for _ in range(docs))]


@pytest.mark.parametrize("together", [256, 4])
def test_many_languages_equal_a_plain_loop(spark, monkeypatch, together):
    monkeypatch.setattr(L, "LANGUAGES", together)
    rows = _rows(12, 6)
    frame = spark.createDataFrame([*rows, (900, None, None), (901, "12 !", "l000")], "doc_id long, text string, lang string")
    learned = L.dictionaries(frame)
    got = {r.doc_id: r for r in L.predict(frame, learned).collect()}
    held = [(r.lang, bytes(r.content)) for r in learned.orderBy(F.desc("n"), "lang").collect()]
    assert len(held) == 12
    for i, text, name in rows:
        plain, score = _plain(f" {text}", held)
        assert got[i].lang_pred == plain == name and got[i].score == pytest.approx(score)
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und")


def test_more_languages_than_a_block_and_clashing_names(spark):
    rows = [(i, f"word{i} other{i} word{i}", f"x{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as id", "2 as t", "3 as lang_pred", "4 as first", "5 as n")
    assert L.report(frame).count() == 300
    assert L.report(frame.limit(0)).count() == 0


def test_repeated_rows_teach_as_much_as_one_of_each(spark):
    """4,000 rows an id are far more than the sample; what is learned doesn't change."""
    rows = [r for r in _rows(4, 10)]
    once = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = once.crossJoin(spark.range(4000).select()).repartition(8)
    want = {(r.lang, r.n, bytes(r.content)) for r in L.dictionaries(once).collect()}
    assert {(r.lang, r.n, bytes(r.content)) for r in L.dictionaries(often).collect()} == want
    assert len(want) == 4 and all(n == 10 and len(content) > 20 for _, n, content in want)
