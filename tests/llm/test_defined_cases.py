"""Every operator and the pipeline over extra columns of clashing names, repeated rows and empty tables; brute-force checks."""

import math

import numpy as np
import public_tokenizers
import pytest

from daftar.llm import bpe, exact_substrings, license_scan, quality_model, url_filter
from daftar.llm.arrowtext import Slice
from daftar.llm.registry import rank_file

BASE = " ".join(f"word{i}" for i in range(90))
CLASH = ("id", "ref", "row", "t", "text_", "score", "pii", "n_words", "q_hash", "key", "x", "h", "n", "`a.b`")


def _clashing(spark, rows, schema):
    frame = spark.createDataFrame(rows, schema)
    for i, name in enumerate(CLASH):
        if name.strip("`") not in frame.columns:
            frame = frame.selectExpr("*", f"{i} as {name}")
    return frame


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, BASE, "en"), (2, BASE, "en"), (2, BASE, "en"), (3, None, None), (4, "", "fr"), (5, "Released under the MIT License. " + BASE, "en")]
    return _clashing(spark, rows, "doc_id long, text string, lang string")


def test_operators_ignore_other_columns(spark, docs):
    labels = _clashing(spark, [(1, 1), (5, 1), (4, 0)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    for made in (
        bpe.digests(docs, rank_file(), public_tokenizers.PATTERN), license_scan.report(docs), exact_substrings.report(docs),
        quality_model.report(docs, labels), quality_model.score(docs, model),
    ):
        assert sorted(r.doc_id for r in made.collect()) == [1, 2, 2, 3, 4, 5]
    kept = quality_model.accept(docs, model)
    assert kept.columns == docs.columns
    empty = docs.limit(0)
    assert bpe.digests(empty, rank_file(), public_tokenizers.PATTERN).count() == license_scan.report(empty).count() == 0
    assert exact_substrings.report(empty).count() == quality_model.report(empty, labels).count() == 0


def test_url_filter_of_other_columns_and_links(spark):
    rows = [
        (1, "https://a.net/x/page?q=1", '<link rel="nofollow canonical" href="../de/1">'), (2, "https://com/de/1", None), (3, "https://com/fr/2", ""),
        (4, "http://com/other", "<link rel=canonical href=?v=2>"), (5, None, None),
    ]
    pages = _clashing(spark, rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    edges = {(r.src, r.dst) for r in url_filter.html_edges(pages).collect()}
    assert {d.split("://")[-1] for _, d in edges} == {"a.net/de/1", "com/other?v=2"}
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_quality_scores_equal_a_plain_discriminant(spark):
    """The same posterior from class means and covariances of all rows at once."""
    rng = np.random.default_rng(1)
    words = ["river", "stone", "of", "the", "Night,", "walked.", "##", "|", "77"]
    texts = [" ".join(rng.choice(words, 60, p=([0.14] * 6 + [0.06, 0.05, 0.05]) if i % 2 else [0.1] * 6 + [0.15, 0.15, 0.1])) for i in range(120)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_model.score(rows, quality_model.train(rows, labels)).collect()}
    x = np.concatenate([quality_model.statistics(Slice(0, 1, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))) for t in texts])
    y = np.arange(120) % 2
    pooled = sum(np.cov(x[y == k].T, bias=True) * 60 for k in (0, 1)) / 120
    target = np.diag(np.maximum(np.diag(pooled), quality_model.FLOOR))
    log = []
    for k in (0, 1):
        c = 0.9 * np.cov(x[y == k].T, bias=True) + 0.1 * target
        d = x - x[y == k].mean(0)
        log.append(math.log(0.5) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    assert np.allclose([got[i] for i in range(120)], want, atol=1e-5)


def test_pipeline_of_other_columns_and_of_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    _clashing(spark, [(1, "x y")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        rows = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, str(tmp_path))
            assert rows.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, rows, str(tmp_path)).collect()
        assert (len(last) > 0) == (name == "some")


def test_quality_scores_of_very_long_texts(spark):
    """A text beyond a slice counts whole: its end changes the statistics, and its score is that of the text alone in a table."""
    from daftar.llm.arrowtext import SLICE_BYTES

    unit = "plain words of a long text, once more. "
    long = unit * (3 * SLICE_BYTES // len(unit))
    train = spark.createDataFrame([(i, f"{unit * (i % 7 + 1)}{'!' * (i % 5)} {i}", i % 2) for i in range(40)], "doc_id int, text string, quality int")
    model = quality_model.train(train.drop("quality"), train.select("doc_id", "quality"))
    texts = {1: unit, 2: long, 3: long + "!" * 100_000, 4: long}
    rows = spark.createDataFrame(list(texts.items()), "doc_id int, text string").coalesce(1)
    vectors = {i: quality_model.statistics(Slice(0, 1, np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])))[0] for i, t in texts.items()}
    assert not np.allclose(vectors[2], vectors[3])
    got = {r.doc_id: r.score for r in quality_model.score(rows, model).collect()}
    for i, x in vectors.items():
        assert math.isclose(got[i], model.score(x[None])[0], abs_tol=1e-9)


def test_url_filter_of_repeated_rows_and_thousands_of_aliases(spark):
    """One blocked page redirects a chain's head; each alias, and each repetition of its row, is blocked, and no other page."""
    refresh = '<meta http-equiv="refresh" content="0; url=http://a.net/{}">'
    rows = [(0, "http://a.com/de/x", refresh.format("n/0"))]
    rows += [(i + 1, f"http://a.net/n/{i}", '<link rel="canonical" href="/n/0"><link rel="canonical" href="/n/1">') for i in range(3000)]
    rows += [(5000 + i, f"http://b.net/{i}", None) for i in range(10)] + [(7, "http://a.net/n/6", "")] * 3
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(rows)
    assert all(r.verdict == ("block" if r.page_id <= 3000 else "allow") for r in got)


def test_all_links_of_a_page_are_edges(spark):
    html = '<link rel=canonical href=/b><LINK REL="canonical" HREF="/c"><link rel="canonical" href="/b"><meta http-equiv=refresh content="1; url=/d"><meta http-equiv="refresh" content="2; url=/e">'
    edges = url_filter.html_edges(spark.createDataFrame([("http://x.net/a", html)], "url string, html string"))
    assert sorted(r.dst for r in edges.collect()) == [f"http://x.net/{c}" for c in "bcde"]
