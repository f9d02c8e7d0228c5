"""The pipeline over a whole table, each stage judged on its own input by plain code."""

import base64
import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from test_near_duplicates import _components, links

import corpus_pipeline
from daftar.llm import pii
from daftar.llm.registry import op8_quality_model, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after each stage, as (doc_id, text), and those of the last."""
    docs, out = table(spark, SF, "documents"), []
    at = tmp_path_factory.mktemp("stages")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        if i == len(corpus_pipeline.STAGES) - 1:
            return out, rows, made.collect()
        assert made.columns == docs.columns, name
        made.write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        after = docs.collect()
        assert all(r.n_chars == len(r.text or "") for r in after)
        now = {r.doc_id: r.text for r in after}
        assert len(now) == len(after)
        out.append((rows, now))
        rows = now


def test_quality_keeps_what_is_predicted(spark, steps):
    before, after = steps[0][0]
    accepted = {r.doc_id for r in op8_quality_model(spark, SF).collect() if r.predicted == 1}
    assert set(after) == accepted and 0 < len(after) < len(before)
    assert all(before[i] == t for i, t in after.items())


def test_one_of_each_class_of_near_duplicates_stays(steps):
    before, after = steps[0][1]
    ids = sorted(before)
    classes = _components(len(ids), links([before[i] for i in ids]))
    kept = [classes[ids.index(i)] for i in after]
    assert len(kept) == len(set(kept)) == len(set(classes))
    assert all(before[i] == t for i, t in after.items())


def test_contaminated_documents_go(spark, steps):
    before, after = steps[0][2]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = set()
    for i, t in before.items():
        w, hit = words(t), set()
        for size in {len(x) for x in windows}:
            for at in range(len(w) - size + 1):
                if tuple(w[at : at + size]) in windows:
                    hit |= set(range(at, at + size))
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert set(after) == clean
    assert all(before[i] == t for i, t in after.items())


def test_personal_data_is_replaced_and_all_documents_stay(spark, steps):
    before, after = steps[0][3]
    rows = spark.createDataFrame(list(before.items()), "doc_id long, text string")
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.report(rows).collect()}
    replaced = 0
    for i, t in before.items():
        found, end, parts = sorted((int(a), -int(b), kind) for kind, a, b in spans[i]), 0, []
        stretches: list[list] = []
        for a, b, kind in found:
            if stretches and a < stretches[-1][1]:
                stretches[-1][1] = max(stretches[-1][1], -b)
            else:
                stretches.append([a, -b, kind])
        for a, b, _ in stretches:
            parts.append(re.escape((t or "")[end:a]) + r"\S+?")
            end = b
        assert re.fullmatch("".join(parts) + re.escape((t or "")[end:]), after[i] or "", re.S), i
        replaced += len(stretches)
    assert set(after) == set(before) and replaced > 0


def test_encoding_equals_the_library(steps):
    _, rows, encoded = steps
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id for r in encoded} == set(rows)
    for r in encoded:
        ids = library.encode_ordinary(rows[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id] or "").encode()).hexdigest()
