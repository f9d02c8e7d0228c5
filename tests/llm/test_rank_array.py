"""Encoding by rank arrays against the tokenizers library."""

import hashlib
import json
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from daftar.llm import rank_array as R
from daftar.llm.registry import op12_rank_array_bpe, rank_file

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _texts():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz' \n\t\r.,!?0123456789éßçñ漢字🙂ABC  \x1c\x85'<|>"
    texts = ["".join(rng.choices(letters, k=rng.randrange(250))) for _ in range(150)]
    texts += ["", " ", "  \n ", "a" * 3000, "ab" * 2000, "the" * 400, "internationalization" * 30, "x" * 48, "x" * 49, "I'll they've 'S"]
    texts += ["hello<|endoftext|>  world!<|endoftext|>", "!<|endoftext|>", "x <|endoftext|> y", "<|endoftext|><|endoftext|>", "<|endoftext", "  <|endoftext|>"]
    return [*texts, "new letter \U0001e030 and \U00031350 here <|endoftext|> !", "long " * 60_000]


def _expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), hexed(",".join(map(str, ids))), hexed(library.decode(ids, skip_special_tokens=False))


def test_same_ids_and_text_as_the_library(spark, library):
    texts = [*_texts(), None, "twice", "twice"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as id", "2 as ids", "3 as pieces", "4 as `a.b`")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in R.digests(frame, rank_file("byte_bpe_50k.json")).collect()}
    assert got == {i: _expected(library, t) for i, t in enumerate(texts)}
    assert R.digests(frame.limit(0), rank_file("byte_bpe_50k.json")).count() == 0


def test_whole_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12_rank_array_bpe(spark, sf).collect()} == {(i, *_expected(library, t)) for i, t in texts}


def test_decode_of_given_ids(spark, library):
    rows = [(1, [31373, 50256, 995]), (2, [255, 254]), (3, []), (4, None)]
    got = {r.k: r.decoded for r in R.decode(spark.createDataFrame(rows, "k long, ids array<int>"), rank_file("byte_bpe_50k.json")).collect()}
    assert got == {k: library.decode(ids or [], skip_special_tokens=False) for k, ids in rows}


def _file(merges, added=()):
    letters = R.byte_alphabet()
    vocab = {c: i for i, c in enumerate(letters)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "normalizer": None, "post_processor": None,
        "added_tokens": [{"id": len(vocab) + i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for i, t in enumerate(added)],
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
                  "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]},
    })


@pytest.mark.parametrize("short", [48, 3, 0])
def test_only_listed_pairs_are_joined(monkeypatch, short):
    """Both ways to merge, over merges whose order and parts matter; ``ab`` + ``c`` isn't listed though ``abc`` is a token."""
    monkeypatch.setattr(R, "SHORT", short)
    merges = [("b", "c"), ("a", "bc"), ("a", "b"), ("a", "a"), ("aa", "a"), ("aa", "aa"), ("c", "ab"), ("c", "c")]
    content = _file(merges, ["<x>", "<x><y>"])
    library, arrays = Tokenizer.from_str(content), R.RankArrays(content.encode())
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 12))) for _ in range(500)})
    ids, at = arrays.encode([w.encode() for w in words])
    for i, w in enumerate(words):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(w, add_special_tokens=False).ids, w
        assert arrays.decode(np.asarray(ids[at[i] : at[i + 1]])) == w.encode()


def test_several_added_tokens(spark):
    content = _file([("a", "b")], ["<x>", "<x><y>", "[END]"])
    library = Tokenizer.from_str(content)
    texts = ["ab<x>ab", "<x><y>ab<x>", "<x><x><y>", "a [END] b[END", "!<x>!", "\U0001e030<x> [END]"]
    got = {r.doc_id: list(r.ids) for r in R.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), content.encode()).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        R.parse(rank_file("word_bpe_49k.json"))
