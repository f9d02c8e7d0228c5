"""Operators of daftar.llm against plain versions on small, awkward tables."""

import base64
import collections
import hashlib
import random
import re
import textwrap

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from daftar.llm import bpe, components, decontaminate, exact_substrings, langid, license_scan, near_duplicates, pii, quality_model, quality_rules, url_filter
from daftar.llm.bwt import repeated_starts
from daftar.llm.registry import rank_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BASE = " ".join(f"word{i}" for i in range(120))
PASSAGE = "the quick brown fox jumps over the lazy dog while nobody watches the old stone bridge near the quiet river at night "
TEXTS = [
    None, "", " \n\t ", BASE, BASE, BASE.replace("word7 ", "other "), BASE.replace("word50 ", "x ").replace("word90 ", "y "),
    PASSAGE * 3 + "alpha beta", "gamma " + PASSAGE * 3, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +1 (555) 123-4567 or 4111 1111 1111 1111 é😀 me@x.org 10.0.0.1",
    "1" * 3000, "x" * 20000, "ab" * 700, "Released under the MIT License.\nplain text", "don't we'll  \n\n 　١٢ ẞ😀", "line one\nline one\nline two\n" * 30,
    "a b", "GB82 WEST 1234 5698 7654 32 bank account", "a a a a a b b c a a a",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "src", None if t is None else len(t)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def luhn(d):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def test_pii(spark, docs):
    got = by_id(pii.report(docs))
    for i, t in enumerate(TEXTS):
        t = t or ""
        spans = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if "@" in t else "")]
        spans += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t if "." in t else "") if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                spans.append(("card", m))
        spans += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        n = collections.Counter(k for k, _ in spans)
        want = (n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in spans)))
        assert tuple(got[i])[1:6] == want, i
    assert "iban:0:27" in got[17].spans
    red = by_id(pii.redact(docs.withColumn("pii", F.lit(1))))
    assert red[0].text is None and red[3].text == BASE and "<EMAIL>" in red[9].text and "4111" not in red[9].text and red[9].pii == 1
    assert pii.report(empty(spark)).count() == 0 == pii.redact(empty(spark)).count()


def test_quality_rules(spark, docs):
    got = by_id(quality_rules.report(docs))
    for i, t in enumerate(TEXTS):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        count = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i])[1:6] == want, i
        assert got[i].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (got[i].base_failed and got[i].kept)
    assert got[3].kept
    assert quality_rules.report(empty(spark)).count() == 0


def test_url_filter_and_aliases(spark):
    rows = [
        (0, "http://A.B/x", '<link href="https://q.com/de/1" rel="canonical">'), (1, "https://q.com/fr/1#f", "<LINK rel=canonical href=/de/2>"),
        (2, "https://z.net/1", '<meta http-equiv="refresh" content="0; url=https://z.net/2">'), (3, "https://z.net/2", '<link rel="canonical" href="http://example.org/es/9">'),
        (4, None, ""), (5, "nourl", None), (6, "https://ORG", ""), (7, "https://www.Example.org/en/15?x", ""), (8, "https://free.net/", '<link rel="canonical" href="https://q.com/fr/2">'),
        (9, "https://r.net/", '<link rel="canonical" href="https://free.net/">'),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == ("a.b", "/x", None, "block") and got[1] == ("q.com", "/fr/1", "com/fr/", "allow")
    assert got[2][3] == got[3][3] == "block" and got[4] == ("", "", None, "allow") == got[5]
    assert got[6] == ("org", "", None, "allow") and got[7][2:] == ("example.org/en/1", "block") and got[8][3] == got[9][3] == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, i) for i in range(101, 130)] + [(200 + i, 201 + i) for i in range(30)]
    parent = {n: n for p in pairs for n in p}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = components.connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r.node: r.component for r in got.collect()} == {n: root(n) for n in parent if any(n in p and p[0] != p[1] for p in pairs)}


def test_bpe(spark, docs):
    content = rank_file()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.digests(docs, content, public_tokenizers.PATTERN))
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t or "")
        assert tuple(got[i])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(t or "")), i
    again = bpe.decode(bpe.encode(docs, content, public_tokenizers.PATTERN), content)
    assert again.where("bytes != decoded").count() == 0
    assert bpe.digests(empty(spark), content, public_tokenizers.PATTERN).count() == 0


def test_license_scan(spark, docs):
    got = by_id(license_scan.report(docs))
    assert got[13].licenses == "MIT" and got[0].n_blocks == 0 and got[3].licenses == ""
    name = license_scan.Scanner().name
    assert name("Licensed under the GNU General Public License, version 2.")[0] == "GPL-2.0" and name("a license to fish") is None
    assert license_scan.report(empty(spark)).count() == 0


def test_license_texts_in_every_layout(spark):
    """Wrapped and commented licences, a phrase in a long line, and licences in a row."""
    bsd, mit, isc = (next(p for t in license_scan.TEMPLATES if t.spdx == k for p in t.passages if len(p) > 150) for k in ("BSD-3-Clause", "MIT", "ISC"))
    flat = {k: " ".join(p.split()) for k, p in (("BSD-3-Clause", bsd), ("MIT", mit), ("ISC", isc))}
    wrap = lambda t, mark, width: "\n".join(mark + x for x in textwrap.wrap(t, width))
    cases = [(wrap(t, mark, width), k) for k, t in flat.items() for mark, width in (("", 80), (" * ", 72), ("# ", 30))]
    cases += [("x y " * 300 + "Released under the MIT License. " + "z w " * 300, "MIT")]
    cases += [("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Apache-2.0", "Apache-2.0,MIT")]
    cases += [("Released under the MIT License. " + "x y " * 260 + "Licensed under the ISC License.", "ISC,MIT")]
    cases += [(cases[0][0] + "\n\n" + cases[3][0], "BSD-3-Clause,MIT"), (flat["MIT"][: len(flat["MIT"]) // 2], "")]
    got = by_id(license_scan.report(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")))
    assert [got[i].licenses for i in range(len(cases))] == [k for _, k in cases]
    assert got[len(cases) - 2].n_confirmed == 2


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(7, PASSAGE), (11, "a b"), (3, None), (4, " ,. "), (7, PASSAGE)], "item_id long, text string")
    got = by_id(decontaminate.report(docs, items))
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    windows = collections.defaultdict(set)
    for k, t in ((7, PASSAGE), (11, "a b")):
        w = find(t)
        for p in range(len(w) - min(13, len(w)) + 1):
            windows[tuple(w[p : p + 13])].add(str(k))
    for i, t in enumerate(TEXTS):
        w, hit, own = find(t), set(), set()
        for x, ids in windows.items():
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit |= set(range(p, p + len(x)))
                    own |= ids
        want = (len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit) and 20 * len(hit) >= len(w))
        assert tuple(got[i])[1:6] == want, i
    kept = decontaminate.remove(docs.withColumn("items", F.lit(1)), items)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}
    assert decontaminate.report(docs, items.where("false")).where("n_hit > 0").count() == 0
    assert decontaminate.report(empty(spark), items).count() == 0


def test_quality_model(spark):
    rng = random.Random(1)
    words = ["stone", "river", "bridge", "the", "of", "and", "night", "walker", "quiet"]
    good = [" ".join(rng.choices(words, k=rng.randrange(60, 200))) + "." for _ in range(80)]
    bad = [" ".join(w + "$$$" for w in rng.choices(words, k=rng.randrange(60, 200))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, ""), (501, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(120)] + [(3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_model.report(frame, labels))
    assert len(got) == 122 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert np.mean([got[i].predicted == int(i < 80) for i in range(120) if got[i].held_out]) > 0.95
    assert {r.score for r in quality_model.report(frame, labels.where("false")).collect()} == {0.5}
    assert quality_model.report(frame.where("false"), labels).count() == 0


def test_bwt_finds_all_repeats():
    rng = random.Random(2)
    for _ in range(60):
        n, length = rng.choice([1, 2, 4]), rng.choice([1, 2, 5, 9])
        texts = [bytes(97 + rng.randrange(n) for _ in range(rng.choice([0, 2, 30]))) for _ in range(rng.randrange(1, 6))]
        at, starts, count = 0, [], collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
        for t in texts:
            starts += [at + i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]
            at += len(t) + 1
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        assert repeated_starts(np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8), ends, length).tolist() == starts


@pytest.mark.parametrize("group_bytes", [256 << 10, 300])
def test_exact_substrings(spark, docs, monkeypatch, group_bytes):
    monkeypatch.setattr(exact_substrings, "GROUP_BYTES", group_bytes)
    got = by_id(exact_substrings.report(docs))
    raw = {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    count = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes() if b else b""
        assert tuple(got[i])[1:] == (len(b), int(gone.sum()), spans, sha(kept)), i
    assert exact_substrings.report(empty(spark)).count() == 0


def test_language_id(spark):
    rng = random.Random(4)
    lexicon = {"aa": ["stone", "bridge", "river", "walker", "night"], "bb": ["pierre", "rivière", "nuit", "marcheur", "pont"]}
    rows = [(i, " ".join(rng.choices(lexicon[k], k=40)), k) for i in range(60) for k in [("aa", "bb")[i % 2]]] + [(90, "12 !!", "aa"), (91, None, "bb"), (92, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.report(frame))
    assert all(got[i].lang_pred == rows[i][2] for i in range(60)) and {got[i].lang_pred for i in (90, 91, 92)} == {"und"}
    assert {r.lang_pred for r in langid.report(frame.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.report(frame.where("false")).count() == 0


def test_language_id_learns_from_whole_texts(spark):
    """Documents that open with a long header in another language still teach their own words."""
    rng = random.Random(6)
    lexicon = {"aa": ["stone", "bridge", "river", "walker", "night"], "bb": ["pierre", "rivière", "nuit", "marcheur", "pont"]}
    header = {"aa": "", "bb": " ".join(rng.choices(lexicon["aa"], k=400)) + " "}
    texts = {i: " ".join(rng.choices(lexicon["aa" if i % 2 else "bb"], k=300)) for i in range(80)}
    rows = [(i, header["aa" if i % 2 else "bb"] * (i < 60) + t, ("aa" if i % 2 else "bb") if i < 60 else None) for i, t in texts.items()]
    learned = langid.dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    contents = {r.lang: bytes(r.content).decode().split() for r in learned.collect()}
    assert set(lexicon["bb"]) <= set(contents["bb"])
    got = by_id(langid.predict(spark.createDataFrame(rows[60:], "doc_id long, text string, lang string"), learned))
    assert all(r.lang_pred == ("aa" if i % 2 else "bb") for i, r in got.items())


def test_bagminhash_is_unbiased():
    rng, gaps = random.Random(3), []
    for t in range(40):
        a = {i: rng.choice([1, 1, 2, 3, 7]) for i in range(60)}
        b = {i: rng.choice([1, 2, 7]) if rng.random() < 0.3 else v for i, v in a.items()}
        element = np.array([*a, *b], np.uint64) + np.uint64(1000 * t)
        s = near_duplicates.signatures(np.repeat([0, 1], 60), element, np.array([*a.values(), *b.values()]), 2)
        gaps.append((s[0] == s[1]).mean() - sum(min(a[i], b[i]) for i in a) / sum(max(a[i], b[i]) for i in a))
    assert abs(np.mean(gaps)) < 0.02


def test_near_duplicates(spark, docs):
    got = by_id(near_duplicates.report(docs))

    def bag(t):
        w = re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", t.lower())
        return collections.Counter([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])

    parent = list(range(len(TEXTS)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(TEXTS):
        for j in range(i):
            b = TEXTS[j]
            if a is not None and b is not None:
                x, y = bag(a), bag(b)
                both, union = sum((x & y).values()), sum((x | y).values())
                if a == b or union and 10 * both >= 8 * union:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    size = collections.Counter(root(i) for i in range(len(TEXTS)))
    assert {i: (r.class_id, r.class_size) for i, r in got.items()} == {i: (root(i), size[root(i)]) for i in range(len(TEXTS))}
    kept = near_duplicates.keep_one(docs.unionByName(docs).withColumn("ref", F.lit(1)))
    assert sorted(r.doc_id for r in kept.where("text is not null").collect()) == sorted({root(i) for i, t in enumerate(TEXTS) if t is not None})
    assert near_duplicates.report(empty(spark)).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(19)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {3, 9} <= kept and not {4, 5, 6, 7, 8} & kept
