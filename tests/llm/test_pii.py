"""Personal data: very many spans, account numbers, clashing names, and a brute-force search."""

import hashlib
import random
import re
import time

from daftar.llm import pii


def _report(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return {r.doc_id: r for r in pii.report(rows).collect()}


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def _base(text: str) -> list[str]:
    """The base kinds, straight from their definition."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return [f"{k}:{a}:{b}" for k, a, b in out]


def test_base_spans_equal_their_definition(spark):
    rng = random.Random(5)
    parts = ["a@b.co", "x.y%z@mail-1.example.org", "10.0.0.1", "300.1.2.3", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+49 (0)30 123456", "+1 2", "𝒳é", "12 34", "@", ".", "-", "+", "7", "\n", "word"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = _report(spark, texts)
    for i, text in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(",".join(_base(text)).encode()).hexdigest(), text


def test_very_many_spans_in_one_row_cost_their_number(spark):
    text = " ".join(f"user{i}@mail.com" for i in range(50_000))
    rows = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.perf_counter()
    assert pii.report(rows).first().n_email == 50_000
    assert pii.redact(rows).first().text == " ".join(["<EMAIL>"] * 50_000)
    assert time.perf_counter() - began < 60


def test_account_numbers_end_at_their_country_s_length(spark):
    got = _report(spark, ["GB82 WEST 1234 5698 7654 32 BANK OF X", "to DE89370400440532013000.", "GB82WEST12345698765432X", "GB82 WEST 1234 5698 7654 33"])
    assert [got[i].spans for i in range(4)] == ["iban:0:27", "iban:3:25", "", ""]


def test_columns_of_clashing_names_are_kept(spark):
    names = "doc_id int, text string, pii int, pii_text int, row int, _email int, chunks int, m_email int, `a.b` int"
    rows = spark.createDataFrame([(1, "mail a@b.co", *range(7))], names)
    found = pii.find(rows)
    assert sorted(found.columns) == sorted(rows.columns)
    assert found.first().pii_text == "mail a@b.co" and found.first()._email == 3
    out = pii.redact(rows)
    assert out.schema.names == rows.schema.names and tuple(out.first()) == (1, "mail <EMAIL>", *range(7))
    assert pii.redact(rows.limit(0)).count() == 0
