"""Personal data in text, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
mod-97 for IBANs, ranges for addresses), and context words near a span raise
its score.  Base kinds (email, ip, card, phone) stay whatever their score; the
added kinds (iban, ssn) are kept from a score of ``KEEP_FROM`` on.

A built-in that returns matches with their places is wanting, so a text is both
matched and split by a pattern, and places are running sums of the lengths.
Running sums go in three levels of blocks, each made once a row, and parts of a text
are taken from chunks of it, so cost grows with the length and the spans of a text,
not with their product.  Rows are never shuffled.

Patterns never scan a long run of word characters or digits again from its middle,
and use possessive repeats, so very long runs neither take quadratic time nor
exhaust the stack; they match what the plain patterns match.

Defined cases: null text is empty and has no span; empty text has none; very long texts,
or ones with very many spans, are searched whole; rows are judged one by one, so equal rows
get equal results, and an empty table gives none; spans that overlap are all reported, and
the first (then the longest) names the place in a redacted text.  Extra columns of any name
pass through ``redact``; ``find`` puts its own ``pii`` and ``pii_text`` in place of columns
so named and touches no other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_FROM = 0.6
#: Characters on each side of a span in which context words count.
NEAR = 40
_BLOCK = 64
#: Code points of the chunks from which parts of a text are taken.
_CHUNK = 1024


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: str
    base: bool


#: Countries by the length of their account numbers (fixed values of the IBAN registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        0.8, r"(?i)\b(e-?mail|mail|contact|kontakt|correo|courriel)\b", True,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        0.6, r"(?i)\b(ip|address|host|server|adresse|direcci[oó]n)\b", True,
    ),
    # a whole run of single or separated digits, 13 to 19 of them
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
        0.7, r"(?i)\b(card|visa|mastercard|credit|karte|tarjeta|carte)\b", True,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        0.6, r"(?i)\b(phone|tel|call|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone)\b", True,
    ),
    Kind(
        "iban",
        rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
        0.7, r"(?i)\b(iban|account|bank|konto|cuenta|compte)\b", False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        0.4, r"(?i)\b(ssn|social security)\b", False,
    ),
)


def _let(value: Column, f) -> Column:
    """``f(value)``, with the value made once a row however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _before(values: Column, zero: Column, fold, levels: int = 2) -> Column:
    """For each place of an array, what lies before it folded together (one value more, for all).

    The array is cut into blocks; what lies before each block is found in the same way, a level up.
    """
    if levels == 0:
        return _let(values, lambda v: F.transform(F.sequence(F.lit(0), F.size(v)), lambda i: F.aggregate(F.slice(v, F.lit(1), i), zero, fold)))

    def of(v: Column) -> Column:
        number = F.sequence(F.lit(0), F.floor(F.size(v) / _BLOCK).cast("int"))
        blocks = F.transform(number, lambda b: F.aggregate(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK)), zero, fold))

        def upto(whole: Column, i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            return F.aggregate(F.slice(v, b * _BLOCK + 1, i - b * _BLOCK), F.get(whole, b), fold)

        return _let(_before(blocks, zero, fold, levels - 1), lambda whole: F.transform(F.sequence(F.lit(0), F.size(v)), lambda i: upto(whole, i)))

    return _let(values, of)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def _part(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start..end of the text that was cut into chunks."""

    def inside(c: Column) -> Column:
        first = F.greatest(start - c * _CHUNK, F.lit(0))
        return F.substring(F.get(chunks, c), first + 1, F.least(end - c * _CHUNK, F.lit(_CHUNK)) - first)

    first, last = F.floor(start / _CHUNK).cast("int"), F.floor((end - 1) / _CHUNK).cast("int")
    return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), inside), "")).otherwise("")


def _valid(kind: Kind, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind.name == "ip":
        return found.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind.name == "card":
        return F.call_function("luhn_check", digits)
    if kind.name == "phone":
        return F.length(digits).between(9, 15)
    if kind.name == "iban":
        plain = F.replace(found, F.lit(" "), F.lit(""))
        turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "(?!^)(?!$)")

        def step(rest: Column, c: Column) -> Column:
            code = F.ascii(c)
            return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

        return F.aggregate(turned, F.lit(0), step) == 1
    return F.lit(True)


_SPAN = "struct<rank:int,start:int,end:int,score:double>"


def _spans(kind: Kind, text: Column, found: Column, length: Column, chunks: Column) -> Column:
    """Confirmed spans (rank, start, end, score) of the matches ``found`` in a text, cut into ``chunks``."""
    # lengths of: text before a match, the match, text before the next, ...
    gaps = F.transform(F.split(text, kind.pattern, -1), F.length)

    def placed(m: Column, starts: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start, end = F.get(starts, 2 * i + 1), F.get(starts, 2 * i + 2)
            near = _part(chunks, F.greatest(start - NEAR, F.lit(0)), F.least(end + NEAR, length))
            score = F.lit(kind.score) + F.when(near.rlike(kind.context), 0.3).otherwise(0.0)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("rank"), start.alias("start"), end.alias("end"),
                F.when(_valid(kind, x), F.least(score, F.lit(1.0))).otherwise(-1.0).alias("score"),
            )

        return F.filter(F.transform(m, span), lambda s: (s["score"] >= 0) & (F.lit(kind.base) | (s["score"] >= KEEP_FROM)))

    def lengths(m: Column) -> Column:
        return F.flatten(F.zip_with(gaps, m, lambda g, x: F.array(g, F.coalesce(F.length(x), F.lit(0)))))

    spans = _let(found, lambda m: _let(_before(lengths(m), F.lit(0), lambda a, b: a + b), lambda starts: placed(m, starts)))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _searched(rows: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """``row``, ``text``, ``chunks`` and ``pii`` of a table (row, text)."""
    t = F.col("text")
    df = rows.withColumn("text", F.coalesce(t, F.lit("")))
    df = df.select("row", "text", *(F.regexp_extract_all(t, F.lit(k.pattern), F.lit(0)).alias(f"m_{k.name}") for k in kinds))
    some = reduce(lambda a, b: a | b, (F.size(f"m_{k.name}") > 0 for k in kinds), F.lit(False))
    df = df.withColumn("chunks", F.when(some, _chunks(t)).otherwise(F.array().cast("array<string>"))).withColumn("length", F.length(t))
    spans = (_spans(k, t, F.col(f"m_{k.name}"), F.col("length"), F.col("chunks")) for k in kinds)
    return df.select("row", "text", "chunks", F.concat(F.array().cast(f"array<{_SPAN}>"), *spans).alias("pii"))


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))


def find(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``pii_text`` (the text, null as empty) and ``pii``: spans (rank, start, end, score) by kind, then start.

    Places count code points, ends are exclusive.
    """
    df = _searched(_rows(docs, text_col), kinds)
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("pii", "pii_text")]
    return df.select(*kept, F.col("text").alias("pii_text"), "pii")


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each span in the text replaced by its kind in angle brackets.

    Of spans that overlap, the one that begins first (then the longer one) names the place.
    """
    df = _searched(_rows(docs, text_col), KINDS)
    names = F.array(*(F.lit(f"<{k.name.upper()}>") for k in KINDS))
    order = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["rank"].alias("rank"))

    def cut(spans: Column, done: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            free = s["start"] >= F.get(done, i)
            return F.when(free, F.concat(_part(F.col("chunks"), F.get(done, i), s["start"]), F.get(names, s["rank"]))).otherwise("")

        rest = _part(F.col("chunks"), F.element_at(done, -1), F.length("text"))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    furthest = lambda spans: _before(F.transform(spans, lambda s: -s["back"]), F.lit(0), lambda a, b: F.greatest(a, b))
    redacted = _let(F.sort_array(F.transform("pii", order)), lambda spans: _let(furthest(spans), lambda done: cut(spans, done)))
    new = F.when(F.size("pii") > 0, redacted).otherwise(F.col(f"row.`{text_col}`"))
    return df.select(*((new if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of their spans, and all spans."""
    base = len([k for k in KINDS if k.base])
    count = lambda r: F.size(F.filter("pii", lambda s: s["rank"] == r)).cast("long")
    df = find(docs.select("doc_id", "text"))
    return df.select(
        "doc_id",
        *(count(r).alias(f"n_{k.name}") for r, k in enumerate(KINDS) if k.base),
        F.sha2(_listed(F.filter("pii", lambda s: s["rank"] < base)), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
