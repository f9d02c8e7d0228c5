"""Rules of text quality as a short-circuit cascade, with DataFrame functions only.

A bounded sample, drawn over the whole table by chance with texts taken whole, gives each
rule's cost (the shorter of two runs over it, each row many times) and selectivity.  The first rule is the
one with most rejections per cost; each next one is chosen by what it rejects of the rows that are left,
as it will see no others.  Rows that the base rules reject never reach a rule, so they aren't in the sample.
The first failure ends a row's evaluation.  The order changes only the cost: a row is kept if it passes every rule.

Defined cases: null or empty text has no words and fails the base rules; a very long text is
measured whole; rows are judged one by one, so repeated rows get equal results, and nothing
is shuffled; an empty table gives an empty one; rules of equal rejections per cost (those that reject
nothing that is left, too) run cheapest first, then as given.  Extra columns pass through, except that a column with the name of
one of the results (``RESULTS``) is replaced by it.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample that orders the rules, about, and how often each is run to time a rule.
SAMPLE_ROWS, RUNS = 500, 20
MIN_WORDS = 50
RESULTS = ("q_text", "q_words", "q_lines", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@dataclass(frozen=True)
class Rule:
    """``passes`` is a Column over the columns that ``measured`` adds; null counts as a failure."""

    name: str
    passes: Column


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``q_text``, ``q_words``, ``q_lines`` and the base counts.

    n_repeat_words counts the words in three-word windows found twice or more in the
    text.  Windows are told apart by 64-bit hashes.
    """
    # the table's own columns stay inside ``row``, out of the way of those made here
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    df = docs.select(own, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("q_text"))
    text, w = F.col("q_text"), F.col("q_words")
    df = df.withColumn("q_words", F.array_remove(F.split(text, SPACES), ""))
    df = df.withColumn("n_words", F.size(w).cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join(w, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
    df = df.withColumn("q_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
    three = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("q_hash", F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), three)).otherwise(none))
    repeats = F.size("q_hash") > F.size(F.array_distinct("q_hash"))
    numbered = F.transform("q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    no_pairs = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("q_sorted", F.when(repeats, F.sort_array(numbered)).otherwise(no_pairs))
    s = F.col("q_sorted")
    beside = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    twins = F.filter(s, lambda x, j: beside(x, j - 1) | beside(x, j + 1))
    df = df.withColumn("q_places", F.sort_array(F.transform(twins, lambda x: x["i"])))
    p = F.col("q_places")
    new = lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))
    covered = F.aggregate(F.transform(p, new), F.lit(0), lambda a, b: a + b)
    df = df.withColumn("n_repeat_words", covered.cast("long"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in RESULTS]
    return df.select(*kept, *RESULTS[:8])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules over the measured columns; each is loose enough to pass ordinary prose of any language."""
    n, lines = F.col("n_words"), F.size("q_lines")
    share = lambda test: F.size(F.filter("q_words", test))
    shouted = share(lambda x: x.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*$") & (F.length(x) > 1))
    return [
        Rule("mean word length", F.col("word_chars").between(2 * n, 14 * n)),
        Rule("symbols", 10 * F.col("n_symbols") <= 3 * n),
        Rule("repeated lines", 10 * F.col("n_dup_lines") <= 5 * lines),
        Rule("words with a letter", 10 * share(lambda x: x.rlike(r"\p{L}")) >= 6 * n),
        Rule("capitals", 10 * shouted <= 4 * n),
        Rule("lines cut short", 10 * F.size(F.filter("q_lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))) <= 5 * lines),
    ]


def ordered(
    docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS, reach: Column | None = None
) -> list[tuple[Rule, float, float]]:
    """Rules as the cascade runs them: (rule, seconds, share rejected of the sample's rows that the rules before it leave).

    Every row of the table has the same chance to be drawn; nothing is shuffled for it.  ``reach``: which of the
    measured rows come to the rules; else all.
    """
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    share = min(1.0, sample_rows / max(texts.count(), 1))
    sample = measured(texts if share == 1 else texts.sample(share, seed=7)).cache()
    # filtered after the cache: before it, the filter would measure every text once more
    rows = sample if reach is None else sample.where(reach)
    fails = [~F.coalesce(rule.passes, F.lit(False)) for rule in rules]
    try:
        # which rules fail together, and how often: never more rows than the sample has
        together = rows.groupBy(F.array(*fails).alias("fails")).count().collect() if rules else []
        many = rows.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(RUNS))))

        def seconds(column: Column) -> float:
            began = time.perf_counter()
            many.agg(F.count_if(column)).first()
            return time.perf_counter() - began

        seconds(F.lit(True))
        floor = min(seconds(F.lit(True)) for _ in range(2))
        cost = [max(min(seconds(column) for _ in range(2)) - floor, 1e-3) for column in fails]
    finally:
        sample.unpersist()
    out, open_ = [], list(range(len(rules)))
    while open_:
        left = sum(r["count"] for r in together)
        shares = {i: sum(r["count"] for r in together if r.fails[i]) / left if left else 0.0 for i in open_}
        best = min(open_, key=lambda i: (-shares[i] / cost[i], cost[i], i))
        out.append((rules[best], cost[best], shares[best]))
        open_.remove(best)
        together = [r for r in together if not r.fails[best]]
    return out


def cascade(rules: list[Rule]) -> Column:
    """True if a row passes all rules; stops at the first failure."""
    verdict = F.when(F.lit(False), False)
    for rule in rules:
        verdict = verdict.when(~F.coalesce(rule.passes, F.lit(False)), False)
    return verdict.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the measured columns, ``base_failed`` and ``kept``."""
    rows = measured(docs, text_col)
    rules = default_rules() if rules is None else rules
    order = [r for r, _, _ in ordered(docs, rules, text_col, sample_rows, ~base_failed())]
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(order)))


def report(docs: DataFrame) -> DataFrame:
    """One row per document with the base counts and both verdicts."""
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
