"""Training material as relations: which fonts serve, lines drawn with retries, totals, and comparisons of two tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of the digits that a font must have.
PERSIAN_DIGITS = range(0x06F0, 0x06FA)


def coverage(glyphs: DataFrame, key: str, required: Iterable[int] = PERSIAN_DIGITS) -> DataFrame:
    """``(key, codes, shapes, content, complete)``: a row for each font with any of the required code points.

    ``glyphs`` are (key, code, shape), a row for each code point of a font; rows that say the same count once.  Division by bitmaps:
    a font's code points are bits set by partial aggregates, and it is complete if as many bits
    are set as are required and each code point has a shape of its own.  ``content`` is a digest by which copies are known.
    """
    codes = sorted(set(required))
    own = glyphs.where(F.col("code").isin(codes)).where(F.col("shape").isNotNull())
    bits = own.groupBy(key, F.bitmap_bucket_number("code").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"), F.collect_set(F.struct("code", "shape")).alias("pairs")
    )
    fonts = bits.groupBy(key).agg(F.sum(F.bitmap_count("bits")).alias("codes"), F.flatten(F.collect_list("pairs")).alias("pairs"))
    said = F.array_join(F.transform(F.array_sort("pairs"), lambda p: F.concat_ws(":", p["code"].cast("string"), p["shape"])), ",")
    shapes = F.size(F.array_distinct(F.transform("pairs", lambda p: p["shape"]))).cast("long")
    complete = (F.col("codes") == len(codes)) & (shapes == len(codes)) & (F.size("pairs") == len(codes))
    return fonts.select(key, "codes", shapes.alias("shapes"), F.sha2(said, 256).alias("content"), complete.alias("complete"))


def usable(fonts: DataFrame, key: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``(key, copies)``: complete fonts without those whose name has an excluded part; of copies the first by name stays."""
    kept = fonts.where("complete")
    for part in excluded:
        kept = kept.where(~F.contains(F.lower(key), F.lit(part.lower())))
    return kept.groupBy("content").agg(F.min(key).alias(key), F.count("*").alias("copies")).select(key, "copies")


def retried(rows: DataFrame, draw: Callable[[Column], Column], good: Callable[[Column], Column], seed: Column, draws: int = 5) -> DataFrame:
    """Add ``attempt`` and ``drawn``: the first of a few draws that is good, both null if none is (a blank negative).

    ``draw`` makes a struct from a seed.  A draw is made only where those before it failed, inside the row, so there is no
    loop of jobs and no shuffle.
    """
    tries = [F.struct(F.lit(a + 1).alias("attempt"), draw(seed * draws + a).alias("drawn")) for a in range(draws)]
    first = F.coalesce(*(F.when(good(t["drawn"]), t) for t in tries))
    return rows.withColumn("first", first).select(*rows.columns, "first.attempt", "first.drawn")


def totals(rows: DataFrame, by: list[str], positive: str) -> DataFrame:
    """Counts and rates over every set of the given columns at once; ``level`` has a bit for each column that was summed over."""
    flag = F.col(positive).cast("long")
    return rows.cube(*by).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(flag).alias("n_positive"), F.avg(flag).alias("rate"))


def compare(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str], tolerance: float) -> DataFrame:
    """``(column, only_one, only_two, differing, worst)``: how two tables of numbers differ, a row for each column.

    Rows meet by their keys, null being a key like others.  A value differs if it is further off than the
    tolerance, or if one side alone is null or NaN; ``worst`` is the largest distance of two numbers.  Keys that a table has twice are an error.
    """
    side = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), *(F.first(c).cast("double").alias(f"{name}_{c}") for c in columns))
    a, b = side(one, "a").alias("a"), side(two, "b").alias("b")
    same = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    both = a.join(b, same, "full")
    once = lambda c: F.assert_true(F.coalesce(F.col(c) == 1, F.lit(True)), F.lit("a key stands twice"))
    both = both.where(once("n_a").isNull() & once("n_b").isNull())
    met = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    each = []
    for c in columns:
        x, y = (F.when(~F.isnan(F.col(f"{s}_{c}")), F.col(f"{s}_{c}")) for s in "ab")
        gap = F.abs(x - y)
        bad = met & ((x.isNull() != y.isNull()) | (gap > tolerance) | (F.coalesce(F.isnan(f"a_{c}"), F.lit(False)) != F.coalesce(F.isnan(f"b_{c}"), F.lit(False))))
        each.append(F.struct(F.count_if(bad).alias("differing"), F.max(F.when(met, gap)).alias("worst")).alias(f"of_{c}"))
    found = both.agg(F.count_if(F.col("n_b").isNull()).alias("only_one"), F.count_if(F.col("n_a").isNull()).alias("only_two"), *each)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), "only_one", "only_two", F.col(f"of_{c}.differing").alias("differing"), F.col(f"of_{c}.worst").alias("worst")) for c in columns))
    return found.select(F.inline(rows))
