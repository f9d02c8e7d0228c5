"""Measures of a digit recogniser: rows with ``truth`` and ``guess`` (eight digits, null truth: no date), ``date_prob``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pairs(rows: DataFrame) -> DataFrame:
    digits = lambda c: F.split(F.col(c), "(?!^)(?!$)")
    pairs = F.arrays_zip(digits("truth").alias("t"), digits("guess").alias("g"))
    return rows.where("truth is not null").select(F.posexplode(pairs).alias("slot", "p")).select("slot", F.col("p.t").alias("t"), F.col("p.g").alias("g"))


def confusion_matrix(rows: DataFrame) -> DataFrame:
    """Counts of guesses by true digit, a column for each guessed digit."""
    wide = _pairs(rows).groupBy("t").pivot("g", [str(i) for i in range(10)]).count().na.fill(0)
    return wide.select(F.col("t").alias("truth"), *(F.col(str(i)).alias(f"g{i}") for i in range(10)))


def metrics(rows: DataFrame) -> DataFrame:
    """One row: exact matches, digit accuracy, accuracy of the date head, and the rates of 0 for 5 and 5 for 0."""
    whole = rows.agg(
        F.avg((F.col("truth") == F.col("guess")).cast("double")).alias("exact"),
        F.avg((F.col("truth").isNotNull() == (F.col("date_prob") >= 0.5)).cast("double")).alias("date_head"),
        F.avg(F.col("truth").isNotNull().cast("double")).alias("positive_rate"),
    )
    rate = lambda a, b: F.coalesce(F.count_if((F.col("t") == a) & (F.col("g") == b)) / F.nullif(F.count_if(F.col("t") == a), F.lit(0)), F.lit(0.0))
    digits = _pairs(rows).agg(
        F.avg((F.col("t") == F.col("g")).cast("double")).alias("digit"), rate("0", "5").alias("zero_as_five"), rate("5", "0").alias("five_as_zero")
    )
    return whole.crossJoin(digits)  # one row each


def quantised(weights: DataFrame) -> DataFrame:
    """Eight-bit weights (layer, out, pos, w): a scale for each layer and output, values within 127."""
    scale = F.greatest(F.max(F.abs("w")) / 127.0, F.lit(1e-9))
    scales = weights.groupBy("layer", "out").agg(scale.alias("scale"))
    q = F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(F.col("w") / F.col("scale"))))
    return weights.join(scales, ["layer", "out"]).select("layer", "out", "pos", q.cast("int").alias("q"), "scale")


def masked_loss(rows: DataFrame) -> DataFrame:
    """One row: the training loss of reads (truth, probs of 80, date_prob), as a measure.

    Cross-entropy of the digits over the dates alone, plus that of the date head over all rows;
    probabilities are kept 1e-7 away from 0 and 1.
    """
    clip = lambda p: F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))
    digit = lambda i: F.substring("truth", i + 1, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: -F.ln(clip(F.get("probs", i * 10 + digit(i)))))
    own = F.when(F.col("truth").isNotNull(), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 8)
    date = clip(F.col("date_prob"))
    head = -F.when(F.col("truth").isNotNull(), F.ln(date)).otherwise(F.ln(1 - date))
    sums = rows.select(own.alias("own"), head.alias("head")).agg(F.coalesce(F.sum("own"), F.lit(0.0)).alias("s"), F.count("own").alias("n"), F.avg("head").alias("date_loss"))
    out = sums.select((F.col("s") / (F.col("n") + 1e-6)).alias("digit_loss"), "date_loss")
    return out.withColumn("loss", F.col("digit_loss") + F.col("date_loss"))


def split_names(rows: DataFrame, name: F.Column, held: tuple[str, ...]) -> DataFrame:
    """Add ``part``: ``held`` for names with one of the given parts, else ``train``; if none were left to train on, all are."""
    out = rows.withColumn("is_held", F.lower(name).rlike("|".join(held)) if held else F.lit(False))
    left = out.agg(F.coalesce(F.max(~F.col("is_held")), F.lit(False)).alias("some"))  # one row
    part = F.when(F.col("is_held") & F.col("some"), "held").otherwise("train")
    return out.crossJoin(F.broadcast(left)).withColumn("part", part).drop("is_held", "some")
