"""Segments of a digit strip as gaps-and-islands queries, and their height rule.

Input of ``column_runs``: one row a column of a strip (strip_id, col, ink): its dark pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.config import DEFAULT, Config


def column_runs(columns: DataFrame, height: int, config: Config = DEFAULT) -> DataFrame:
    """``(strip_id, x0, x1)``: stretches of columns with enough ink, x1 exclusive."""
    least = max(2, int(height * config.shape.row_share + 0.5))
    by = Window.partitionBy("strip_id").orderBy("col")
    active = columns.where(F.col("ink") >= least)
    island = active.withColumn("island", F.col("col") - F.row_number().over(by))
    runs = island.groupBy("strip_id", "island").agg(F.min("col").alias("x0"), (F.max("col") + 1).alias("x1"))
    return runs.where(F.col("x1") - F.col("x0") >= config.shape.min_run).select("strip_id", "x0", "x1")


def merge_runs(runs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Runs of a strip joined over gaps that are small."""
    by = Window.partitionBy("strip_id").orderBy("x0")
    gap = F.col("x0") - F.lag("x1").over(by)
    marked = runs.withColumn("new", F.when(gap <= config.shape.merge_gap, 0).otherwise(1))
    marked = marked.withColumn("part", F.sum("new").over(by))
    return marked.groupBy("strip_id", "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("part")


def digit_slots(runs: DataFrame) -> DataFrame:
    """The eight digits of strips with exactly ten runs; the fifth and eighth runs are slashes."""
    by = Window.partitionBy("strip_id")
    numbered = runs.withColumn("n", F.count("*").over(by)).withColumn("i", F.row_number().over(by.orderBy("x0")) - 1)
    digits = numbered.where((F.col("n") == 10) & ~F.col("i").isin(4, 7))
    return digits.select("strip_id", (F.col("i") - (F.col("i") > 4).cast("int") - (F.col("i") > 7).cast("int")).alias("slot"), "x0", "x1")


def height_gate(digits: F.Column, heights: F.Column, config: Config = DEFAULT) -> F.Column:
    """Reasons against a read (eight digits, eight heights): tall zeros and short fives; empty if it abstains."""
    s = config.shape
    median = F.get(F.array_sort(heights), 4)

    def reason(h, i):
        d, ratio = F.substring(digits, i + 1, F.lit(1)), h / median
        shown = F.format_string("%.2f", ratio)
        return F.when((d == "0") & (ratio > s.zero_max), F.concat(F.lit("pos"), i.cast("string"), F.lit(":0-tall-"), shown)).when(
            (d == "5") & (ratio < s.five_min), F.concat(F.lit("pos"), i.cast("string"), F.lit(":5-short-"), shown)
        )

    ok = (F.length(digits) == 8) & (F.size(heights) == 8) & (median > 0)
    return F.when(ok, F.filter(F.transform(heights, reason), lambda r: r.isNotNull())).otherwise(F.array().cast("array<string>"))


def gap_clusters(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """Number the boxes (sheet_id, seq, x, width) of a sheet by clusters in order of x.

    A gap parts clusters if it exceeds a share of the sheet's median width, four pixels at least.
    """
    median = boxes.groupBy("sheet_id").agg(F.percentile("width", F.lit(0.5)).alias("median"))
    by = Window.partitionBy("sheet_id").orderBy("x", "seq")
    right = F.max(F.col("x") + F.col("width")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = boxes.join(median, "sheet_id").withColumn("right", right)
    new = F.when(F.col("x") - F.col("right") > F.greatest(F.lit(4.0), F.col("median") * share), 1).otherwise(0)
    return marked.withColumn("new", new).withColumn("cluster", F.sum("new").over(by)).drop("new", "right", "median")


def label_checks(glyphs: DataFrame, labels: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``(sheet_id, reason)``: why the labels of a sliced sheet can't be trusted; null if nothing speaks against them.

    Glyphs are (sheet_id, seq, x, width, height, holes, slanted), labels (sheet_id, labels): a string in
    order of x.  A zero must be a ring and a ring a zero, a one narrow, a slash slanted.
    """
    tall = F.when((F.col("holes") == 0) & (F.col("height") > 15), F.col("height"))
    sheets = glyphs.groupBy("sheet_id").agg(F.count("*").alias("n"), F.coalesce(F.percentile(tall, F.lit(0.5)), F.lit(24.0)).alias("median"))
    by = Window.partitionBy("sheet_id").orderBy("x", "seq")
    rows = glyphs.withColumn("place", F.row_number().over(by)).join(sheets.join(labels, "sheet_id"), "sheet_id")
    label, ratio = F.substring("labels", F.col("place"), F.lit(1)), F.col("height") / F.col("median")
    ring = (F.col("holes") == 1) & (ratio < 0.62)
    narrow = (F.col("holes") == 0) & (F.col("width") / F.greatest("height", F.lit(1)) < 0.42)
    slash = (F.col("holes") == 0) & (ratio >= 0.85) & F.col("slanted")
    against = (
        F.when((label == "0") & ~ring, "zero is no ring").when((label == "1") & ~narrow, "one isn't narrow")
        .when((label == "/") & ~slash, "slash isn't slanted").when(~label.isin("0", "1", "/") & ring, "ring isn't a zero")
    )
    first = rows.withColumn("against", against).groupBy("sheet_id").agg(
        F.first("n").alias("n"), F.first(F.length("labels")).alias("due"), F.min_by("against", F.when(F.col("against").isNotNull(), F.col("place"))).alias("against")
    )
    return first.select("sheet_id", F.when(F.col("n") != F.col("due"), "other number of labels").otherwise(F.col("against")).alias("reason"))
