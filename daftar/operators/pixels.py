"""Operators over pixel rows (image_id, x, y, v): equalisation by tiles as counts, running sums and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 256


def tile_curves(pixels: DataFrame, tile_width: int, tile_height: int, clip: float) -> DataFrame:
    """``(image_id, tx, ty, v, level)``: for each tile and level, the level that it becomes.

    No level of a tile counts more often than ``clip`` times its even share, once at least; what is cut off is dealt
    evenly to all levels, the rest to every so-many-th of them from 0 on.
    """
    tile = (F.floor(F.col("x") / tile_width).cast("int").alias("tx"), F.floor(F.col("y") / tile_height).cast("int").alias("ty"))
    counts = pixels.groupBy("image_id", *tile, "v").agg(F.count("*").alias("n"))
    tiles = counts.groupBy("image_id", "tx", "ty").agg(F.sum("n").alias("area"), F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("of"))  # 256 levels at most
    limit = F.greatest(F.lit(1), F.floor(F.lit(clip) * F.col("area") / LEVELS)).cast("long")
    every = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda v: F.coalesce(F.try_element_at("of", v), F.lit(0).cast("long")))
    tiles = tiles.select("image_id", "tx", "ty", "area", limit.alias("most"), every.alias("levels"))
    over = F.aggregate("levels", F.lit(0).cast("long"), lambda a, n: a + F.greatest(n - F.col("most"), F.lit(0)))
    rows = tiles.withColumn("over", over).select("*", F.posexplode("levels").alias("v", "n"))
    rest = F.col("over") % LEVELS
    step = F.greatest(F.floor(F.lit(LEVELS) / F.greatest(rest, F.lit(1))), F.lit(1))
    one = F.when((F.col("v") % step == 0) & (F.floor(F.col("v") / step) < rest), 1).otherwise(0)
    n = F.least("n", "most") + F.floor(F.col("over") / LEVELS) + one
    below = F.sum(n).over(Window.partitionBy("image_id", "tx", "ty").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    level = F.floor(below * (LEVELS - 1) / F.col("area") + 0.5)
    return rows.select("image_id", "tx", "ty", "v", F.least(level, F.lit(LEVELS - 1)).cast("int").alias("level"))


def equalise_tiles(pixels: DataFrame, width: int, height: int, tiles: tuple[int, int] = (8, 8), clip: float = 2.0) -> DataFrame:
    """Contrast-limited equalisation by tiles: each pixel's level is that of the four tiles around it, mixed by distance.

    Tiles are as large as the image's share of one, rounded up; those at the right and lower edge may be smaller and
    count by what they hold.  Levels are whole numbers from 0 to 255.
    """
    tw, th = -(-width // tiles[0]), -(-height // tiles[1])
    # a row for each tile, as its rows lie together already: one a level would be shuffled once more
    tiles_ = tile_curves(pixels, tw, th, clip).groupBy("image_id", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct("v", "level"))).alias("curve"))
    curves = tiles_.select("image_id", "tx", "ty", F.col("curve.level").alias("levels"))
    fx, fy = F.col("x") / tw - 0.5, F.col("y") / th - 0.5
    last = (-(-width // tw) - 1, -(-height // th) - 1)
    clamp = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), c)).cast("int")

    def corner(dx: int, dy: int):
        x0, y0 = F.floor(fx), F.floor(fy)
        part = (fx - x0 if dx else 1 - (fx - x0)) * (fy - y0 if dy else 1 - (fy - y0))
        return F.struct(clamp(x0 + dx, last[0]).alias("tx"), clamp(y0 + dy, last[1]).alias("ty"), part.alias("part"))

    spread = pixels.select("image_id", "x", "y", "v", F.inline(F.array(*(corner(dx, dy) for dy in (0, 1) for dx in (0, 1)))))
    met = spread.join(curves, ["image_id", "tx", "ty"]).select("image_id", "x", "y", (F.col("part") * F.get("levels", F.col("v"))).alias("share")).where("share is not null")
    mixed = met.groupBy("image_id", "x", "y").agg(F.sum("share").alias("m"))
    return mixed.select("image_id", "x", "y", F.floor(F.round("m", 6) + 0.5).cast("int").alias("v"))
