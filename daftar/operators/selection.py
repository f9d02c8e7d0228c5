"""From accepted reads to one result per card.

Input rows are reads: card_id, read_id (their order), year, month, day, formatted,
confidence, date_prob, y_min, roi_w (each of the last three may be null).  Reads are reduced
to one row a card and date by aggregates whose states are single rows (``max_by``), so a card with
very many reads is combined before it is shuffled.  What is left of a card, a row a date of the
calendar at most, is decided in windows over the card, all in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daftar.config import DEFAULT, Config

PARTS = ("year", "month", "day", "formatted", "confidence", "date_prob", "y_min", "roi_w")


def row_position(y_min: Column, rel_y: Column | None = None) -> Column:
    """Top edge, else centre, else 1; NaN counts as missing."""
    options = [y_min] + ([rel_y] if rel_y is not None else [])
    return F.coalesce(*(F.when(~F.isnan(c), c) for c in options), F.lit(1.0))


def accept(reads: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Reads that are sure enough to be dates."""
    a = config.acceptance
    return reads.where((F.col("date_prob") >= max(a.is_date, a.date_prob)) & (F.col("confidence") >= a.confidence))


def suppress_lower_rows(reads: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Drop the rows of a card clearly below its topmost one."""
    y = row_position(F.col("y_min"))
    top = reads.groupBy("card_id").agg(F.min(y).alias("top"))
    return reads.join(top, "card_id").where(y <= F.col("top") + config.selection.row_margin).drop("top")


def year_cutoff(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Drop years after the cutoff where the card has one before it."""
    young = F.col("year") <= config.selection.cutoff_year
    has = rows.groupBy("card_id").agg(F.max(young).alias("has_young"))
    return rows.join(has, "card_id").where(young | ~F.col("has_young")).drop("has_young")


def full_strips(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Drop narrow strips where the card has a full one; a missing width counts as full."""
    full = _is_full(config)
    has = rows.groupBy("card_id").agg(F.max(full).alias("has_full"))
    return rows.join(has, "card_id").where(full | ~F.col("has_full")).drop("has_full")


def _is_full(config: Config) -> Column:
    return F.coalesce(F.col("roi_w") >= config.selection.full_strip, F.lit(True))


def vote(reads: DataFrame, tight: Column | None = None) -> DataFrame:
    """One row a card and date: votes, sums, and the read with the highest score (the first of equals)."""
    best = F.max_by(F.struct("read_id", *PARTS), F.struct(F.col("confidence"), -F.col("read_id")))
    more = [] if tight is None else [F.max(tight).alias("tight")]
    votes = reads.groupBy("card_id", F.col("formatted").alias("date")).agg(
        F.count("*").alias("votes"), F.sum("confidence").alias("total_confidence"), F.min("read_id").alias("first_read"), best.alias("best"), *more
    )
    return votes.select(
        "card_id", "best.*", "votes", "total_confidence",
        (F.col("total_confidence") / F.col("votes")).alias("average_confidence"), "first_read", *(["tight"] if more else []),
    )


def rank(voted: DataFrame) -> DataFrame:
    """Number a card's dates by confidence; equal ones by first appearance."""
    w = Window.partitionBy("card_id").orderBy(F.desc("confidence"), "first_read")
    return voted.withColumn("rank", F.row_number().over(w))


def _row() -> Column:
    return F.struct("read_id", *PARTS, "votes", "average_confidence")


def _decide(voted: DataFrame, config: Config) -> DataFrame:
    """Each date with its rank and its card's n, winner, earliest and topmost dates."""
    young, y = F.col("year") <= config.selection.cutoff_year, row_position(F.col("y_min"))
    prob = F.coalesce("date_prob", F.lit(0.0))
    card = Window.partitionBy("card_id")
    return rank(voted).select(
        "*", F.count("*").over(card).alias("n"),
        F.max_by(_row(), F.struct(young, _is_full(config), F.col("confidence"), prob, -y, -F.col("first_read"))).over(card).alias("winner"),
        F.min_by(_row(), F.struct(~young, F.col("year"), y, -F.col("confidence"), F.col("first_read"))).over(card).alias("earliest"),
        F.min_by(_row(), F.struct(y, F.col("year"), -F.col("confidence"), F.col("first_read"))).over(card).alias("topmost"),
    )


def _one_each(decided: DataFrame) -> DataFrame:
    """A row a card."""
    return decided.where(F.col("rank") == 1)


def select_best(voted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The winning date of each card: early years first, full strips first, then the surest, then the upper row."""
    return _one_each(_decide(voted, config)).select("card_id", "winner.*")


def _decide_all(voted: DataFrame, config: Config) -> DataFrame:
    """Each date with all that is decided about its card: also the latest date below the topmost and the surest above the winner."""
    s = config.selection
    y = row_position(F.col("y_min"))
    above = (F.col("formatted") != F.col("winner.formatted")) & (
        F.coalesce("y_min", F.lit(1.0)) < F.coalesce("winner.y_min", F.lit(1.0)) - s.row_gap
    )
    rest = F.col("formatted") != F.col("topmost.formatted")
    late = F.struct(F.col("year"), -y, F.col("confidence"), -F.col("first_read"))
    sure = F.struct(F.col("confidence"), -F.col("year"), -F.col("first_read"))
    card = Window.partitionBy("card_id")
    return _decide(voted, config).select(
        "*", F.max_by(F.when(rest, _row()), F.when(rest, late)).over(card).alias("latest"), F.max_by(F.when(above, _row()), F.when(above, sure)).over(card).alias("upper")
    )


def assign_fields(voted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Birth and expiry of each card: (card_id, birth, expiry, swapped, method, sequence_error)."""
    return _one_each(_fields(_decide_all(voted, config), config)).select(
        "card_id", F.col("birth.formatted").alias("birth"), F.col("expiry.formatted").alias("expiry"), "swapped", "method", "sequence_error"
    )


def _fields(decided: DataFrame, config: Config) -> DataFrame:
    s = config.selection
    lone = F.col("n") == 1
    only_late = lone & (F.col("winner.year") > s.cutoff_year) & (row_position(F.col("winner.y_min")) > s.lone_y)
    out = decided.withColumn("birth", F.when(~only_late, F.col("earliest")))
    out = out.withColumn("expiry", F.when(only_late, F.col("winner")).when(~lone, F.col("latest")))
    by, ey = row_position(F.col("birth.y_min")), row_position(F.col("expiry.y_min"))
    both = F.col("birth").isNotNull() & F.col("expiry").isNotNull()
    out = out.withColumn("swapped", F.coalesce(both & ~lone & (by > ey) & (F.col("birth.year") < F.col("expiry.year")), F.lit(False)))
    out = out.withColumn("method", F.when(lone, "single").otherwise("y-sort"))
    return out.withColumn("sequence_error", F.coalesce(both & (F.col("birth.year") > F.col("expiry.year")), F.lit(False)))


def takeover(voted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The winner of each card after an upper row of close score may have taken over."""
    return _one_each(_takeover(_decide_all(voted, config), config)).select(
        "card_id", F.col("winner.formatted").alias("winner"), F.col("final.formatted").alias("final")
    )


def _takeover(decided: DataFrame, config: Config) -> DataFrame:
    s = config.selection
    close = (F.col("upper.year") <= s.cutoff_year) & (F.col("winner.confidence") - F.col("upper.confidence") < s.takeover_gap)
    return decided.withColumn("final", F.when(F.coalesce(close, F.lit(False)), F.col("upper")).otherwise(F.col("winner")))


def _settled(reads: DataFrame, tight: Column | None, config: Config) -> DataFrame:
    """Each date of each card, with the card's final, birth and expiry dates and its method."""
    s = config.selection
    voted = vote(reads, F.lit(False) if tight is None else tight)
    decided = _fields(_takeover(_decide_all(voted, config), config), config)
    cut_out = F.max("tight").over(Window.partitionBy("card_id"))
    single, winner = F.col("method") == "single", F.col("winner")
    lone = single & ~F.col("cut_out") & (winner["year"] > s.cutoff_year) & (F.coalesce(winner["y_min"], F.lit(0.0)) > s.lone_y)
    decided = decided.withColumn("cut_out", cut_out).withColumn("lone", lone)
    return decided.select(
        "card_id", "formatted", "confidence", "votes", "rank", "final", "swapped", "sequence_error", "n",
        F.when(~F.col("lone"), F.col("birth.formatted")).alias("birth"),
        F.when(F.col("lone"), winner["formatted"]).otherwise(F.col("expiry.formatted")).alias("expiry"),
        F.when(F.col("lone"), "single-expiry").when(single & F.col("cut_out"), "single-crop").otherwise(F.col("method")).alias("method"),
    )


def finalise(reads: DataFrame, attempts: DataFrame | None = None, tight: Column | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row a card: best date (null rather than a guess), birth, expiry, method.

    ``attempts`` (card_id, formatted, y_min, roi_w, confidence, attempt_id) are what may be shown for
    the winner; without them the reads themselves are, and the surest of its date is its own.
    ``tight`` tells, by columns of the reads, whether the user had cut out the line.
    """
    out = _one_each(_settled(reads, tight, config))
    if attempts is None:
        out = out.withColumn("attempt_id", F.col("final.read_id"))
    else:
        out = out.join(attach_attempt(out.select("card_id", "final"), attempts), "card_id", "left")
    ok = ~F.col("sequence_error") & (F.col("method") != "single-expiry") & F.col("attempt_id").isNotNull()
    return out.select(
        "card_id", F.when(ok, F.col("final.formatted")).alias("best"), F.when(ok, F.col("final.confidence")).alias("confidence"),
        F.when(ok, F.col("final.votes")).alias("votes"), F.when(ok, F.col("attempt_id")).alias("attempt_id"),
        "birth", "expiry", "swapped", "method", "sequence_error", F.col("n").alias("n_dates"),
    )


def attach_attempt(winners: DataFrame, attempts: DataFrame) -> DataFrame:
    """The attempt that shows each winner (card_id, final): its own box if any, else the same date, the surest first."""
    own = F.col("roi_w").eqNullSafe(F.col("final.roi_w")) & F.col("y_min").eqNullSafe(F.col("final.y_min"))
    return (
        attempts.join(winners, "card_id")
        .where(F.col("formatted") == F.col("final.formatted"))
        .groupBy("card_id")
        .agg(F.max_by("attempt_id", F.struct(own, F.col("confidence"), -F.col("attempt_id"))).alias("attempt_id"))
    )


def tag(reads: DataFrame, tight: Column | None = None, config: Config = DEFAULT) -> DataFrame:
    """Each ranked date of each card with its field: birth, expiry or unknown."""
    f = F.when(F.col("formatted") == F.col("birth"), "birth").when(F.col("formatted") == F.col("expiry"), "expiry").otherwise("unknown")
    return _settled(reads, tight, config).select("card_id", "formatted", "confidence", "votes", "rank", f.alias("field"))


def alternatives(voted: DataFrame) -> DataFrame:
    """Ranks 2 to 6 of each card, as shown beside the result."""
    return rank(voted).where(F.col("rank").between(2, 6))
