"""Agreement of several frames on one date, as batch queries.

Input rows are frames: session, frame (their order), formatted (null: nothing read), confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daftar.config import DEFAULT


def since_reset(frames: DataFrame) -> DataFrame:
    """The frames of each session after its last reset (a frame whose ``reset`` is true clears what was seen before it)."""
    last = frames.where("reset").groupBy("session").agg(F.max("frame").alias("last_reset"))
    out = frames.join(last, "session", "left")
    return out.where(F.col("last_reset").isNull() | (F.col("frame") >= F.col("last_reset"))).drop("last_reset", "reset")


def vote_table(frames: DataFrame) -> DataFrame:
    """One row a session and date: frames, summed confidence, and the last frame's confidence."""
    return (
        frames.where("formatted is not null")
        .groupBy("session", "formatted")
        .agg(
            F.count("*").alias("count"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("total_confidence"),
            F.max_by("confidence", "frame").alias("last_confidence"), F.min("frame").alias("first_frame"),
        )
    )


def status(frames: DataFrame, required: int = DEFAULT.required_votes) -> DataFrame:
    """The leading date of each session (the first seen of equals) and whether it is agreed."""
    lead = F.max_by(F.struct("formatted", "count", "total_confidence"), F.struct(F.col("count"), -F.col("first_frame")))
    out = vote_table(frames).groupBy("session").agg(lead.alias("b"))
    return out.select(
        "session", "b.formatted", "b.count", "b.total_confidence", F.when(F.col("b.count") >= required, F.col("b.formatted")).alias("agreed")
    )


def first_agreement(frames: DataFrame, required: int = DEFAULT.required_votes) -> DataFrame:
    """The frame at which each session first agrees, and on what: where reading stops.

    Spark limits the window to ``required`` frames a date in each task before it shuffles, so a long session is no large group.
    """
    each = Window.partitionBy("session", "formatted").orderBy("frame")
    counted = frames.where("formatted is not null").withColumn("n", F.row_number().over(each)).where(F.col("n") == required)
    return counted.groupBy("session").agg(F.min("frame").alias("frame"), F.min_by("formatted", "frame").alias("agreed"))


def consensus_result(frames: DataFrame, required: int = DEFAULT.required_votes) -> DataFrame:
    """A row a session: the agreed date with the last frame that was read, or an error."""
    agreed = first_agreement(frames, required)
    last = frames.groupBy("session").agg(F.max("frame").alias("last_frame"))
    out = last.join(agreed, "session", "left")
    return out.select(
        "session", F.coalesce("frame", "last_frame").alias("frame"), "agreed",
        F.when(F.col("agreed").isNull(), F.lit("no agreement")).alias("error"),
    )
