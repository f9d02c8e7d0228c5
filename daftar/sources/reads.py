"""Reads of document lines: the schema, and a deterministic stand-in over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.config import DEFAULT, Config
from daftar.functions.text import to_latin_digits, with_dates

#: The same text in both SQL dialects; six ways of writing a date.
SYNTHETIC_READS_SQL = """
WITH k AS (
  SELECT user_id AS card_id, event_id AS read_id,
         1285 + ((user_id*37 + (event_id%3)*11) % 125) AS y,
         1 + ((user_id*5 + (event_id%3)*7) % 13) AS m,
         1 + ((user_id*11 + (event_id%3)*5) % 32) AS d,
         event_id % 6 AS fmt,
         CAST(5000 + ((event_id*31) % 5000) AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
         CAST((event_id*17) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS date_prob,
         CAST((event_id*13) % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS y_min,
         100 + ((event_id*29) % 300) AS roi_w,
         ts
  FROM {events}),
z AS (SELECT *, lpad(CAST(y AS VARCHAR(4)),4,'0') AS ys, lpad(CAST(m AS VARCHAR(2)),2,'0') AS ms, lpad(CAST(d AS VARCHAR(2)),2,'0') AS ds FROM k)
SELECT card_id, read_id, y, m, d, fmt, confidence, date_prob, y_min, roi_w, ts,
  CASE fmt
    WHEN 0 THEN concat(ys,'/',ms,'/',ds)
    WHEN 1 THEN concat(ys,'-',CAST(m AS VARCHAR(2)),'-',CAST(d AS VARCHAR(2)))
    WHEN 2 THEN concat(ys,ms,ds)
    WHEN 3 THEN concat(ds,'.',ms,'.',ys)
    WHEN 4 THEN translate(concat('/',ys,'|',ms,'|',ds,'/'),'0123456789','۰۱۲۳۴۵۶۷۸۹')
    ELSE translate(concat('x ',ys,'/',ms,'/',ds),'0123456789','٠١٢٣٤٥٦٧٨٩')
  END AS raw
FROM z
"""


def synthetic_reads(events: DataFrame) -> DataFrame:
    """Raw reads (card_id, read_id, raw, confidence, date_prob, y_min, roi_w, ...) derived from events."""
    return events.sparkSession.sql(SYNTHETIC_READS_SQL.format(events="{events}"), events=events)


def parsed_reads(raw: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Reads whose text is a valid date, with its parts; reads that aren't are dropped, never guessed."""
    return with_dates(raw, F.col("raw"), config.calendar)


def load_labels_csv(spark, path: str, files: DataFrame | None = None) -> DataFrame:
    """Headerless ``file,label`` lines: label ``none`` is a negative, eight digits a positive, others are dropped.

    With ``files`` (file), lines whose file doesn't exist are dropped too.
    """
    rows = spark.read.schema("file string, label string").csv(path)
    digits = F.regexp_replace(to_latin_digits(F.col("label")), "[^0-9]", "")
    rows = rows.withColumn("digits", F.when(F.lower(F.trim("label")) != "none", digits))
    rows = rows.where(F.col("digits").isNull() | (F.length("digits") == 8)).where("label is not null")
    if files is not None:
        rows = rows.join(files.select("file"), "file", "left_semi")
    return rows.select("file", F.col("digits").isNotNull().alias("positive"), "digits")


def load_scene_labels(spark, path: str) -> DataFrame:
    """A JSON array of ``{file, birth}``."""
    return spark.read.schema("file string, birth string").option("multiLine", True).json(path)
