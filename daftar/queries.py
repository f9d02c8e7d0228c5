"""All queries outside ``daftar.llm``, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.config import DEFAULT
from daftar.functions import arrays as A
from daftar.functions import geometry as G
from daftar.functions import text as T
from daftar.functions.calendar import days_in_month, is_leap_year, is_valid_date
from daftar.operators import boxes as B
from daftar.operators import consensus as C
from daftar.operators import digits as D
from daftar.operators import evaluation as E
from daftar.operators import selection as S
from daftar.sources import reads as R
from daftar.sources import scenes as Z

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query by its name, with its SQL if there is any."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


# --- date text ---------------------------------------------------------------------------------

RAW = R.SYNTHETIC_READS_SQL.format(events="events").strip()
DIGITS_SQL = "translate(raw, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789')"
REPAIR_SQL = rf"""
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({DIGITS_SQL},
  '[\\|\-.:،٫٬⁄／]', '/', 'g'), '[^0-9/]', '', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g'),
  '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})$', '\1/\2/\3'), '^([0-9]{{0,2}})/([0-9]*)/([0-9]{{4}})$', '\3/\2/\1')"""
LEAP_SQL = "(y % 33 IN (1,5,9,13,17,22,26,30))"
DAYS_SQL = f"(CASE WHEN m <= 6 THEN 31 WHEN m <= 11 THEN 30 WHEN {LEAP_SQL} THEN 30 ELSE 29 END)"
FORMAT_SQL = "concat(y, '/', lpad(CAST(m AS VARCHAR), 2, '0'), '/', lpad(CAST(d AS VARCHAR), 2, '0'))"
PARSED_SQL = f"""
raw_reads AS ({RAW}),
fixed AS (SELECT card_id, read_id, confidence, date_prob, y_min, roi_w, raw, {REPAIR_SQL} AS s FROM raw_reads),
parts AS (SELECT *, TRY_CAST(split_part(s,'/',1) AS INT) AS y, TRY_CAST(split_part(s,'/',2) AS INT) AS m, TRY_CAST(split_part(s,'/',3) AS INT) AS d
          FROM fixed WHERE regexp_matches(s, '^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}$')),
parsed AS (SELECT card_id, read_id, confidence, date_prob, y_min, roi_w, raw, y AS year, m AS month, d AS day, {FORMAT_SQL} AS formatted
           FROM parts WHERE y BETWEEN 1290 AND 1410 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND {DAYS_SQL})"""
ACCEPTED_SQL = PARSED_SQL + ",\naccepted AS (SELECT * FROM parsed WHERE date_prob >= 0.6 AND confidence >= 60)"
READ_COLUMNS = ("card_id", "read_id", "formatted", "year", "confidence", "date_prob", "y_min", "roi_w")
COLUMNS_SQL = ", ".join(READ_COLUMNS)


def raw_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.synthetic_reads(table(spark, sf_dir, "events"))


def accepted_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.accept(R.parsed_reads(raw_reads(spark, sf_dir)))


@query(f"SELECT read_id, {DIGITS_SQL} AS digits FROM ({RAW})")
def digit_normalise(spark, sf_dir):
    return raw_reads(spark, sf_dir).select("read_id", T.to_latin_digits(F.col("raw")).alias("digits"))


@query(f"SELECT read_id, translate({DIGITS_SQL}, '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS shown FROM ({RAW})")
def persian_digits(spark, sf_dir):
    return raw_reads(spark, sf_dir).select("read_id", T.to_persian_digits(T.to_latin_digits(F.col("raw"))).alias("shown"))


@query(f"SELECT read_id, regexp_replace({DIGITS_SQL}, '[^0-9]', '', 'g') AS digits FROM ({RAW})")
def only_digits(spark, sf_dir):
    return raw_reads(spark, sf_dir).select("read_id", T.only_digits(T.to_latin_digits(F.col("raw"))).alias("digits"))


@query(f"SELECT read_id, {REPAIR_SQL} AS repaired FROM ({RAW})")
def repair_structure(spark, sf_dir):
    return raw_reads(spark, sf_dir).select("read_id", T.repair_structure(F.col("raw")).alias("repaired"))


@query(f"WITH {PARSED_SQL} SELECT read_id, year, month, day, formatted FROM parsed")
def parse_dates(spark, sf_dir):
    return R.parsed_reads(raw_reads(spark, sf_dir)).select("read_id", "year", "month", "day", "formatted")


@query(f"SELECT read_id, y, m, {LEAP_SQL} AS leap, {DAYS_SQL} AS days, {FORMAT_SQL} AS formatted FROM ({RAW})")
def jalali_leap(spark, sf_dir):
    y, m, d = F.col("y"), F.col("m"), F.col("d")
    return raw_reads(spark, sf_dir).select("read_id", "y", "m", is_leap_year(y).alias("leap"), days_in_month(y, m).alias("days"), T.format_date(y, m, d).alias("formatted"))


@query(f"SELECT read_id, (y BETWEEN 1290 AND 1410 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND {DAYS_SQL}) AS valid FROM ({RAW})")
def jalali_valid(spark, sf_dir):
    return raw_reads(spark, sf_dir).select("read_id", is_valid_date(F.col("y"), F.col("m"), F.col("d")).alias("valid"))


# --- from reads to results -----------------------------------------------------------------------


@query(f"WITH {ACCEPTED_SQL} SELECT {COLUMNS_SQL} FROM accepted")
def accept_reads(spark, sf_dir):
    return accepted_reads(spark, sf_dir).select(*READ_COLUMNS)


@query(f"WITH {ACCEPTED_SQL} SELECT {COLUMNS_SQL} FROM accepted QUALIFY y_min <= min(y_min) OVER (PARTITION BY card_id) + 0.02")
def suppress_rows(spark, sf_dir):
    return S.suppress_lower_rows(accepted_reads(spark, sf_dir)).select(*READ_COLUMNS)


YOUNG_SQL = ", young AS (SELECT * FROM accepted QUALIFY year <= 1400 OR NOT bool_or(year <= 1400) OVER (PARTITION BY card_id))"


@query(f"WITH {ACCEPTED_SQL}{YOUNG_SQL} SELECT {COLUMNS_SQL} FROM young")
def year_cutoff(spark, sf_dir):
    return S.year_cutoff(accepted_reads(spark, sf_dir)).select(*READ_COLUMNS)


@query(f"WITH {ACCEPTED_SQL}{YOUNG_SQL} SELECT {COLUMNS_SQL} FROM young QUALIFY roi_w >= 140 OR NOT bool_or(roi_w >= 140) OVER (PARTITION BY card_id)")
def full_strip(spark, sf_dir):
    return S.full_strips(S.year_cutoff(accepted_reads(spark, sf_dir))).select(*READ_COLUMNS)


VOTED_SQL = (
    ACCEPTED_SQL
    + """,
best_read AS (SELECT * FROM accepted QUALIFY row_number() OVER (PARTITION BY card_id, formatted ORDER BY confidence DESC, read_id) = 1),
sums AS (SELECT card_id, formatted, count(*) AS votes, sum(confidence) AS total_confidence, min(read_id) AS first_read FROM accepted GROUP BY ALL),
voted AS (SELECT b.*, s.votes, s.total_confidence, s.total_confidence / s.votes AS average_confidence, s.first_read
          FROM best_read b JOIN sums s USING (card_id, formatted)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY confidence DESC, first_read) AS rank, count(*) OVER (PARTITION BY card_id) AS n FROM voted)"""
)
VOTE_COLUMNS = ("card_id", "formatted", "year", "votes", "confidence", "y_min", "roi_w", "first_read")


@query(f"WITH {VOTED_SQL} SELECT {', '.join(VOTE_COLUMNS)}, round(total_confidence, 6) AS total_confidence, round(average_confidence, 6) AS average_confidence FROM voted")
def vote_aggregate(spark, sf_dir):
    v = S.vote(accepted_reads(spark, sf_dir))
    return v.select(*VOTE_COLUMNS, r6("total_confidence").alias("total_confidence"), r6("average_confidence").alias("average_confidence"))


@query(f"WITH {VOTED_SQL} SELECT card_id, formatted, confidence, votes, rank FROM ranked")
def rank_dates(spark, sf_dir):
    return S.rank(S.vote(accepted_reads(spark, sf_dir))).select("card_id", "formatted", "confidence", "votes", "rank")


@query(f"WITH {VOTED_SQL} SELECT card_id, formatted, confidence, rank FROM ranked WHERE rank BETWEEN 2 AND 6")
def date_alternatives(spark, sf_dir):
    return S.alternatives(S.vote(accepted_reads(spark, sf_dir))).select("card_id", "formatted", "confidence", "rank")


WINNER_SQL = (
    VOTED_SQL
    + """,
pool AS (SELECT * FROM ranked QUALIFY year <= 1400 OR NOT bool_or(year <= 1400) OVER (PARTITION BY card_id)),
raced AS (SELECT * FROM pool QUALIFY roi_w >= 140 OR NOT bool_or(roi_w >= 140) OVER (PARTITION BY card_id)),
winner AS (SELECT * FROM raced QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY confidence DESC, date_prob DESC, y_min, rank) = 1)"""
)


@query(f"WITH {WINNER_SQL} SELECT card_id, formatted, year, confidence, date_prob, y_min, votes FROM winner")
def select_best(spark, sf_dir):
    return S.select_best(S.vote(accepted_reads(spark, sf_dir))).select("card_id", "formatted", "year", "confidence", "date_prob", "y_min", "votes")


FINAL_SQL = (
    WINNER_SQL
    + """,
upper AS (SELECT r.* FROM ranked r JOIN winner w USING (card_id) WHERE r.formatted <> w.formatted AND r.y_min < w.y_min - 0.015
          QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY r.confidence DESC, r.year, r.rank) = 1),
taken AS (SELECT w.card_id, w.formatted AS winner, w.year AS winner_year, w.y_min AS winner_y,
                 CASE WHEN u.year <= 1400 AND w.confidence - u.confidence < 15 THEN u.formatted ELSE w.formatted END AS final
          FROM winner w LEFT JOIN upper u USING (card_id)),
by_y AS (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY y_min, year, rank) AS yr FROM ranked),
late AS (SELECT * FROM by_y WHERE yr > 1 QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY year DESC, yr) = 1),
early AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY year, y_min, rank) = 1),
fields AS (SELECT w.card_id, w.n, w.n = 1 AND w.year > 1400 AND w.y_min > 0.65 AS only_late, e.formatted AS e, e.year AS ey, e.y_min AS eyy,
                  l.formatted AS l, l.year AS ly, l.y_min AS lyy, w.formatted AS w
           FROM winner w JOIN early e USING (card_id) LEFT JOIN late l USING (card_id)),
assigned AS (SELECT card_id, n, CASE WHEN only_late THEN NULL ELSE e END AS birth, CASE WHEN only_late THEN w WHEN n > 1 THEN l END AS expiry,
                    coalesce(n > 1 AND eyy > lyy AND ey < ly, false) AS swapped, CASE WHEN n = 1 THEN 'single' ELSE 'y-sort' END AS method,
                    coalesce(n > 1 AND ey > ly, false) AS sequence_error FROM fields),
final AS (SELECT a.card_id, CASE WHEN a.n = 1 AND t.winner_year > 1400 AND t.winner_y > 0.65 THEN NULL ELSE a.birth END AS birth,
                 CASE WHEN a.n = 1 AND t.winner_year > 1400 AND t.winner_y > 0.65 THEN t.winner ELSE a.expiry END AS expiry,
                 CASE WHEN a.n = 1 AND t.winner_year > 1400 AND t.winner_y > 0.65 THEN 'single-expiry' ELSE a.method END AS method,
                 a.swapped, a.sequence_error, a.n, t.final FROM assigned a JOIN taken t USING (card_id)),
results AS (SELECT f.card_id, CASE WHEN NOT f.sequence_error AND f.method <> 'single-expiry' THEN r.formatted END AS best,
                   CASE WHEN NOT f.sequence_error AND f.method <> 'single-expiry' THEN r.confidence END AS confidence,
                   CASE WHEN NOT f.sequence_error AND f.method <> 'single-expiry' THEN r.votes END AS votes,
                   CASE WHEN NOT f.sequence_error AND f.method <> 'single-expiry' THEN t.read_id END AS attempt_id,
                   f.birth, f.expiry, f.swapped, f.method, f.sequence_error, f.n AS n_dates
            FROM final f JOIN ranked r ON r.card_id = f.card_id AND r.formatted = f.final
            JOIN (SELECT a.card_id, a.formatted, a.read_id FROM accepted a JOIN ranked r USING (card_id, formatted)
                  QUALIFY row_number() OVER (PARTITION BY a.card_id, a.formatted
                    ORDER BY (a.roi_w = r.roi_w AND a.y_min = r.y_min) DESC, a.confidence DESC, a.read_id) = 1) t
              ON t.card_id = f.card_id AND t.formatted = f.final)"""
)


@query(f"WITH {FINAL_SQL} SELECT card_id, winner, final FROM taken")
def takeover(spark, sf_dir):
    return S.takeover(S.vote(accepted_reads(spark, sf_dir)))


@query(f"WITH {FINAL_SQL} SELECT card_id, birth, expiry, swapped, method, sequence_error FROM assigned")
def assign_fields(spark, sf_dir):
    return S.assign_fields(S.vote(accepted_reads(spark, sf_dir)))


@query(f"WITH {FINAL_SQL} SELECT * FROM results")
def final_result(spark, sf_dir):
    """The flagship query: one row a card, from accepted reads."""
    return S.finalise(accepted_reads(spark, sf_dir))


@query(
    f"WITH {FINAL_SQL} SELECT r.card_id, r.formatted, r.rank, CASE WHEN r.formatted = x.birth THEN 'birth' "
    "WHEN r.formatted = x.expiry THEN 'expiry' ELSE 'unknown' END AS field FROM ranked r JOIN results x USING (card_id)"
)
def tagged_dates(spark, sf_dir):
    return S.tag(accepted_reads(spark, sf_dir)).select("card_id", "formatted", "rank", "field")


@query(
    f"WITH {FINAL_SQL} SELECT card_id, best IS NOT NULL AS ok, coalesce(translate(best, '0123456789', '۰۱۲۳۴۵۶۷۸۹'), '') AS shown, "
    "coalesce(confidence, 0.0::DOUBLE) AS score, CASE WHEN best IS NULL THEN 'retake' END AS error FROM results"
)
def ui_result(spark, sf_dir):
    """What a user is shown; a missing date is an error, never a success."""
    r = S.finalise(accepted_reads(spark, sf_dir))
    return r.select(
        "card_id", F.col("best").isNotNull().alias("ok"), F.coalesce(T.to_persian_digits(F.col("best")), F.lit("")).alias("shown"),
        F.coalesce("confidence", F.lit(0.0)).alias("score"), F.when(F.col("best").isNull(), "retake").alias("error"),
    )


@query(
    f"WITH {PARSED_SQL}, a AS (SELECT * FROM parsed WHERE date_prob >= 0.6 AND confidence >= 60), "
    "open AS (SELECT DISTINCT card_id FROM raw_reads WHERE card_id NOT IN (SELECT card_id FROM a WHERE confidence >= 80)) "
    "SELECT card_id FROM open"
)
def second_pass_cards(spark, sf_dir):
    """Cards that a second pass must read again: those without a sure date."""
    sure = accepted_reads(spark, sf_dir).where(F.col("confidence") >= DEFAULT.acceptance.skip_second_pass).select("card_id")
    return raw_reads(spark, sf_dir).select("card_id").distinct().join(sure, "card_id", "left_anti")


# --- agreement of frames -------------------------------------------------------------------------


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.when(F.col("date_prob") >= 0.6, T.parse_date(F.col("raw"))["formatted"])
    return raw_reads(spark, sf_dir).select(F.col("card_id").alias("session"), F.col("read_id").alias("frame"), date.alias("formatted"), "confidence")


FRAMES_SQL = f"{PARSED_SQL}, frames AS (SELECT r.card_id AS session, r.read_id AS frame, p.formatted, r.confidence FROM raw_reads r LEFT JOIN (SELECT * FROM parsed WHERE date_prob >= 0.6) p USING (read_id))"
TALLY_SQL = FRAMES_SQL + ", tally AS (SELECT session, formatted, count(*) AS count, sum(confidence) AS total, min(frame) AS first FROM frames WHERE formatted IS NOT NULL GROUP BY ALL)"


@query(
    f"WITH {TALLY_SQL} SELECT session, formatted, count, round(total, 6) AS total_confidence, CASE WHEN count >= 2 THEN formatted END AS agreed "
    "FROM tally QUALIFY row_number() OVER (PARTITION BY session ORDER BY count DESC, first) = 1"
)
def consensus_batch(spark, sf_dir):
    return C.status(frames(spark, sf_dir)).withColumn("total_confidence", r6("total_confidence"))


FIRST_SQL = FRAMES_SQL + (
    ", second AS (SELECT session, formatted, frame FROM frames WHERE formatted IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, formatted ORDER BY frame) = 2),"
    " agreed AS (SELECT session, frame, formatted AS agreed FROM second QUALIFY row_number() OVER (PARTITION BY session ORDER BY frame) = 1)"
)


@query(f"WITH {FIRST_SQL} SELECT * FROM agreed")
def consensus_first_agreement(spark, sf_dir):
    return C.first_agreement(frames(spark, sf_dir))


@query(
    f"WITH {FIRST_SQL} SELECT l.session, coalesce(a.frame, l.frame) AS frame, a.agreed, CASE WHEN a.agreed IS NULL THEN 'no agreement' END AS error "
    "FROM (SELECT session, max(frame) AS frame FROM frames GROUP BY ALL) l LEFT JOIN agreed a USING (session)"
)
def consensus_result(spark, sf_dir):
    return C.consensus_result(frames(spark, sf_dir))


# --- boxes ---------------------------------------------------------------------------------------

BOX_SQL = "SELECT vec_id, CAST(vec_id // 40 AS BIGINT) AS image_id, label, CAST((vec_id*37)%900 AS INT) AS x, CAST((vec_id*53)%700 AS INT) AS y, CAST(90+(vec_id*29)%300 AS INT) AS width, CAST(18+(vec_id*7)%60 AS INT) AS height FROM embeddings"
COLS, ROWS = 1200, 756


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.floor(v / 40).alias("image_id"), "label", ((v * 37) % 900).cast("int").alias("x"), ((v * 53) % 700).cast("int").alias("y"),
        (90 + (v * 29) % 300).cast("int").alias("width"), (18 + (v * 7) % 60).cast("int").alias("height"),
    )


def as_box() -> F.Column:
    return F.struct("x", "y", "width", "height")


@query(
    f"SELECT vec_id, round(0.7::DOUBLE * greatest(0, least(1, ((x + width) / 1200.0::DOUBLE - 0.35::DOUBLE) / 0.6::DOUBLE)) "
    f"+ 0.3::DOUBLE * (CASE WHEN width / 1200.0::DOUBLE BETWEEN 0.12::DOUBLE AND 0.75::DOUBLE THEN 1 ELSE 0.25::DOUBLE END), 6) AS score FROM ({BOX_SQL})"
)
def anchor_score(spark, sf_dir):
    return line_boxes(spark, sf_dir).select("vec_id", r6(G.anchor_score(as_box(), F.lit(COLS), F.lit(ROWS))).alias("score"))


@query(
    f"SELECT vec_id, x0 AS x, y0 AS y, greatest(1, least(1200, x + width + 10) - x0) AS width, greatest(1, least(756, y + height + 13) - y0) AS height "
    f"FROM (SELECT *, greatest(0, x - 10) AS x0, greatest(0, y - 13) AS y0 FROM ({BOX_SQL}))"
)
def expand_roi(spark, sf_dir):
    return line_boxes(spark, sf_dir).select("vec_id", G.expand_roi(as_box(), F.lit(COLS), F.lit(ROWS)).alias("b")).select("vec_id", "b.*")


@query(
    f"""WITH v(variant, dx, dy, g) AS (VALUES (0, -0.1::DOUBLE, 0::DOUBLE, 0.1::DOUBLE), (1, 0.1, 0, 0.1), (2, 0, -0.05, 0.12), (3, 0, 0.05, 0.16)),
a AS (SELECT vec_id, variant, width * (1 + g) AS gw, height * (1 + g) AS gh, x + width / 2.0::DOUBLE + dx * width AS cx,
             y + height / 2.0::DOUBLE + dy * height AS cy FROM ({BOX_SQL}) CROSS JOIN v),
b AS (SELECT *, greatest(0, least(floor(cx - gw / 2 + 0.5::DOUBLE), 1199)) AS nx, greatest(0, least(floor(cy - gh / 2 + 0.5::DOUBLE), 755)) AS ny FROM a)
SELECT vec_id, variant, CAST(nx AS INT) AS x, CAST(ny AS INT) AS y, CAST(greatest(8, least(floor(gw + 0.5::DOUBLE), 1200 - nx)) AS INT) AS width,
       CAST(greatest(8, least(floor(gh + 0.5::DOUBLE), 756 - ny)) AS INT) AS height FROM b"""
)
def variant_boxes(spark, sf_dir):
    rows = line_boxes(spark, sf_dir).select("vec_id", as_box().alias("b"), F.explode(G.variants()).alias("v"))
    return rows.select("vec_id", F.col("v.variant").alias("variant"), G.variant_box(F.col("b"), F.col("v"), F.lit(COLS), F.lit(ROWS)).alias("n")).select("vec_id", "variant", "n.*")


@query(
    f"""WITH b AS ({BOX_SQL}), p AS (SELECT a.vec_id, a.width * a.height + c.width * c.height AS s,
  greatest(0, least(a.x + a.width, c.x + c.width) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.height, c.y + c.height) - greatest(a.y, c.y)) AS i
  FROM b a JOIN b c ON c.vec_id = a.vec_id + 1) SELECT vec_id, round(i / (s - i)::DOUBLE, 6) AS iou FROM p"""
)
def iou_pairs(spark, sf_dir):
    rows = line_boxes(spark, sf_dir)
    a, b = rows.select("vec_id", as_box().alias("a")), rows.select((F.col("vec_id") - 1).alias("vec_id"), as_box().alias("b"))
    return a.join(b, "vec_id").select("vec_id", r6(G.iou(F.col("a"), F.col("b"))).alias("iou"))


@query(
    f"SELECT image_id, vec_id, row_number() OVER (PARTITION BY image_id ORDER BY abs(y + height / 2.0::DOUBLE - 0.52::DOUBLE * 756), vec_id) AS place "
    f"FROM ({BOX_SQL}) QUALIFY place <= 18"
)
def topk_boxes(spark, sf_dir):
    return B.nearest_to_row(line_boxes(spark, sf_dir).withColumn("seq", F.col("vec_id")), F.lit(ROWS)).select("image_id", "vec_id", "place")


@query(
    f"""WITH RECURSIVE b AS (SELECT image_id, vec_id, x, y, width AS w, height AS h, row_number() OVER (PARTITION BY image_id ORDER BY vec_id) AS place FROM ({BOX_SQL})),
s AS (SELECT image_id, CAST(0 AS BIGINT) AS place, CAST([] AS STRUCT(vec_id BIGINT, x INT, y INT, w INT, h INT)[]) AS kept FROM b GROUP BY image_id
  UNION ALL SELECT s.image_id, b.place, CASE WHEN len(list_filter(kept, lambda k:
    greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y)) * 1.6::DOUBLE > 0.6::DOUBLE * (k.w * k.h + b.w * b.h))) = 0
    THEN list_append(kept, {{'vec_id': b.vec_id, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) ELSE kept END FROM s JOIN b ON b.image_id = s.image_id AND b.place = s.place + 1)
SELECT image_id, unnest(kept).vec_id AS vec_id FROM s QUALIFY place = max(place) OVER (PARTITION BY image_id)"""
)
def nms_boxes(spark, sf_dir):
    rows = line_boxes(spark, sf_dir).withColumnRenamed("vec_id", "seq").drop("label")
    return B.suppress_overlaps(rows).select("image_id", F.col("seq").alias("vec_id"))


@query(
    f"SELECT vec_id, (height BETWEEN 18 AND 84 AND width >= 90 AND width / height::DOUBLE >= 2.2::DOUBLE AND width <= 1080) AS line, "
    f"(x >= 96 AND y >= 136 AND x + width <= 1188 AND y + height <= 703) AS in_band FROM ({BOX_SQL})"
)
def line_geometry(spark, sf_dir):
    b, cols, rows = as_box(), F.lit(COLS), F.lit(ROWS)
    return line_boxes(spark, sf_dir).select("vec_id", G.is_line(b, cols).alias("line"), G.in_band(b, cols, rows).alias("in_band"))


@query(
    f"SELECT vec_id, CAST(floor(width * abs(cos(radians(label * 30))) + height * abs(sin(radians(label * 30))) + 0.5::DOUBLE) AS INT) AS width, "
    f"CAST(floor(width * abs(sin(radians(label * 30))) + height * abs(cos(radians(label * 30))) + 0.5::DOUBLE) AS INT) AS height FROM ({BOX_SQL})"
)
def rotated_size(spark, sf_dir):
    return line_boxes(spark, sf_dir).select("vec_id", G.rotated_size(F.col("width"), F.col("height"), F.col("label") * 30).alias("s")).select("vec_id", "s.*")


def _points() -> F.Column:
    """A slanted quadrilateral from a box, corners out of order."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    return F.array(p(x + w, y + h), p(x, y), p(x + 5, y + h), p(x + w, y + 3))


@query(
    f"SELECT vec_id, round(abs((x+w)*y*1.0::DOUBLE - x*(y+h) + x*(y+h) - (x+5)*y + (x+5)*(y+3) - (x+w)*(y+h) + (x+w)*(y+h) - (x+w)*(y+3)) / 2, 6) AS area, "
    f"x::DOUBLE AS left_x, (x+w)::DOUBLE AS right_x, (y+h)::DOUBLE AS bottom_y FROM (SELECT vec_id, x, y, width AS w, height AS h FROM ({BOX_SQL}))"
)
def quad_corners(spark, sf_dir):
    rows = line_boxes(spark, sf_dir).select("vec_id", _points().alias("p"))
    rows = rows.select("vec_id", G.polygon_area(F.col("p")).alias("area"), G.order_corners(F.col("p")).alias("c"))
    at = lambda i, k: F.get("c", F.lit(i))[k]
    return rows.select("vec_id", r6("area").alias("area"), at(0, "x").alias("left_x"), at(1, "x").alias("right_x"), at(3, "y").alias("bottom_y"))


# --- vectors and small images ------------------------------------------------------------------

PX_SQL = "SELECT vec_id, label, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(e::DOUBLE * 255 + 128))) AS INT)) AS px FROM embeddings"


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 gray images from embeddings."""
    px = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(e.cast("double") * 255 + 128))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", px.alias("px"))


def spread(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row an element: (vec_id, place, name)."""
    return df.select("vec_id", F.posexplode(column).alias("place", name))


@query(f"SELECT vec_id, generate_subscripts(px, 1) - 1 AS place, unnest(CASE WHEN list_avg(px) < 110 THEN list_transform(px, lambda v: 255 - v) ELSE px END) AS v FROM ({PX_SQL})")
def polarity(spark, sf_dir):
    return spread(grids(spark, sf_dir).withColumn("o", A.invert_dark(F.col("px"))), "o", "v")


@query(f"SELECT vec_id, generate_subscripts(px, 1) - 1 AS place, unnest(list_transform(px, lambda v: CAST(least(255, round_even(v * 1.12::DOUBLE + 8, 0)) AS INT))) AS v FROM ({PX_SQL})")
def lift_readability(spark, sf_dir):
    return spread(grids(spark, sf_dir).withColumn("o", A.lift(F.col("px"))), "o", "v")


@query(
    f"SELECT vec_id, generate_subscripts(px, 1) - 1 AS place, unnest(list_transform(px, lambda v: CAST(floor((v - list_min(px)) * 255.0::DOUBLE / (list_max(px) - list_min(px)) + 0.5::DOUBLE) AS INT))) AS v FROM ({PX_SQL})"
)
def contrast_stretch(spark, sf_dir):
    return spread(grids(spark, sf_dir).withColumn("o", A.stretch(F.col("px"))), "o", "v")


@query(
    f"SELECT vec_id, round(list_avg(px), 6) AS mu, round(list_stddev_pop(px), 6) AS sigma, list_min(px) AS low, list_max(px) AS high FROM ({PX_SQL})"
)
def pixel_stats(spark, sf_dir):
    p = F.col("px")
    return grids(spark, sf_dir).select("vec_id", r6(A.mean(p)).alias("mu"), r6(A.deviation(p)).alias("sigma"), F.array_min(p).alias("low"), F.array_max(p).alias("high"))


@query(
    f"SELECT vec_id, place, round((v - avg(v) OVER w) / (stddev_pop(v) OVER w + 0.000001::DOUBLE), 6) AS v FROM "
    f"(SELECT vec_id, generate_subscripts(px, 1) - 1 AS place, unnest(px) AS v FROM ({PX_SQL})) WINDOW w AS (PARTITION BY vec_id)"
)
def standardise(spark, sf_dir):
    return spread(grids(spark, sf_dir).withColumn("o", F.transform(A.standardise(F.col("px")), r6)), "o", "v")


@query(
    f"SELECT vec_id, y * 4 + x AS place, greatest(px[16*y+2*x+1], px[16*y+2*x+2], px[16*y+2*x+9], px[16*y+2*x+10]) AS v "
    f"FROM ({PX_SQL}), range(4) a(y), range(4) b(x)"
)
def max_pool(spark, sf_dir):
    return spread(grids(spark, sf_dir).withColumn("o", A.max_pool(F.col("px"), 8, 8)), "o", "v")


@query(f"SELECT vec_id, y * 5 + x AS place, px[(y * 8 // 3) * 8 + x * 8 // 5 + 1] AS v FROM ({PX_SQL}), range(3) a(y), range(5) b(x)")
def resize_nearest(spark, sf_dir):
    return spread(grids(spark, sf_dir).withColumn("o", A.resize_nearest(F.col("px"), 8, 8, 5, 3)), "o", "v")


LOGITS_SQL = "SELECT vec_id, list_transform(list_concat(embedding, embedding[1:16]), lambda e: e::DOUBLE * 10) AS logits, embedding[1]::DOUBLE * 10 AS date_logit FROM embeddings"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform(F.concat("embedding", F.slice("embedding", 1, 16)), lambda x: x.cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("logits"), (F.get("embedding", F.lit(0)).cast("double") * 10).alias("date_logit"))


PROBS_SQL = f"""flat AS (SELECT vec_id, date_logit, generate_subscripts(logits, 1) - 1 AS place, unnest(logits) AS v FROM ({LOGITS_SQL})),
e AS (SELECT vec_id, date_logit, place, exp(v - max(v) OVER (PARTITION BY vec_id, place // 10)) AS v FROM flat),
probs AS (SELECT vec_id, date_logit, place, v / sum(v) OVER (PARTITION BY vec_id, place // 10) AS p FROM e)"""


@query(
    f"""WITH {PROBS_SQL}, best AS (SELECT vec_id, date_logit, place // 10 AS slot, place % 10 AS digit, p FROM probs
  QUALIFY row_number() OVER (PARTITION BY vec_id, place // 10 ORDER BY p DESC, place) = 1),
r AS (SELECT vec_id, string_agg(digit::VARCHAR, '' ORDER BY slot) AS digits, avg(p) * 100 AS c, min(p) AS m, any_value(1 / (1 + exp(-date_logit))) AS d FROM best GROUP BY vec_id)
SELECT vec_id, digits, concat(digits[1:4], '/', digits[5:6], '/', digits[7:8]) AS text, round(c, 6) AS confidence, round(m, 6) AS min_prob, round(d, 6) AS date_prob, d >= 0.5 AS is_date FROM r"""
)
def softmax_decode(spark, sf_dir):
    rows = logits(spark, sf_dir).withColumn("probs", A.softmax_slots(F.col("logits")))
    r = rows.select("vec_id", A.decode_digits(F.col("probs"), A.sigmoid(F.col("date_logit"))).alias("r")).select("vec_id", "r.*")
    return r.select("vec_id", "digits", "text", *(r6(c).alias(c) for c in ("confidence", "min_prob", "date_prob")), "is_date")


@query(f"WITH {PROBS_SQL} SELECT label, place, round(avg(p), 6) AS p FROM probs JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) GROUP BY label, place")
def average_reads(spark, sf_dir):
    from daftar.plans.recognise import average_reads as mean_of

    rows = logits(spark, sf_dir).select("label", A.softmax_slots(F.col("logits")).alias("probs"), A.sigmoid(F.col("date_logit")).alias("date_prob"))
    return mean_of(rows, ["label"]).select("label", F.posexplode("probs").alias("place", "p")).select("label", "place", r6("p").alias("p"))


@query(
    "SELECT vec_id, o, round(sum(e * (((o * 64 + place) % 7) - 3)::DOUBLE) + o, 6) AS v FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS place, "
    "unnest(embedding)::DOUBLE AS e FROM embeddings), range(4) r(o) GROUP BY vec_id, o"
)
def dense_head(spark, sf_dir):
    w = F.array(*(F.array(*(F.lit(float((o * 64 + i) % 7 - 3)) for i in range(64))) for o in range(4)))
    b = F.array(*(F.lit(float(o)) for o in range(4)))
    x = F.transform("embedding", lambda e: e.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(A.dense(x, w, b), r6)).alias("o", "v"))


@query(
    f"WITH g AS ({PX_SQL}), p AS (SELECT a.vec_id, unnest(a.px) AS x, unnest(b.px) AS y FROM g a JOIN g b ON b.vec_id = a.vec_id + 1) "
    "SELECT vec_id, round(corr(x, y), 6) AS ncc FROM p GROUP BY vec_id"
)
def ncc_pairs(spark, sf_dir):
    g = grids(spark, sf_dir)
    pairs = g.join(g.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("q")), "vec_id")
    return pairs.select("vec_id", r6(A.ncc(F.col("px"), F.col("q"))).alias("ncc"))


HU_SQL = f"""ink AS (SELECT vec_id, place % 8 AS x, place // 8 AS y FROM (SELECT vec_id, generate_subscripts(px, 1) - 1 AS place, unnest(px) AS v FROM ({PX_SQL})) WHERE v < 128),
c AS (SELECT vec_id, count(*)::DOUBLE AS n, avg(x) AS cx, avg(y) AS cy FROM ink GROUP BY vec_id),
m AS (SELECT vec_id, sum((x-cx)^2)/n^2 AS a, sum((y-cy)^2)/n^2 AS b, sum((x-cx)*(y-cy))/n^2 AS e,
  sum((x-cx)^3)/n^2.5 AS m30, sum((x-cx)^2*(y-cy))/n^2.5 AS m21, sum((x-cx)*(y-cy)^2)/n^2.5 AS m12, sum((y-cy)^3)/n^2.5 AS m03 FROM ink JOIN c USING (vec_id) GROUP BY vec_id, n)"""


def _signed_log(v: str) -> str:
    return f"CASE WHEN abs({v}) < 1e-10 THEN 0 ELSE round(-sign({v}) * log10(abs({v})), 3) END"


@query(
    f"WITH {HU_SQL}, k AS (SELECT *, m30-3*m12 AS p, 3*m21-m03 AS q, m30+m12 AS u, m21+m03 AS w FROM m) "
    "SELECT vec_id, round(-log10(a + b), 4) AS h1, CASE WHEN (a-b)^2+4*e^2 < 1e-12 THEN 0 ELSE round(-log10((a-b)^2+4*e^2), 4) END AS h2, "
    "CASE WHEN p^2+q^2 < 1e-12 THEN 0 ELSE round(-log10(p^2+q^2), 4) END AS h3, CASE WHEN u^2+w^2 < 1e-12 THEN 0 ELSE round(-log10(u^2+w^2), 4) END AS h4, "
    f"{_signed_log('p*u*(u^2-3*w^2) + q*w*(3*u^2-w^2)')} AS h5, {_signed_log('(a-b)*(u^2-w^2) + 4*e*u*w')} AS h6, {_signed_log('q*u*(u^2-3*w^2) - p*w*(3*u^2-w^2)')} AS h7 FROM k"
)
def hu_moments(spark, sf_dir):
    """The seven moments of ink, relationally: sums over the dark pixels."""
    ink = spread(grids(spark, sf_dir), "px", "v").where("v < 128").select("vec_id", (F.col("place") % 8).alias("x"), F.floor(F.col("place") / 8).alias("y"))
    c = ink.groupBy("vec_id").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    part = lambda p, q, k: (F.sum(F.pow(dx, F.lit(p)) * F.pow(dy, F.lit(q))) / F.pow("n", F.lit(k)))
    m = ink.join(c, "vec_id").groupBy("vec_id", "n").agg(
        part(2, 0, 2).alias("a"), part(0, 2, 2).alias("b"), part(1, 1, 2).alias("e"), part(3, 0, 2.5).alias("m30"),
        part(2, 1, 2.5).alias("m21"), part(1, 2, 2.5).alias("m12"), part(0, 3, 2.5).alias("m03"),
    )
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    two = (a - b) * (a - b) + 4 * e * e
    p, q = F.col("m30") - 3 * F.col("m12"), 3 * F.col("m21") - F.col("m03")
    three = p * p + q * q
    u, w = F.col("m30") + F.col("m12"), F.col("m21") + F.col("m03")
    right, left = u * u - 3 * w * w, 3 * u * u - w * w
    log = lambda v: F.when(v < 1e-12, 0.0).otherwise(F.round(-F.log10(v), 4))
    signed = lambda v: F.when(F.abs(v) < 1e-10, 0.0).otherwise(F.round(-F.signum(v) * F.log10(F.abs(v)), 3))
    return m.select(
        "vec_id", F.round(-F.log10(a + b), 4).alias("h1"), log(two).alias("h2"), log(three).alias("h3"), log(u * u + w * w).alias("h4"),
        signed(p * u * right + q * w * left).alias("h5"), signed((a - b) * (u * u - w * w) + 4 * e * u * w).alias("h6"), signed(q * u * right - p * w * left).alias("h7"),
    )


@query(
    "SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 8), lambda i: (embedding[i]::DOUBLE - embedding[i+7]::DOUBLE)^2))), 6) AS d FROM embeddings"
)
def hu_distance(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(A.hu_distance(F.slice(e, 1, 7), F.slice(e, 8, 7))).alias("d"))


@query(
    f"SELECT vec_id, CAST(list_sum(list_transform(px, lambda v: CASE WHEN v < 128 THEN 1 ELSE 0 END)) AS BIGINT) AS ink FROM ({PX_SQL})"
)
def ink_mask(spark, sf_dir):
    return grids(spark, sf_dir).select("vec_id", F.aggregate(A.ink_mask(F.col("px")), F.lit(0), lambda a, x: a + x).cast("long").alias("ink"))


@query(
    """WITH w AS (SELECT label AS layer, vec_id AS o, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS w FROM embeddings),
s AS (SELECT layer, o, greatest(max(abs(w)) / 127, 1e-9::DOUBLE) AS scale FROM w GROUP BY ALL)
SELECT layer, o AS out, pos, CAST(greatest(-127, least(127, round_even(w / scale, 0))) AS INT) AS q, round(scale, 9) AS scale FROM w JOIN s USING (layer, o)"""
)
def quantise(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("out"), F.posexplode("embedding").alias("pos", "w"))
    return E.quantised(rows.withColumn("w", F.col("w").cast("double"))).withColumn("scale", F.round("scale", 9))


@query(f"SELECT v AS level, count(*) AS n FROM (SELECT unnest(px) AS v FROM ({PX_SQL})) GROUP BY v")
def histogram(spark, sf_dir):
    return spread(grids(spark, sf_dir), "px", "level").groupBy("level").agg(F.count("*").alias("n"))


# --- digit strips ----------------------------------------------------------------------------------

COLUMN_SQL = f"""flat AS (SELECT vec_id AS strip_id, generate_subscripts(px, 1) - 1 AS col, unnest(px) AS v FROM ({PX_SQL})),
cols AS (SELECT strip_id, col, CASE WHEN v < 128 THEN 3 ELSE 0 END AS ink FROM flat)"""
RUN_SQL = (
    COLUMN_SQL
    + """, isl AS (SELECT strip_id, col, col - row_number() OVER (PARTITION BY strip_id ORDER BY col) AS g FROM cols WHERE ink >= 2),
runs AS (SELECT strip_id, min(col) AS x0, max(col) + 1 AS x1 FROM isl GROUP BY strip_id, g HAVING count(*) >= 2)"""
)


def _columns(spark, sf_dir) -> DataFrame:
    rows = grids(spark, sf_dir).select(F.col("vec_id").alias("strip_id"), F.posexplode("px").alias("col", "v"))
    return rows.select("strip_id", "col", F.when(F.col("v") < 128, 3).otherwise(0).alias("ink"))


@query(f"WITH {RUN_SQL} SELECT * FROM runs")
def column_runs(spark, sf_dir):
    return D.column_runs(_columns(spark, sf_dir), 16)


MERGED_SQL = (
    RUN_SQL
    + """, marked AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM runs WINDOW w AS (PARTITION BY strip_id ORDER BY x0)),
parted AS (SELECT *, sum(fresh) OVER (PARTITION BY strip_id ORDER BY x0) AS part FROM marked),
merged AS (SELECT strip_id, min(x0) AS x0, max(x1) AS x1 FROM parted GROUP BY strip_id, part)"""
)


@query(f"WITH {MERGED_SQL} SELECT * FROM merged")
def merged_runs(spark, sf_dir):
    return D.merge_runs(D.column_runs(_columns(spark, sf_dir), 16))


@query(
    f"WITH {RUN_SQL}, numbered AS (SELECT *, count(*) OVER (PARTITION BY strip_id) AS n, row_number() OVER (PARTITION BY strip_id ORDER BY x0) - 1 AS i FROM runs) "
    "SELECT strip_id, CAST(i - (i > 4)::INT - (i > 7)::INT AS INT) AS slot, x0, x1 FROM numbered WHERE n = 10 AND i NOT IN (4, 7)"
)
def digit_slots(spark, sf_dir):
    return D.digit_slots(D.column_runs(_columns(spark, sf_dir), 16))


@query(
    f"""WITH h AS (SELECT read_id, regexp_replace({DIGITS_SQL}, '[^0-9]', '', 'g') AS digits, list_transform(range(8), lambda i: 10 + (read_id * (i + 3)) % 23) AS hs FROM ({RAW})),
m AS (SELECT *, list_sort(hs)[5] AS med FROM h WHERE length(digits) = 8),
s AS (SELECT read_id, digits, unnest(range(8)) AS i, unnest(hs) / med::DOUBLE AS r FROM m)
SELECT read_id, CAST(count(*) FILTER ((digits[i+1] = '0' AND r > 0.7) OR (digits[i+1] = '5' AND r < 0.55)) AS INT) AS n_reasons FROM s GROUP BY read_id"""
)
def gate_line(spark, sf_dir):
    rows = raw_reads(spark, sf_dir).select("read_id", T.only_digits(T.to_latin_digits(F.col("raw"))).alias("digits")).where("length(digits) = 8")
    heights = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: 10 + (F.col("read_id") * (i + 3)) % 23)
    return rows.select("read_id", F.size(D.height_gate(F.col("digits"), heights)).alias("n_reasons"))


@query(
    f"""WITH b AS ({BOX_SQL}), m AS (SELECT image_id, median(width) AS med FROM b GROUP BY image_id),
r AS (SELECT b.*, med, max(x + width) OVER (PARTITION BY image_id ORDER BY x, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b JOIN m USING (image_id))
SELECT vec_id, CAST(sum(CASE WHEN x - reach > greatest(4, med * 0.05::DOUBLE) THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY x, vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM r"""
)
def component_clusters(spark, sf_dir):
    rows = line_boxes(spark, sf_dir).select(F.col("image_id").alias("sheet_id"), F.col("vec_id").alias("seq"), "x", "width")
    return D.gap_clusters(rows, 0.05).select(F.col("seq").alias("vec_id"), F.col("cluster").cast("long").alias("cluster"))


# --- measures and generators ------------------------------------------------------------------

GUESS_SQL = f"""base AS ({RAW}),
g AS (SELECT read_id, date_prob, CASE WHEN read_id % 5 <> 0 THEN concat(lpad(y::VARCHAR, 4, '0'), lpad(m::VARCHAR, 2, '0'), lpad(d::VARCHAR, 2, '0')) END AS truth,
  concat(lpad(y::VARCHAR, 4, '0'), lpad(m::VARCHAR, 2, '0'), lpad(CASE WHEN read_id % 7 = 0 THEN '50' ELSE lpad(d::VARCHAR, 2, '0') END, 2, '0')) AS guess FROM base)"""


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    head = F.concat(F.lpad(F.col("y").cast("string"), 4, "0"), two("m"))
    return raw_reads(spark, sf_dir).select(
        "read_id", "date_prob", F.when(F.col("read_id") % 5 != 0, F.concat(head, two("d"))).alias("truth"),
        F.concat(head, F.when(F.col("read_id") % 7 == 0, "50").otherwise(two("d"))).alias("guess"),
    )


@query(
    f"WITH {GUESS_SQL}, p AS (SELECT substr(truth, i + 1, 1) AS truth, substr(guess, i + 1, 1) AS g FROM g, range(8) r(i) WHERE truth IS NOT NULL) "
    f"SELECT truth, {', '.join(f'''count(*) FILTER (g = '{i}') AS g{i}''' for i in range(10))} FROM p GROUP BY truth"
)
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(guesses(spark, sf_dir))


@query(
    f"""WITH {GUESS_SQL}, p AS (SELECT substr(truth, i + 1, 1) AS t, substr(guess, i + 1, 1) AS g FROM g, range(8) r(i) WHERE truth IS NOT NULL),
a AS (SELECT avg((truth = guess)::INT::DOUBLE) AS exact, avg(((truth IS NOT NULL) = (date_prob >= 0.5))::INT::DOUBLE) AS date_head, avg((truth IS NOT NULL)::INT::DOUBLE) AS positive_rate FROM g),
b AS (SELECT avg((t = g)::INT::DOUBLE) AS digit, count(*) FILTER (t = '0' AND g = '5') / count(*) FILTER (t = '0')::DOUBLE AS zf, count(*) FILTER (t = '5' AND g = '0') / count(*) FILTER (t = '5')::DOUBLE AS fz FROM p)
SELECT round(exact, 6) AS exact, round(date_head, 6) AS date_head, round(positive_rate, 6) AS positive_rate, round(digit, 6) AS digit, round(zf, 6) AS zero_as_five, round(fz, 6) AS five_as_zero FROM a, b"""
)
def digit_metrics(spark, sf_dir):
    m = E.metrics(guesses(spark, sf_dir))
    return m.select(*(r6(c).alias(c) for c in m.columns))


def _draw(seed: str, n) -> str:
    return f"((({seed}) * 2654435761 + 40503) % 4294967296 % {n})"


DATES_SQL = f"""ym AS (SELECT event_id AS id, CAST(1300 + {_draw("event_id", 116)} AS INT) AS y, CAST(1 + {_draw("event_id + 7", 12)} AS INT) AS m FROM events),
dates AS (SELECT id, y, m, CAST(1 + (id * 31 + 17) % {DAYS_SQL} AS INT) AS d FROM ym)"""


@query(f"WITH {DATES_SQL} SELECT id, y AS year, m AS month, d AS day, replace({FORMAT_SQL}, '/', '') AS digits FROM dates")
def random_dates(spark, sf_dir):
    return Z.random_dates(table(spark, sf_dir, "events"), "event_id")


PAIRS_SQL = "[" + ", ".join(f"['{a}', '{b}']" for a, b in Z.CONFUSABLE) + "]"
HARD_SQL = f"""{DATES_SQL}, s AS (SELECT id, replace({FORMAT_SQL}, '/', '') AS digits, {PAIRS_SQL}[1 + {_draw("id + 3", 14)}] AS pair, 1 + {_draw("id + 5", 7)} AS spot FROM dates),
c AS (SELECT *, CASE WHEN {_draw("id", 100)} < 45 AND substr(digits, spot, 1) = pair[1] THEN concat(substr(digits, 1, spot - 1), pair[2], substr(digits, spot + 1)) END AS new FROM s),
k AS (SELECT *, CAST(substr(new, 1, 4) AS INT) AS y, CAST(substr(new, 5, 2) AS INT) AS m, CAST(substr(new, 7, 2) AS INT) AS d FROM c)"""


@query(f"WITH {HARD_SQL} SELECT id, digits, CASE WHEN m BETWEEN 1 AND 12 AND d BETWEEN 1 AND {DAYS_SQL} THEN new ELSE digits END AS hard FROM k")
def confusable_digits(spark, sf_dir):
    return Z.confuse(Z.random_dates(table(spark, sf_dir, "events"), "event_id")).select("id", "digits", "hard")


@query(
    f"SELECT event_id AS id, CASE WHEN u < 296 THEN 'labelled date' WHEN u < 740 THEN 'date' ELSE ['words', 'number', 'short date', 'partial date', 'identity', 'noise'][1 + event_id % 6] END AS kind, "
    f"u < 740 AS positive FROM (SELECT event_id, {_draw('event_id', 1000)} AS u FROM events)"
)
def label_kinds(spark, sf_dir):
    return Z.label_kinds(table(spark, sf_dir, "events"), "event_id")


# --- pixels: numpy kernels, tested against plain versions -------------------------------------------


#: Images that a kernel is given at once: what it makes of them may be a thousand times as large.
STACK = 256


def _kernel(spark: SparkSession, sf_dir: str, f, schema: str) -> DataFrame:
    """A function of stacked 8x8 images (n, 8, 8) over all embeddings, in slices of Arrow batches; it gives a column for each name."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), STACK):
                b = batch.iloc[at : at + STACK]
                px = np.stack(b.px.to_numpy()).astype(np.uint8).reshape(-1, 8, 8)
                yield pd.DataFrame({"vec_id": b.vec_id.to_numpy()} | dict(zip(names, f(px), strict=True)))

    return grids(spark, sf_dir).select("vec_id", "px").mapInPandas(run, f"vec_id long, {schema}")


def _each(*fs):
    """Functions of one image as functions of a stack."""
    return lambda px: tuple([f(x) for x in px] for f in fs)


@query(
    f"""WITH flat AS (SELECT vec_id, unnest(px) AS v FROM ({PX_SQL})), n AS (SELECT vec_id, v, count(*)::DOUBLE AS c FROM flat GROUP BY ALL),
s AS (SELECT vec_id, v, sum(c) OVER w AS wb, sum(c * v) OVER w AS sb, sum(c) OVER (PARTITION BY vec_id) AS t, sum(c * v) OVER (PARTITION BY vec_id) AS st
  FROM n WINDOW w AS (PARTITION BY vec_id ORDER BY v)),
b AS (SELECT vec_id, v, CASE WHEN wb < t THEN wb * (t - wb) * (sb / wb - (st - sb) / (t - wb))^2 ELSE -1 END AS q FROM s)
SELECT vec_id, CAST(v AS INT) AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(q, 6) DESC, v) = 1"""
)
def otsu_threshold(spark, sf_dir):
    from daftar.vision import kernels

    return _kernel(spark, sf_dir, _each(kernels.otsu), "threshold int")


@query()
def cnn_forward(spark, sf_dir):
    """Reads of embeddings stretched to lines, by a network with synthetic weights."""
    from daftar.vision import kernels, network, preprocess

    net = network.load(network.dump(network.synthetic()))

    def read(px):
        lines = [preprocess.model_input(kernels.resize(x, 160, 32, "nearest"), DEFAULT) for x in px]
        probs, date = network.probabilities(net, np.stack(lines)) if lines else (np.zeros((0, 80)), np.zeros(0))
        return ["".join(map(str, p)) for p in probs.reshape(-1, 8, 10).argmax(2)], date

    return _kernel(spark, sf_dir, read, "digits string, date_prob double")


# --- photographs: one drawn for each user of events ---------------------------------------------------


def _photographs(spark, sf_dir) -> DataFrame:
    return Z.scenes(table(spark, sf_dir, "events"), "user_id").select("image_id", "image")


def _cards(spark, sf_dir) -> DataFrame:
    from daftar.plans import recognise as P
    from daftar.stages import Scratch

    return Scratch(spark, "cards").write(P.cards(_photographs(spark, sf_dir)), P.IMAGES, P.IMAGES)


DRAWN_SQL = f"""ym AS (SELECT id, CAST(1300 + {_draw("id", 116)} AS INT) AS y, CAST(1 + {_draw("id + 7", 12)} AS INT) AS m FROM (SELECT DISTINCT user_id AS id FROM events WHERE user_id IS NOT NULL)),
drawn AS (SELECT CAST(id AS VARCHAR) AS image_id, y, m, CAST(1 + (id * 31 + 17) % {DAYS_SQL} AS INT) AS d FROM ym)"""


@query(f"WITH {DRAWN_SQL} SELECT image_id, line, true AS found FROM drawn, (VALUES ('birth'), ('expiry')) v(line)")
def line_candidates(spark, sf_dir):
    """Whether each drawn date lies in a candidate box of its card, as it stands or upside down."""
    from daftar.plans import recognise as P
    from daftar.stages import Scratch

    boxes = Scratch(spark, "boxes").write(P.line_boxes(_cards(spark, sf_dir)), P.IMAGES).select("image_id", as_box().alias("b"))
    width, height = 10 * 5 * (Z.CARD_DIGITS // 7) + 9 * Z.CARD_GAP, Z.CARD_DIGITS
    right, found = int(0.88 * COLS), []
    for line, share in Z.CARD_ROWS:
        x, y = right - width, int(share * ROWS)
        for x0, y0 in ((x, y), (COLS - x - width, ROWS - y - height)):
            place = F.struct(F.lit(x0).alias("x"), F.lit(y0).alias("y"), F.lit(width).alias("width"), F.lit(height).alias("height"))
            found.append((line, G.iou(F.col("b"), place)))
    # a box frames its line loosely: it's some three times as large
    per = [F.max(F.greatest(*(v for k, v in found if k == line)) > 0.25).alias(line) for line, _ in Z.CARD_ROWS]
    return boxes.groupBy("image_id").agg(*per).unpivot("image_id", [line for line, _ in Z.CARD_ROWS], "line", "found")


@query(f"WITH {DRAWN_SQL} SELECT image_id, true AS rectified, 1200 AS w, 756 AS h, CAST(NULL AS VARCHAR) AS error FROM drawn")
def warp_card(spark, sf_dir):
    """Every drawn card is found and straightened to its standard size."""
    return _cards(spark, sf_dir).select("image_id", "rectified", "w", "h", "error")


@query(
    f"WITH {DRAWN_SQL}, r AS (SELECT image_id, CASE WHEN y <= 1410 THEN {FORMAT_SQL} END AS best FROM drawn) "
    "SELECT image_id, true AS rectified, CAST(NULL AS VARCHAR) AS error, best, best AS birth, CAST(NULL AS VARCHAR) AS expiry, CASE WHEN best IS NOT NULL THEN 'single' END AS method FROM r"
)
def recognise_images(spark, sf_dir):
    """The whole plan over all photographs, read with weights fitted to drawn digits; the SQL gives the dates that were drawn.

    A year after 1410 isn't accepted; the lower row, an expiry, is left out beside an upper one.
    """
    from daftar.plans import reader
    from daftar.plans import recognise as P

    r = P.recognise(_photographs(spark, sf_dir), reader.fit(spark))
    return r.select(F.col("card_id").alias("image_id"), "rectified", "error", "best", "birth", "expiry", "method")


from daftar import image_queries, live_queries, pixel_queries, training_queries  # noqa: E402, F401  register their queries here
