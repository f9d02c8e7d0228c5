"""Queries over training material and training; ``daftar.queries`` registers them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions.calendar import days_in_month
from daftar.operators import evaluation as E
from daftar.operators import material as M
from daftar.plans import train as T
from daftar.queries import DAYS_SQL, _draw, query, r6, table
from daftar.sources import scenes as Z

# --- fonts --------------------------------------------------------------------------------------------------------

GLYPHS_SQL = """glyphs AS (SELECT concat(dir, '/font', vec_id // 50, '.ttf') AS font, 1776 + label AS code, min_by(array_to_string(list_transform(embedding[1:12], lambda e: CAST(e > 0 AS INT)), ''), vec_id) AS shape
  FROM embeddings, (VALUES ('a'), ('b')) d(dir) WHERE dir = 'a' OR (vec_id // 50) % 2 = 0 GROUP BY ALL),
fonts AS (SELECT font, count(DISTINCT code) AS codes, count(DISTINCT shape) AS shapes, string_agg(concat(code, ':', shape), ',' ORDER BY code, shape) AS content FROM glyphs GROUP BY font)"""


def _glyphs(spark, sf_dir) -> DataFrame:
    """A font for every fifty embeddings, those of even number under two paths; a glyph's shape is the signs of its first numbers."""
    e = table(spark, sf_dir, "embeddings").withColumn("font", F.floor(F.col("vec_id") / 50))
    folders = F.when(F.col("font") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    signs = F.array_join(F.transform(F.slice("embedding", 1, 12), lambda v: (v > 0).cast("int").cast("string")), "")
    rows = e.select(F.explode(folders).alias("dir"), "font", (1776 + F.col("label")).alias("code"), "vec_id", signs.alias("shape"))
    return rows.groupBy(F.concat("dir", F.lit("/font"), "font", F.lit(".ttf")).alias("font"), "code").agg(F.min_by("shape", "vec_id").alias("shape"))


@query(f"WITH {GLYPHS_SQL} SELECT font, codes, shapes, sha256(content) AS content, codes = 10 AND shapes = 10 AS complete FROM fonts")
def font_coverage(spark, sf_dir):
    """Which fonts have all ten digits, each of a shape of its own."""
    return M.coverage(_glyphs(spark, sf_dir), "font")


@query(f"WITH {GLYPHS_SQL} SELECT min(font) AS font, count(*) AS copies FROM fonts WHERE codes = 10 AND shapes = 10 AND NOT contains(font, 'font3') GROUP BY content")
def usable_fonts(spark, sf_dir):
    """Complete fonts that aren't excluded by name, one of each set of copies."""
    return M.usable(M.coverage(_glyphs(spark, sf_dir), "font"), "font", ("FONT3",))


# --- lines ----------------------------------------------------------------------------------------------------------


def _seeded(k: int, n: int) -> str:
    return _draw(f"seed + {k}", n)


@query(
    f"""WITH s AS (SELECT event_id AS id, a + 1 AS attempt, event_id * 5 + a AS seed FROM events, range(5) r(a)),
d AS (SELECT id, attempt, CAST(1300 + {_seeded(0, 116)} AS INT) AS y, CAST(1 + {_seeded(7, 12)} AS INT) AS m, CAST(1 + {_seeded(13, 40)} AS INT) AS d, CAST({_seeded(21, 60)} AS INT) AS height FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt) AS nth FROM d WHERE d <= {DAYS_SQL} AND height >= 24)
SELECT e.event_id AS id, CAST(attempt AS INT) AS attempt, CASE WHEN g.id IS NOT NULL THEN concat(y, lpad(CAST(m AS VARCHAR), 2, '0'), lpad(CAST(d AS VARCHAR), 2, '0')) END AS digits,
  height, g.id IS NOT NULL AS positive FROM events e LEFT JOIN g ON g.id = e.event_id AND nth = 1"""
)
def sampled_lines(spark, sf_dir):
    """A line for each event: up to five draws until its date exists and it is high enough, else a blank negative."""

    def draw(seed):
        n = lambda k, below: Z.draw(seed + k, below).cast("int")
        return F.struct((1300 + n(0, 116)).alias("y"), (1 + n(7, 12)).alias("m"), (1 + n(13, 40)).alias("d"), n(21, 60).alias("height"))

    good = lambda c: (c["d"] <= days_in_month(c["y"], c["m"])) & (c["height"] >= 24)
    rows = M.retried(table(spark, sf_dir, "events").select(F.col("event_id").alias("id")), draw, good, F.col("id"))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    digits = F.when(F.col("drawn").isNotNull(), F.concat(F.col("drawn.y").cast("string"), two("drawn.m"), two("drawn.d")))
    return rows.select("id", "attempt", digits.alias("digits"), F.col("drawn.height").alias("height"), F.col("drawn").isNotNull().alias("positive"))


@query(
    f"""WITH k AS (SELECT event_id AS id, {_draw('event_id', 1000)} AS u FROM events),
r AS (SELECT CASE WHEN u < 296 THEN 'labelled date' WHEN u < 740 THEN 'date' ELSE ['words', 'number', 'short date', 'partial date', 'identity', 'noise'][1 + id % 6] END AS kind, u < 740 AS positive,
  CASE WHEN {_draw('id + 1', 1000)} < 150 THEN 'real' WHEN {_draw('id + 2', 1000)} < 600 THEN 'glyphs' WHEN {_draw('id + 3', 1000)} < 500 THEN 'row' ELSE 'line' END AS source, CASE WHEN id % 10 = 0 THEN 'held' ELSE 'train' END AS part FROM k)
SELECT kind, source, part, CAST(GROUPING_ID(kind, source, part) AS BIGINT) AS level, count(*) AS n, CAST(sum(CAST(positive AS INT)) AS BIGINT) AS n_positive, round(avg(CAST(positive AS INT)), 6) AS rate FROM r GROUP BY CUBE (kind, source, part)"""
)
def material_totals(spark, sf_dir):
    """Lines and positive rates by kind, source and part, and over each set of these."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    i = F.col("id").cast("long")
    source = F.when(Z.draw(i + 1, 1000) < 150, "real").when(Z.draw(i + 2, 1000) < 600, "glyphs").when(Z.draw(i + 3, 1000) < 500, "row").otherwise("line")
    rows = Z.label_kinds(events, "id").select("kind", "positive", source.alias("source"), F.when(F.col("id") % 10 == 0, "held").otherwise("train").alias("part"))
    return M.totals(rows, ["kind", "source", "part"], "positive").withColumn("rate", r6("rate"))


# --- parity ---------------------------------------------------------------------------------------------------------

TWO_SQL = """w AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS w FROM embeddings),
s AS (SELECT vec_id, greatest(max(abs(w)) / 127.0::DOUBLE, 1e-9::DOUBLE) AS scale FROM w GROUP BY vec_id),
q AS (SELECT vec_id, pos, greatest(-127, least(127, round_even(w / scale, 0))) * scale AS w FROM w JOIN s USING (vec_id)),
one AS (SELECT vec_id, pos, w, CASE WHEN pos % 5 <> 0 THEN pos::DOUBLE END AS place FROM w WHERE NOT (vec_id % 7 = 1 AND pos = 3)),
two AS (SELECT vec_id, pos, w, CASE WHEN pos % 6 <> 0 THEN pos::DOUBLE END AS place FROM q WHERE NOT (vec_id % 11 = 2 AND pos < 2))"""


@query(
    f"""WITH {TWO_SQL}, f AS (SELECT a.vec_id AS a, b.vec_id AS b, a.w AS aw, b.w AS bw, a.place AS ap, b.place AS bp FROM one a FULL JOIN two b USING (vec_id, pos)),
n AS (SELECT count(*) FILTER (b IS NULL) AS only_one, count(*) FILTER (a IS NULL) AS only_two FROM f), m AS (SELECT * FROM f WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT 'w' AS "column", only_one, only_two, (SELECT count(*) FROM m WHERE abs(aw - bw) > 0.001) AS differing, (SELECT round(max(abs(aw - bw)), 6) FROM m) AS worst FROM n
UNION ALL SELECT 'place', only_one, only_two, (SELECT count(*) FROM m WHERE (ap IS NULL) <> (bp IS NULL) OR abs(ap - bp) > 0.001), (SELECT round(max(abs(ap - bp)), 6) FROM m) FROM n"""
)
def parity(spark, sf_dir):
    """Weights against their eight-bit form, matched by place: missing, extra and differing ones, and the worst difference."""
    w = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "w")).withColumn("w", F.col("w").cast("double"))
    q = E.quantised(w.select(F.lit(0).alias("layer"), F.col("vec_id").alias("out"), "pos", "w")).select(F.col("out").alias("vec_id"), "pos", (F.col("q") * F.col("scale")).alias("w"))
    place = lambda k: F.when(F.col("pos") % k != 0, F.col("pos").cast("double")).alias("place")
    one = w.where("not (vec_id % 7 = 1 and pos = 3)").select("vec_id", "pos", "w", place(5))
    two = q.where("not (vec_id % 11 = 2 and pos < 2)").select("vec_id", "pos", "w", place(6))
    return M.compare(one, two, ["vec_id", "pos"], ["w", "place"], 0.001).withColumn("worst", r6("worst"))


# --- training ---------------------------------------------------------------------------------------------------------


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label")


@query(
    """WITH f AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS v FROM embeddings UNION ALL SELECT vec_id, 64, 1 FROM embeddings),
y AS (SELECT vec_id, k AS j, CASE WHEN label = k THEN 0.9 ELSE -0.1 END::DOUBLE AS v FROM embeddings, range(10) r(k))
SELECT 'xx' AS sums, a.i, b.i AS j, round(sum(a.v * b.v), 4) + 0.0::DOUBLE AS v FROM f a JOIN f b USING (vec_id) GROUP BY ALL
UNION ALL SELECT 'xy', f.i, y.j, round(sum(f.v * y.v), 4) + 0.0::DOUBLE FROM f JOIN y USING (vec_id) GROUP BY ALL"""
)
def gram_sums(spark, sf_dir):
    """The sums that least squares needs, added up in tasks."""
    y = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(F.col("label") == k, 0.9).otherwise(-0.1))
    g = T.gram(_labelled(spark, sf_dir).withColumn("y", y), 64, 10)
    rows = [(name, i, j, float(np.round(v, 4)) + 0.0) for name, m in (("xx", g.xx), ("xy", g.xy)) for (i, j), v in np.ndenumerate(m)]  # as many as the model is large
    return spark.createDataFrame(rows, "sums string, i int, j int, v double")


@query()
def trained_classifier(spark, sf_dir):
    """Accuracy on held-out rows after each epoch of steps, and whether its weights were the best so far."""
    rows = _labelled(spark, sf_dir)
    held = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    _, told = T.descend(rows.where(~held), rows.where(held), 64, 10, T.Schedule(3, 2, 4.0))
    return spark.createDataFrame(told, "epoch int, accuracy double, kept boolean")
