"""Queries over pixels, readers and writers, and the training material, each with the SQL that must give the same rows.

Imported by ``daftar.queries``, which registers them with the others.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from daftar.config import DEFAULT
from daftar.functions import arrays as A
from daftar.functions import geometry as G
from daftar.operators import consensus as C
from daftar.operators import digits as D
from daftar.operators import evaluation as E
from daftar.queries import (
    BOX_SQL, COLS, DIGITS_SQL, FRAMES_SQL, LOGITS_SQL, PROBS_SQL, PX_SQL, RAW, ROWS, _draw, _each, _kernel, as_box, frames, grids, line_boxes, logits, query, r6, raw_reads,
    spread, table,
)
from daftar.sources import images as I
from daftar.sources import reads as R
from daftar.sources import scenes as Z
from daftar.stages import Scratch
from daftar.vision import kernels as K
from daftar.vision import network as N
from daftar.vision import preprocess as P
from daftar.vision import shapes as S

FLAT_SQL = f"""flat AS (SELECT vec_id, CAST(place % 8 AS INT) AS x, CAST(place // 8 AS INT) AS y, v
  FROM (SELECT vec_id, generate_subscripts(px, 1) - 1 AS place, unnest(px) AS v FROM ({PX_SQL})))"""


def _image(spark, sf_dir, f, kind: str = "int"):
    """A row for each pixel of what a kernel makes of each image."""
    made = _kernel(spark, sf_dir, _each(lambda px: f(px).ravel().tolist()), f"o array<{kind}>")
    return spread(made, "o", "v")


def _mirrored(i: str) -> str:
    return f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > 7 THEN 14 - ({i}) ELSE {i} END)"


def _blurred(taps: list[tuple[int, float]], source: str = "flat", of: str = "v") -> str:
    rows = ", ".join(f"({d}, {w!r}::DOUBLE)" for d, w in taps)
    return f"""SELECT a.vec_id, a.x, a.y, any_value(a.{of}) AS v, sum(p.w * q.w * b.{of}) AS soft FROM {source} a, (VALUES {rows}) p(d, w), (VALUES {rows}) q(d, w), {source} b
  WHERE b.vec_id = a.vec_id AND b.x = {_mirrored('a.x + p.d')} AND b.y = {_mirrored('a.y + q.d')} GROUP BY a.vec_id, a.x, a.y"""


BINOMIAL_3 = [(-1, 0.25), (0, 0.5), (1, 0.25)]
BINOMIAL_5 = [(-2, 0.0625), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625)]


# --- kernels ---------------------------------------------------------------------------------------


@query(f"WITH {FLAT_SQL}, s AS ({_blurred(BINOMIAL_3)}) SELECT vec_id, y * 8 + x AS place, CAST(round_even(soft, 0) AS INT) AS v FROM s")
def gaussian_blur(spark, sf_dir):
    return _image(spark, sf_dir, lambda px: K.blur(px, 3))


@query(f"WITH {FLAT_SQL}, s AS ({_blurred(BINOMIAL_5)}) SELECT vec_id, y * 8 + x AS place, CAST(v <= round_even(soft, 0) - 12 AS INT) AS v FROM s")
def adaptive_threshold(spark, sf_dir):
    return _image(spark, sf_dir, lambda px: K.adaptive_ink(px, 5, 12).astype(int))


_NEAR = "abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1"


def _fold(source: str, fold: str) -> str:
    return f"SELECT a.vec_id, a.x, a.y, {fold}(b.m) AS m FROM {source} a JOIN {source} b ON a.vec_id = b.vec_id AND {_NEAR} GROUP BY ALL"


@query(
    f"WITH {FLAT_SQL}, ink AS (SELECT vec_id, x, y, v < 128 AS m FROM flat), wide AS ({_fold('ink', 'bool_or')}), closed AS ({_fold('wide', 'bool_and')}), "
    f"thin AS ({_fold('ink', 'bool_and')}), opened AS ({_fold('thin', 'bool_or')}) "
    "SELECT vec_id, y * 8 + x AS place, CAST(c.m AS INT) + 2 * CAST(o.m AS INT) AS v FROM closed c JOIN opened o USING (vec_id, x, y)"
)
def close_open(spark, sf_dir):
    """Ink closed (1) and opened (2) by a three-pixel square."""
    return _image(spark, sf_dir, lambda px: K.close(px < 128, 3, 3).astype(int) + 2 * K.open_(px < 128, 3, 3).astype(int))


_CUBIC = "(CASE WHEN t <= 1 THEN ((1.25 * t - 2.25) * t) * t + 1 WHEN t < 2 THEN ((-0.75 * t + 3.75) * t - 6) * t + 3 ELSE 0 END)"


def _doubled(weight: str, first: int, last: int) -> str:
    """Taps of doubling eight pixels: new place, old place, weight."""
    return f"""SELECT i, greatest(0, least(7, b + k)) AS j, {weight} AS w FROM (SELECT i, k, CAST(floor(i * 0.5::DOUBLE - 0.25) AS INT) AS b, abs(i * 0.5::DOUBLE - 0.25 - floor(i * 0.5::DOUBLE - 0.25) - k) AS t
  FROM range(16) r(i), range({first}, {last}) s(k))"""


@query(
    f"""WITH {FLAT_SQL}, linear AS ({_doubled('greatest(0, 1 - t)', 0, 2)}), cubic AS ({_doubled(_CUBIC, -1, 3)}),
taps AS (SELECT 'linear' AS how, * FROM linear UNION ALL SELECT 'cubic', * FROM cubic),
o AS (SELECT vec_id, p.how, q.i * 16 + p.i AS place, sum(p.w * q.w * v) AS v FROM flat, taps p, taps q WHERE p.how = q.how AND p.j = x AND q.j = y GROUP BY ALL)
SELECT vec_id, how, place, CAST(greatest(0, least(255, round_even(v, 0))) AS INT) AS v FROM o
UNION ALL SELECT vec_id, 'area', (y // 4) * 4 + x // 2, CAST(round_even(avg(v), 0) AS INT) FROM flat GROUP BY vec_id, y // 4, x // 2"""
)
def resample(spark, sf_dir):
    """Images halved by area, and doubled by linear and cubic interpolation."""
    sizes = {"area": (4, 2), "linear": (16, 16), "cubic": (16, 16)}
    made = _kernel(spark, sf_dir, _each(*(lambda px, how=how, size=size: K.resize(px, *size, how).ravel().tolist() for how, size in sizes.items())), ", ".join(f"{how} array<int>" for how in sizes))
    return made.unpivot("vec_id", list(sizes), "how", "o").select("vec_id", "how", F.posexplode("o").alias("place", "v"))


MOVES = {"shift": [[1, 0, 2], [0, 1, 1], [0, 0, 1]], "half turn": [[-1, 0, 7], [0, -1, 7], [0, 0, 1]]}


@query(
    f"WITH {FLAT_SQL} SELECT a.vec_id, how, a.y * 8 + a.x AS place, b.v FROM flat a, (VALUES ('shift'), ('half turn')) m(how), flat b WHERE a.vec_id = b.vec_id "
    "AND b.x = CASE how WHEN 'shift' THEN greatest(0, a.x - 2) ELSE 7 - a.x END AND b.y = CASE how WHEN 'shift' THEN greatest(0, a.y - 1) ELSE 7 - a.y END"
)
def warp_moves(spark, sf_dir):
    """A perspective warp that only moves pixels, edges repeated."""
    made = _kernel(spark, sf_dir, _each(*(lambda px, m=m: K.warp(px, np.array(m, float), 8, 8).ravel().tolist() for m in MOVES.values())), "shift array<int>, `half turn` array<int>".replace("`half turn`", "half_turn"))
    made = made.withColumnRenamed("half_turn", "half turn")
    return made.unpivot("vec_id", list(MOVES), "how", "o").select("vec_id", "how", F.posexplode("o").alias("place", "v"))


@query(f"SELECT vec_id, corner, u, v FROM ({BOX_SQL}), (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 1199.0, 0.0), (2, 1199.0, 755.0), (3, 0.0, 755.0)) t(corner, u, v)")
def perspective_corners(spark, sf_dir):
    """The map of a slanted quadrilateral to a card takes its corners to the card's."""
    target = np.array([[0, 0], [1199, 0], [1199, 755], [0, 755]], float)

    def run(batches):
        for b in batches:
            rows = []
            for i, x, y, w, h in zip(b.vec_id, b.x, b.y, b.width, b.height, strict=True):
                quad = np.array([[x, y], [x + w, y + 3], [x + w + 5, y + h], [x - 2, y + h + 4]], float)
                at = K.perspective(quad, target) @ np.column_stack([quad, np.ones(4)]).T
                rows += [(i, k, *uv) for k, uv in enumerate((at[:2] / at[2]).T.tolist())]
            yield pd.DataFrame(rows, columns=["vec_id", "corner", "u", "v"])

    made = line_boxes(spark, sf_dir).mapInPandas(run, "vec_id long, corner int, u double, v double")
    return made.select("vec_id", "corner", (F.round("u", 3) + 0.0).alias("u"), (F.round("v", 3) + 0.0).alias("v"))


def _grown(start: str, through: str, touch: str) -> str:
    """Pixels of ``through`` that are reached from ``start``."""
    return f"SELECT vec_id, x, y FROM {start} UNION SELECT b.vec_id, b.x, b.y FROM grown a JOIN {through} b ON a.vec_id = b.vec_id AND {touch}"


def _parts(pixels: str, touch: str) -> str:
    """Connected parts of a table of pixels: ``reach``, then ``part`` (vec_id, x, y, c)."""
    return f"""reach AS (SELECT vec_id, y * 8 + x AS c, x, y FROM {pixels} UNION SELECT a.vec_id, a.c, b.x, b.y FROM reach a JOIN {pixels} b ON a.vec_id = b.vec_id AND {touch}),
part AS (SELECT vec_id, x, y, min(c) AS c FROM reach GROUP BY ALL)"""


_FOUR = "abs(a.x - b.x) + abs(a.y - b.y) = 1"


@query(
    f"WITH RECURSIVE {FLAT_SQL}, ink AS (SELECT vec_id, x, y FROM flat WHERE v < 128), {_parts('ink', _NEAR)} "
    "SELECT vec_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS pixels FROM part GROUP BY vec_id, c"
)
def component_stats(spark, sf_dir):
    """Connected components of ink: boxes and pixels."""
    names = ("x", "y", "width", "height", "pixels")

    def boxes(px):
        return [tuple(r) for r in K.component_boxes(*K.components(px < 128)).tolist()]

    made = _kernel(spark, sf_dir, _each(boxes), "o array<struct<x:int,y:int,width:int,height:int,pixels:long>>")
    return made.select("vec_id", F.explode("o").alias("o")).select("vec_id", *(F.col(f"o.{n}") for n in names))


@query(
    f"""WITH RECURSIVE {FLAT_SQL}, near AS (SELECT a.vec_id, a.x, a.y, b.v, d, e FROM flat a, range(-1, 2) p(d), range(-1, 2) q(e), flat b
  WHERE a.vec_id = b.vec_id AND b.x = greatest(0, least(7, a.x + d)) AND b.y = greatest(0, least(7, a.y + e))),
g AS (SELECT vec_id, x, y, sum(d * (2 - abs(e)) * v) AS dx, sum(e * (2 - abs(d)) * v) AS dy FROM near GROUP BY ALL),
s AS (SELECT *, abs(dx) + abs(dy) AS size, (degrees(atan2(dy, dx)) + 360) % 180 AS angle FROM g),
w AS (SELECT *, CASE WHEN angle < 22.5 OR angle >= 157.5 THEN 0 ELSE 1 END AS sy, CASE WHEN angle < 67.5 OR angle >= 157.5 THEN 1 WHEN angle < 112.5 THEN 0 ELSE -1 END AS sx FROM s),
crest AS (SELECT w.vec_id, w.x, w.y, w.size FROM w LEFT JOIN s b ON b.vec_id = w.vec_id AND b.x = w.x - sx AND b.y = w.y - sy LEFT JOIN s f ON f.vec_id = w.vec_id AND f.x = w.x + sx AND f.y = w.y + sy
  WHERE w.size > coalesce(b.size, 0) AND w.size >= coalesce(f.size, 0) AND w.size > 60),
strong AS (SELECT * FROM crest WHERE size > 200), grown AS ({_grown('strong', 'crest', _NEAR)})
SELECT flat.vec_id, flat.y * 8 + flat.x AS place, CAST(grown.x IS NOT NULL AS INT) AS v FROM flat LEFT JOIN grown USING (vec_id, x, y)"""
)
def edge_map(spark, sf_dir):
    """Canny edges."""
    return _image(spark, sf_dir, lambda px: K.edges(px, 60, 200).astype(int))


def _holes(white: str, threshold: str = "") -> str:
    """Parts of white that no way joins to the border."""
    return f"""white AS (SELECT vec_id, x, y FROM flat {threshold} WHERE {white}), rim AS (SELECT * FROM white WHERE x IN (0, 7) OR y IN (0, 7)),
grown AS ({_grown('rim', 'white', _FOUR)}), inner_ AS (SELECT * FROM white ANTI JOIN grown USING (vec_id, x, y)), {_parts('inner_', _FOUR)}"""


OTSU_SQL = f"""n AS (SELECT vec_id, v, count(*)::DOUBLE AS c FROM flat GROUP BY vec_id, v),
sums AS (SELECT vec_id, v, sum(c) OVER w AS wb, sum(c * v) OVER w AS sb, sum(c) OVER (PARTITION BY vec_id) AS t, sum(c * v) OVER (PARTITION BY vec_id) AS st FROM n WINDOW w AS (PARTITION BY vec_id ORDER BY v)),
otsu AS (SELECT vec_id, v AS threshold FROM sums QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(CASE WHEN wb < t THEN wb * (t - wb) * (sb / wb - (st - sb) / (t - wb))^2 ELSE -1 END, 6) DESC, v) = 1)"""


@query(
    f"""SELECT vec_id, CAST(coalesce(a.n, 0) AS INT) AS holes, CAST(coalesce(b.n, 0) AS INT) AS holes_any FROM embeddings
LEFT JOIN (WITH RECURSIVE {FLAT_SQL}, {_holes('v >= 128')} SELECT vec_id, count(*) AS n FROM (SELECT vec_id, c FROM part GROUP BY ALL HAVING count(*) >= 2) GROUP BY vec_id) a USING (vec_id)
LEFT JOIN (WITH RECURSIVE {FLAT_SQL}, {OTSU_SQL}, {_holes('v > threshold', 'JOIN otsu USING (vec_id)')} SELECT vec_id, count(DISTINCT c) AS n FROM part GROUP BY vec_id) b USING (vec_id)"""
)
def count_holes(spark, sf_dir):
    return _kernel(spark, sf_dir, _each(lambda px: len(S.holes(px, DEFAULT)), S.holes_by_threshold), "holes int, holes_any int")


def _wrong_holes(digit: str, due: int) -> str:
    return f"CASE WHEN n <> {due} THEN concat('{digit}-holes-', n) END"


@query(
    f"""WITH RECURSIVE {FLAT_SQL}, {_holes('v >= 128')},
h AS (SELECT vec_id, count(*) AS n, any_value(cy) AS cy FROM (SELECT vec_id, c, avg(y) AS cy FROM part GROUP BY vec_id, c HAVING count(*) >= 2) GROUP BY vec_id),
stem AS (SELECT vec_id, count(*) FILTER (x >= 4 AND v < 128) AS rightside, count(*) FILTER (x < 4 AND v < 128) AS leftside FROM flat WHERE y >= 4 GROUP BY vec_id),
f AS (SELECT vec_id, coalesce(n, 0) AS n, cy / 8.0 AS cy, rightside, rightside > leftside * 1.5 AND rightside > 2 AS heavy FROM stem LEFT JOIN h USING (vec_id))
SELECT vec_id, concat_ws('+', {_wrong_holes('0', 1)}, {_wrong_holes('1', 0)}, '1-aspect-1.00', {_wrong_holes('3', 0)}, {_wrong_holes('5', 1)},
  CASE WHEN n = 1 AND NOT cy BETWEEN 0.3 AND 0.7 THEN '5-loop-offcenter' END, CASE WHEN heavy AND rightside > 12 THEN '5-has-descending-stem' END,
  {_wrong_holes('6', 0)}, {_wrong_holes('8', 0)}, {_wrong_holes('9', 1)}, CASE WHEN n = 1 AND cy > 0.55 THEN '9-loop-low' END, CASE WHEN NOT heavy THEN '9-no-right-stem' END) AS reasons FROM f"""
)
def digit_topology(spark, sf_dir):
    return _kernel(spark, sf_dir, _each(lambda px: "+".join(r for d in "0135689" for r in S.topology_reasons(px, d, DEFAULT))), "reasons string")


@query(
    "SELECT vec_id, CAST((w - 1) * (h - 1) AS DOUBLE) AS area, concat_ws(' ', concat('3,2'), concat('3,', h + 1), concat(w + 2, ',2'), concat(w + 2, ',', h + 1)) AS corners "
    "FROM (SELECT vec_id, 5 + vec_id % 9 AS w, 14 + vec_id % 5 AS h FROM embeddings)"
)
def rectangle_outline(spark, sf_dir):
    """The border of a drawn rectangle, traced, measured and simplified to its corners."""

    def run(batches):
        for b in batches:
            rows = []
            for i in b.vec_id.tolist():
                w, h = 5 + i % 9, 14 + i % 5
                mask = np.zeros((h + 5, w + 6), bool)
                mask[2 : 2 + h, 3 : 3 + w] = True
                line = K.border(mask)
                corners = {f"{x},{y}" for x, y in K.simplify(line, 1.0).tolist()}
                order = lambda c: tuple(map(int, c.split(",")))
                rows.append((i, K.polygon_area(line), " ".join(sorted(corners, key=order))))
            yield pd.DataFrame(rows, columns=["vec_id", "area", "corners"])

    return table(spark, sf_dir, "embeddings").select("vec_id").mapInPandas(run, "vec_id long, area double, corners string")


TEMPLATES = {"bar": [[0, 255, 0], [0, 255, 0], [0, 255, 0]], "cross": [[0, 255, 0], [255, 255, 255], [0, 255, 0]], "edge": [[0, 0, 255], [0, 0, 255], [0, 0, 255]]}
_TEMPLATE_ROWS = ", ".join(f"('{k}', {x}, {y}, {v})" for k, rows in TEMPLATES.items() for y, row in enumerate(rows) for x, v in enumerate(row))


@query(
    f"""WITH {FLAT_SQL}, t(label, dx, dy, w) AS (VALUES {_TEMPLATE_ROWS}), m AS (SELECT vec_id, label, x - dx AS px, y - dy AS py, corr(v, w) AS r FROM flat, t GROUP BY ALL HAVING count(*) = 9),
best AS (SELECT vec_id, label, max(CASE WHEN isnan(r) THEN 0 ELSE r END) AS score FROM m GROUP BY ALL)
SELECT vec_id, label, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS INT) AS place FROM best"""
)
def rank_templates(spark, sf_dir):
    """Templates by their best match in an image."""
    small = {k: np.array(v, np.uint8) for k, v in TEMPLATES.items()}

    def ranked(px):
        return [(label, score, i + 1) for i, (label, score) in enumerate(S.rank_templates(px, small))]

    made = _kernel(spark, sf_dir, _each(ranked), "o array<struct<label:string,score:double,place:int>>").select("vec_id", F.explode("o").alias("o"))
    return made.select("vec_id", "o.label", r6("o.score").alias("score"), "o.place")


SHAPES_SQL = """shapes(kind, seed, x, y) AS (
SELECT DISTINCT 'hollow', seed, CAST(floor(12 + cos(k / 64.0 * 2 * pi()) * (7 - seed - s) + 0.5) AS INT), CAST(floor(16 + sin(k / 64.0 * 2 * pi()) * (6 - seed - s) + 0.5) AS INT) FROM range(2) a(seed), (VALUES (0), (2)) b(s), range(64) c(k)
UNION ALL SELECT 'narrow', seed, 10 + seed + i, y FROM range(2) a(seed), range(3) b(i), range(3, 29) c(y)
UNION ALL SELECT 'slash', seed, CAST(floor(18 - (y - 3) / 26.0 * 12 + 0.5) AS INT) + seed + i, y FROM range(2) a(seed), range(2) b(i), range(3, 29) c(y)
UNION ALL SELECT 'looped', 0, x, y FROM range(6, 18) a(x), range(6, 26) b(y) WHERE ((x - 12) / 6.0)^2 + ((y - 16) / 10.0)^2 < 1)"""


def _templates() -> list[tuple[str, int, np.ndarray]]:
    return [(kind, seed, px) for kind, several in S.drawn_templates(DEFAULT).items() for seed, px in enumerate(several)]


@query(
    f"WITH {FLAT_SQL}, {SHAPES_SQL}, g AS (SELECT x AS gx, y AS gy, avg(v) AS level FROM flat GROUP BY ALL) "
    "SELECT kind, CAST(seed AS INT) AS seed, CAST(y * 24 + x AS INT) AS place, round(level, 6) AS level FROM shapes JOIN g ON gx = x * 8 // 24 AND gy = y * 8 // 32"
)
def shape_templates(spark, sf_dir):
    """The ink of the seven drawn templates, and how dark all images together are under it."""
    rows = [(kind, seed, np.flatnonzero(px.ravel() == 0).tolist()) for kind, seed, px in _templates()]
    ink = spark.createDataFrame(rows, "kind string, seed int, ink array<int>").select("kind", "seed", F.explode("ink").alias("place"))
    levels = spread(grids(spark, sf_dir), "px", "v").groupBy(F.col("place").alias("cell")).agg(F.avg("v").alias("level"))
    cell = F.floor(F.floor(F.col("place") / 24) * 8 / 32) * 8 + F.floor(F.col("place") % 24 * 8 / 24)
    return ink.withColumn("cell", cell.cast("int")).join(levels, "cell").select("kind", "seed", "place", r6("level").alias("level"))


@query(
    f"""WITH {FLAT_SQL}, {SHAPES_SQL}, kinds AS (SELECT DISTINCT kind, seed FROM shapes), big AS (SELECT f.vec_id, a.x, b.y, f.v FROM range(24) a(x), range(32) b(y), flat f WHERE f.x = a.x * 8 // 24 AND f.y = b.y * 8 // 32),
cells AS (SELECT kind, seed, CAST(a.x AS INT) AS x, CAST(b.y AS INT) AS y FROM kinds, range(24) a(x), range(32) b(y)), t AS (SELECT c.*, CASE WHEN s.kind IS NULL THEN 255 ELSE 0 END AS w FROM cells c LEFT JOIN shapes s USING (kind, seed, x, y)),
c AS (SELECT vec_id, kind, seed, corr(v, w) AS r FROM big JOIN t USING (x, y) GROUP BY ALL) SELECT vec_id, kind, round(max(r), 6) AS best FROM c GROUP BY vec_id, kind"""
)
def template_scores(spark, sf_dir):
    """The best correlation of each image with each kind of the drawn templates, which are constants of the plan."""
    w, h = DEFAULT.shape.compare_width, DEFAULT.shape.compare_height
    flat = lambda px: F.split(F.lit(",".join(map(str, px.ravel().astype(int)))), ",").cast("array<double>")
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), flat(px).alias("t")) for kind, _, px in _templates()))
    rows = grids(spark, sf_dir).select("vec_id", A.resize_nearest(F.col("px"), 8, 8, w, h).alias("big")).select("vec_id", "big", F.explode(each).alias("t"))
    r = rows.select("vec_id", "t.kind", A.ncc(F.col("big"), F.col("t.t")).alias("r"))
    return r.groupBy("vec_id", "kind").agg(r6(F.max("r")).alias("best"))


@query(
    f"""WITH {FLAT_SQL}, c AS (SELECT vec_id, x FROM flat WHERE v < 128 GROUP BY vec_id, x HAVING count(*) >= 2),
i AS (SELECT vec_id, x, x - row_number() OVER (PARTITION BY vec_id ORDER BY x) AS g FROM c), r AS (SELECT vec_id, min(x) AS x0, max(x) + 1 AS x1 FROM i GROUP BY vec_id, g HAVING count(*) >= 2),
e AS (SELECT r.vec_id, x0, x1, min(y) AS top, max(y) - min(y) + 1 AS height FROM r JOIN flat f ON f.vec_id = r.vec_id AND f.x >= x0 AND f.x < x1 AND v < 128 GROUP BY ALL)
SELECT vec_id, string_agg(concat(x0, '-', x1, ':', top, '+', height), ' ' ORDER BY x0) AS runs, concat(min(x0), '-', max(x1)) AS one FROM e GROUP BY vec_id"""
)
def run_extents(spark, sf_dir):
    """Runs of inked columns with the extent of their ink, and all of them forced into one."""

    def runs(px):
        found = S.column_runs(px, DEFAULT)
        return " ".join("{}-{}:{}+{}".format(*r, *S.extent(px, r, DEFAULT)) for r in found) or None

    one = lambda px: next((f"{a}-{b}" for a, b in S.force_slots(px, 1, DEFAULT)), None)
    return _kernel(spark, sf_dir, _each(runs, one), "runs string, one string").where("runs is not null")


# --- from colours to the recogniser -------------------------------------------------------------------


@query(f"WITH {FLAT_SQL} SELECT a.vec_id, a.y * 8 + a.x AS place, (299 * a.v + 587 * b.v + 114 * c.v + 500) // 1000 AS v FROM flat a, flat b, flat c WHERE a.vec_id = b.vec_id AND b.vec_id = c.vec_id AND b.x = 7 - a.x AND b.y = a.y AND c.x = a.x AND c.y = 7 - a.y")
def gray_from_colour(spark, sf_dir):
    return _image(spark, sf_dir, lambda px: K.to_gray(np.stack([px, px[:, ::-1], px[::-1]], axis=-1)))


_SOFT = [(d, float(w)) for d, w in zip(range(-4, 5), K.gaussian_kernel(9, DEFAULT.gray.unsharp_sigma), strict=True)]


@query(
    f"""WITH {FLAT_SQL}, m AS (SELECT vec_id, avg(v) AS mean FROM flat GROUP BY vec_id), dark AS (SELECT vec_id, x, y, CASE WHEN mean < 110 THEN 255 - v ELSE v END AS v FROM flat JOIN m USING (vec_id)),
k AS (SELECT vec_id, stddev_pop(v) AS sigma, min(v) AS lo, max(v) AS hi FROM dark GROUP BY vec_id), s AS ({_blurred(_SOFT, 'dark')})
SELECT vec_id, y * 8 + x AS place, CAST(CASE WHEN sigma < 38 AND hi > lo THEN floor((v - lo) * 255.0::DOUBLE / (hi - lo) + 0.5::DOUBLE)
  WHEN sigma >= 38 AND sigma < 65 THEN greatest(0, least(255, round_even(1.5::DOUBLE * v - 0.5::DOUBLE * round_even(soft, 0), 0))) ELSE v END AS INT) AS v FROM s JOIN k USING (vec_id)"""
)
def second_gray_pass(spark, sf_dir):
    """A flat image spread, a soft one sharpened."""
    return _image(spark, sf_dir, lambda px: P.gray_pass(px, 2, DEFAULT)[0])


@query(
    f"SELECT vec_id, x, y, greatest(1, least(w, 1200 - x)) AS width, greatest(1, least(h, 756 - y)) AS height FROM "
    f"(SELECT vec_id, greatest(0, least(x - 200, 1199)) AS x, greatest(0, least(y - 100, 755)) AS y, width + 600 AS w, height + 300 AS h FROM ({BOX_SQL}))"
)
def clamp_crop(spark, sf_dir):
    b = F.struct((F.col("x") - 200).alias("x"), (F.col("y") - 100).alias("y"), (F.col("width") + 600).alias("width"), (F.col("height") + 300).alias("height"))
    return line_boxes(spark, sf_dir).select("vec_id", G.clamp_crop(b, F.lit(COLS), F.lit(ROWS)).alias("b")).select("vec_id", "b.*")


@query(
    f"""WITH {FLAT_SQL}, taps AS (SELECT i, greatest(0, least(7, b + k)) AS j, CASE k WHEN 0 THEN 1 - t ELSE t END AS w
  FROM (SELECT i, CAST(floor(i * 0.25::DOUBLE - 0.375) AS INT) AS b, i * 0.25::DOUBLE - 0.375 - floor(i * 0.25::DOUBLE - 0.375) AS t FROM range(32) r(i)), range(2) s(k)),
big AS (SELECT vec_id, p.i AS x, q.i AS y, round_even(sum(p.w * q.w * v), 0) AS v FROM flat, taps p, taps q WHERE p.j = flat.x AND q.j = flat.y GROUP BY ALL),
s AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS sigma FROM big GROUP BY vec_id)
SELECT s.vec_id, s.col, coalesce(round(CAST((v - mean) / (sigma + 1e-6::DOUBLE) AS FLOAT)::DOUBLE, 5), 0.0::DOUBLE) + 0.0::DOUBLE AS v
FROM (SELECT * FROM s, range(160) c(col)) s LEFT JOIN big ON big.vec_id = s.vec_id AND big.x = s.col AND big.y = 13"""
)
def model_input(spark, sf_dir):
    """The fourteenth row of what the recogniser is given: the image at its height, standardised, zeros to its right."""
    made = _kernel(spark, sf_dir, _each(lambda px: P.model_input(px, DEFAULT)[13].astype(float).tolist()), "o array<double>")
    return made.select("vec_id", F.posexplode("o").alias("col", "v")).withColumn("v", F.round("v", 5) + 0.0)


@query(
    f"""WITH {FLAT_SQL} SELECT a.vec_id, CAST(o AS INT) AS o, a.y * 8 + a.x AS place, CAST(greatest(0, sum(b.v * (((o + 1) * ((b.y - a.y + 1) * 3 + b.x - a.x + 1)) % 5 - 2)) + 10 * o) AS DOUBLE) AS v
FROM flat a, flat b, range(2) r(o) WHERE a.vec_id = b.vec_id AND {_NEAR} GROUP BY a.vec_id, o, a.x, a.y"""
)
def convolution(spark, sf_dir):
    """A layer of two rectified 3x3 convolutions."""
    w = np.array([[((o + 1) * i) % 5 - 2 for i in range(9)] for o in range(2)], np.float32)
    f = lambda px: (np.moveaxis(N._conv(px[..., None].astype(np.float32), w, np.array([0, 10], np.float32)), 3, 1).reshape(len(px), -1).astype(float).tolist(),)
    made = spread(_kernel(spark, sf_dir, f, "o array<double>"), "o", "v")
    return made.select("vec_id", F.floor(F.col("place") / 64).cast("int").alias("o"), (F.col("place") % 64).cast("int").alias("place"), "v")


def _plain_network() -> N.Network:
    """Weights whose outputs can be told by hand: the convolutions hand the image on, the dense layers add and subtract."""
    w, b = {}, {}
    for name, out, inn, k in N.LAYERS:
        w[name], b[name] = np.zeros((out, inn * k), np.float32), np.zeros(out, np.float32)
        if k == 9:
            w[name][0, 4 * inn] = 1
    n = np.arange(128)
    w["fc1"][n, (n % 20) * 32] = 1
    w["digits"][:] = (np.arange(80)[:, None] + n) % 3 - 1
    w["is_date"][0, :20] = 1
    return N.Network(w, b)


@query(
    f"""WITH {FLAT_SQL}, pool AS (SELECT vec_id, j, y // 2 AS r, max(v) AS v FROM flat, range(20) s(j) WHERE x BETWEEN 8 * j // 20 AND (8 * j + 7) // 20 GROUP BY ALL),
f AS (SELECT vec_id, j, avg(v) AS v FROM pool GROUP BY ALL)
SELECT vec_id, CAST(o AS INT) AS o, CAST(sum(v * ((o + k) % 3 - 1)) AS DOUBLE) + 0.0::DOUBLE AS v FROM f, range(128) a(k), range(80) b(o) WHERE j = k % 20 GROUP BY vec_id, o
UNION ALL SELECT vec_id, 80, CAST(sum(v) AS DOUBLE) FROM f GROUP BY vec_id"""
)
def forward_pass(spark, sf_dir):
    """All layers of the recogniser, with weights that SQL can follow: 80 digit logits and that of a date."""
    network = _plain_network()

    def read(px):
        lines = np.repeat(np.repeat(px, 4, axis=1), 20, axis=2)
        digits, date = N.forward(network, lines)
        return (np.column_stack([digits, date]).astype(float).tolist(),)

    made = _kernel(spark, sf_dir, read, "v array<double>")
    return made.select("vec_id", F.posexplode("v").alias("o", "v")).withColumn("v", F.col("v") + 0.0)


@query(
    "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, round(unnest(embedding)::DOUBLE * 1.5 / sqrt(0.25::DOUBLE + label / 10.0::DOUBLE), 6) AS w, "
    "round((0.3::DOUBLE - 0.1::DOUBLE) * 1.5 / sqrt(0.25::DOUBLE + label / 10.0::DOUBLE) + 0.2::DOUBLE, 6) AS bias FROM embeddings"
)
def fold_norm(spark, sf_dir):
    """Weights that do a batch normalisation's work too."""

    def run(batches):
        for b in batches:
            rows = []
            for i, label, e in zip(b.vec_id, b.label, b.embedding, strict=True):
                w, bias = N.fold_norm(np.array([e], float), np.array([0.3]), [1.5], [0.2], [0.1], [0.25 + label / 10 - 0.001], 0.001)
                rows.append((i, w[0].tolist(), float(bias[0])))
            yield pd.DataFrame(rows, columns=["vec_id", "w", "bias"])

    made = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").mapInPandas(run, "vec_id long, w array<double>, bias double")
    return made.select("vec_id", r6("bias").alias("bias"), F.posexplode("w").alias("pos", "w")).withColumn("w", r6("w"))


# --- files ---------------------------------------------------------------------------------------------


@query(f"SELECT vec_id, array_to_string(px, ',') AS px FROM ({PX_SQL})")
def png_round_trip(spark, sf_dir):
    """Images shown as PNG data URLs, and read back from them."""
    packed = _kernel(spark, sf_dir, _each(lambda px: {"w": 8, "h": 8, "px": px.tobytes()}), f"image {I.GRAY}")

    @F.pandas_udf("string")
    def pixels(data: pd.Series) -> pd.Series:
        return data.map(lambda d: ",".join(map(str, I.from_png(d).ravel())))

    return I.previews(packed).select("vec_id", pixels(I.from_data_url(F.col("preview"))).alias("px"))


LABEL_SQL = "SELECT event_id, concat('line', event_id, '.png') AS file, CASE event_id % 4 WHEN 0 THEN ' None' WHEN 1 THEN '۱۳۷۵۰۵۱۲' WHEN 2 THEN '12' ELSE concat('1380/01/', lpad(CAST(event_id % 31 AS VARCHAR), 2, '0')) END AS label FROM events"


@query(
    f"SELECT file, event_id % 4 <> 0 AS positive, CASE event_id % 4 WHEN 1 THEN '13750512' WHEN 3 THEN replace(label, '/', '') END AS digits FROM ({LABEL_SQL}) WHERE event_id % 4 <> 2 AND event_id % 5 <> 0"
)
def label_file(spark, sf_dir):
    """Labels written as CSV and read back, those of missing files left out."""
    rows = spark.sql(LABEL_SQL.replace("VARCHAR", "STRING").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    scratch = Scratch(spark, "labels")
    path = f"{scratch.root}/csv"
    rows.select("file", "label").write.csv(path, ignoreLeadingWhiteSpace=False)
    return R.load_labels_csv(spark, path, rows.where("event_id % 5 <> 0").select("file"))


@query(
    "WITH m AS (SELECT label, i, avg(v) AS w FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY ALL) "
    "SELECT CAST(o AS INT) AS output, round(max(abs(w)), 5) AS top, true AS close FROM m JOIN range(80) r(o) ON o % 10 = label GROUP BY o"
)
def weight_file(spark, sf_dir):
    """A weight file whose digit head is the mean of each label's embeddings, written as base64 text, read back and scaled: its largest
    weight for each output, and whether all are within half a step of what they were made from."""
    e = table(spark, sf_dir, "embeddings")
    means = e.groupBy("label").agg(F.array(*(F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64))).alias("w")).collect()  # one row a label
    network, own = N.synthetic(3), {r.label: np.array(r.w * 2, np.float32) for r in means}
    head = np.stack([own.get(o % 10, np.zeros(128, np.float32)) for o in range(80)])
    network = N.Network(network.weights | {"digits": head}, network.bias)
    scratch = Scratch(spark, "weights")
    path = f"{scratch.root}/text"
    spark.createDataFrame([(base64.b64encode(N.dump(network)).decode(),)], "value string").coalesce(1).write.text(path)
    again = N.load(I.read_weights(spark, path)).weights["digits"]
    close = (np.abs(again - head) <= 0.5001 * np.abs(head).max(1, keepdims=True) / 127).all(1)
    rows = [(o, round(float(np.abs(again[o]).max()), 5), bool(close[o])) for o in range(80) if o % 10 in own]
    return spark.createDataFrame(rows, "output int, top double, close boolean")


@query(f"SELECT kind, count(*) AS n, sum(id) AS total FROM (SELECT event_id AS id, CASE WHEN u < 740 THEN 'date' ELSE 'other' END AS kind FROM (SELECT event_id, {_draw('event_id', 1000)} AS u FROM events)) GROUP BY kind")
def dataset_files(spark, sf_dir):
    """Training rows written in parts by kind, and read back."""
    rows = Z.label_kinds(table(spark, sf_dir, "events"), "event_id").select("id", F.when(F.col("positive"), "date").otherwise("other").alias("kind"))
    path = f"{Scratch(spark, 'dataset').root}/parts"
    rows.write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


# --- training material ------------------------------------------------------------------------------------


@query(
    f"""WITH {PROBS_SQL}, t AS (SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN lpad(CAST((vec_id * 7919) % 100000000 AS VARCHAR), 8, '0') END AS truth FROM embeddings),
r AS (SELECT vec_id, truth, any_value(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, 1 / (1 + exp(-date_logit))))) AS d,
  -sum(CASE WHEN place % 10 = CAST(truth[place // 10 + 1] AS INT) THEN ln(greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, p))) END) / 8 AS ce FROM probs JOIN t USING (vec_id) GROUP BY ALL),
s AS (SELECT sum(ce) / (count(ce) + 1e-6::DOUBLE) AS digit_loss, avg(-CASE WHEN truth IS NOT NULL THEN ln(d) ELSE ln(1 - d) END) AS date_loss FROM r)
SELECT round(digit_loss, 6) AS digit_loss, round(date_loss, 6) AS date_loss, round(digit_loss + date_loss, 6) AS loss FROM s"""
)
def masked_loss(spark, sf_dir):
    truth = F.when(F.col("vec_id") % 3 != 0, F.lpad(((F.col("vec_id") * 7919) % 100000000).cast("string"), 8, "0"))
    rows = logits(spark, sf_dir).select(truth.alias("truth"), A.softmax_slots(F.col("logits")).alias("probs"), A.sigmoid(F.col("date_logit")).alias("date_prob"))
    loss = E.masked_loss(rows)
    return loss.select(*(r6(c).alias(c) for c in loss.columns))


@query("SELECT n_name AS name, CASE WHEN n_name LIKE '%1%' OR n_name LIKE '%2_' THEN 'held' ELSE 'train' END AS part, 'train' AS all_held FROM nation")
def split_names(spark, sf_dir):
    """Names dealt to training and held-out parts; where none would be left to train on, all are."""
    rows = E.split_names(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), F.col("name"), ("1", "2.$"))
    return E.split_names(rows.withColumnRenamed("part", "p"), F.col("name"), ("nation",)).select("name", F.col("p").alias("part"), F.col("part").alias("all_held"))


@query(
    f"SELECT event_id AS id, CASE WHEN {_draw('event_id + 1', 1000)} < 150 THEN 'real' WHEN {_draw('event_id + 2', 1000)} < 600 THEN 'glyphs' WHEN {_draw('event_id + 3', 1000)} < 500 THEN "
    f"CASE WHEN {_draw('event_id + 4', 1000)} < 700 THEN 'row of a date' WHEN {_draw('event_id + 4', 1000)} < 850 THEN 'row of an identity' ELSE 'row of words' END ELSE 'line' END AS source FROM events"
)
def source_mix(spark, sf_dir):
    return Z.source_mix(table(spark, sf_dir, "events"), "event_id")


def _margin(k: int, lo: float, hi: float) -> str:
    return f"({lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * {_draw(f'vec_id + {k}', 1000)} / 1000.0::DOUBLE) * h"


@query(
    f"""WITH {FLAT_SQL}, b AS (SELECT vec_id, min(x) AS l, max(x) AS r, min(y) AS t, max(y) AS d, greatest(8, max(y) - min(y)) AS h FROM flat WHERE v < 100 GROUP BY vec_id),
c AS (SELECT vec_id, greatest(0, CAST(trunc(l - {_margin(1, 0.05, 0.8)}) AS INT)) AS x0, greatest(0, CAST(trunc(t - {_margin(3, 0.1, 0.6)}) AS INT)) AS y0,
  least(8, CAST(trunc(r + {_margin(2, 0.05, 0.8)}) AS INT)) AS x1, least(8, CAST(trunc(d + {_margin(4, 0.1, 0.6)}) AS INT)) AS y1 FROM b)
SELECT vec_id, CASE WHEN ok THEN x0 ELSE 0 END AS x0, CASE WHEN ok THEN y0 ELSE 0 END AS y0, CASE WHEN ok THEN x1 ELSE 8 END AS x1, CASE WHEN ok THEN y1 ELSE 8 END AS y1 FROM (SELECT *, x1 > x0 AND y1 > y0 AS ok FROM c)"""
)
def ink_margins(spark, sf_dir):
    ink = spread(grids(spark, sf_dir), "px", "v").where("v < 100").select("vec_id", (F.col("place") % 8).cast("int").alias("x"), F.floor(F.col("place") / 8).cast("int").alias("y"))
    return Z.ink_margins(ink, 8, 8, "vec_id")


GLYPH_SQL = f"SELECT image_id AS sheet_id, vec_id AS seq, x, CAST(10 + vec_id % 20 AS INT) AS width, CAST(12 + (vec_id * 7) % 30 AS INT) AS height, CAST(vec_id % 3 = 0 AS INT) AS holes, vec_id % 2 = 0 AS slanted FROM ({BOX_SQL})"


@query(
    f"""WITH g AS ({GLYPH_SQL}), m AS (SELECT sheet_id, count(*) AS n, coalesce(median(height) FILTER (holes = 0 AND height > 15), 24.0) AS med, CASE sheet_id % 4 WHEN 0 THEN repeat('7', count(*)) WHEN 1 THEN substr(repeat('01/7', count(*)), 1, count(*)) WHEN 2 THEN repeat('7', count(*) - 1) ELSE concat(repeat('7', count(*) - 1), '1') END AS labels FROM g GROUP BY sheet_id),
r AS (SELECT g.*, n, labels, row_number() OVER (PARTITION BY sheet_id ORDER BY x, seq) AS place, height / med AS ratio FROM g JOIN m USING (sheet_id)),
k AS (SELECT *, substr(labels, place, 1) AS l, holes = 1 AND ratio < 0.62 AS ring, holes = 0 AND width / height::DOUBLE < 0.42 AS narrow, holes = 0 AND ratio >= 0.85 AND slanted AS slash FROM r),
a AS (SELECT *, CASE WHEN l = '0' AND NOT ring THEN 'zero is no ring' WHEN l = '1' AND NOT narrow THEN 'one isn''t narrow' WHEN l = '/' AND NOT slash THEN 'slash isn''t slanted' WHEN l NOT IN ('0', '1', '/') AND ring THEN 'ring isn''t a zero' END AS w FROM k)
SELECT sheet_id, CASE WHEN any_value(n) <> any_value(length(labels)) THEN 'other number of labels' ELSE min_by(w, place) FILTER (w IS NOT NULL) END AS reason FROM a GROUP BY sheet_id"""
)
def label_checks(spark, sf_dir):
    """Whether the labels of sliced sheets, as long as the sheets or one short, agree with the shapes of their glyphs."""
    v = F.col("seq")
    glyphs = line_boxes(spark, sf_dir).select(
        F.col("image_id").alias("sheet_id"), F.col("vec_id").alias("seq"), "x", (10 + F.col("vec_id") % 20).cast("int").alias("width"), (12 + (F.col("vec_id") * 7) % 30).cast("int").alias("height")
    ).withColumn("holes", (v % 3 == 0).cast("int")).withColumn("slanted", v % 2 == 0)
    n, kind = F.col("n").cast("int"), F.col("sheet_id") % 4
    text = F.when(kind == 0, F.repeat(F.lit("7"), n)).when(kind == 1, F.substring(F.repeat(F.lit("01/7"), n), F.lit(1), n))
    text = text.when(kind == 2, F.repeat(F.lit("7"), n - 1)).otherwise(F.concat(F.repeat(F.lit("7"), n - 1), F.lit("1")))
    labels = glyphs.groupBy("sheet_id").agg(F.count("*").alias("n")).select("sheet_id", text.alias("labels"))
    return D.label_checks(glyphs, labels)


# --- agreement with resets, in batch and as a stream ------------------------------------------------------------

RESET_SQL = FRAMES_SQL + (
    ", kept AS (SELECT * FROM frames QUALIFY frame >= coalesce(max(CASE WHEN frame % 7 = 0 THEN frame END) OVER (PARTITION BY session), frame) AND formatted IS NOT NULL),"
    " tally AS (SELECT session, formatted, count(*) AS count, sum(confidence) AS total, min(frame) AS first FROM kept GROUP BY ALL),"
    " best AS (SELECT * FROM tally QUALIFY row_number() OVER (PARTITION BY session ORDER BY count DESC, first) = 1)"
)


def _frames_with_resets(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("reset", F.col("frame") % 7 == 0)


@query(f"WITH {RESET_SQL} SELECT session, formatted, count, round(total, 6) AS total_confidence, CASE WHEN count >= 2 THEN formatted END AS agreed FROM best")
def consensus_reset(spark, sf_dir):
    """The leading date of each session since its last reset."""
    return C.status(C.since_reset(_frames_with_resets(spark, sf_dir))).withColumn("total_confidence", r6("total_confidence"))


@query(
    f"""WITH {RESET_SQL}, second AS (SELECT session, formatted, frame FROM kept QUALIFY row_number() OVER (PARTITION BY session, formatted ORDER BY frame) = 2),
agreed AS (SELECT session, formatted AS agreed FROM second QUALIFY row_number() OVER (PARTITION BY session ORDER BY frame) = 1)
SELECT session, f.frame, formatted, coalesce(count, 0) AS count, round(coalesce(total, 0), 6) AS total_confidence, agreed
FROM (SELECT session, max(frame) AS frame FROM frames GROUP BY session) f LEFT JOIN best USING (session) LEFT JOIN agreed USING (session)"""
)
def consensus_stream(spark, sf_dir):
    """The same as a stream over files of frames, whose state is each session's votes."""
    from daftar.streaming.consensus import consensus_stream as votes

    scratch = Scratch(spark, "frames")
    told = scratch.write(_frames_with_resets(spark, sf_dir))
    path = f"{scratch.root}/said"
    stream = votes(spark.readStream.schema(told.schema).parquet(f"{scratch.root}/1"))
    job = stream.writeStream.outputMode("update").option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True)
    job.foreachBatch(lambda rows, _: rows.write.mode("append").parquet(path)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).withColumn("total_confidence", r6("total_confidence"))
