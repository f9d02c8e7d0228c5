"""Queries over pixels: equalisation by tiles and what cameras do to lines; ``daftar.queries`` registers them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from daftar.functions import degrade as G
from daftar.image_queries import FLAT_SQL
from daftar.operators import pixels as P
from daftar.queries import PX_SQL, grids, query

# --- equalisation by tiles ----------------------------------------------------------------------------------------------

CURVES_SQL = f"""{FLAT_SQL}, n AS (SELECT vec_id, x // 4 AS tx, y // 4 AS ty, v, count(*) AS n FROM flat GROUP BY ALL),
t AS (SELECT vec_id, tx, ty, sum(n) AS area, CAST(greatest(1, floor(40 * sum(n) / 256.0::DOUBLE)) AS BIGINT) AS most FROM n GROUP BY ALL),
o AS (SELECT vec_id, tx, ty, any_value(area) AS area, any_value(most) AS most, CAST(sum(greatest(n - most, 0)) AS BIGINT) AS over FROM n JOIN t USING (vec_id, tx, ty) GROUP BY ALL),
l AS (SELECT o.*, k AS v, coalesce(n, 0) AS n, over % 256 AS rest, greatest(1, 256 // greatest(1, over % 256)) AS step FROM o CROSS JOIN range(256) r(k) LEFT JOIN n ON n.vec_id = o.vec_id AND n.tx = o.tx AND n.ty = o.ty AND n.v = k),
c AS (SELECT vec_id, tx, ty, v, least(255, floor(sum(least(n, most) + over // 256 + CASE WHEN v % step = 0 AND v // step < rest THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id, tx, ty ORDER BY v) * 255 / area::DOUBLE + 0.5)) AS level FROM l)"""


@query(
    f"""WITH {CURVES_SQL}, p AS (SELECT vec_id, x, y, v, x / 4.0::DOUBLE - 0.5 AS fx, y / 4.0::DOUBLE - 0.5 AS fy FROM flat),
q AS (SELECT p.*, greatest(0, least(1, floor(fx) + dx)) AS tx, greatest(0, least(1, floor(fy) + dy)) AS ty,
  (CASE dx WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE dy WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS part FROM p, range(2) a(dx), range(2) b(dy))
SELECT q.vec_id, q.x, q.y, CAST(floor(round(sum(part * level), 6) + 0.5) AS INT) AS v FROM q JOIN c ON c.vec_id = q.vec_id AND c.tx = q.tx AND c.ty = q.ty AND c.v = q.v GROUP BY ALL"""
)
def tile_equalisation(spark, sf_dir):
    """Equalisation of 8x8 images in four tiles, in which a level counts twice at most."""
    place = F.posexplode("px").alias("place", "v")
    px = grids(spark, sf_dir).select(F.col("vec_id").alias("image_id"), place).select("image_id", (F.col("place") % 8).alias("x"), F.floor(F.col("place") / 8).cast("int").alias("y"), "v")
    return P.equalise_tiles(px, 8, 8, (2, 2), 40.0).withColumnRenamed("image_id", "vec_id")


# --- degradations -----------------------------------------------------------------------------------------------------------

_QUALITY = "25 + (vec_id * 13) % 66"
_BASE = ", ".join(f"({u}, {x}, {math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.5) if u == 0 else 1.0) / 2!r}::DOUBLE)" for u in range(8) for x in range(8))
_STEPS = ", ".join(f"({i % 8}, {i // 8}, {t})" for i, t in enumerate(G.LUMINANCE))


@query(
    f"""WITH {FLAT_SQL}, b(u, x, c) AS (VALUES {_BASE}), s(u, w, t) AS (VALUES {_STEPS}),
k AS (SELECT vec_id, b.u, d.u AS w, sum((v - 128) * b.c * d.c) AS z FROM flat JOIN b ON b.x = flat.x JOIN b d ON d.x = flat.y GROUP BY ALL),
q AS (SELECT vec_id, {_QUALITY} AS quality, CASE WHEN {_QUALITY} < 50 THEN 5000 // ({_QUALITY}) ELSE 200 - 2 * ({_QUALITY}) END AS scale FROM embeddings),
r AS (SELECT k.vec_id, k.u, k.w, z, greatest(1, least(255, (t * scale + 50) // 100)) AS step FROM k JOIN q USING (vec_id) JOIN s ON s.u = k.u AND s.w = k.w),
e AS (SELECT vec_id, u, w, floor(round(z / step::DOUBLE, 6) + 0.5) * step AS z FROM r)
SELECT vec_id, any_value(quality) AS quality, array_to_string(list(v ORDER BY y, x), ',') AS px FROM (
  SELECT vec_id, quality, b.x, d.x AS y, CAST(greatest(0, least(255, floor(round(sum(z * b.c * d.c) + 128, 6) + 0.5))) AS INT) AS v FROM e JOIN q USING (vec_id) JOIN b ON b.u = e.u JOIN b d ON d.u = e.w GROUP BY ALL) GROUP BY vec_id"""
)
def cosine_steps(spark, sf_dir):
    """Blocks as they come back from a JPEG file of some quality."""
    quality = F.expr(_QUALITY)
    return grids(spark, sf_dir).select("vec_id", quality.alias("quality"), F.array_join(G.requantise(F.col("px"), quality).cast("array<string>"), ",").alias("px"))


@query(
    f"""SELECT vec_id, array_to_string(list_transform(px, lambda v, i: CAST(greatest(0, least(255, floor(round(v + (40 + vec_id % 80) *
  exp(-(pow((i - 1) % 8 - vec_id % 8, 2) + pow((i - 1) // 8 - vec_id % 5, 2)) / (2 * pow((2 + vec_id % 4) / 2.0::DOUBLE, 2))), 6) + 0.5))) AS INT)), ',') AS px FROM ({PX_SQL})"""
)
def glare_spots(spark, sf_dir):
    v = F.col("vec_id")
    lit = G.glare(F.col("px"), 8, v % 8, v % 5, 2 + v % 4, 40 + v % 80)
    return grids(spark, sf_dir).select("vec_id", F.array_join(lit.cast("array<string>"), ",").alias("px"))


@query(
    f"""WITH {FLAT_SQL}, m AS (SELECT vec_id, radians(vec_id % 7 - 3) AS a, (vec_id % 5 - 2) / 16.0::DOUBLE AS s FROM embeddings),
p AS (SELECT vec_id, x, y, round((cos(a) - s * sin(a)) * x + (sin(a) + s * cos(a)) * y + 0.25, 6) AS u, round(-sin(a) * x + cos(a) * y - 0.5, 6) AS w FROM m, range(8) i(x), range(8) j(y)),
c AS (SELECT p.*, floor(u) AS x0, floor(w) AS y0, dx, dy FROM p, range(2) i(dx), range(2) j(dy)),
g AS (SELECT c.vec_id, c.x, c.y, sum((CASE dx WHEN 1 THEN u - x0 ELSE 1 - (u - x0) END) * (CASE dy WHEN 1 THEN w - y0 ELSE 1 - (w - y0) END) * coalesce(f.v, 255)) AS v
  FROM c LEFT JOIN flat f ON f.vec_id = c.vec_id AND f.x = x0 + dx AND f.y = y0 + dy GROUP BY ALL)
SELECT vec_id, array_to_string(list(CAST(greatest(0, least(255, floor(round(v, 6) + 0.5))) AS INT) ORDER BY y, x), ',') AS px FROM g GROUP BY vec_id"""
)
def affine_lines(spark, sf_dir):
    """Images turned by some degrees, slanted and shifted."""
    a, s = F.radians((F.col("vec_id") % 7 - 3).cast("double")), (F.col("vec_id") % 5 - 2) / 16.0
    rows = grids(spark, sf_dir).withColumns({"a": a, "s": s})
    a, s = F.col("a"), F.col("s")
    m = [F.cos(a) - s * F.sin(a), F.sin(a) + s * F.cos(a), F.lit(0.25), -F.sin(a), F.cos(a), F.lit(-0.5)]
    return rows.select("vec_id", F.array_join(G.affine(F.col("px"), 8, 8, m).cast("array<string>"), ",").alias("px"))
