"""Queries on the geometry of sides, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlock.functions import geom
from interlock.operators import match, sides
from interlock.plans.registry import Registry
from interlock.session import read_table, staged

REGISTRY = Registry()
#: Limits fitted to these tables; the defaults of ``Conf`` would let nearly every pair through.
FIT_MAX, FLAT_MAX = 0.8, 20.0

SIDES_SQL = """
WITH s0 AS (SELECT piece_id, side_index, any_value(vertices) AS v, any_value(piece_center) AS pc, any_value(is_edge) AS is_edge
            FROM sides WHERE len(vertices) >= 2 AND piece_center IS NOT NULL AND piece_id IS NOT NULL AND side_index BETWEEN 0 AND 3 GROUP BY 1, 2),
     ok AS (SELECT piece_id FROM s0 GROUP BY 1 HAVING count(*) = 4),
     s AS (SELECT s0.*, v[1][1]::DOUBLE AS x1, v[1][2]::DOUBLE AS y1, v[len(v)][1]::DOUBLE AS x2, v[len(v)][2]::DOUBLE AS y2, len(v) AS n FROM s0 JOIN ok USING (piece_id)),
     p AS (SELECT piece_id, side_index, is_edge, n, x1, y1, x2, y2, unnest(v) AS q, generate_subscripts(v, 1) AS i FROM s),
     pt AS (SELECT * EXCLUDE (q), q[1]::DOUBLE AS x, q[2]::DOUBLE AS y FROM p),
     st AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny, sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS chord FROM pt WINDOW w AS (PARTITION BY piece_id, side_index ORDER BY i)),
     o AS (SELECT *, CASE WHEN chord = 0 THEN sqrt(pow(x - x1, 2) + pow(y - y1, 2)) ELSE ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / chord END AS off, coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)), 0) AS seg FROM st)
"""
_POINTS_SQL = """,
     cum AS (SELECT *, sum(seg) OVER (PARTITION BY piece_id, side_index ORDER BY i ROWS UNBOUNDED PRECEDING) AS walked FROM o),
     tot AS (SELECT piece_id, side_index, max(walked) AS total, any_value(n) AS n FROM cum GROUP BY 1, 2),
     goal AS (SELECT piece_id, side_index, n, total, k, total * k / {k}.0 AS at FROM tot, range(0, {k} + 1) AS r(k)),
     seat AS (SELECT g.piece_id, g.side_index, g.k, g.at, g.total, least(max(c.i), g.n - 1) AS i FROM goal g JOIN cum c ON g.piece_id = c.piece_id AND g.side_index = c.side_index AND c.walked <= g.at GROUP BY g.piece_id, g.side_index, g.k, g.at, g.total, g.n),
     rs AS (SELECT t.piece_id, t.side_index, t.k, t.total, c.is_edge, c.x1, c.y1, c.x2, c.y2, c.chord, CASE WHEN sg = 0 THEN c.x ELSE c.x + least(t.at - c.walked, sg) / sg * (c.nx - c.x) END AS x, CASE WHEN sg = 0 THEN c.y ELSE c.y + least(t.at - c.walked, sg) / sg * (c.ny - c.y) END AS y
            FROM seat t JOIN (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS sg FROM cum) c ON t.piece_id = c.piece_id AND t.side_index = c.side_index AND t.i = c.i)
"""


def _sides(spark: SparkSession, base: str) -> DataFrame:
    return sides.distinct_sides(read_table(spark, base, "sides"))


def _round(df: DataFrame, *cols: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in cols})


@REGISTRY.query(
    SIDES_SQL
    + """SELECT piece_id, side_index, round(any_value(chord), 4) AS chord_len, round(atan2(any_value(y2 - y1), any_value(x2 - x1)), 4) AS direction, round(sum(seg), 4) AS arc_len,
 min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, round(avg(abs(off)), 4) AS mean_offset, round(stddev_pop(abs(off)), 4) AS offset_spread FROM o GROUP BY 1, 2"""
)
def side_metrics(spark: SparkSession, base: str) -> DataFrame:
    return _round(sides.metrics(_sides(spark, base)), "chord_len", "direction", "arc_len", "mean_offset", "offset_spread")


@REGISTRY.query(
    SIDES_SQL
    + f""", f AS (SELECT piece_id, side_index, stddev_pop(abs(off)) < {FLAT_MAX} AS is_flat FROM o GROUP BY 1, 2),
 g AS (SELECT piece_id, sum(is_flat::INT) AS n_flat, sum(CASE WHEN is_flat THEN 1 << side_index ELSE 0 END) AS m FROM f GROUP BY 1)
SELECT piece_id, side_index, is_flat, n_flat::BIGINT AS n_flat, CASE WHEN n_flat > 2 THEN 'more than two edges' WHEN m IN (5, 10) THEN 'opposite edges' END AS reject_reason FROM f JOIN g USING (piece_id)"""
)
def edge_class(spark: SparkSession, base: str) -> DataFrame:
    return sides.edge_class(_sides(spark, base), FLAT_MAX)


@REGISTRY.query(
    SIDES_SQL
    + """, m AS (SELECT is_edge, avg(abs(off)) AS mean, max(abs(off)) AS max, stddev_pop(abs(off)) AS sd, pow(stddev_pop(abs(off)), 2) AS var FROM o GROUP BY piece_id, side_index, is_edge),
 l AS (SELECT is_edge, 'mean' AS measure, mean AS value FROM m UNION ALL SELECT is_edge, 'max', max FROM m UNION ALL SELECT is_edge, 'sd', sd FROM m UNION ALL SELECT is_edge, 'var', var FROM m),
 e AS (SELECT measure, max(value) FILTER (is_edge) AS flat_max, min(value) FILTER (NOT is_edge) AS other_min FROM l GROUP BY 1)
SELECT measure, round(any_value(flat_max), 4) AS flat_max, round(any_value(other_min), 4) AS other_min, any_value(other_min / flat_max) > 1 AS clean, sum((value >= other_min AND value <= flat_max)::INT)::BIGINT AS n_overlap FROM l JOIN e USING (measure) GROUP BY 1"""
)
def edge_separation(spark: SparkSession, base: str) -> DataFrame:
    return _round(sides.edge_separation(_sides(spark, base)), "flat_max", "other_min")


@REGISTRY.query(SIDES_SQL + _POINTS_SQL.format(k=26) + "SELECT piece_id, side_index, list(round(x, 3) ORDER BY k) AS xs, list(round(y, 3) ORDER BY k) AS ys FROM rs GROUP BY 1, 2")
def side_resample(spark: SparkSession, base: str) -> DataFrame:
    p = _sides(spark, base).select("piece_id", "side_index", geom.resample(F.col("vertices"), 26).alias("p"))
    return p.select("piece_id", "side_index", *[F.transform(F.transform("p", geom.field(k)), lambda v: F.round(v, 3)).alias(n) for k, n in ((0, "xs"), (1, "ys"))])


@REGISTRY.query(
    SIDES_SQL
    + _POINTS_SQL.format(k=49)
    + """, pr AS (SELECT piece_id, side_index, k, CASE WHEN chord < 1 THEN 0 ELSE ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / chord / chord END AS f FROM rs)
SELECT a.piece_id, round(sqrt(avg(pow(a.f - b.f, 2))), 4) AS rmse_02, round(sqrt(avg(pow(c.f - d.f, 2))), 4) AS rmse_13
FROM pr a JOIN pr b ON a.piece_id = b.piece_id AND a.k = b.k AND a.side_index = 0 AND b.side_index = 2 JOIN pr c ON c.piece_id = a.piece_id AND c.k = a.k AND c.side_index = 1 JOIN pr d ON d.piece_id = a.piece_id AND d.k = a.k AND d.side_index = 3 GROUP BY 1"""
)
def side_profile_rmse(spark: SparkSession, base: str) -> DataFrame:
    """Profile errors of opposite sides of each piece."""
    r = sides.piece_rows(_sides(spark, base))
    g = lambda k: F.get("profile", k)
    return _round(r.select("piece_id", sides.profile_error(g(0), g(2)).alias("rmse_02"), sides.profile_error(g(1), g(3)).alias("rmse_13")), "rmse_02", "rmse_13")


@REGISTRY.query(
    SIDES_SQL
    + """, a AS (SELECT piece_id, side_index, atan2(y - py, x - px) AS d, seg AS w FROM o WHERE px IS NOT NULL),
 m AS (SELECT piece_id, side_index, atan2(sum(sin(d)), sum(cos(d))) AS m, atan2(sum(w * sin(d)), sum(w * cos(d))) AS wm FROM a GROUP BY 1, 2),
 dv AS (SELECT a.*, m, wm, atan2(sin(d - m), cos(d - m)) AS e, atan2(sin(d - wm), cos(d - wm)) AS we FROM a JOIN m USING (piece_id, side_index))
SELECT piece_id, side_index, round(any_value(m), 4) AS mean_dir, round(any_value(wm), 4) AS weighted_dir, round(stddev_pop(e), 4) AS dir_spread,
 round(sqrt(sum(w * we * we) / sum(w) - pow(sum(w * we) / sum(w), 2)), 4) AS weighted_spread FROM dv GROUP BY 1, 2"""
)
def circular_stats(spark: SparkSession, base: str) -> DataFrame:
    """(Weighted) circular mean and spread of each side's segment directions."""
    p = _sides(spark, base).withColumn("p", geom.pairs(F.col("vertices")))
    p = p.withColumn("d", F.transform("p", lambda s: geom.angle(s["a"], s["b"]))).withColumn("w", F.transform("p", lambda s: geom.distance(s["a"], s["b"])))
    d, w = F.col("d"), F.col("w")
    out = p.select("piece_id", "side_index", geom.mean_angle(d).alias("mean_dir"), geom.mean_angle(d, w).alias("weighted_dir"), geom.angle_spread(d).alias("dir_spread"), geom.angle_spread(d, w).alias("weighted_spread"))
    return _round(out, "mean_dir", "weighted_dir", "dir_spread", "weighted_spread")


@REGISTRY.query(
    SIDES_SQL
    + """, a AS (SELECT piece_id, side_index, i - 1 AS j, n, atan2(y - py, x - px) AS d, seg FROM o WHERE px IS NOT NULL),
 b AS (SELECT *, coalesce(lead(d, 2) OVER w, last_value(d) OVER (PARTITION BY piece_id, side_index ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS d2 FROM a WINDOW w AS (PARTITION BY piece_id, side_index ORDER BY j)),
 c AS (SELECT piece_id, side_index, j, n, CASE WHEN least(j + 2, n - 1) = j THEN 1.0 ELSE pow(greatest(0.0, 1 - least(abs((d2 + 2*pi()) % (2*pi()) - (d + 2*pi()) % (2*pi())), 2*pi() - abs((d2 + 2*pi()) % (2*pi()) - (d + 2*pi()) % (2*pi()))) / (pi() / 3)), 6) END AS r FROM b
       UNION ALL SELECT piece_id, side_index, n, n, 1.0 FROM s),
 c1 AS (SELECT *, CASE WHEN j = 1 OR j = n THEN r ELSE 0.25 * lag(r) OVER w + 0.5 * r + 0.25 * lead(r) OVER w END AS r1 FROM c WINDOW w AS (PARTITION BY piece_id, side_index ORDER BY j)),
 c2 AS (SELECT *, CASE WHEN j = 1 OR j = n THEN r1 ELSE 0.25 * lag(r1) OVER w + 0.5 * r1 + 0.25 * lead(r1) OVER w END AS r2 FROM c1 WINDOW w AS (PARTITION BY piece_id, side_index ORDER BY j)),
 ds AS (SELECT piece_id, side_index, i, CASE WHEN px IS NULL THEN ns WHEN nx IS NULL THEN seg ELSE (seg + ns) / 2 END AS reach FROM (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS ns FROM o))
SELECT c2.piece_id, c2.side_index, round(CASE WHEN any_value(n) < 3 THEN any_value(n) ELSE sum(r2 * reach) END, 3) AS straight_weight FROM c2 JOIN ds ON c2.piece_id = ds.piece_id AND c2.side_index = ds.side_index AND c2.j = ds.i GROUP BY 1, 2"""
)
def straightness(spark: SparkSession, base: str) -> DataFrame:
    """Total straightness weight of each side."""
    w = geom.straightness_weights(F.col("vertices"))
    return _sides(spark, base).select("piece_id", "side_index", F.round(F.aggregate(w, F.lit(0.0), lambda acc, v: acc + v), 3).alias("straight_weight"))


_TYPES_SQL = SIDES_SQL + """, ty AS (SELECT o.piece_id, o.side_index, CASE WHEN any_value(o.is_edge) OR any_value(o.n) < 3 OR any_value(chord) < 1 THEN 'F'
   WHEN avg(off) FILTER (i > floor(o.n / 4) AND i <= floor(3 * o.n / 4)) * any_value(((x2 - x1) * (pc[2] - y1) - (y2 - y1) * (pc[1] - x1)) / chord) < 0 THEN 'T' ELSE 'B' END AS t FROM o JOIN (SELECT piece_id, side_index, pc FROM s) c USING (piece_id, side_index) GROUP BY 1, 2),
 sg AS (SELECT piece_id, sum((t = 'F')::INT) AS n_flat, string_agg(t, '' ORDER BY side_index) AS w FROM ty GROUP BY 1),
 sig AS (SELECT piece_id, n_flat, least(w, w[2:] || w[1], w[3:] || w[1:2], w[4:] || w[1:3]) AS types FROM sg)
"""


@REGISTRY.query(_TYPES_SQL + "SELECT piece_id, n_flat::INTEGER AS n_flat, types FROM sig")
def piece_signature(spark: SparkSession, base: str) -> DataFrame:
    return sides.signatures(_sides(spark, base))


@REGISTRY.query(_TYPES_SQL + "SELECT n_flat::INTEGER AS n_flat, types, count(*) AS n_pieces, min(piece_id) AS first_piece FROM sig GROUP BY 1, 2")
def signature_groups(spark: SparkSession, base: str) -> DataFrame:
    """Pieces per signature."""
    return sides.signatures(_sides(spark, base)).groupBy("n_flat", "types").agg(F.count(F.lit(1)).alias("n_pieces"), F.min("piece_id").alias("first_piece"))


_NORMAL_SQL = SIDES_SQL + _POINTS_SQL.format(k=26) + """,
 ends AS (SELECT piece_id, side_index, max(x) FILTER (k = 0) AS ox, max(y) FILTER (k = 0) AS oy, max(x) FILTER (k = 26) AS ex, max(y) FILTER (k = 26) AS ey FROM rs GROUP BY 1, 2),
 rt AS (SELECT rs.piece_id, rs.side_index, k, total, is_edge, x - ox AS dx, y - oy AS dy, atan2(ey - oy, ex - ox) AS a FROM rs JOIN ends USING (piece_id, side_index)),
 nv AS (SELECT piece_id, side_index, k, total, is_edge, round_even(dx * cos(-a) - dy * sin(-a), 0)::INTEGER AS vx, round_even(dx * sin(-a) + dy * cos(-a), 0)::INTEGER AS vy,
               round_even(dx * cos(pi() - a) - dy * sin(pi() - a), 0)::INTEGER AS fx, round_even(dx * sin(pi() - a) + dy * cos(pi() - a), 0)::INTEGER AS fy FROM rt),
 nr AS (SELECT piece_id, side_index, any_value(total) AS arc_len, any_value(is_edge) AS is_edge, list(vx ORDER BY k) AS vx, list(vy ORDER BY k) AS vy, list(fx ORDER BY k DESC) AS fx0, list(fy ORDER BY k DESC) AS fy FROM nv GROUP BY 1, 2),
 ns AS (SELECT * EXCLUDE (fx0), list_transform(fx0, lambda q: q - list_min(fx0)) AS fx, sqrt(pow(vx[27] - vx[1], 2) + pow(vy[27] - vy[1], 2)) AS chord_len FROM nr)
"""


@REGISTRY.query(_NORMAL_SQL + "SELECT piece_id, side_index, round(arc_len, 4) AS arc_len, round(chord_len, 4) AS chord_len, vx, vy, fx, fy FROM ns")
def side_normal_form(spark: SparkSession, base: str) -> DataFrame:
    n = sides.normalised(_sides(spark, base))
    out = [F.transform(c, geom.field(k)).cast("array<int>").alias(a) for c, k, a in (("v", 0, "vx"), ("v", 1, "vy"), ("vf", 0, "fx"), ("vf", 1, "fy"))]
    return _round(n.select("piece_id", "side_index", "arc_len", "chord_len", *out), "arc_len", "chord_len")


_FITS_SQL = _NORMAL_SQL + f""",
 sd AS (SELECT *, list_sum(vy[1:9]) AS a1, list_sum(vy[10:18]) AS a2, list_sum(vy[19:27]) AS a3, list_sum(fy[1:9]) AS b1, list_sum(fy[10:18]) AS b2, list_sum(fy[19:27]) AS b3 FROM ns WHERE NOT is_edge AND chord_len > 0),
 pr AS (SELECT a.piece_id, a.side_index AS side, b.piece_id AS other_piece, b.side_index AS other_side, b.arc_len, list_transform(range(1, 28), lambda i: a.vx[i] - b.fx[i]) AS dx, list_transform(range(1, 28), lambda i: a.vy[i] - b.fy[i]) AS dy
        FROM sd a JOIN sd b ON a.piece_id <> b.piece_id AND a.chord_len BETWEEN b.chord_len * (1 - 0.081) AND b.chord_len * (1 + 0.081) AND abs(1 - a.chord_len / b.chord_len) <= 0.08
          AND abs(a.a1 - b.b1) + abs(a.a2 - b.b2) + abs(a.a3 - b.b3) <= {FIT_MAX} * b.arc_len + 135),
 sh AS (SELECT *, list_sum(list_transform(dx, lambda d: abs(d) - d)) / 27 AS ex, greatest(-5, least(5, list_sum(list_transform(dy, lambda d: abs(d) - d)) / 27)) AS ey FROM pr),
 er AS (SELECT piece_id, side, other_piece, other_side, least(list_sum(list_transform(dx, lambda d: abs(d))) + list_sum(list_transform(dy, lambda d: abs(d))), list_sum(list_transform(dx, lambda d: abs(d - ex))) + list_sum(list_transform(dy, lambda d: abs(d - ey)))) / arc_len AS err FROM sh),
 ft AS (SELECT * FROM er WHERE err <= {FIT_MAX})
"""


def _lines(spark: SparkSession, base: str) -> DataFrame:
    return staged(match.normal_lines(read_table(spark, base, "sides")), "lines")


def _fits(spark: SparkSession, base: str) -> DataFrame:
    return match.line_errors(_lines(spark, base), FIT_MAX)


@REGISTRY.query(_FITS_SQL + "SELECT piece_id, side, other_piece, other_side, round(err, 4) AS err FROM ft")
def fit_error_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Directed pairs of sides that fit, by the bounded-error self-join."""
    return _round(_fits(spark, base), "err")


@REGISTRY.query(_FITS_SQL + "SELECT piece_id, side, other_piece, other_side, round(err, 4) AS err FROM (SELECT *, min(err) OVER (PARTITION BY piece_id, side) AS best FROM ft) WHERE err <= 2 * best")
def fit_keep_best(spark: SparkSession, base: str) -> DataFrame:
    """Fits within twice the best of their side."""
    return _round(match.keep_best(_fits(spark, base), 2.0), "err")


@REGISTRY.query(_FITS_SQL + "SELECT piece_id, side_index AS side FROM ns WHERE NOT is_edge AND NOT EXISTS (SELECT 1 FROM ft WHERE ft.piece_id = ns.piece_id AND ft.side = ns.side_index)")
def orphan_sides(spark: SparkSession, base: str) -> DataFrame:
    """Sides without any fit."""
    return match.without_fit(_lines(spark, base), FIT_MAX)


@REGISTRY.query(
    _FITS_SQL
    + """, j AS (SELECT piece_id, side, list([other_piece, other_side, round_even(err * 1000, 0)::BIGINT] ORDER BY round_even(err * 1000, 0)::INT, other_piece, other_side) AS l FROM ft GROUP BY 1, 2)
SELECT piece_id, replace(to_json([coalesce(max(l) FILTER (side = 0), []), coalesce(max(l) FILTER (side = 1), []), coalesce(max(l) FILTER (side = 2), []), coalesce(max(l) FILTER (side = 3), [])])::VARCHAR, ' ', '') AS fits_json FROM j GROUP BY 1"""
)
def connectivity_json(spark: SparkSession, base: str) -> DataFrame:
    """The fits of each piece as nested lists, errors in thousandths."""
    return match.connectivity(_fits(spark, base))


_SAME_SQL = _TYPES_SQL + _POINTS_SQL.format(k=49) + """,
 pf AS (SELECT piece_id, side_index, any_value(is_edge) AS is_edge, any_value(chord) AS chord, list(CASE WHEN chord < 1 THEN 0 ELSE ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / chord / chord END ORDER BY k) AS f FROM rs GROUP BY 1, 2),
 pq AS (SELECT *, list_avg(f) AS lv FROM pf),
 sp AS (SELECT a.piece_id AS a, b.piece_id AS b, r.rot, x.side_index AS i, x.is_edge AND y.is_edge AS bt, CASE WHEN x.chord > 0 AND y.chord > 0 THEN least(x.chord, y.chord) / greatest(x.chord, y.chord) ELSE 1 END AS ratio,
               CASE WHEN abs(x.lv - y.lv) > 0.081 THEN 9.0 ELSE sqrt(list_sum(list_transform(range(1, 51), lambda k: pow(x.f[k] - y.f[k], 2))) / 50) END AS e
        FROM sig a JOIN sig b ON a.n_flat = b.n_flat AND a.types = b.types AND a.piece_id < b.piece_id, range(0, 4) AS r(rot), pq x, pq y WHERE x.piece_id = a.piece_id AND y.piece_id = b.piece_id AND y.side_index = (x.side_index + r.rot) % 4 {first}),
 sm AS (SELECT a, b, rot, sum(e) FILTER (NOT bt) AS t, count(*) FILTER (NOT bt) AS n, max(e) FILTER (NOT bt) AS worst, min(ratio) FILTER (NOT bt) AS low FROM sp GROUP BY 1, 2, 3),
 st1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY t, rot) AS z FROM sm WHERE n > 0 AND worst <= 0.025 AND low >= 0.85) WHERE z = 1),
 st2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY t, rot) AS z FROM sm WHERE n > 0 AND worst <= 0.08 AND low >= 0.65 AND (a, b) NOT IN (SELECT (a, b) FROM st1)) WHERE z = 1),
 cs AS (SELECT *, 1 AS stage FROM st1 UNION ALL SELECT *, 2 FROM st2)
"""
_SAME_SQL = _SAME_SQL.replace("{first}", "")


def _pieces(spark: SparkSession, base: str) -> DataFrame:
    return staged(sides.piece_rows(sides.distinct_sides(read_table(spark, base, "sides"), by_piece=True)), "pieces")


@REGISTRY.query(_SAME_SQL + "SELECT a, b, rot::INTEGER AS rot, round(t, 4) AS total_rmse, n::INTEGER AS n_matching FROM st1")
def dup_rotations(spark: SparkSession, base: str) -> DataFrame:
    """Pieces alike under one of four rotations, by the strict limits."""
    return _round(match.same_shape(_pieces(spark, base), 0.025, 0.85), "total_rmse")


@REGISTRY.query(_SAME_SQL + "SELECT a, b, stage, rot::INTEGER AS rot, round(t, 4) AS total_rmse, n::INTEGER AS n_matching FROM cs")
def dup_cascade(spark: SparkSession, base: str) -> DataFrame:
    """Strict matches, then relaxed ones of pairs without any."""
    return _round(match.cascade(_pieces(spark, base)), "total_rmse")
