"""Queries of the llm problems, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlock.llm.components import view_groups
from interlock.llm.history import repeats
from interlock.llm.mixing import mix, shares
from interlock.llm.neighbours import nearest_sides
from interlock.llm.personal import personal_spans, redact
from interlock.llm.survivor import fused_groups, fused_views, most_central, view_sources
from interlock.llm.tokens import encode
from interlock.llm.topn import top_n_per_group
from interlock.operators.pieces import usable_ids, usable_pieces
from interlock.plans.registry import Registry
from interlock.session import read_table, staged

REGISTRY = Registry()
#: Value of err that marks a partner without fit.
NO_FIT = 1000000

GROUPS_SQL = """
WITH RECURSIVE u AS (SELECT piece_id FROM sides WHERE len(vertices) >= 2 AND piece_center IS NOT NULL AND side_index BETWEEN 0 AND 3 AND piece_id IS NOT NULL
                     GROUP BY piece_id HAVING count(DISTINCT side_index) = 4),
     m AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max({'t': checked_at, 'c': confirmed}) AS r FROM pair_meta WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
     l AS (SELECT a, b FROM m WHERE r.c AND a <> b AND a IN (SELECT piece_id FROM u) AND b IN (SELECT piece_id FROM u)),
     e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
     reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
     g AS (SELECT a AS piece_id, least(a, min(b)) AS group_id FROM reach GROUP BY a)
"""


@REGISTRY.query(
    f"""
SELECT piece_id, side, CAST(rank_no AS INTEGER) AS rank_no, other_piece, other_side FROM (
  SELECT *, row_number() OVER (PARTITION BY piece_id, side ORDER BY err, other_piece, other_side) AS rank_no FROM (
    SELECT piece_id, side, other_piece, other_side, min(err) AS err FROM fits
    WHERE err IS NOT NULL AND other_piece IS NOT NULL AND other_side IS NOT NULL AND err <> {NO_FIT} AND other_piece <> piece_id GROUP BY 1, 2, 3, 4))
WHERE rank_no <= 5
"""
)
def p1_found(spark: SparkSession, base: str) -> DataFrame:
    """The five best partners of every side."""
    fits = read_table(spark, base, "fits")
    rows = fits.where((fits.err != NO_FIT) & (fits.other_piece != fits.piece_id))
    return top_n_per_group(rows, ["piece_id", "side"], ["other_piece", "other_side"], "err", 5).drop("err")


#: Side vectors by the definition: 27 points at equal length along the line, first at the origin, last at (1, 0).
_VECTORS_SQL = """
WITH s0 AS (SELECT piece_id, side_index, any_value(vertices) AS v, any_value(batch_id) AS batch_id, any_value(is_edge) AS is_edge FROM sides
            WHERE len(vertices) >= 2 AND piece_center IS NOT NULL AND piece_id IS NOT NULL AND side_index BETWEEN 0 AND 3 GROUP BY 1, 2),
     ok AS (SELECT piece_id FROM s0 GROUP BY 1 HAVING count(*) = 4),
     pt AS (SELECT piece_id, side_index, unnest(v) AS q, generate_subscripts(v, 1) AS i, len(v) AS n FROM s0 JOIN ok USING (piece_id)),
     st AS (SELECT piece_id, side_index, i, n, q[1]::DOUBLE AS x, q[2]::DOUBLE AS y, lead(q[1]::DOUBLE) OVER w AS nx, lead(q[2]::DOUBLE) OVER w AS ny,
                   coalesce(sqrt(pow(q[1] - lag(q[1]) OVER w, 2) + pow(q[2] - lag(q[2]) OVER w, 2)), 0) AS seg FROM pt WINDOW w AS (PARTITION BY piece_id, side_index ORDER BY i)),
     cum AS (SELECT *, sum(seg) OVER (PARTITION BY piece_id, side_index ORDER BY i ROWS UNBOUNDED PRECEDING) AS walked FROM st),
     tot AS (SELECT piece_id, side_index, max(walked) AS total, any_value(n) AS n FROM cum GROUP BY 1, 2),
     goal AS (SELECT piece_id, side_index, n, k, total * k / 26.0 AS at FROM tot, range(0, 27) AS r(k)),
     seat AS (SELECT g.piece_id, g.side_index, g.k, g.at, least(max(c.i), g.n - 1) AS i FROM goal g JOIN cum c ON g.piece_id = c.piece_id AND g.side_index = c.side_index AND c.walked <= g.at GROUP BY g.piece_id, g.side_index, g.k, g.at, g.n),
     rs AS (SELECT t.piece_id, t.side_index, t.k, c.x + CASE WHEN sg = 0 THEN 0 ELSE least(t.at - c.walked, sg) / sg * (c.nx - c.x) END AS x, c.y + CASE WHEN sg = 0 THEN 0 ELSE least(t.at - c.walked, sg) / sg * (c.ny - c.y) END AS y
            FROM seat t JOIN (SELECT *, sqrt(pow(nx - x, 2) + pow(ny - y, 2)) AS sg FROM cum) c ON t.piece_id = c.piece_id AND t.side_index = c.side_index AND t.i = c.i),
     e AS (SELECT piece_id, side_index, max(x) FILTER (k = 0) AS ox, max(y) FILTER (k = 0) AS oy, max(x) FILTER (k = 26) - max(x) FILTER (k = 0) AS cx, max(y) FILTER (k = 26) - max(y) FILTER (k = 0) AS cy FROM rs GROUP BY 1, 2),
     vec AS (SELECT piece_id, side_index, (list(((x - ox) * cx + (y - oy) * cy) / (cx * cx + cy * cy) ORDER BY k) || list(((y - oy) * cx - (x - ox) * cy) / (cx * cx + cy * cy) ORDER BY k))::DOUBLE[54] AS w
             FROM rs JOIN e USING (piece_id, side_index) WHERE cx * cx + cy * cy > 0 GROUP BY 1, 2),
     side AS (SELECT v.piece_id, v.side_index, w, batch_id, is_edge FROM vec v JOIN s0 USING (piece_id, side_index))
"""
_LINKS_SQL = (
    _VECTORS_SQL
    + """,
     near AS (SELECT a.piece_id AS x, b.piece_id AS y, (a.side_index - b.side_index + 4) % 4 AS shift, a.batch_id AS bx, b.batch_id AS yb FROM side a JOIN side b
              ON a.batch_id > b.batch_id AND abs(a.w[41] - b.w[41]) <= 0.0600005 AND abs(a.w[34] - b.w[34]) <= 0.0600005 WHERE round(array_distance(a.w, b.w), 6) <= 0.06),
     l AS (SELECT DISTINCT x, y, yb FROM (SELECT x, y, yb, shift, count(*) AS n FROM near GROUP BY ALL) WHERE n = 4),
     c0 AS (SELECT NULL::BIGINT AS x WHERE false)"""
)
#: A piece is a case if a link leads to a piece that is none; worked out again from the last round, more rounds than any chain is long.
_ROUNDS = 24
_CASES_SQL = _LINKS_SQL + "".join(f",\n     c{k} AS MATERIALIZED (SELECT DISTINCT x FROM l WHERE y NOT IN (SELECT x FROM c{k - 1}))" for k in range(1, _ROUNDS + 1)) + f"""
SELECT least(x, y) AS piece_a, greatest(x, y) AS piece_b FROM (SELECT x, min({{'b': yb, 'y': y}}).y AS y FROM l WHERE y NOT IN (SELECT x FROM c{_ROUNDS}) GROUP BY x)
"""


@REGISTRY.query(_CASES_SQL)
def p2_deliveries(spark: SparkSession, base: str) -> DataFrame:
    """The same as ``p2_found``, from six deliveries into one history: each reads only the partitions its own pieces can be in."""
    pieces = staged(usable_pieces(read_table(spark, base, "sides")), "pieces")
    found = repeats(pieces, deliveries=6)
    return found.select(F.least("x", "y").alias("piece_a"), F.greatest("x", "y").alias("piece_b"))


@REGISTRY.query(_CASES_SQL)
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Each piece that repeats an accepted piece of an earlier batch, with that piece."""
    pieces = staged(usable_pieces(read_table(spark, base, "sides")), "pieces")
    found = repeats(pieces)
    return found.select(F.least("x", "y").alias("piece_a"), F.greatest("x", "y").alias("piece_b"))


def _groups(spark: SparkSession, base: str) -> DataFrame:
    return view_groups(read_table(spark, base, "pair_meta"), usable_ids(read_table(spark, base, "sides")))


@REGISTRY.query(GROUPS_SQL + "SELECT piece_id, group_id FROM g")
def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """One group id for all views linked by confirmed decisions."""
    return _groups(spark, base)


@REGISTRY.query(
    GROUPS_SQL
    + """,
     c AS (SELECT piece_id, max({'t': ingested_at, 'v': photo_space_centroid}) FILTER (photo_space_centroid IS NOT NULL) AS c,
                  max({'t': ingested_at, 'v': photo_width}) FILTER (photo_width IS NOT NULL) AS w,
                  max({'t': ingested_at, 'v': photo_height}) FILTER (photo_height IS NOT NULL) AS h FROM sides GROUP BY piece_id),
     d AS (SELECT group_id, piece_id, sqrt(pow(c.v[1] - w.v / 2.0, 2) + pow(c.v[2] - h.v / 2.0, 2)) AS off FROM g JOIN c USING (piece_id))
SELECT group_id, piece_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY off, piece_id) AS n FROM d WHERE off IS NOT NULL) WHERE n = 1
"""
)
def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """The view of each group nearest to the middle of its photo."""
    groups = staged(_groups(spark, base), "groups")
    return most_central(fused_views(read_table(spark, base, "sides"), groups))


@REGISTRY.query()
def p5_fused(spark: SparkSession, base: str) -> DataFrame:
    """Centroid, photo width and height of each group, by truth discovery among its views."""
    groups = staged(_groups(spark, base), "groups")
    sides = read_table(spark, base, "sides")
    return fused_groups(fused_views(sides, groups), view_sources(sides.join(groups.select("piece_id"), "piece_id", "left_semi")))


@REGISTRY.query(
    _VECTORS_SQL
    + """,
     q AS (SELECT * FROM side WHERE NOT is_edge),
     d AS (SELECT a.piece_id, a.side_index, b.piece_id AS near_piece_id, b.side_index AS near_side_index, round(array_distance(a.w, b.w), 6) AS d FROM q a JOIN q b
           ON a.piece_id <> b.piece_id AND abs(a.w[41] - b.w[41]) <= 0.0600005 AND abs(a.w[34] - b.w[34]) <= 0.0600005)
SELECT piece_id, side_index, near_piece_id, near_side_index FROM (SELECT *, row_number() OVER (PARTITION BY piece_id, side_index ORDER BY d, near_piece_id, near_side_index) AS n FROM d WHERE d <= 0.06) WHERE n <= 5
"""
)
def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Up to five sides of other pieces with the most similar outline, for every side that is no edge."""
    return nearest_sides(read_table(spark, base, "sides")).drop("distance")


@REGISTRY.query()
def p8_ids(spark: SparkSession, base: str) -> DataFrame:
    """The token ids of every text."""
    return encode(read_table(spark, base, "documents"))


@REGISTRY.query()
def p9_mix(spark: SparkSession, base: str) -> DataFrame:
    """The texts drawn so that every source comes near its target share of all tokens."""
    return mix(read_table(spark, base, "documents"), read_table(spark, base, "mix_targets"))[0]


@REGISTRY.query()
def p9_shares(spark: SparkSession, base: str) -> DataFrame:
    """The share of all drawn tokens that each target source reached."""
    return shares(read_table(spark, base, "documents"), read_table(spark, base, "mix_targets"))


@REGISTRY.query()
def p10_found(spark: SparkSession, base: str) -> DataFrame:
    """Each personal detail in the texts, by its kind and first place."""
    return personal_spans(read_table(spark, base, "documents"), read_table(spark, base, "contributors")).drop("end_pos")


@REGISTRY.query()
def p10_redacted(spark: SparkSession, base: str) -> DataFrame:
    """The texts with personal details replaced by marks of their kind."""
    return redact(read_table(spark, base, "documents"), read_table(spark, base, "contributors"))
