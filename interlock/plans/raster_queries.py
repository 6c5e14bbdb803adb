"""Queries of the image operators, with SQL: pictures are made from the rows of tables, one pixel a row.

Eight pictures: order ``k`` is a pixel of picture k % 8, at place k // 8 modulo their size, row by row; its price modulo 256 is the
brightness, and of orders on one pixel the first counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlock.operators import board
from interlock.operators.stats import grid_by_count
from interlock.plans.registry import Registry
from interlock.raster import kernels, plans
from interlock.session import read_table, staged

REGISTRY = Registry()
WIDE, HIGH, LIGHT, PICTURES = 48, 40, 140, 8

_PIXELS_SQL = f"""
WITH RECURSIVE px AS (SELECT (o_orderkey % {PICTURES})::INT AS n, (o_orderkey // {PICTURES} % {WIDE})::INT AS x, (o_orderkey // {PICTURES} // {WIDE} % {HIGH})::INT AS y, arg_min(floor(o_totalprice)::BIGINT % 256, o_orderkey) AS v FROM orders GROUP BY 1, 2, 3),
     g AS (SELECT n, x, y, coalesce(v, 0) AS v FROM (SELECT DISTINCT n FROM px) CROSS JOIN (SELECT range::INT AS x FROM range(0, {WIDE})) CROSS JOIN (SELECT range::INT AS y FROM range(0, {HIGH})) LEFT JOIN px USING (n, x, y)),
     m AS (SELECT n, x, y FROM g WHERE v > {LIGHT})"""
#: Parts of light pixels: the smallest place (y, then x) each can reach.
_PARTS_SQL = _PIXELS_SQL + f""",
     r(n, x, y, f) AS (SELECT n, x, y, y * {WIDE} + x FROM m UNION SELECT m.n, m.x, m.y, r.f FROM r JOIN m ON m.n = r.n AND abs(m.x - r.x) + abs(m.y - r.y) = 1 AND r.f < m.y * {WIDE} + m.x),
     l AS (SELECT n, x, y, min(f) AS f FROM r GROUP BY 1, 2, 3)"""


def pictures(spark: SparkSession, base: str) -> DataFrame:
    """(photo_id, height, width, n_channels, data): gray pictures of the orders."""
    o = read_table(spark, base, "orders")
    cell = (F.floor(F.col("o_orderkey") / PICTURES) % (WIDE * HIGH)).cast("int")
    px = o.groupBy((F.col("o_orderkey") % PICTURES).alias("n"), cell.alias("at")).agg(F.min_by(F.floor("o_totalprice") % 256, "o_orderkey").cast("int").alias("v"))
    lists = px.groupBy("n").agg(F.collect_list(F.struct("at", "v")).alias("p"))  # at most one entry a cell

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            out = []
            for n, cells in zip(d["n"], d["p"]):
                img = np.zeros(WIDE * HIGH, np.uint8)
                for s in cells:
                    img[s["at"]] = s["v"]
                out.append((str(n), HIGH, WIDE, 1, img.tobytes()))
            yield pd.DataFrame(out, columns=["photo_id", "height", "width", "n_channels", "data"])

    return lists.mapInPandas(run, "photo_id string, height int, width int, n_channels int, data binary")


def _each(images: DataFrame, f: Callable[[np.ndarray], list[tuple]], names: str) -> DataFrame:
    """Rows of numbers worked out of each picture."""
    columns = [n.split()[0] for n in names.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(int(r.photo_id), *row) for r in p.itertuples(index=False) for row in f(plans.pixels(r))], columns=["picture", *columns])

    return images.mapInPandas(run, f"picture long, {names}")


@REGISTRY.query(_PIXELS_SQL + f" SELECT n::BIGINT AS picture, sum((v > {LIGHT})::INT)::BIGINT AS n_light, round(avg((v > {LIGHT})::INT), 6) AS share FROM g GROUP BY 1")
def raster_threshold(spark: SparkSession, base: str) -> DataFrame:
    """Light pixels of each picture and their share."""
    return _each(pictures(spark, base), lambda g: [(int(kernels.threshold(g, LIGHT).sum()), round(kernels.white_share(g, LIGHT), 6))], "n_light long, share double")


@REGISTRY.query(_PIXELS_SQL + " SELECT n::BIGINT AS picture, v::BIGINT AS level, count(*) AS n_pixels FROM g GROUP BY 1, 2")
def raster_luminance(spark: SparkSession, base: str) -> DataFrame:
    """How many pixels of each picture have which brightness."""
    return _each(pictures(spark, base), lambda g: [(int(v), int(n)) for v, n in enumerate(kernels.luminance_counts(g)) if n], "level long, n_pixels long")


@REGISTRY.query(
    _PIXELS_SQL
    + """, w AS (SELECT *, lag(v) OVER (PARTITION BY n, y ORDER BY x) AS a, lead(v) OVER (PARTITION BY n, y ORDER BY x) AS b, lag(v) OVER (PARTITION BY n, x ORDER BY y) AS c, lead(v) OVER (PARTITION BY n, x ORDER BY y) AS d FROM g)
 SELECT n::BIGINT AS picture, round(greatest(0, least(100, var_pop(a + b + c + d - 4 * v) / 10)), 4) AS blur, round(avg(v), 4) AS brightness, round(stddev_pop(v) / 1.28::DOUBLE, 4) AS contrast FROM w GROUP BY 1"""
)
def raster_quality(spark: SparkSession, base: str) -> DataFrame:
    """Sharpness, brightness and contrast of each picture."""
    return _each(pictures(spark, base), lambda g: [tuple(round(kernels.quality(g)[c], 4) for c in ("blur", "brightness", "contrast"))], "blur double, brightness double, contrast double")


@REGISTRY.query(_PARTS_SQL + " SELECT n::BIGINT AS picture, f::BIGINT AS first_at, count(*) AS area FROM l GROUP BY 1, 2")
def raster_components(spark: SparkSession, base: str) -> DataFrame:
    """Every connected part of light pixels, by its first pixel, with its area."""

    def parts(g: np.ndarray) -> list[tuple]:
        labels, n = kernels.components(kernels.threshold(g, LIGHT))
        flat = labels.ravel()
        first = np.unique(flat, return_index=True)[1]
        return [(int(a), int(c)) for a, c, k in zip(first, np.bincount(flat, minlength=n + 1), range(n + 1)) if k]

    return _each(pictures(spark, base), parts, "first_at long, area long")


@REGISTRY.query(
    _PARTS_SQL
    + f""", i AS (SELECT n, f, count(*) AS area, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM l GROUP BY 1, 2)
 SELECT n::BIGINT AS picture, (x1 - 1)::BIGINT AS origin_x, (y1 - 1)::BIGINT AS origin_y, (x2 - x1 + 3)::BIGINT AS width, (y2 - y1 + 3)::BIGINT AS height, area, NOT (x1 = 0 OR y1 = 0 OR x2 = {WIDE - 1} OR y2 = {HIGH - 1}) AS is_complete FROM i WHERE area >= 4"""
)
def raster_islands(spark: SparkSession, base: str) -> DataFrame:
    """Parts of four or more light pixels cut out with a margin, and whether they are whole."""
    found = lambda g: [(o[0], o[1], c.shape[1], c.shape[0], a, not t) for c, o, a, t in kernels.islands(kernels.threshold(g, LIGHT), 4, ignore_border=False)]
    return _each(pictures(spark, base), found, "origin_x long, origin_y long, width long, height long, area long, is_complete boolean")


@REGISTRY.query(
    _PARTS_SQL
    + f""", k AS (SELECT n, f FROM l GROUP BY 1, 2 HAVING count(*) >= 4), t AS (SELECT n FROM g GROUP BY 1)
 SELECT t.n::BIGINT AS picture, (SELECT count(*) FROM l JOIN k USING (n, f) WHERE l.n = t.n) AS n_left FROM t"""
)
def raster_without_small(spark: SparkSession, base: str) -> DataFrame:
    """Light pixels left when parts of fewer than four are dropped."""
    return _each(pictures(spark, base), lambda g: [(int(kernels.without_small(kernels.threshold(g, LIGHT), 4).sum()),)], "n_left long")


@REGISTRY.query(
    _PIXELS_SQL
    + f""", d AS (SELECT n, x, y FROM g WHERE v <= {LIGHT}),
     o(n, x, y) AS (SELECT n, x, y FROM d WHERE x IN (0, {WIDE - 1}) OR y IN (0, {HIGH - 1}) UNION SELECT d.n, d.x, d.y FROM o JOIN d ON d.n = o.n AND abs(d.x - o.x) + abs(d.y - o.y) = 1)
 SELECT g.n::BIGINT AS picture, count(*) - count(o.x) AS n_filled FROM g LEFT JOIN o USING (n, x, y) GROUP BY 1"""
)
def raster_filled(spark: SparkSession, base: str) -> DataFrame:
    """Light pixels once dark holes that no path leads out of are filled."""
    return _each(pictures(spark, base), lambda g: [(int(kernels.filled(kernels.threshold(g, LIGHT)).sum()),)], "n_filled long")


@REGISTRY.query(
    _PIXELS_SQL
    + f""", e AS (SELECT m.n, m.x, m.y, (SELECT count(*) FROM m q WHERE q.n = m.n AND abs(q.x - m.x) <= 1 AND abs(q.y - m.y) <= 1) AS k FROM m),
     s AS (SELECT DISTINCT m.n, m.x + i AS x, m.y + j AS y FROM m, (SELECT range - 1 AS i FROM range(0, 3)), (SELECT range - 1 AS j FROM range(0, 3)))
 SELECT t.n::BIGINT AS picture, (SELECT count(*) FROM e WHERE e.n = t.n AND k = 4 + 2 * ((x NOT IN (0, {WIDE - 1}))::INT + (y NOT IN (0, {HIGH - 1}))::INT) + ((x NOT IN (0, {WIDE - 1})) AND (y NOT IN (0, {HIGH - 1})))::INT) AS n_eroded,
   (SELECT count(*) FROM s WHERE s.n = t.n AND x BETWEEN 0 AND {WIDE - 1} AND y BETWEEN 0 AND {HIGH - 1}) AS n_dilated FROM (SELECT DISTINCT n FROM g) t"""
)
def raster_morphology(spark: SparkSession, base: str) -> DataFrame:
    """Light pixels left by an erosion with a square of three, and there after a dilation."""
    both = lambda g: [tuple(int(f(kernels.threshold(g, LIGHT), 3).sum()) for f in (kernels.eroded, kernels.dilated))]
    return _each(pictures(spark, base), both, "n_eroded long, n_dilated long")


@REGISTRY.query(_PIXELS_SQL + f" SELECT n::BIGINT AS picture, {62 + HIGH * ((WIDE + 31) // 32 * 4)}::BIGINT AS n_bytes, sum((v > {LIGHT})::INT)::BIGINT AS n_light, sum((v > {LIGHT})::INT * (y * {WIDE} + x))::BIGINT AS places FROM g GROUP BY 1")
def raster_bitmap(spark: SparkSession, base: str) -> DataFrame:
    """Each mask written as a bitmap file and read again: its size, its light pixels and the sum of their places."""

    def there_and_back(g: np.ndarray) -> list[tuple]:
        data = kernels.write_bmp(kernels.threshold(g, LIGHT))
        at = np.flatnonzero(kernels.read_bmp(data))
        return [(len(data), len(at), int(at.sum()))]

    return _each(pictures(spark, base), there_and_back, "n_bytes long, n_light long, places long")


@REGISTRY.query(
    _PIXELS_SQL
    + f""", tr AS (SELECT n, y AS x, x AS y, v FROM g) SELECT n::BIGINT AS picture, {WIDE}::BIGINT AS height, {HIGH}::BIGINT AS width, sum(v * (y * {HIGH} + ({HIGH - 1} - x)))::BIGINT AS places FROM tr GROUP BY 1"""
)
def raster_upright(spark: SparkSession, base: str) -> DataFrame:
    """Pictures with orientation tag 6 turned upright: their new size and the sum of brightness times place."""
    images = pictures(spark, base)
    turned = plans.upright(images, images.select("photo_id", F.lit(6).alias("orientation")))
    return _each(turned, lambda g: [(g.shape[0], g.shape[1], int((g.ravel().astype(np.int64) * np.arange(g.size)).sum()))], "height long, width long, places long")


@REGISTRY.query(
    """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), g AS (SELECT w::INT AS w, h::INT AS h FROM range(1, 401) a(w), range(1, 401) b(h) WHERE w >= h),
 s AS (SELECT c_nationkey, w, h, round(w - h + 0.1 * (w * h - n), 6) AS s FROM c JOIN g ON w * h >= n AND w * h <= 4 * n + 4),
 z AS (SELECT c_nationkey, w, h FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY s, w, h) AS k FROM s) WHERE k = 1)
SELECT c_nationkey::BIGINT AS board_id, (w * h)::BIGINT AS n_placed, (2 * w * h - w - h)::BIGINT AS n_true, true AS complete FROM z WHERE w > 1 AND h > 1"""
)
def board_answer(spark: SparkSession, base: str) -> DataFrame:
    """Generated boards solved from their fits: pieces placed, and how many neighbours on the board are true neighbours of the puzzle.

    The generator knows the answer; the search sees true and false fits alike.
    """
    c = read_table(spark, base, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    grids = grid_by_count(spark, c, "n").select(F.col("c_nationkey").cast("long").alias("board_id"), "width", "height").where("width > 1 and height > 1")

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        k, w, h = (int(pdf[c].iloc[0]) for c in ("board_id", "width", "height"))
        fits, answer = board.generated_puzzle(w, h, k)
        at = {(x, y): p for p, x, y, _ in answer}
        true = {(p, at.get((x + dx, y + dy))) for (x, y), p in at.items() for dx, dy in board.STEPS}
        return pd.DataFrame([(k, *f, (f[0], f[2]) in true) for f in fits], columns=["board_id", "piece_id", "side", "other_piece", "other_side", "err", "truly"])

    fits = staged(board.spread(grids, "board_id").groupBy("board_id").applyInPandas(make, "board_id long, piece_id long, side int, other_piece long, other_side int, err double, truly boolean"), "puzzles")
    placed = staged(board.solve_boards(fits.select("board_id", "piece_id").distinct(), fits.drop("truly"), grids), "boards")
    beside = placed.select("board_id", F.col("piece_id").alias("other_piece"), F.explode(F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y")) for dx, dy in ((1, 0), (0, 1))])).alias("c"))
    pairs = placed.join(beside.select("board_id", "other_piece", "c.x", "c.y"), ["board_id", "x", "y"]).select("board_id", "piece_id", "other_piece")
    right = pairs.join(fits.where("truly").select("board_id", "piece_id", "other_piece").distinct(), ["board_id", "piece_id", "other_piece"], "left_semi").groupBy("board_id").agg(F.count(F.lit(1)).alias("n_true"))
    whole = placed.groupBy("board_id").agg(F.count(F.lit(1)).alias("n_placed"), F.min(F.col("complete").cast("int")).cast("boolean").alias("complete"))
    return whole.join(right, "board_id").select("board_id", "n_placed", "n_true", "complete")
