"""Queries on matches, duplicates, boards and reports, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlock.conf import Conf
from interlock.operators import dedup, match, stats
from interlock.operators.pieces import bed_places, current_values
from interlock.plans.data_queries import PLACES_SQL
from interlock.plans.registry import Registry
from interlock.session import read_table

REGISTRY = Registry()
CONF = Conf()


def _meta(spark: SparkSession, base: str) -> DataFrame:
    m = read_table(spark, base, "pair_meta")
    return m.where(F.col("ncc").isNotNull() & (F.col("ncc") >= 0) & F.col("confirmed").isNotNull())


_META_SQL = "WITH m AS (SELECT * FROM pair_meta WHERE ncc IS NOT NULL AND ncc >= 0 AND confirmed IS NOT NULL) "


@REGISTRY.query(_META_SQL + "SELECT confirmed, count(*) AS n, min(ncc) AS low, max(ncc) AS high, round(avg(ncc), 6) AS mean, round(median(ncc), 6) AS median, round(quantile_cont(ncc, 0.1), 6) AS p10, round(quantile_cont(ncc, 0.9), 6) AS p90 FROM m GROUP BY 1")
def ncc_summary(spark: SparkSession, base: str) -> DataFrame:
    d = stats.describe(_meta(spark, base), "ncc", ["confirmed"])
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "median", "p10", "p90")})


@REGISTRY.query(_META_SQL + "SELECT confirmed, floor(ncc / 0.05)::BIGINT AS bin, count(*) AS n, round(any_value(floor(ncc / 0.05)) * 0.05, 6) AS low FROM m GROUP BY 1, 2")
def ncc_histogram(spark: SparkSession, base: str) -> DataFrame:
    return stats.histogram(_meta(spark, base), "ncc", 0.05, ["confirmed"]).withColumn("low", F.round("low", 6))


@REGISTRY.query(
    _META_SQL
    + """, v AS (SELECT confirmed, ncc AS above, lag(ncc) OVER (PARTITION BY confirmed ORDER BY ncc) AS below FROM m)
SELECT confirmed, above, below, round(above - below, 6) AS gap, n::INTEGER AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY confirmed ORDER BY above - below DESC, below, above) AS n FROM v WHERE below IS NOT NULL) WHERE n <= 5"""
)
def ncc_gaps(spark: SparkSession, base: str) -> DataFrame:
    return stats.widest_gaps(_meta(spark, base), "ncc", 5, "confirmed").withColumn("gap", F.round("gap", 6))


@REGISTRY.query(
    _META_SQL
    + """, t AS (SELECT range AS k FROM range(300, 960, 5))
SELECT round(k * 0.001::DOUBLE, 6) AS threshold, sum((confirmed AND round(ncc * 1000, 3) < k)::INT)::BIGINT AS confirmed_below, sum((NOT confirmed AND round(ncc * 1000, 3) >= k)::INT)::BIGINT AS rejected_above,
 sum((confirmed AND round(ncc * 1000, 3) < k)::INT)::BIGINT + sum((NOT confirmed AND round(ncc * 1000, 3) >= k)::INT)::BIGINT AS wrong FROM t, m GROUP BY k"""
)
def ncc_sweep(spark: SparkSession, base: str) -> DataFrame:
    """Errors of every threshold on the correlation."""
    return stats.threshold_sweep(_meta(spark, base), "ncc", "confirmed", 300, 955, 5, 0.001).withColumn("threshold", F.round("threshold", 6))


@REGISTRY.query("SELECT least(a, b) AS a, greatest(a, b) AS b, stage, rot, round(total_rmse, 6) AS total_rmse, ncc, coalesce(ncc >= 0.7, false) AS confirms FROM pair_meta")
def pair_decisions(spark: SparkSession, base: str) -> DataFrame:
    return dedup.decided(read_table(spark, base, "pair_meta"), CONF.ncc_min).withColumn("total_rmse", F.round("total_rmse", 6))


_LINKS_SQL = """
WITH RECURSIVE l AS (SELECT DISTINCT a, b FROM pair_meta WHERE ncc >= 0.7 AND a <> b), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS id, least(a, min(b)) AS group_id FROM r GROUP BY a)
"""


def _groups(spark: SparkSession, base: str) -> DataFrame:
    d = dedup.decided(read_table(spark, base, "pair_meta"), CONF.ncc_min)
    return dedup.linked_groups(d.where("confirms"))


@REGISTRY.query(_LINKS_SQL + "SELECT id, group_id FROM g")
def dup_components(spark: SparkSession, base: str) -> DataFrame:
    """Groups of pieces whose pairs a correlation confirms."""
    return _groups(spark, base)


@REGISTRY.query(
    _LINKS_SQL
    + """, s AS (SELECT piece_id, bool_or(coalesce(is_complete, false)) AS done, count(*) AS n FROM sides WHERE piece_id IS NOT NULL GROUP BY 1)
SELECT group_id, id FROM (SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN done IS NULL THEN NULL ELSE 1000000 * done::INT + n END DESC NULLS LAST, id) AS z FROM g LEFT JOIN s ON s.piece_id = g.id) WHERE z = 1"""
)
def group_representative(spark: SparkSession, base: str) -> DataFrame:
    """Of each group the most complete piece, then the one with most rows, then the smallest id."""
    s = read_table(spark, base, "sides").where("piece_id is not null").groupBy("piece_id").agg(F.max(F.coalesce("is_complete", F.lit(False))).alias("done"), F.count(F.lit(1)).alias("n"))
    m = _groups(spark, base).join(s.withColumnRenamed("piece_id", "id"), "id", "left")
    return dedup.best_of_group(m, 1_000_000 * F.col("done").cast("int") + F.col("n")).select("group_id", "id")


@REGISTRY.query(
    _LINKS_SQL
    + """, c AS (SELECT piece_id, max({'t': ingested_at, 'v': photo_space_centroid}) FILTER (photo_space_centroid IS NOT NULL) AS m FROM sides GROUP BY 1), x AS (SELECT group_id, m.v[1] AS a, m.v[2] AS b FROM g JOIN c ON c.piece_id = g.id WHERE m IS NOT NULL),
 u AS (SELECT group_id, avg(a) AS ma, avg(b) AS mb, greatest(max(a) - avg(a), avg(a) - min(a), max(b) - avg(b), avg(b) - min(b)) AS w FROM x GROUP BY 1)
SELECT group_id, [round(ma, 6), round(mb, 6)] AS fused, round(w, 6) AS max_diff FROM u"""
)
def view_fusion(spark: SparkSession, base: str) -> DataFrame:
    """Mean centroid of each group's views."""
    c = current_values(read_table(spark, base, "sides"), ["photo_space_centroid"]).where("photo_space_centroid is not null")
    f = dedup.fused(_groups(spark, base).join(c.withColumnRenamed("piece_id", "id"), "id"), "group_id", "photo_space_centroid")
    return f.select("group_id", F.transform("fused", lambda v: F.round(v, 6)).alias("fused"), F.round("max_diff", 6).alias("max_diff"))


@REGISTRY.query(
    PLACES_SQL
    + """SELECT a.piece_id AS a, b.piece_id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS distance, CASE WHEN sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 220 THEN 'same' ELSE 'near' END AS kind
FROM place a JOIN place b ON a.batch_id = b.batch_id AND a.piece_id < b.piece_id AND abs(a.x - b.x) < 660 AND abs(a.y - b.y) < 660 WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 660"""
)
def spot_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """Pieces on one spot of the bed and near misses."""
    p = bed_places(read_table(spark, base, "sides"), read_table(spark, base, "batch_photos"))
    return dedup.spot_duplicates(p, 220.0, 660.0).withColumn("distance", F.round("distance", 4))


_SIGN_SQL = "WITH c AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN (1::HUGEINT << (i - 1)) ELSE 0 END))::HUGEINT AS h FROM embeddings) "


def _codes(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "embeddings")
    code = F.expr("aggregate(transform(embedding, (v, i) -> if(v > 0, shiftleft(1L, i), 0L)), 0L, (acc, v) -> acc | v)")
    return e.select("vec_id", code.alias("code"))


@REGISTRY.query(_SIGN_SQL + "SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM c a JOIN c b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.h, b.h)) < 18")
def hamming_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of sign codes less than 18 bits apart."""
    return match.hamming_pairs(_codes(spark, base), "vec_id", "code", 18)


_COS_SQL = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS z FROM u)"""


@REGISTRY.query(
    _COS_SQL
    + """, p AS (SELECT q.vec_id AS query_id, t.vec_id AS target_id, round(list_sum(list_transform(range(1, 65), lambda i: q.e[i] * t.e[i])) / (q.z * t.z), 6) AS score FROM n q, n t WHERE q.vec_id % 50 = 0 AND q.vec_id <> t.vec_id)
SELECT query_id, target_id, score, k::INTEGER AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS k FROM p) WHERE k <= 3"""
)
def identify_topk(spark: SparkSession, base: str) -> DataFrame:
    """The three best targets of each query; queries are the ids divisible by 50, targets all others."""
    e = read_table(spark, base, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    e = e.withColumn("z", F.sqrt(F.aggregate("e", F.lit(0.0), lambda acc, v: acc + v * v)))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("qe"), F.col("z").alias("qz"))
    t = e.select(F.col("vec_id").alias("target_id"), F.col("e").alias("te"), F.col("z").alias("tz"))
    score = F.round(F.aggregate(F.zip_with("qe", "te", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v) / (F.col("qz") * F.col("tz")), 6)
    return match.top_matches(q, t, F.when(F.col("query_id") != F.col("target_id"), score), "query_id", "target_id", 3).where("score is not null")


@REGISTRY.query(
    _COS_SQL
    + """, p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_sum(list_transform(range(1, 65), lambda i: a.e[i] * b.e[i])) / (a.z * b.z), 6) AS d FROM n a, n b WHERE a.label = 0 AND b.label = 1),
 f AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS x, row_number() OVER (PARTITION BY b ORDER BY d, a) AS y FROM p) SELECT a, b, d FROM f WHERE x = 1 AND y = 1"""
)
def mutual_nn(spark: SparkSession, base: str) -> DataFrame:
    """Vectors of two labels that are each other's nearest."""
    e = read_table(spark, base, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    e = e.withColumn("z", F.sqrt(F.aggregate("e", F.lit(0.0), lambda acc, v: acc + v * v)))
    a, b = (e.where(F.col("label") == k).select(F.col("vec_id").alias(n), F.col("e").alias(f"e{n}"), F.col("z").alias(f"z{n}")) for k, n in ((0, "a"), (1, "b")))
    d = F.round(1 - F.aggregate(F.zip_with("ea", "eb", lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v) / (F.col("za") * F.col("zb")), 6)
    return match.mutual_nearest(a.crossJoin(b).select("a", "b", d.alias("d")), "a", "b", "d")


@REGISTRY.query(
    """WITH h AS (SELECT l_returnflag AS f, least(9, floor((l_quantity - 1) / 5))::INT AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT f, k, coalesce(n, 0) AS n FROM (SELECT DISTINCT f FROM h) CROSS JOIN (SELECT range::INT AS k FROM range(0, 10)) LEFT JOIN h USING (f, k))
SELECT a.f AS flag_a, b.f AS flag_b, round(corr(a.n, b.n), 4) AS likeness FROM g a JOIN g b ON a.k = b.k AND a.f < b.f GROUP BY 1, 2"""
)
def histogram_corr(spark: SparkSession, base: str) -> DataFrame:
    """Correlation of quantity histograms between return flags."""
    li = read_table(spark, base, "lineitem").groupBy("l_returnflag", F.least(F.lit(9), F.floor((F.col("l_quantity") - 1) / 5)).cast("int").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    m = li.groupBy("l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    h = m.select("l_returnflag", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("h"))
    a, b = h.select(F.col("l_returnflag").alias("flag_a"), F.col("h").alias("ha")), h.select(F.col("l_returnflag").alias("flag_b"), F.col("h").alias("hb"))
    return a.crossJoin(b).where("flag_a < flag_b").select("flag_a", "flag_b", F.round(match.histogram_likeness([F.col("ha")], [F.col("hb")]), 4).alias("likeness"))


@REGISTRY.query(
    """WITH f AS (SELECT piece_id, side, other_piece, other_side, err::DOUBLE / 1000 AS e, ((piece_id + other_piece) % 11)::DOUBLE / 10 AS k FROM fits WHERE err IS NOT NULL AND other_piece IS NOT NULL AND err <> 1000000)
SELECT piece_id, side, other_piece, other_side, round(CASE WHEN e <= 7 THEN e * (1 - 0.3::DOUBLE * least(1, k)) ELSE e END, 6) AS err FROM f WHERE true"""
)
def color_adjust(spark: SparkSession, base: str) -> DataFrame:
    """Errors of listed fits lowered by a likeness of 0 to 1 (here made from the ids)."""
    f = read_table(spark, base, "fits").where("err is not null and other_piece is not null and err <> 1000000")
    f = f.select("piece_id", "side", "other_piece", "other_side", (F.col("err").cast("double") / 1000).alias("err"), (F.pmod(F.col("piece_id") + F.col("other_piece"), F.lit(11)) / 10.0).alias("k"))
    f = match.color_adjusted(f, F.least(F.lit(1.0), F.col("k")))
    return f.drop("k").withColumn("err", F.round("err", 6))


@REGISTRY.query(
    """WITH v AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), f AS (SELECT *, CASE WHEN v - lag(v) OVER w > 3600 THEN 1 ELSE 0 END AS new FROM v WINDOW w AS (PARTITION BY user_id ORDER BY v)),
 c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY v) AS cluster FROM f) SELECT user_id, cluster::BIGINT AS cluster, count(*) AS n, min(v) AS low, max(v) AS high FROM c GROUP BY 1, 2"""
)
def gap_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Runs of a user's events with no more than an hour between."""
    e = read_table(spark, base, "events")
    return stats.gap_clusters(e, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "user_id", 3600)


@REGISTRY.query(
    """WITH m AS (SELECT p_brand, median(p_size) AS med FROM part GROUP BY 1) SELECT p_partkey, p_brand, p_size, round(med, 4) AS median, CASE WHEN p_size / med > 1.8 THEN 'large' ELSE 'small' END AS kind FROM part JOIN m USING (p_brand) WHERE p_size / med > 1.8 OR p_size / med < 0.35"""
)
def size_outliers(spark: SparkSession, base: str) -> DataFrame:
    return stats.size_outliers(read_table(spark, base, "part"), "p_size", "p_brand", "p_partkey", 1.8, 0.35).withColumn("median", F.round("median", 4))


def _rules(t: str = "text") -> list:
    c = F.col(t)
    return [("missing", c.isNull()), ("empty", F.length(c) == 0), ("blank", F.trim(c) == ""), ("short", F.length(c) < 40), ("long", F.length(c) > 3000), ("repeats", c.contains("0000000000"))]


@REGISTRY.query(
    """SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) = 0 THEN 'empty' WHEN trim(text, ' ') = '' THEN 'blank' WHEN length(text) < 40 THEN 'short' WHEN length(text) > 3000 THEN 'long' WHEN contains(text, '0000000000') THEN 'repeats' END AS reason,
 list_filter([CASE WHEN text IS NULL THEN 'missing' END, CASE WHEN length(text) = 0 THEN 'empty' END, CASE WHEN trim(text, ' ') = '' THEN 'blank' END, CASE WHEN length(text) < 40 THEN 'short' END, CASE WHEN length(text) > 3000 THEN 'long' END, CASE WHEN contains(text, '0000000000') THEN 'repeats' END], lambda x: x IS NOT NULL) AS tags FROM documents"""
)
def doc_quality_tags(spark: SparkSession, base: str) -> DataFrame:
    """First reason against each text, and all of them."""
    d = read_table(spark, base, "documents")
    return d.select("doc_id", stats.first_reason(_rules()).alias("reason"), stats.quality_tags(d, _rules()).alias("tags"))


@REGISTRY.query("SELECT text, min(doc_id) AS kept, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def doc_exact_dupes(spark: SparkSession, base: str) -> DataFrame:
    """Texts occurring more than once, the first kept."""
    d = read_table(spark, base, "documents").where("text is not null")
    return d.groupBy("text").agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")


@REGISTRY.query(
    "SELECT batch_id, file_name, CASE WHEN regexp_matches(file_name, '_\\d+\\.') THEN regexp_extract(file_name, '_(\\d+)\\.', 1)::BIGINT END AS photo_no, lower(regexp_extract(file_name, '\\.([A-Za-z]+)$', 1)) AS kind, count(*) AS n FROM batch_photos GROUP BY 1, 2"
)
def photo_names(spark: SparkSession, base: str) -> DataFrame:
    """Number and kind of each photo, from its name."""
    f = F.col("file_name")
    p = read_table(spark, base, "batch_photos").groupBy("batch_id", "file_name").agg(F.count(F.lit(1)).alias("n"))
    return p.select("batch_id", "file_name", F.when(f.rlike(r"_\d+\."), F.regexp_extract(f, r"_(\d+)\.", 1).cast("bigint")).alias("photo_no"), F.lower(F.regexp_extract(f, r"\.([A-Za-z]+)$", 1)).alias("kind"), "n")


_BOARD_SQL = "WITH sz AS (SELECT batch_id AS board_id, ceil(sqrt(n * 1.2))::INT AS width, ceil(sqrt(n * 1.2))::INT AS height FROM (SELECT batch_id, count(DISTINCT piece_id) AS n FROM sides WHERE piece_id IS NOT NULL AND batch_id IS NOT NULL GROUP BY 1)), d AS (SELECT piece_id, min(batch_id) AS board_id FROM sides WHERE piece_id IS NOT NULL AND batch_id IS NOT NULL GROUP BY 1), r AS (SELECT board_id, piece_id, row_number() OVER (PARTITION BY board_id ORDER BY piece_id) - 1 AS k FROM d), pl AS (SELECT r.board_id, piece_id, (k % width)::INT AS x, (k // width)::INT AS y, (piece_id % 4)::INT AS orientation, width, height FROM r JOIN sz USING (board_id)) "


def _board(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """A board a batch: its pieces laid row by row into a square with room to spare."""
    from pyspark.sql import Window

    d = read_table(spark, base, "sides").where("piece_id is not null and batch_id is not null").groupBy("piece_id").agg(F.min("batch_id").alias("board_id"))
    n = d.groupBy("board_id").agg(F.count(F.lit(1)).alias("n"))
    side = F.ceil(F.sqrt(F.col("n") * 1.2)).cast("int")
    sizes = n.select("board_id", side.alias("width"), side.alias("height"))
    k = F.row_number().over(Window.partitionBy("board_id").orderBy("piece_id")) - 1
    placed = d.withColumn("k", k).join(sizes, "board_id").select("board_id", "piece_id", (F.col("k") % F.col("width")).cast("int").alias("x"), F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), (F.col("piece_id") % 4).cast("int").alias("orientation"))
    return placed, sizes


@REGISTRY.query(_BOARD_SQL + ", g AS (SELECT board_id, xx::INT AS x, yy::INT AS y FROM (SELECT board_id, unnest(range(0, width)) AS xx, height FROM sz), LATERAL (SELECT unnest(range(0, height)) AS yy)) SELECT g.board_id, g.x, g.y FROM g LEFT JOIN pl USING (board_id, x, y) WHERE pl.piece_id IS NULL")
def missing_cells(spark: SparkSession, base: str) -> DataFrame:
    placed, sizes = _board(spark, base)
    return stats.missing_cells(spark, placed, sizes)


@REGISTRY.query(
    _BOARD_SQL
    + """, q AS (SELECT a.board_id, a.width, a.height, (a.x + 1 < a.width)::INT + (a.y + 1 < a.height)::INT AS p, (r.piece_id IS NOT NULL)::INT + (d.piece_id IS NOT NULL)::INT AS m FROM pl a LEFT JOIN pl r ON r.board_id = a.board_id AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN pl d ON d.board_id = a.board_id AND d.x = a.x AND d.y = a.y + 1)
SELECT board_id, count(*) AS n_placed, round(count(*) / (any_value(width) * any_value(height))::DOUBLE, 4) AS coverage, sum(p)::BIGINT AS possible, sum(m)::BIGINT AS matched, round(sum(m) / sum(p)::DOUBLE, 4) AS quality FROM q GROUP BY 1"""
)
def solution_quality(spark: SparkSession, base: str) -> DataFrame:
    q = stats.solution_quality(*_board(spark, base))
    return q.withColumn("coverage", F.round("coverage", 4)).withColumn("quality", F.round("quality", 4))


@REGISTRY.query(
    _BOARD_SQL
    + """, c AS (SELECT *, CASE WHEN x IN (0, width - 1) AND y IN (0, height - 1) THEN 'corner' WHEN x IN (0, width - 1) OR y IN (0, height - 1) THEN 'edge' ELSE 'inner' END AS class FROM pl)
SELECT c.board_id, row_number() OVER (PARTITION BY c.board_id ORDER BY CASE class WHEN 'corner' THEN 0 WHEN 'edge' THEN 1 ELSE 2 END, c.y, c.x)::INTEGER AS step, c.piece_id, c.x, c.y, class, CASE c.orientation WHEN 0 THEN 'as it lies' WHEN 1 THEN 'a quarter turn clockwise' WHEN 2 THEN 'half a turn' ELSE 'a quarter turn anticlockwise' END AS turn,
 l.piece_id AS left_id, r.piece_id AS right_id, t.piece_id AS top_id, b.piece_id AS bottom_id FROM c LEFT JOIN pl l ON l.board_id = c.board_id AND l.x = c.x - 1 AND l.y = c.y LEFT JOIN pl r ON r.board_id = c.board_id AND r.x = c.x + 1 AND r.y = c.y LEFT JOIN pl t ON t.board_id = c.board_id AND t.x = c.x AND t.y = c.y - 1 LEFT JOIN pl b ON b.board_id = c.board_id AND b.x = c.x AND b.y = c.y + 1"""
)
def assembly_order(spark: SparkSession, base: str) -> DataFrame:
    return stats.assembly_order(*_board(spark, base))


@REGISTRY.query(
    _BOARD_SQL
    + """, g AS (SELECT board_id, xx::INT AS x, yy::INT AS y FROM (SELECT board_id, unnest(range(0, width)) AS xx, height FROM sz), LATERAL (SELECT unnest(range(0, height)) AS yy)),
 w AS (SELECT board_id, length(max(piece_id)::VARCHAR) AS p FROM pl GROUP BY 1)
SELECT g.board_id, g.y, string_agg(CASE WHEN pl.piece_id IS NULL THEN repeat(' ', w.p) || '-' ELSE right(lpad(pl.piece_id::VARCHAR, 12, ' ') || CASE pl.orientation WHEN 0 THEN '^' WHEN 1 THEN '>' WHEN 2 THEN 'v' ELSE '<' END, (w.p + 1)::INT) END, ' ' ORDER BY g.x) AS line
FROM g JOIN w ON w.board_id = g.board_id LEFT JOIN pl ON pl.board_id = g.board_id AND pl.x = g.x AND pl.y = g.y GROUP BY 1, 2"""
)
def solution_text(spark: SparkSession, base: str) -> DataFrame:
    """Each board as lines of text."""
    return stats.grid_text(*_board(spark, base))


@REGISTRY.query(_BOARD_SQL + "SELECT board_id, piece_id, x, y, round(x * 10 + x * 5.699827119::DOUBLE, 4) AS dest_x, round(y * 10 + y * 9.121796862::DOUBLE, 4) AS dest_y FROM pl")
def spacing(spark: SparkSession, base: str) -> DataFrame:
    placed, _ = _board(spark, base)
    p = placed.withColumn("dest_x", F.col("x") * 10.0).withColumn("dest_y", F.col("y") * 10.0)
    return stats.spacing(p, CONF.gap_x, CONF.gap_y).select("board_id", "piece_id", "x", "y", F.round("dest_x", 4).alias("dest_x"), F.round("dest_y", 4).alias("dest_y"))


@REGISTRY.query(
    """WITH c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), g AS (SELECT w::INT AS w, h::INT AS h FROM range(1, 201) a(w), range(1, 201) b(h) WHERE w >= h),
 s AS (SELECT c_nationkey, n, w, h, round(w - h + 0.1 * (w * h - n), 6) AS s FROM c JOIN g ON w * h >= n AND w * h <= 4 * n + 4)
SELECT c_nationkey, n, w AS width, h AS height FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY s, w, h) AS z FROM s) WHERE z = 1"""
)
def grid_infer(spark: SparkSession, base: str) -> DataFrame:
    """A board size for the number of customers of each nation."""
    c = read_table(spark, base, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return stats.grid_by_count(spark, c, "n")


@REGISTRY.query("SELECT o_orderpriority, count(*) AS n, count(c_custkey) AS n_found, round(sum(c_acctbal), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def position_join(spark: SparkSession, base: str) -> DataFrame:
    """A lookup by key that keeps rows without a match."""
    o, c = read_table(spark, base, "orders"), read_table(spark, base, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count("c_custkey").alias("n_found"), F.round(F.sum("c_acctbal"), 2).alias("total"))
