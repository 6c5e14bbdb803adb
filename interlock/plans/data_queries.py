"""Queries of the general data problems: small files (p4) and near points (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlock.operators.compact import compacted_records, newest_file
from interlock.operators.nearby import containing_regions, near_pairs
from interlock.operators.pieces import bed_places, photo_positions
from interlock.plans.registry import Registry
from interlock.session import read_table

REGISTRY = Registry()
#: Pieces of one batch closer than this on the bed are listed.
NEAR = 220.0
#: Half axes of the lozenge round a camera position that counts as its own region.
REACH_X, REACH_Y = 3000.3, 2000.7

PLACES_SQL = """
WITH p AS (SELECT piece_id, min(batch_id) AS b, max(original_photo_name) FILTER (original_photo_name <> '') AS f,
                  max({'t': ingested_at, 'v': photo_space_centroid}) FILTER (photo_space_centroid IS NOT NULL) AS m
           FROM sides WHERE piece_id IS NOT NULL GROUP BY piece_id),
     q AS (SELECT batch_id AS b, file_name AS f, max({'t': received_at, 'v': position}) FILTER (position IS NOT NULL) AS m
           FROM batch_photos WHERE file_name <> '' GROUP BY 1, 2),
     place AS (SELECT p.piece_id, p.b AS batch_id, q.m.v[1] + 10.0 * p.m.v[1] AS x, q.m.v[2] - 10.0 * p.m.v[2] AS y
               FROM p JOIN q ON p.b = q.b AND p.f = q.f)
"""


@REGISTRY.query(
    r"""
WITH t AS (SELECT file_path, modified_at, trim(payload, chr(9) || chr(10) || chr(13) || ' ') AS p FROM side_files WHERE payload IS NOT NULL),
     parts AS (SELECT file_path, modified_at, unnest(CASE WHEN json_valid(p) THEN [p] ELSE string_split(p, chr(10)) END) AS r FROM t),
     good AS (SELECT file_path, modified_at, r::JSON AS j FROM parts WHERE json_valid(r)),
     rec AS (SELECT CAST(j ->> '$.piece_id' AS BIGINT) AS piece_id, CAST(j ->> '$.side_index' AS INTEGER) AS side_index, file_path, modified_at
             FROM good WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.piece_id') IN ('UBIGINT', 'BIGINT') AND json_type(j, '$.side_index') IN ('UBIGINT', 'BIGINT')
               AND json_type(j, '$.is_edge') = 'BOOLEAN' AND json_type(j, '$.vertices') = 'ARRAY' AND json_array_length(j, '$.vertices') >= 2)
SELECT piece_id, side_index, file_path FROM (
  SELECT *, row_number() OVER (PARTITION BY piece_id, side_index ORDER BY modified_at DESC NULLS LAST, file_path) AS n FROM rec) WHERE n = 1
"""
)
def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """The file that counts for every side, from the consolidated records."""
    return newest_file(compacted_records(read_table(spark, base, "side_files")))


@REGISTRY.query(
    PLACES_SQL
    + """
SELECT a.piece_id AS piece_a, b.piece_id AS piece_b FROM place a JOIN place b
ON a.batch_id = b.batch_id AND a.piece_id < b.piece_id AND abs(a.x - b.x) < 220 AND abs(a.y - b.y) < 220
WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 220
"""
)
def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of pieces of one batch that lie closer than 220 on the bed."""
    places = bed_places(read_table(spark, base, "sides"), read_table(spark, base, "batch_photos"))
    return near_pairs(places, NEAR, by=["batch_id"]).select(F.col("a").alias("piece_a"), F.col("b").alias("piece_b"))


@REGISTRY.query(
    PLACES_SQL
    + f"""
SELECT place.piece_id, q.b AS batch_id, q.f AS file_name FROM place JOIN q ON place.batch_id = q.b
WHERE abs(place.x - q.m.v[1]) / {REACH_X} + abs(place.y - q.m.v[2]) / {REACH_Y} <= 1
"""
)
def p7_regions(spark: SparkSession, base: str) -> DataFrame:
    """Each piece with the photos of its batch in whose lozenge it lies on the bed."""
    photos = read_table(spark, base, "batch_photos")
    places = bed_places(read_table(spark, base, "sides"), photos)
    listed = photo_positions(photos).withColumn("region_id", F.xxhash64("batch_id", "file_name"))
    x, y = F.col("position")[0], F.col("position")[1]
    ring = F.array(F.array(x - REACH_X, y), F.array(x, y - REACH_Y), F.array(x + REACH_X, y), F.array(x, y + REACH_Y))
    found = containing_regions(places, listed.withColumn("ring", ring), by=["batch_id"])
    return found.join(listed.select("region_id", "batch_id", "file_name"), "region_id").select("piece_id", "batch_id", "file_name")
