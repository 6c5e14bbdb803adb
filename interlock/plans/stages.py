"""Whole runs as lists of stages for ``Pipeline``: from photos to pieces, sides, duplicates, fits and a solved board.

Every stage is a table under the run's folder; a run that broke off goes on from the last one written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlock.conf import Conf
from interlock.operators import board, dedup, match, sides, stats
from interlock.raster import plans

CONF = Conf()
Stages = list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]


def photo_stages(spark: SparkSession, folder: str, method: str | None = None, min_area: int = 100, batch: int = 0) -> Stages:
    """photos (turned upright), pieces (masks with reasons), sides (in the layout of side files); ids are hashes of photo and number."""

    def photos(_: dict[str, DataFrame]) -> DataFrame:
        return plans.upright(plans.read_images(spark, folder), plans.orientations(spark, folder))

    def named(t: dict[str, DataFrame]) -> DataFrame:
        s = plans.sides_of(t["pieces"]).where("reason is null")
        one = t["pieces"].select("photo_id", "piece_no", "origin", "is_complete", F.col("width").alias("photo_width"), F.col("height").alias("photo_height"))
        j = s.drop("reason").join(one, ["photo_id", "piece_no"])
        return j.select(
            F.xxhash64("photo_id", "piece_no").alias("piece_id"), "side_index", "vertices", "piece_center", "is_edge", "incenter", F.col("photo_id").alias("original_photo_name"), F.col("origin").alias("photo_space_origin"),
            F.array(*[(F.col("origin")[k] + F.col("piece_center")[k]).cast("double") for k in (0, 1)]).alias("photo_space_centroid"), "photo_width", "photo_height", "is_complete", F.lit(batch).cast("long").alias("batch_id"),
        )

    return [("photos", photos), ("pieces", lambda t: plans.pieces_of(t["photos"], method, min_area)), ("sides", named)]


def match_stages(conf: Conf = CONF) -> Stages:
    """same (pairs alike), groups, kept (one piece a group: complete ones first, then the smallest id), normal, fits; from ``sides``."""

    def kept(t: dict[str, DataFrame]) -> DataFrame:
        best = dedup.best_of_group(t["groups"].join(t["sides"].groupBy(F.col("piece_id").alias("id")).agg(F.max(F.coalesce(F.col("is_complete"), F.lit(False)).cast("int")).alias("done")), "id"), F.col("done"))
        gone = t["groups"].join(best.select("id"), "id", "left_anti").select(F.col("id").alias("piece_id"))
        return t["sides"].join(gone, "piece_id", "left_anti")

    return [
        ("distinct", lambda t: sides.distinct_sides(t["sides"])),
        ("same", lambda t: match.cascade(sides.piece_rows(t["distinct"]), conf)),
        ("groups", lambda t: dedup.linked_groups(t["same"])),
        ("kept", kept),
        ("normal", lambda t: sides.normalised(sides.distinct_sides(t["kept"]), conf).drop("vertices", "piece_center")),
        ("fits", lambda t: match.keep_best(match.fit_errors(t["normal"], conf.fit_error_max, conf), conf.keep_within_best)),
    ]


def spot_stages(photos: Callable[[dict[str, DataFrame]], DataFrame], distance: float = CONF.duplicate_distance, near: float = CONF.near_miss_distance) -> Stages:
    """places and groups of pieces lying on one spot of the bed, for photos with camera positions; in place of the stages ``same`` and ``groups``."""
    from interlock.operators.pieces import bed_places

    return [
        ("places", lambda t: bed_places(t["sides"].withColumn("ingested_at", F.lit(None).cast("timestamp")), photos(t))),
        ("spots", lambda t: dedup.spot_duplicates(t["places"], distance, near)),
        ("groups", lambda t: dedup.linked_groups(t["spots"].where("kind = 'same'"))),
    ]


def board_stages(spark: SparkSession, width: int | None = None, height: int | None = None) -> Stages:
    """sizes (by the number of pieces and of pieces with a flat side where not given), board, steps; from ``normal`` and ``fits``."""
    one = F.lit(0).cast("long").alias("board_id")

    def sizes(t: dict[str, DataFrame]) -> DataFrame:
        if width and height:
            return spark.createDataFrame([(0, width, height)], "board_id long, width int, height int")
        flat = t["normal"].groupBy("piece_id").agg(F.max(F.col("is_edge").cast("int")).alias("e"))
        n = flat.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))
        return stats.grid_by_edges(spark, n, "n", "edges").select(one, "width", "height")

    return [
        ("sizes", sizes),
        ("board", lambda t: board.solve_boards(t["normal"].select(one, "piece_id").distinct(), t["fits"].select(one, "piece_id", "side", "other_piece", "other_side", "err"), t["sizes"])),
        ("steps", lambda t: stats.assembly_order(t["board"].drop("complete"), t["sizes"])),
    ]


def phone_run(spark: SparkSession, folder: str, width: int | None = None, height: int | None = None, method: str | None = None, conf: Conf = CONF) -> Stages:
    """All stages for loose photos: duplicates are found by shape."""
    return [*photo_stages(spark, folder, method), *match_stages(conf), *board_stages(spark, width, height)]


def robot_run(spark: SparkSession, folder: str, photos: Callable[[dict[str, DataFrame]], DataFrame], width: int | None = None, height: int | None = None, conf: Conf = CONF) -> Stages:
    """All stages for photos with camera positions (batch_id, file_name, position, received_at): duplicates are found by place, then by shape no more."""
    by_shape = dict(match_stages(conf))
    rest = [(n, by_shape[n]) for n in ("kept", "normal", "fits")]
    return [*photo_stages(spark, folder), *spot_stages(photos), *rest, *board_stages(spark, width, height)]
