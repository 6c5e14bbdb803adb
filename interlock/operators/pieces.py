"""Piece-level views of delivered sides: usable pieces, current values, places."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlock.functions.outline import pack

SIDES = 4


def valid_side(vertices: str = "vertices", center: str = "piece_center") -> Column:
    """At least two vertices and a piece centre."""
    return (F.size(F.col(vertices)) >= 2) & F.col(center).isNotNull()


def usable_ids(sides: DataFrame) -> DataFrame:
    """``piece_id`` of every piece with all four sides valid.

    A bit mask per piece is or-ed map-side, so a piece delivered any number of
    times sends one row per task.  Rows with a null id or another side index
    than 0..3 count for nothing.
    """
    bit = F.when(F.col("side_index").between(0, SIDES - 1), F.element_at(F.array(*[F.lit(1 << k) for k in range(SIDES)]), F.col("side_index") + 1))
    return (
        sides.where(valid_side() & F.col("piece_id").isNotNull())
        .groupBy("piece_id")
        .agg(F.bit_or(bit).alias("seen"))
        .where(F.col("seen") == (1 << SIDES) - 1)
        .select("piece_id")
    )


def packed_sides(sides: DataFrame) -> DataFrame:
    """(piece_id, side_index, batch_id, is_edge, outline) of every valid side row.

    Outlines are packed; within one Arrow batch a repeated side comes out once,
    which keeps a piece that is delivered over and over from filling a task.
    Rows without a whole outline drop out.
    """
    schema = "piece_id long, side_index int, batch_id long, is_edge boolean, outline binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pack(batch.column("vertices"))
            seen, keep = set(), []
            ids, index = batch.column("piece_id").to_pylist(), batch.column("side_index").to_pylist()
            for i, p in enumerate(packed):
                if p is not None and (k := (ids[i], index[i])) not in seen:
                    seen.add(k)
                    keep.append(i)
            taken = batch.select(["piece_id", "side_index", "batch_id", "is_edge"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([packed[i] for i in keep], pa.binary())], names=["piece_id", "side_index", "batch_id", "is_edge", "outline"])

    return (
        sides.where(valid_side() & F.col("piece_id").isNotNull() & F.col("side_index").between(0, SIDES - 1))
        .select("piece_id", "side_index", "batch_id", "is_edge", "vertices")
        .mapInArrow(run, schema)
    )


def usable_pieces(sides: DataFrame) -> DataFrame:
    """(piece_id, batch_id, is_edge array<boolean>, outlines array<binary>), one row a usable piece.

    One shuffle of packed outlines by piece.  Copies of a side are alike by
    contract; should they differ, the largest packed outline counts.
    """
    one = [F.max(F.when(F.col("side_index") == k, F.struct("outline", "is_edge"))).alias(f"s{k}") for k in range(SIDES)]
    rows = packed_sides(sides).groupBy("piece_id").agg(F.min("batch_id").alias("batch_id"), *one)
    for k in range(SIDES):
        rows = rows.where(F.col(f"s{k}").isNotNull())
    return rows.select(
        "piece_id",
        "batch_id",
        F.array(*[F.col(f"s{k}.is_edge") for k in range(SIDES)]).alias("is_edge"),
        F.array(*[F.col(f"s{k}.outline") for k in range(SIDES)]).alias("outlines"),
    )


def latest(value: str, at: str) -> Column:
    """Aggregate: the non-null ``value`` with the latest ``at``.

    Rows without a time count as oldest; equal times go to the larger value.
    """
    return F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v"))))["v"]


def current_values(sides: DataFrame, fields: list[str], at: str = "ingested_at", key: str = "piece_id") -> DataFrame:
    """One row a key with the current value of each field, each for itself."""
    return sides.where(F.col(key).isNotNull()).groupBy(key).agg(*[latest(f, at).alias(f) for f in fields])


def point(column: str) -> Column:
    """Whether an array holds two finite numbers first."""
    c = F.col(column)
    return (F.size(c) >= 2) & F.get(c, 0).isNotNull() & F.get(c, 1).isNotNull() & ~F.isnan(F.get(c, 0).cast("double")) & ~F.isnan(F.get(c, 1).cast("double"))


def photo_positions(photos: DataFrame) -> DataFrame:
    """(batch_id, file_name, position): the current position of every named photo that has one."""
    return photos.where(F.col("file_name") != "").groupBy("batch_id", "file_name").agg(latest("position", "received_at").alias("position")).where(point("position"))


def bed_places(sides: DataFrame, photos: DataFrame, scale: float = 10.0) -> DataFrame:
    """(piece_id, batch_id, x, y): where each piece lies on the bed.

    Camera position plus the scaled centroid, the y axis downwards.  Pieces
    without a centroid, a photo name or a listed photo position have no place.
    """
    pieces = (
        sides.where(F.col("piece_id").isNotNull())
        .groupBy("piece_id")
        .agg(
            F.min("batch_id").alias("batch_id"),
            F.max(F.when(F.col("original_photo_name") != "", F.col("original_photo_name"))).alias("file_name"),
            latest("photo_space_centroid", "ingested_at").alias("centroid"),
        )
        .where(point("centroid") & F.col("file_name").isNotNull())
    )
    listed = photo_positions(photos)
    return pieces.join(listed, ["batch_id", "file_name"]).select(
        "piece_id",
        "batch_id",
        (F.col("position")[0] + scale * F.col("centroid")[0]).alias("x"),
        (F.col("position")[1] - scale * F.col("centroid")[1]).alias("y"),
    )
