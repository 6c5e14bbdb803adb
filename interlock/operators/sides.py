"""Sides of pieces: normal form, measures, profiles and types, as column plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from interlock.conf import Conf
from interlock.functions import geom
from interlock.operators import alike
from interlock.operators.pieces import usable_ids, valid_side

CONF = Conf()


def distinct_sides(sides: DataFrame, by_piece: bool = False) -> DataFrame:
    """One row per side of every usable piece: piece_id, side_index, vertices, piece_center, is_edge, batch_id.

    Copies of a side are alike by contract; an aggregate without order picks one map-side, or with ``by_piece``
    after a shuffle by piece, which then serves all that follows by piece.
    """
    rows = sides.where(valid_side() & F.col("piece_id").isNotNull() & F.col("side_index").between(0, 3))
    if by_piece:
        rows = rows.select("piece_id", "side_index", "vertices", "piece_center", "is_edge", "batch_id").repartition("piece_id")
    one = rows.groupBy("piece_id", "side_index").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("vertices", "piece_center", "is_edge", "batch_id")])
    return one.join(usable_ids(sides), "piece_id", "left_semi")


def normalised(sides: DataFrame, conf: Conf = CONF) -> DataFrame:
    """Adds arc_len, chord_len, v (27 whole points, first at the origin, last on the x axis) and vf (the same seen from
    the other piece: turned half round, moved to x >= 0, order reversed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                arc, chord, v, vf = alike.normal_forms(*alike.points_of(b.column("vertices")), conf.segments)
                new = [*(pa.array(c, from_pandas=True) for c in (arc, chord)), *(alike.lists(c, pa.int32()) for c in (v, vf))]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "arc_len", "chord_len", "v", "vf"])

    added = "arc_len double, chord_len double, v array<array<int>>, vf array<array<int>>"
    return sides.mapInArrow(run, StructType([*sides.schema.fields, *StructType.fromDDL(added).fields]))


def metrics(sides: DataFrame) -> DataFrame:
    """Chord, direction, arc length, box and straightness of every side."""
    v = F.col("vertices")
    b = geom.bounds(v)
    return sides.select(
        "piece_id", "side_index", geom.distance(geom.first(v), geom.last(v)).alias("chord_len"), geom.angle(geom.first(v), geom.last(v)).alias("direction"), geom.polyline_length(v).alias("arc_len"),
        b["min_x"].alias("min_x"), b["min_y"].alias("min_y"), b["max_x"].alias("max_x"), b["max_y"].alias("max_y"),
        geom.mean_offset(v).alias("mean_offset"), geom.offset_spread(v).alias("offset_spread"),
    )


def edge_class(sides: DataFrame, limit: float) -> DataFrame:
    """is_flat per side by its spread, and per piece whether the flat sides can be: at most two, and not opposite."""
    flat = sides.select("piece_id", "side_index", (geom.offset_spread(F.col("vertices")) < limit).alias("is_flat"))
    mask = flat.groupBy("piece_id").agg(F.sum(F.col("is_flat").cast("int")).alias("n_flat"), F.sum(F.when(F.col("is_flat"), F.element_at(F.array(*[F.lit(1 << k) for k in range(4)]), F.col("side_index") + 1)).otherwise(0)).alias("m"))
    bad = F.when(F.col("n_flat") > 2, "more than two edges").when(F.col("m").isin(5, 10), "opposite edges")
    return flat.join(mask.select("piece_id", "n_flat", bad.alias("reject_reason")), "piece_id")


def edge_separation(sides: DataFrame) -> DataFrame:
    """Per measure, the largest value over flat sides against the smallest over the others, their ratio and how many lie between."""
    d = F.transform(geom.offsets(F.col("vertices")), F.abs)
    m = sides.select("is_edge", geom.mean(d).alias("mean"), F.array_max(d).alias("max"), geom.spread(d).alias("sd"), F.pow(geom.spread(d), 2).alias("var"))
    long = m.select("is_edge", F.expr("stack(4, 'mean', mean, 'max', max, 'sd', sd, 'var', var) as (measure, value)"))
    ends = long.groupBy("measure").agg(F.max(F.when(F.col("is_edge"), F.col("value"))).alias("flat_max"), F.min(F.when(~F.col("is_edge"), F.col("value"))).alias("other_min"))
    zone = long.join(F.broadcast(ends), "measure").groupBy("measure", "flat_max", "other_min").agg(F.sum(((F.col("value") >= F.col("other_min")) & (F.col("value") <= F.col("flat_max"))).cast("long")).alias("n_overlap"))
    ratio = F.col("other_min") / F.col("flat_max")
    return zone.select("measure", "flat_max", "other_min", (ratio > 1).alias("clean"), "n_overlap")


def side_type(vertices: Column, center: Column, is_edge: Column) -> Column:
    """'F' flat, 'T' tab (its middle half lies away from the centre), else 'B'."""
    n = F.size(vertices)
    lo, hi = F.floor(n / 4).cast("int"), F.floor(3 * n / 4).cast("int")
    middle = geom.mean(F.slice(geom.offsets(vertices), lo + 1, hi - lo))
    own = geom.signed_offset(center, geom.first(vertices), geom.last(vertices))
    chord = geom.distance(geom.first(vertices), geom.last(vertices))
    return F.when(is_edge | (n < 3) | (chord < 1), "F").when(own * middle < 0, "T").otherwise("B")


def profile(vertices: Column, points: int = CONF.profile_points) -> Column:
    """Signed offsets from the chord over its length at ``points`` places; zeros for a chord below 1."""
    p = geom.resample(vertices, points - 1)
    ends = F.struct(geom.first(vertices).alias("a"), geom.last(vertices).alias("b"), geom.distance(geom.first(vertices), geom.last(vertices)).alias("d"))
    heights = geom.let(ends, lambda e: F.transform(p, lambda q: geom.signed_offset(q, e["a"], e["b"]) / e["d"]))
    return F.when(geom.distance(geom.first(vertices), geom.last(vertices)) < 1, F.array_repeat(F.lit(0.0), points)).otherwise(heights)


def profile_error(one: Column, two: Column) -> Column:
    """Root mean squared difference of two profiles; 999 for different sizes."""
    return F.when(F.size(one) != F.size(two), F.lit(999.0)).otherwise(F.sqrt(geom.squared_difference(one, two)))


def signatures(sides: DataFrame) -> DataFrame:
    """(piece_id, n_flat, types): side types in order, and the smallest of their four rotations as the key of alike pieces."""
    t = sides.select("piece_id", "side_index", side_type(F.col("vertices"), F.col("piece_center"), F.col("is_edge")).alias("t"))
    rows = t.groupBy("piece_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("side_index", "t"))), lambda s: s["t"]).alias("in_order"))
    return rows.select("piece_id", *_signature(F.col("in_order")))


def _signature(in_order: Column) -> list[Column]:
    return [F.size(F.filter(in_order, lambda x: x == "F")).alias("n_flat"), F.array_join(geom.smallest_rotation(in_order), "").alias("types")]


def piece_rows(sides: DataFrame, points: int = CONF.profile_points) -> DataFrame:
    """One row a piece: arrays over its four sides (edge, chord, profile, mean of profile) and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lines = alike.points_of(b.column("vertices").flatten())
                chord, heights, level = alike.profiles(*lines, points)
                center = np.stack([b.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")], axis=1)
                edge = pc.fill_null(b.column("is_edge").flatten(), False).to_numpy(zero_copy_only=False)
                at = b.column("vertices").offsets
                nested = [pa.ListArray.from_arrays(at, v) for v in (pa.array(chord), alike.lists(heights), pa.array(level), pa.array(alike.types(*lines, center, edge)))]
                yield pa.RecordBatch.from_arrays([b.column("piece_id"), b.column("is_edge"), *nested], names=names)

    names = ["piece_id", "is_edge", "chord", "profile", "level", "t"]
    center = [F.get("piece_center", k).cast("double").alias(c) for k, c in enumerate("xy")]
    rows = sides.where("size(vertices) > 1").select("piece_id", F.struct("side_index", "is_edge", *center, "vertices").alias("s"))
    got = rows.groupBy("piece_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    arrays = got.select("piece_id", *[F.transform("s", geom.field(c)).alias(c) for c in ("is_edge", "x", "y", "vertices")])
    found = arrays.mapInArrow(run, "piece_id long, is_edge array<boolean>, chord array<double>, profile array<array<double>>, level array<double>, t array<string>")
    return found.select("piece_id", "is_edge", "chord", "profile", "level", *_signature(F.col("t")))
