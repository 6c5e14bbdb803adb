"""Points near other points, and regions around points, by strips and a sweep.

Points are cut into strips of latitude (y) a few distances high; a point within
one distance of its strip's upper end also goes to the next strip, as a guest.
Within a strip, long stretches of x are cut the same way.  The tiles are partitioned by range of group,
strip and stretch, so neighbouring tiles lie together.
Inside a partition rows are sorted by tile and x; one pass keeps the points
whose x is within the distance of the newest (the active set) and compares.

A pair has one owner: the tile that is home, in y, to one of the two and, in x,
to one of the two.  A tile in which both are guests in y, or both in x, skips it.

A tile of more than ``HOT`` points is split: its points fall into blocks by a hash of their ids, and each pair
of blocks is swept by itself, comparing only points of different blocks (or all of one).

Regions (closed outlines) go to every strip their box touches, points to one; a sweep along x keeps the
regions that have begun and not ended.  Strips are as high as the mean box, so on average a region is in two.  In a strip of more than ``HOT``
points these are split into blocks, each of which gets the strip's regions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interlock.session import staged

#: Height and length of a tile, in distances.
STRIP, STRETCH = 6, 24
#: Compared pairs in flight in one step of the sweep.
_STEP = 2_000_000
#: Points of a tile or strip beyond which it is split into blocks of about so many.
HOT = 50_000


def near_pairs(points: DataFrame, distance: float, *, by: list[str], id_: str = "piece_id", x: str = "x", y: str = "y") -> DataFrame:
    """(a, b), a < b: ids of points with equal ``by`` strictly closer than ``distance``.

    Points with a null id or coordinate have no place and come out in no pair; null
    values in ``by`` match nothing.  Points at the same place pair up like
    any others.  Each id stands for one point; further rows of an id never pair with it.
    """
    if distance <= 0:
        return points.select(F.col(id_).cast("long").alias("a"), F.col(id_).cast("long").alias("b")).where(F.lit(False))
    ok = F.col(id_).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    for c in by:
        ok &= F.col(c).isNotNull()
    height, length = STRIP * distance, STRETCH * distance
    px, py = F.col(x).cast("double"), F.col(y).cast("double")

    def homes(v, size):
        """Own cell, and the next one if within the distance of it, as (cell, guest)."""
        own = F.floor(v / size)
        up = F.floor((v + distance) / size)
        return F.when(up > own, F.array(F.struct(own.alias("c"), F.lit(False).alias("g")), F.struct((own + 1).alias("c"), F.lit(True).alias("g")))).otherwise(F.array(F.struct(own.alias("c"), F.lit(False).alias("g"))))

    groups = [f"by{i}" for i in range(len(by))]
    tile = [*groups, "strip", "stretch"]
    tiled = staged(
        points.where(ok)
        .select(*[F.col(c).alias(g) for c, g in zip(by, groups)], F.col(id_).cast("long").alias("id"), px.alias("x"), py.alias("y"))
        .withColumn("s", F.explode(homes(F.col("y"), height)))
        .withColumn("r", F.explode(homes(F.col("x"), length)))
        .select(*groups, F.col("s.c").alias("strip"), F.col("r.c").alias("stretch"), "id", "x", "y", F.col("s.g").alias("gy"), F.col("r.g").alias("gx")),
        "tiles",
    )
    hot = staged(tiled.groupBy(*tile).count().where(F.col("count") > HOT).select(*tile, F.ceil(F.col("count") / HOT).cast("int").alias("n")), "hot-tiles")
    whole = tiled.withColumns({"block": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    if not hot.isEmpty():
        # hot tiles are few: at most one for each HOT rows
        split = (
            tiled.join(hot, tile)
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
            .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
            .drop("n", "o")
        )
        whole = whole.join(hot.select(*tile), tile, "left_anti").unionByName(split)
    order = [*tile, "i", "j"]
    ranged = whole.repartitionByRange(*order).sortWithinPartitions(*order, "x")
    return ranged.select(F.xxhash64(*order).alias("tile"), "id", "x", "y", "gy", "gx", "block", (F.col("i") != F.col("j")).alias("cross")).mapInArrow(_sweep(distance), "a long, b long")


def _sweep(distance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if not len(new["id"]):
                continue
            old = 0 if held is None else len(held["id"])
            rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in new}
            yield from _compare(rows, old, distance)
            active = (rows["tile"] == rows["tile"][-1]) & (rows["x"] > rows["x"][-1] - distance)
            held = {c: v[active] for c, v in rows.items()}

    return run


def _compare(rows: dict[str, np.ndarray], old: int, distance: float) -> Iterator[pa.RecordBatch]:
    """Each new row (from ``old`` on) against the rows before it in the active set."""
    tile, x, n = rows["tile"], rows["x"], len(rows["x"])
    change = np.concatenate([[True], tile[1:] != tile[:-1]])
    group = np.cumsum(change) - 1
    starts = np.flatnonzero(change)
    first = np.empty(n, np.int64)
    for g, a in enumerate(starts):
        b = starts[g + 1] if g + 1 < len(starts) else n
        first[a:b] = a + np.searchsorted(x[a:b], x[a:b] - distance, side="right")
    del group
    count = np.arange(n) - first
    count[:old] = 0
    ends = np.cumsum(count)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STEP, side="right")))
        c = count[at:upto]
        if c.sum():
            i = np.repeat(np.arange(at, upto), c)
            j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[at:upto], c)
            dx, dy = x[i] - x[j], rows["y"][i] - rows["y"][j]
            hit = (np.abs(dy) < distance) & (np.hypot(dx, dy) < distance)
            i, j = i[hit], j[hit]
            keep = ~(rows["gy"][i] & rows["gy"][j]) & ~(rows["gx"][i] & rows["gx"][j]) & (rows["id"][i] != rows["id"][j])
            keep &= ~(rows["cross"][i] & (rows["block"][i] == rows["block"][j]))
            a, b = rows["id"][i[keep]], rows["id"][j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
        at = upto


def containing_regions(points: DataFrame, regions: DataFrame, *, by: list[str], id_: str = "piece_id", x: str = "x", y: str = "y", region: str = "region_id", ring: str = "ring") -> DataFrame:
    """(id, region): each point with every region of equal ``by`` that contains it or has it on its border.

    ``ring`` is a closed outline as an array of points, its last one joined to the first.  Points with a null id or coordinate lie in no
    region; regions with a null id, fewer than three vertices or a null in them contain nothing; null values in
    ``by`` match nothing.  A point or region given twice counts once a row.
    """
    fine = F.col(id_).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    shaped = F.col(region).isNotNull() & (F.size(ring) >= 3) & F.forall(ring, lambda p: (F.size(p) >= 2) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull())
    for c in by:
        fine &= F.col(c).isNotNull()
        shaped &= F.col(c).isNotNull()
    groups = [f"by{i}" for i in range(len(by))]
    keys = lambda: [F.col(c).alias(g) for c, g in zip(by, groups)]
    axis = lambda k: F.transform(F.col(ring), lambda p: F.get(p, k).cast("double"))
    boxes = staged(
        regions.where(shaped).select(*keys(), F.col(region).cast("long").alias("id"), axis(0).alias("rx"), axis(1).alias("ry"))
        .withColumns({"x": F.array_min("rx"), "x2": F.array_max("rx"), "y": F.array_min("ry"), "y2": F.array_max("ry")}),
        "boxes",
    )
    height = boxes.agg(F.avg(F.col("y2") - F.col("y"))).first()[0]
    height = height if height and height > 0 else 1.0
    strip = lambda c: F.floor(F.col(c) / height)
    spots = points.where(fine).select(*keys(), F.col(id_).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumn("strip", strip("y"))
    spots = staged(spots, "spots")
    cut = [*groups, "strip"]
    blocks = staged(spots.groupBy(*cut).count().select(*cut, F.ceil(F.col("count") / HOT).cast("int").alias("n")), "strips")  # one row a strip with points
    # a strip without points needs no regions
    there = boxes.withColumn("strip", F.explode(F.sequence(strip("y"), strip("y2")))).join(blocks, cut).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    hot = blocks.where("n > 1")
    placed = spots.join(hot, cut, "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id"), F.col("n")).cast("int"), F.lit(0))).drop("n")
    none = F.lit(None)
    rows = placed.select(*cut, "block", F.lit(True).alias("spot"), "id", "x", "y", none.cast("double").alias("x2"), none.cast("double").alias("y2"), none.cast("array<double>").alias("rx"), none.cast("array<double>").alias("ry")).unionByName(
        there.select(*cut, "block", F.lit(False).alias("spot"), "id", "x", "y", "x2", "y2", "rx", "ry")
    )
    order = [*cut, "block"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "x", "spot")
    return ranged.select(F.xxhash64(*order).alias("tile"), "spot", "id", "x", "y", "x2", "y2", "rx", "ry").mapInArrow(_swept_regions, f"{id_} long, {region} long")


def _swept_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    active: list[tuple] = []  # (tile, x2, y, y2, id, ring) of regions that have begun
    for batch in batches:
        if not batch.num_rows:
            continue
        tile, spot, ids, x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "spot", "id", "x", "y"))
        active = [a for a in active if a[0] == tile[0] and a[1] >= x[0]]
        begun = [(0, a) for a in active]
        for k in np.flatnonzero(~spot):
            ring = np.stack([np.asarray(batch.column(c)[int(k)].values) for c in ("rx", "ry")], axis=1)
            region = (tile[k], batch.column("x2")[int(k)].as_py(), y[k], batch.column("y2")[int(k)].as_py(), ids[k], ring)
            begun.append((int(k) + 1, region))
        out_p, out_r = [], []
        ends = np.concatenate([np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]])
        for at, (name, x2, low, high, id_, ring) in begun:
            stop = int(ends[np.searchsorted(ends, at, side="right")]) if at < len(tile) else at
            if at < stop and tile[at] == name:
                stop = at + int(np.searchsorted(x[at:stop], x2, side="right"))
                near = at + np.flatnonzero(spot[at:stop] & (y[at:stop] >= low) & (y[at:stop] <= high))
                if len(near):
                    near = near[within(np.stack([x[near], y[near]], axis=1), ring)]
                    out_p.append(ids[near])
                    out_r.append(np.full(len(near), id_))
        active = [r for _, r in begun if r[0] == tile[-1]]
        p, r = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (out_p, out_r))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(r)], names=["p", "r"])


def within(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which points lie in a closed outline or on it, by counting crossings."""
    a, b = ring, np.roll(ring, -1, axis=0)
    d = b - a
    px, py = points[:, :1], points[:, 1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        crossed = ((a[:, 1] > py) != (b[:, 1] > py)) & (px < d[:, 0] * (py - a[:, 1]) / d[:, 1] + a[:, 0])
        t = np.clip(np.nan_to_num(((px - a[:, 0]) * d[:, 0] + (py - a[:, 1]) * d[:, 1]) / (d**2).sum(axis=1)), 0, 1)
    on = np.hypot(px - a[:, 0] - t * d[:, 0], py - a[:, 1] - t * d[:, 1]).min(axis=1) < 1e-9
    return on | (crossed.sum(axis=1) % 2 == 1)
