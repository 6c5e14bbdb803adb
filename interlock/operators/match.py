"""Which sides fit each other, which pieces repeat each other: bounded-error joins."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlock.conf import Conf
from interlock.functions.geom import field, let
from interlock.operators import alike, fitting
from interlock.operators.pieces import usable_ids, valid_side
from interlock.session import staged

CONF = Conf()
#: Sides in one block of ``fit_errors`` at most; few sides are cut into up to ``BLOCKS`` blocks of at least ``LEAST`` for the sake of the cores.
SIDES, BLOCKS, LEAST = 40_000, 8, 2_000
#: Pairs of blocks in as many tasks, up to so many tasks.
TASKS = 2_000
LINES, LINE = ("piece_id", "side", "chord", "arc", "turn", "line"), "piece_id long, side int, chord double, arc double, turn array<long>, line binary"
KEYS = ("area", "lean")
#: Pieces in one block of ``same_shape``.
PIECES = 32_000
#: Queries in one block of ``top_matches``.
QUERIES = 20_000


def polyline_error(one: Column, two: Column, two_len: Column, y_max: float = CONF.y_shift_max) -> Column:
    """Sum of coordinate differences over the other's length, the smaller of as is and shifted.

    The shift is twice the mean of the negative parts per axis, in y at most ``y_max``.
    """
    n = F.size(one)

    def total(d: Column, by: Column) -> Column:
        return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + F.abs(v - by))

    def shift(d: Column) -> Column:
        return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + F.abs(v) - v) / n

    def both(d: Column) -> Column:
        by = F.struct(shift(d["x"]).alias("x"), F.greatest(F.lit(-y_max), F.least(F.lit(y_max), shift(d["y"]))).alias("y"))
        return let(by, lambda e: F.least(total(d["x"], F.lit(0.0)) + total(d["y"], F.lit(0.0)), total(d["x"], e["x"]) + total(d["y"], e["y"])))

    dx, dy = (F.zip_with(F.transform(one, field(k)), F.transform(two, field(k)), lambda a, b: (a - b).cast("double")) for k in (0, 1))
    return let(F.struct(dx.alias("x"), dy.alias("y")), both) / two_len


def fit_errors(sides: DataFrame, error_max: float = CONF.fit_error_max, conf: Conf = CONF, among: DataFrame | None = None, flip: bool = True, turn: str | None = None) -> DataFrame:
    """(piece_id, side, other_piece, other_side, err): directed pairs of sides of different pieces that fit within ``error_max``.

    ``sides`` is normalised; edges take no part.  With ``among`` only its sides are asked for (a delta); without ``flip`` sides of the same shape are sought
    in place of those that fit; with ``turn``, a column of whole numbers or of structs of them in both, only sides whose turn came earlier are sought.
    Blocks of about ``SIDES`` sides meet in numpy, within a window of chord lengths; before the full error is worked out, sums over
    runs of points bound it from below; the bound loses no pair.  A side seen from the other piece is itself turned half round, so without
    ``among`` each pair is looked at once for both directions.
    """
    mutual = among is None and flip and turn is None
    found, asked = lines_of(sides, flip, turn), sides if among is None else among
    sizes = [side_count(sides), None if mutual else side_count(asked)]
    return line_errors(found, error_max, conf, None if mutual else lines_of(asked, flip, turn), flip, sizes=sizes)


def side_count(sides: DataFrame) -> int:
    """How many normalised sides take part in ``fit_errors``; counted before they are packed, which takes longer."""
    return sides.where(~F.col("is_edge") & (F.col("chord_len") > 0) & (F.col("arc_len") > 0)).count()


def lines_of(sides: DataFrame, flip: bool = True, turn: str | None = None) -> DataFrame:
    """(piece_id, side, chord, arc, turn, line): normalised sides packed for ``line_errors``, without edges."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                line = fitting.pack(*[b.column(c) for c in ("v", "vf")[: 1 + flip]])
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("piece_id", "side", "chord", "arc", "turn")), line], names=["piece_id", "side", "chord", "arc", "turn", "line"])

    own = [] if turn is None else [f"{turn}.{f.name}" for f in sides.schema[turn].dataType.fields] if sides.schema[turn].dataType.typeName() == "struct" else [turn]
    order = F.array(*[F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63))) for c in own]).cast("array<long>")
    out = sides.where(~F.col("is_edge")).select("piece_id", F.col("side_index").alias("side"), F.col("chord_len").cast("double").alias("chord"), F.col("arc_len").cast("double").alias("arc"), order.alias("turn"), *("v", "vf")[: 1 + flip])
    return out.mapInArrow(packed, LINE)


def normal_lines(sides: DataFrame, conf: Conf = CONF) -> DataFrame:
    """``lines_of`` of ``normalised`` ``distinct_sides``, with two keys of shape: how much area lies on a side's chord, and how unevenly.

    Both are the same for a side and for what it looks like from the other piece, so sides that fit have keys alike.
    Lines are packed before the shuffle, as outlines are several times as large; of a side delivered over and over, an Arrow batch keeps one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                once = pa.table([*b.columns[:3], pa.array(np.arange(b.num_rows))], names=["p", "s", "e", "row"]).group_by(["p", "s", "e"]).aggregate([("row", "min")])
                if len(once) < b.num_rows:
                    b = b.take(once.column("row_min").combine_chunks())
                arc, chord, v, vf = alike.normal_forms(*alike.points_of(b.column("vertices")), conf.segments)
                y, half = v[..., 1], v.shape[1] // 2
                numbers = chord, arc, np.abs(y.sum(axis=1)), y[:, :half].sum(axis=1) - y[:, -half:].sum(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, from_pandas=True) for c in numbers), fitting.pack_numbers(v, vf)], names=names)

    names = ["piece_id", "side", "is_edge", "chord", "arc", *KEYS, "line"]
    rows = sides.where(valid_side() & F.col("piece_id").isNotNull() & F.col("side_index").between(0, 3)).select("piece_id", F.col("side_index").alias("side"), "is_edge", "vertices")
    rows = rows.mapInArrow(run, "piece_id long, side int, is_edge boolean, chord double, arc double, area double, lean double, line binary")
    one = rows.repartition("piece_id").groupBy("piece_id", "side").agg(*[F.first(c, ignorenulls=True).alias(c) for c in names[2:]]).where(~F.col("is_edge"))
    return one.join(usable_ids(sides), "piece_id", "left_semi").select(*LINES[:4], F.array().cast("array<long>").alias("turn"), "line", *KEYS)


def _blocks(n: int, most: int = BLOCKS) -> int:
    return max(math.ceil(n / SIDES), min(most, math.ceil(n / LEAST)), 1)


def line_errors(lines: DataFrame, error_max: float, conf: Conf = CONF, among: DataFrame | None = None, flip: bool = True, both: bool = False, sizes: list[int] | None = None) -> DataFrame:
    """``fit_errors`` of packed sides; without ``among`` each pair is looked at once for both directions, and with ``both`` those of ``among`` and ``lines``, two sets without a common side.

    ``sizes`` has the numbers of sides of both, where counting lines would pack them once more.
    """
    points, mutual = conf.segments + 1, among is None
    inner = (F.col("chord") > 0) & (F.col("arc") > 0)
    own = lambda n: F.pmod(F.xxhash64("piece_id", "side"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = lines.where(inner).select(*LINES)
    n = _blocks(sizes[0] if sizes else rows.count())
    if mutual:
        dealt = rows.withColumn("own", own(n)).withColumn("other", every(n))
        dealt = dealt.select("*", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).withColumn("asked", F.col("own") == F.col("low")).drop("own", "other")
    else:
        asked = among.where(inner).select(*LINES)
        m = _blocks(sizes[1] if sizes else asked.count(), math.ceil(BLOCKS / n))  # each block is sent once for each of the other kind
        dealt = asked.withColumn("low", own(m)).withColumn("high", every(n)).withColumn("asked", F.lit(True))
        dealt = dealt.unionByName(rows.withColumn("low", every(m)).withColumn("high", own(n)).withColumn("asked", F.lit(False)))
    dealt = dealt.repartitionByRange(min(n * (n + 1) // 2 if mutual else n * m, TASKS), "low", "high")  # by hash, pairs of blocks gather in few tasks

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        first = t.column("asked")
        x = fitting.Sides(t.filter(first), points, 1 + flip)
        y = x if mutual and t.column("low")[0] == t.column("high")[0] else fitting.Sides(t.filter(pc.invert(first)), points, 1 + flip)
        return fitting.fitting(x, y, error_max, conf.y_shift_max, conf.length_gap_max, mutual or both)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.Table.from_batches(list(batches)))

    return dealt.groupBy("low", "high").applyInArrow(each, "piece_id long, side int, other_piece long, other_side int, err double")


def keep_best(fits: DataFrame, factor: float = CONF.keep_within_best) -> DataFrame:
    """Fits within ``factor`` times the best of their side."""
    best = F.min("err").over(Window.partitionBy("piece_id", "side"))
    return fits.withColumn("best", best).where(F.col("err") <= factor * F.col("best")).drop("best")


def orphans(sides: DataFrame, fits: DataFrame) -> DataFrame:
    """Sides that are no edge and have no fit; they count as edges from then on."""
    return sides.where(~F.col("is_edge")).select("piece_id", F.col("side_index").alias("side")).join(fits, ["piece_id", "side"], "left_anti")


def without_fit(lines: DataFrame, error_max: float, conf: Conf = CONF) -> DataFrame:
    """(piece_id, side) of sides without any fit: ``orphans`` of all fits, of the lines of ``normal_lines``.

    Most sides have a fit among those with a like key, and one is enough; only the others are held against all.
    """
    points, n = conf.segments + 1, _blocks(lines.count())

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def run() -> pa.RecordBatch:
            x = fitting.Sides(pa.Table.from_batches(held), points, 2)
            found = fitting.some(x, error_max, conf.y_shift_max, conf.length_gap_max)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x.id[found]), pa.array(x.side[found])], names=["piece_id", "side"])

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 2 * SIDES:
                yield run()
                rows = 0
        if rows:
            yield run()

    inner = (F.col("chord") > 0) & (F.col("arc") > 0)
    found = None
    for key in KEYS:
        near = lines.where(inner).repartitionByRange(n, key).select(*LINES).mapInArrow(settled, "piece_id long, side int")
        found = near if found is None else found.unionByName(near)
    rest = staged(lines.select(*LINES).join(found.distinct(), ["piece_id", "side"], "left_anti"), "rest")
    return rest.select("piece_id", "side").join(line_errors(lines, error_max, conf, rest), ["piece_id", "side"], "left_anti")


def thousandths(err: Column) -> Column:
    return F.rint(err * 1000).cast("int")


def connectivity(fits: DataFrame) -> DataFrame:
    """(piece_id, fits_json): per piece four lists of [other, side, thousandths], best first."""
    lists = fits.groupBy("piece_id").agg(
        *[F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct(thousandths(F.col("err")).alias("e"), "other_piece", "other_side")))), lambda s: F.array(s["other_piece"], s["other_side"].cast("long"), s["e"].cast("long"))).alias(f"s{k}") for k in range(4)]
    )
    return lists.select("piece_id", F.to_json(F.array("s0", "s1", "s2", "s3")).alias("fits_json"))


def color_adjusted(fits: DataFrame, likeness: Column, conf: Conf = CONF) -> DataFrame:
    """Errors within the colour window are lowered by up to the discount, in proportion to a likeness of 0..1 (null counts as 0)."""
    like = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(likeness, F.lit(0.0))))
    return fits.withColumn("err", F.when(F.col("err") <= conf.color_window, F.col("err") * (1 - conf.color_discount * like)).otherwise(F.col("err")))


def continuity(band_a: Column, band_b: Column) -> Column:
    """Likeness of two colour bands in (0, 1]; 1 where one is missing or empty."""
    n = F.least(F.size(band_a), F.size(band_b))
    d = F.aggregate(F.zip_with(F.slice(band_a, F.lit(1), n), F.slice(band_b, F.lit(1), n), lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(band_a.isNull() | band_b.isNull() | (n == 0), F.lit(1.0)).otherwise(1 / (1 + d / n / 1000))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays; null for constant ones or different sizes."""
    sums = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    centred = lambda c: let(sums(c) / F.size(c), lambda m: F.transform(c, lambda x: x - m))

    def of(p: Column) -> Column:
        cov = sums(F.zip_with(p["a"], p["b"], lambda x, y: x * y))
        squares = [sums(F.transform(p[c], lambda x: x * x)) for c in "ab"]
        return let(F.struct(cov.alias("c"), squares[0].alias("a"), squares[1].alias("b")), lambda t: F.when((t["a"] > 0) & (t["b"] > 0), t["c"] / F.sqrt(t["a"] * t["b"])))

    return F.when(F.size(a) == F.size(b), let(F.struct(centred(a).alias("a"), centred(b).alias("b")), of))


def histogram_likeness(one: list[Column], two: list[Column]) -> Column:
    """Mean correlation over the channels both have; 0 without any."""
    r = F.array_compact(F.array(*[correlation(a, b) for a, b in zip(one, two)]))
    return F.when(F.size(r) == 0, F.lit(0.0)).otherwise(F.aggregate(r, F.lit(0.0), lambda acc, v: acc + v) / F.size(r))


def combined_score(err: Column, image: Column, color: Column | None = None) -> Column:
    """Half shape, three tenths picture, a fifth colour (1 where unknown)."""
    return 0.5 * F.greatest(F.lit(0.0), 1 - err / 10) + 0.3 * image + 0.2 * (F.lit(1.0) if color is None else color)


def top_matches(queries: DataFrame, targets: DataFrame, score: Column, query_id: str, target_id: str, n: int) -> DataFrame:
    """Each query's ``n`` best targets, a stated set of queries against all targets.

    The queries go to the targets in blocks of at most ``QUERIES``, so what is broadcast is bounded however many there are;
    every partition of targets keeps only its best of each query before the shuffle.
    """
    blocks = math.ceil(queries.count() / QUERIES) or 1
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), target_id)
    out = None
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == k)
        scored = targets.crossJoin(F.broadcast(part)).select(query_id, target_id, score.alias("score"))
        best = scored.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)
        out = best if out is None else out.unionByName(best)
    return out


def mutual_nearest(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """Pairs in which each is the other's nearest; ties to the smaller id."""
    fore = F.row_number().over(Window.partitionBy(a).orderBy(distance, b))
    back = F.row_number().over(Window.partitionBy(b).orderBy(distance, a))
    return pairs.withColumn("f", fore).where(F.col("f") == 1).join(pairs.withColumn("g", back).where(F.col("g") == 1).select(a, b), [a, b]).drop("f")


def hamming_pairs(rows: DataFrame, id_: str, code: str, below: int, bands: int = 16) -> DataFrame:
    """(a, b, distance) of 64-bit codes less than ``below`` apart.

    Fewer differing bits than bands leave at least one band equal, so joining on
    bands loses nothing; for wider radii all pairs are compared in blocks of the id's hash.
    """
    r = rows.where(F.col(code).isNotNull() & F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.col(code).alias("c"))
    width = 64 // bands
    if below <= bands:
        keyed = r.select("id", "c", F.posexplode(F.array(*[F.shiftrightunsigned("c", k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(bands)])).alias("band", "part"))
    else:
        n = 8
        block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
        keyed = r.select("id", "c", block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("o")).select("id", "c", F.least("own", "o").alias("band"), F.greatest("own", "o").alias("part"))
    a, b = keyed.alias("a"), keyed.alias("b")
    d = F.bit_count(F.col("a.c").bitwiseXOR(F.col("b.c")))
    on = (F.col("a.band") == F.col("b.band")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.id") < F.col("b.id")) & (d < below)
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.alias("distance")).distinct()


def same_shape(pieces: DataFrame, rmse: float, ratio: float) -> DataFrame:
    """(a, b, rot, total_rmse, n_matching) of pieces alike under one of four rotations.

    Only pieces of one signature meet, in numpy, block against block.  Sides that are edges in both are passed over; all others need a
    chord ratio of at least ``ratio`` (where both have length) and a profile error of at most ``rmse``.  The least total
    wins, then the first rotation.  Means over runs of the profiles bound the error from below, which is checked first, losing nothing.
    """
    return _alike(pieces, [(rmse, ratio)]).drop("stage")


def cascade(pieces: DataFrame, conf: Conf = CONF) -> DataFrame:
    """Strict matches as stage 1, and relaxed ones of pairs that had none as stage 2."""
    found = _alike(pieces, [(conf.strict_rmse, conf.strict_ratio), (conf.relaxed_rmse, conf.relaxed_ratio)])
    return found.select("a", "b", "rot", "total_rmse", "n_matching", "stage")


def _alike(pieces: DataFrame, limits: list[tuple[float, float]]) -> DataFrame:
    """The pairs of ``alike.alike`` over all signatures: a signature's pieces in blocks of about ``PIECES``, each pair of blocks a task's group."""
    groups = pieces.groupBy("n_flat", "types").agg(F.ceil(F.count(F.lit(1)) / PIECES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("piece_id"), F.col("blocks")).cast("int")
    rows = pieces.select("piece_id", "n_flat", "types", "is_edge", "chord", "profile").join(F.broadcast(groups), ["n_flat", "types"]).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def run(t: pa.Table) -> pa.Table:
        if t.column("low")[0] == t.column("high")[0]:
            found = alike.alike(alike.Pieces(t), None, limits)
        else:
            low = pc.equal(t.column("own"), t.column("low"))
            found = alike.alike(*[alike.Pieces(t.filter(half)) for half in (low, pc.invert(low))], limits)
        return pa.table(found)

    parted = rows.groupBy("n_flat", "types", "low", "high")
    return parted.applyInArrow(run, "a long, b long, stage int, rot int, total_rmse double, n_matching int")
