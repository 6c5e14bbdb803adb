"""Report statistics: histograms, gaps, threshold sweeps, outliers, grid sizes, boards as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, width: float, by: list[str] | None = None) -> DataFrame:
    """(by, bin, low, n): half-open bins of ``width``; nulls count in none."""
    bin_ = F.floor(F.col(value) / width)
    return df.where(F.col(value).isNotNull()).groupBy(*(by or []), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.col("bin") * width)


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, extremes, mean, median and deciles per group.

    Equal values are counted first, map-side, so a group comes to one task as its distinct values with their numbers.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    at = lambda p: F.percentile("v", F.lit(p), F.col("k"))
    return counted.groupBy(*by).agg(
        F.sum("k").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), (F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"), at(0.5).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90")
    )


def widest_gaps(df: DataFrame, value: str, n: int, by: str) -> DataFrame:
    """Per group the ``n`` widest gaps between neighbouring values; repeats of a value are neighbours without a gap.

    Only distinct values are put in order; of their repeats, ``n`` stand for all.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("above")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(by).orderBy("above")
    between = counted.select(by, "above", F.lag("above").over(w).alias("below")).where(F.col("below").isNotNull())
    repeats = counted.where(F.col("k") > 1).select(by, "above", F.col("above").alias("below"), F.explode(F.sequence(F.lit(1), F.least(F.col("k") - 1, F.lit(n).cast("long")))).alias("i")).drop("i")
    r = Window.partitionBy(by).orderBy(F.desc("gap"), "below", "above")
    gaps = between.unionByName(repeats).withColumn("gap", F.col("above") - F.col("below"))
    return gaps.withColumn("rank_no", F.row_number().over(r)).where(F.col("rank_no") <= n)


def gap_clusters(df: DataFrame, value: Column, by: str, gap: float) -> DataFrame:
    """(by, cluster, n, low, high): runs of values no more than ``gap`` apart."""
    w = Window.partitionBy(by).orderBy("v")
    rows = df.select(by, value.alias("v")).where(F.col("v").isNotNull() & F.col(by).isNotNull())
    new = F.when(F.col("v") - F.lag("v").over(w) > gap, 1).otherwise(0)
    runs = rows.withColumn("new", new).withColumn("cluster", F.sum("new").over(w))
    return runs.groupBy(by, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def threshold_sweep(df: DataFrame, value: str, label: str, low: int, high: int, step: int, unit: float) -> DataFrame:
    """(threshold, confirmed_below, rejected_above, wrong) over a grid of thresholds.

    Values are first counted by the grid cell they fall in, so the sweep is a running sum over
    cells, not a join of every row with every threshold.
    """
    live = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    cell = F.least(F.lit(high + step), F.greatest(F.lit(low), low + step * (F.floor((F.round(F.col(value) / unit, 6) - low) / step).cast("int") + 1)))
    counts = live.groupBy(cell.alias("t")).agg(F.sum(F.col(label).cast("long")).alias("yes"), F.sum((~F.col(label)).cast("long")).alias("no"))
    grid = df.sparkSession.range(low, high + 2 * step, step).select(F.col("id").cast("int").alias("t"))
    full = grid.join(counts, "t", "left").fillna(0, ["yes", "no"])
    below = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy("t").rowsBetween(1, Window.unboundedFollowing)
    s = full.select("t", F.sum("yes").over(below).alias("confirmed_below"), F.coalesce(F.sum("no").over(above), F.lit(0)).alias("rejected_above"))
    return s.where(F.col("t") <= high).select((F.col("t") * unit).alias("threshold"), "confirmed_below", "rejected_above", (F.col("confirmed_below") + F.col("rejected_above")).alias("wrong"))


def size_outliers(df: DataFrame, value: str, by: str, id_: str, high: float, low: float) -> DataFrame:
    """Rows whose value is over ``high`` or under ``low`` times their group's median."""
    m = df.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    r = F.col(value) / F.col("median")
    return df.join(m, by).where((r > high) | (r < low)).select(id_, by, value, "median", F.when(r > high, "large").otherwise("small").alias("kind"))


def quality_tags(df: DataFrame, rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null."""
    out = None
    for n, c in rules:
        out = F.when(c, F.lit(n)) if out is None else out.when(c, F.lit(n))
    return out


def grid_by_count(spark: SparkSession, counts: DataFrame, n: str) -> DataFrame:
    """Adds width and height that come nearest to ``n`` pieces: least |w - h| + 0.1 * (w h - n) with w h >= n and w >= h.

    Heights up to the square root and two more are tried, each with the least width that will do; beyond that the score only grows.
    """
    total = F.greatest(F.col(n), F.lit(0)).cast("long")
    heights = F.sequence(F.lit(1).cast("long"), F.floor(F.sqrt(total)).cast("long") + 2)

    def size(h: Column) -> Column:
        w = F.greatest(h, F.ceil(total / h).cast("long"))
        return F.struct(F.round(w - h + 0.1 * (w * h - F.col(n)), 6).alias("s"), w.cast("int").alias("w"), h.cast("int").alias("h"))

    best = counts.withColumn("m", F.array_min(F.transform(heights, size)))
    return best.select(*counts.columns, F.col("m.w").alias("width"), F.col("m.h").alias("height"))


def grid_by_edges(spark: SparkSession, counts: DataFrame, total: str, edges: str, limit: int = 200) -> DataFrame:
    """Adds width and height with w h = total and a border of about ``edges`` pieces (within 2); the nearest border, then the squarest.

    Without such a size, the square root rounded down and what it needs beside it.
    """
    sizes = spark.range(2, limit + 1).select(F.col("id").cast("int").alias("w"))
    grid = sizes.crossJoin(sizes.select(F.col("w").alias("h"))).where("w >= h")
    off = F.abs(2 * (F.col("w") + F.col("h")) - 4 - F.col(edges))
    near = counts.join(F.broadcast(grid), (F.col("w") * F.col("h") == F.col(total)) & (off <= 2))
    key = list(counts.columns)
    best = near.groupBy(*key).agg(F.min(F.struct(off.alias("o"), (F.col("w") - F.col("h")).alias("d"), "w", "h")).alias("m"))
    root = F.greatest(F.lit(1), F.floor(F.sqrt(F.col(total)))).cast("int")
    return counts.join(best, key, "left").select(*key, F.coalesce("m.w", F.ceil(F.col(total) / root).cast("int")).alias("width"), F.coalesce("m.h", root).alias("height"))


def missing_cells(spark: SparkSession, placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cells (board_id, x, y) without a piece."""
    grid = sizes.select("board_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), "width").select("board_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    return grid.join(placed, ["board_id", "x", "y"], "left_anti").select("board_id", "x", "y")


def solution_quality(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per board: pieces placed, share of cells filled, share of right and down neighbours (inside the board) that are placed."""
    p = placed.join(sizes, "board_id")
    right = F.lead("x").over(Window.partitionBy("board_id", "y").orderBy("x"))
    down = F.lead("y").over(Window.partitionBy("board_id", "x").orderBy("y"))
    n = p.select("board_id", "width", "height", (F.col("x") + 1 < F.col("width")).cast("int").alias("r"), (F.col("y") + 1 < F.col("height")).cast("int").alias("d"), F.coalesce((right == F.col("x") + 1).cast("int"), F.lit(0)).alias("rm"), F.coalesce((down == F.col("y") + 1).cast("int"), F.lit(0)).alias("dm"))
    g = n.groupBy("board_id", "width", "height").agg(F.count(F.lit(1)).alias("n_placed"), F.sum(F.col("r") + F.col("d")).alias("possible"), F.sum(F.col("rm") + F.col("dm")).alias("matched"))
    return g.select("board_id", "n_placed", (F.col("n_placed") / (F.col("width") * F.col("height"))).alias("coverage"), "possible", "matched", F.when(F.col("possible") > 0, F.col("matched") / F.col("possible")).otherwise(0.0).alias("quality"))


def cell_class(x: Column, y: Column, w: Column, h: Column) -> Column:
    """corner, edge or inner."""
    ex, ey = (x == 0) | (x == w - 1), (y == 0) | (y == h - 1)
    return F.when(ex & ey, "corner").when(ex | ey, "edge").otherwise("inner")


def assembly_order(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Steps of putting a board together: corners, edges, then the inside, row by row, with the ids of the four neighbours."""
    p = placed.join(sizes, "board_id").withColumn("class", cell_class(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
    rank = F.when(F.col("class") == "corner", 0).when(F.col("class") == "edge", 1).otherwise(2)
    out = p.withColumn("step", F.row_number().over(Window.partitionBy("board_id").orderBy(rank, "y", "x")))
    row, col = Window.partitionBy("board_id", "y").orderBy("x"), Window.partitionBy("board_id", "x").orderBy("y")
    for name, f, w, c, d in (("left_id", F.lag, row, "x", -1), ("right_id", F.lead, row, "x", 1), ("top_id", F.lag, col, "y", -1), ("bottom_id", F.lead, col, "y", 1)):
        out = out.withColumn(name, F.when(f(c).over(w) == F.col(c) + d, f("piece_id").over(w)))
    turn = F.element_at(F.array(*[F.lit(t) for t in ("as it lies", "a quarter turn clockwise", "half a turn", "a quarter turn anticlockwise")]), F.col("orientation") + 1)
    return out.select("board_id", "step", "piece_id", "x", "y", "class", turn.alias("turn"), "left_id", "right_id", "top_id", "bottom_id")


def grid_text(placed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(board_id, y, line): each row of a board as text, piece id and an arrow a cell, '-' where empty."""
    width = F.length(F.max(F.col("piece_id")).over(Window.partitionBy("board_id")).cast("string"))
    arrow = F.element_at(F.array(*[F.lit(a) for a in "^>v<"]), F.col("orientation") + 1)
    cells = placed.withColumn("pad", width).withColumn("cell", F.concat(F.lpad(F.col("piece_id").cast("string"), 12, " "), arrow))
    grid = sizes.select("board_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y")).select("board_id", "y", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    pads = cells.groupBy("board_id").agg(F.max("pad").alias("pad"))
    full = grid.join(F.broadcast(pads), "board_id").join(cells.select("board_id", "x", "y", "cell"), ["board_id", "x", "y"], "left")
    text = F.coalesce(F.expr("right(cell, pad + 1)"), F.concat(F.expr("repeat(' ', pad)"), F.lit("-")))
    rows = full.groupBy("board_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", text.alias("c")))).alias("cells"))
    return rows.select("board_id", "y", F.array_join(F.transform("cells", lambda s: s["c"]), " ").alias("line"))


def spacing(placed: DataFrame, gap_x: float, gap_y: float) -> DataFrame:
    """Places moved apart: a linear map of the cell added to the destination."""
    return placed.withColumn("dest_x", F.col("dest_x") + F.col("x") * gap_x).withColumn("dest_y", F.col("dest_y") + F.col("y") * gap_y)
