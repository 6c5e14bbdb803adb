"""Queries that SQL can't say: board search, layout, identification of arriving pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interlock.operators import board, sides
from interlock.operators.layout import layout
from interlock.plans.registry import Registry
from interlock.session import read_table, scratch, staged, timed_by_name
from interlock.streaming.identify import Store, arrivals

REGISTRY = Registry()


@REGISTRY.query()
def board_solve(spark: SparkSession, base: str) -> DataFrame:
    """A generated board for each nation, as large as its number of customers asks for, solved from its listed fits."""
    from interlock.operators.stats import grid_by_count

    c = read_table(spark, base, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    grids = grid_by_count(spark, c, "n").select(F.col("c_nationkey").cast("long").alias("board_id"), "width", "height").where("width > 1 and height > 1")

    def make(pdf):
        import pandas as pd

        k, w, h = (int(pdf[c].iloc[0]) for c in ("board_id", "width", "height"))
        return pd.DataFrame([(k, *f) for f in board.generated_puzzle(w, h, k)[0]], columns=["board_id", "piece_id", "side", "other_piece", "other_side", "err"])

    fits = staged(board.spread(grids, "board_id").groupBy("board_id").applyInPandas(make, "board_id long, piece_id long, side int, other_piece long, other_side int, err double"), "puzzles")
    return board.solve_boards(fits.select("board_id", "piece_id").distinct(), fits, grids)


@REGISTRY.query()
def board_layout(spark: SparkSession, base: str) -> DataFrame:
    """Where the pieces of each batch go if laid row by row."""
    from interlock.plans.report_queries import _board

    placed, sizes = _board(spark, base)
    s = read_table(spark, base, "sides").where("size(vertices) >= 2 and incenter is not null and piece_id is not null")
    one = s.groupBy("piece_id", "side_index").agg(F.first("vertices").alias("vertices"), F.first("incenter").alias("incenter"))
    out = layout(placed, one, sizes)
    return out.select("board_id", "piece_id", "x", "y", *[F.round(c, 3).alias(c) for c in ("dest_x", "dest_y", "turn")])


@REGISTRY.query()
def stream_identify(spark: SparkSession, base: str) -> DataFrame:
    """Every usable piece, streamed in through files in order of batches and identified against those before it."""
    n = sides.normalised(sides.distinct_sides(read_table(spark, base, "sides"))).select("piece_id", "side_index", "is_edge", "arc_len", "chord_len", "v", "vf", "batch_id")
    src = scratch(spark, "arriving")
    n.repartitionByRange(4, "batch_id").write.parquet(src)
    timed_by_name(spark, src)
    store = Store(spark, scratch(spark, "store"), error_max=0.15, fit_max=0.5)
    stream = spark.readStream.schema(n.schema).option("maxFilesPerTrigger", 1).parquet(src)
    store.start(stream, scratch(spark, "stream-state")).awaitTermination()
    return store.table("results").select("piece_id", "status", "known_id", F.round("confidence", 4).alias("confidence"))


@REGISTRY.query(
    """WITH g AS (SELECT piece_id, min(ingested_at) AS first_at, max(ingested_at) AS last_at, count(*) AS n_rows FROM sides WHERE piece_id IS NOT NULL GROUP BY 1)
SELECT *, row_number() OVER (PARTITION BY first_at::DATE ORDER BY first_at, piece_id)::INTEGER AS arrival_no FROM g"""
)
def piece_arrivals(spark: SparkSession, base: str) -> DataFrame:
    """When each piece came first and last, numbered within its day."""
    return arrivals(read_table(spark, base, "sides"))
