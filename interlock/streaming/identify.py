"""Identifying arriving pieces against a stored set, batch by batch.

The store is three Parquet tables in a folder: ``sides`` (normalised), ``fits`` and ``results``.  A micro-batch is joined
once with the store and itself (new against all before them), known pieces get a result, new ones are appended with the fits between
them and all others.  A batch that is delivered again after a failure is recognised by its number and replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from interlock.conf import Conf
from interlock.operators import match
from interlock.operators.board import first_open_cell, solve_boards
from interlock.session import exists, file_names, scratch_ends, staged

CONF = Conf()


def likeness(new: DataFrame, stored: DataFrame, error_max: float, conf: Conf = CONF) -> DataFrame:
    """(piece_id, other_piece, err): for each new piece the stored pieces, and those new ones whose turn came earlier, with a side of the same shape strictly under ``error_max``.

    New pieces take turns by batch_id (where there is one), then id.  Edges take no part.
    """
    turn = lambda k: F.struct(F.lit(k), *[c for c in ("batch_id", "piece_id") if c in new.columns])
    new, stored = new.withColumn("turn", turn(1)), stored.withColumn("turn", turn(0))
    rows = match.fit_errors(stored.unionByName(new), error_max, conf, among=new, flip=False, turn="turn").where(F.col("err") < error_max)
    return rows.groupBy("piece_id", "other_piece").agg(F.min("err").alias("err"))


def repeating(alike: DataFrame) -> DataFrame:
    """piece_id of new pieces that repeat an earlier new one which itself repeats none, as if they had come one by one.

    ``alike`` (piece_id, other_piece) links new pieces to earlier new ones.  In each round, pieces without open links are new and settle all that link to them.
    """
    left, found = alike.select("piece_id", "other_piece"), alike.select("piece_id").limit(0)
    while not (left := staged(left, "open")).isEmpty():
        first = left.select("other_piece").distinct().join(left.select(F.col("piece_id").alias("other_piece")), "other_piece", "left_anti")
        known = staged(left.join(first, "other_piece", "left_semi").select("piece_id").distinct(), "repeating")
        found = found.unionByName(known)
        left = left.join(known, "piece_id", "left_anti").join(known.withColumnRenamed("piece_id", "other_piece"), "other_piece", "left_anti")
    return found


def identified(new: DataFrame, stored: DataFrame, error_max: float = CONF.known_error, conf: Conf = CONF) -> DataFrame:
    """(piece_id, status, known_id, confidence): 'known' with 1 - err / limit, else 'new_unsolved' with a half.

    New pieces are held against what is stored and against the unknown among the new ones before them, so the
    result is that of one piece at a time.  The most similar one counts; ties go to the smaller id.
    """
    pairs = staged(likeness(new, stored, error_max, conf), "alike")
    ids = stored.select(F.col("piece_id").alias("other_piece")).distinct()
    by_store, among = pairs.join(ids, "other_piece", "left_semi"), pairs.join(ids, "other_piece", "left_anti")
    settled = by_store.select("piece_id").distinct()
    as_other = lambda df: df.withColumnRenamed("piece_id", "other_piece")
    among = among.join(as_other(settled), "other_piece", "left_anti")
    among = among.join(as_other(repeating(among.join(settled, "piece_id", "left_anti"))), "other_piece", "left_anti")
    best = by_store.unionByName(among).groupBy("piece_id").agg(F.min(F.struct("err", F.col("other_piece").alias("known_id"))).alias("m"))
    found = new.select("piece_id").distinct().join(best.select("piece_id", "m.known_id", "m.err"), "piece_id", "left")
    known = F.col("known_id").isNotNull()
    return found.select("piece_id", F.when(known, "known").otherwise("new_unsolved").alias("status"), "known_id", F.when(known, 1 - F.col("err") / error_max).otherwise(0.5).alias("confidence"))


class Store:
    """Pieces seen so far and the fits between them."""

    def __init__(self, spark: SparkSession, path: str, error_max: float = CONF.known_error, fit_max: float = CONF.fit_error_max, conf: Conf = CONF) -> None:
        self.spark, self.path, self.error_max, self.fit_max, self.conf = spark, path, error_max, fit_max, conf

    def table(self, name: str, like: DataFrame | None = None) -> DataFrame | None:
        at = f"{self.path}/{name}"
        if not exists(self.spark, at):
            return like.limit(0) if like is not None else None
        return self.spark.read.parquet(at)

    def ingest(self, sides: DataFrame, batch: int) -> None:
        """One batch of normalised sides; the same batch number again replaces what it wrote."""
        new = sides.persist()
        try:
            stored = self.table("sides", new.withColumn("batch", F.lit(batch)))
            stored = stored.where(F.col("batch") != batch).drop("batch")
            results = identified(new, stored, self.error_max, self.conf)
            self._write(results, "results", batch)
            unknown = self.spark.read.parquet(f"{self.path}/results/batch={batch}").where("status <> 'known'").select("piece_id")
            fresh = new.join(unknown, "piece_id", "left_semi")
            self._write(fresh, "sides", batch)
            lines = staged(match.lines_of(self.spark.read.parquet(f"{self.path}/sides/batch={batch}")), "fresh")
            own = match.line_errors(lines, self.fit_max, self.conf)
            sizes = [match.side_count(stored), lines.count()]
            other = match.line_errors(match.lines_of(stored), self.fit_max, self.conf, among=lines, both=True, sizes=sizes)  # each pair looked at once
            self._write(own.unionByName(other), "fits", batch)
        finally:
            new.unpersist()

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def remove(self, piece: int) -> DataFrame:
        """Take a piece out of sides, fits and results for good; the sides that stay.

        Only the batches it occurs in are written again, each beside the old one and then in its place.
        """
        gone = {"sides": F.col("piece_id") == piece, "results": F.col("piece_id") == piece, "fits": (F.col("piece_id") == piece) | (F.col("other_piece") == piece)}
        for name, hit in gone.items():
            if (table := self.table(name)) is None:
                continue
            for (batch,) in table.where(hit).select("batch").distinct().collect():
                at = f"{self.path}/{name}/batch={batch}"
                kept = staged(table.where((F.col("batch") == batch) & ~hit).drop("batch"), "kept")
                kept.write.mode("overwrite").parquet(at)
        return self.table("sides")

    def edge_info(self) -> DataFrame:
        """(piece_id, is_edge, is_corner): whether a stored piece has a flat side, and more than one."""
        n = self.table("sides").groupBy("piece_id").agg(F.sum(F.col("is_edge").cast("int")).alias("n"))
        return n.select("piece_id", (F.col("n") > 0).alias("is_edge"), (F.col("n") > 1).alias("is_corner"))

    # -- the solved board, board_id 0

    def _solution(self) -> tuple[DataFrame, DataFrame] | None:
        names = [n for n in file_names(self.spark, f"{self.path}/solution") if n.startswith("v")]
        if not names:
            return None
        at = f"{self.path}/solution/{names[-1]}"
        return self.spark.read.parquet(f"{at}/placed"), self.spark.read.parquet(f"{at}/size")

    def load_solution(self, placed: DataFrame, width: int, height: int) -> None:
        """Keep (piece_id, x, y, orientation) of a solved board as the newest solution."""
        at = f"{self.path}/solution/v{len(file_names(self.spark, f'{self.path}/solution')):09d}"
        self.spark.createDataFrame([(width, height)], "width int, height int").write.parquet(f"{at}/size")
        placed.select("piece_id", "x", "y", "orientation").write.parquet(f"{at}/placed")

    def position_of(self, piece: int) -> tuple[int, int, int] | None:
        """(x, y, orientation) of a piece in the newest solution."""
        found = self._solution()
        row = found[0].where(F.col("piece_id") == piece).first() if found else None
        return (row["x"], row["y"], row["orientation"]) if row else None

    def piece_at(self, x: int, y: int) -> int | None:
        """The piece in a cell of the newest solution."""
        found = self._solution()
        row = found[0].where((F.col("x") == x) & (F.col("y") == y)).first() if found else None
        return row["piece_id"] if row else None

    def solve(self, width: int, height: int) -> bool:
        """Solve the board of all stored pieces from the stored fits; whether it is whole.  A partial board is kept too."""
        one = F.lit(0).cast("long").alias("board_id")
        pieces = self.table("sides").select(one, "piece_id").distinct()
        fits = self.table("fits").select(one, "piece_id", "side", "other_piece", "other_side", "err")
        sizes = self.spark.createDataFrame([(0, width, height)], "board_id long, width int, height int")
        placed = staged(solve_boards(pieces, fits, sizes), "solved")
        self.load_solution(placed, width, height)
        return placed.where("complete").count() == width * height

    def insert(self, piece: int) -> tuple[int, int, int] | None:
        """Put a stored piece into the first empty cell of the newest solution where it can lie; None if there is none.  What is read is one board."""
        found = self._solution()
        if found is None:
            return None
        placed, (width, height) = found[0], found[1].first()
        lists: dict[int, tuple[list, ...]] = {piece: ([], [], [], [])}
        for r in self.table("fits").where(F.col("piece_id") == piece).collect():  # the fits of one piece
            lists[piece][r["side"]].append((r["other_piece"], r["other_side"], r["err"]))
        board = {(r["x"], r["y"]): (r["piece_id"], r["orientation"]) for r in placed.collect()}  # one board
        spot = first_open_cell(board, lists, piece, width, height)
        if spot is not None:
            new = self.spark.createDataFrame([(piece, *spot)], "piece_id long, x int, y int, orientation int")
            self.load_solution(staged(placed.unionByName(new), "placed"), width, height)
        return spot

    def place_new(self, piece: int, width: int, height: int) -> str:
        """'new_solved' if a new piece can be inserted into the solution or, without one, the board be solved with it; else 'new_unsolved'."""
        if self._solution() is not None:
            return "new_solved" if self.insert(piece) is not None else "new_unsolved"
        enough = self.table("sides").select("piece_id").distinct().limit(4).count() >= 4 and self.table("fits") is not None
        return "new_solved" if enough and self.solve(width, height) else "new_unsolved"

    def next_id(self) -> int:
        return (self.table("sides").agg(F.max("piece_id")).first()[0] or 0) + 1

    def completeness(self, expected: int) -> tuple[int, bool]:
        n = self.table("sides").select("piece_id").distinct().count()
        return max(0, expected - n), n >= expected

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Identify a stream of normalised sides: what is there now, or with ``every`` (an interval) frame by frame until stopped."""

        def ingest(df: DataFrame, k: int) -> None:
            with scratch_ends(self.spark):  # a stream that keeps running must not fill the disk
                self.ingest(df, k)

        out = stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if every is None else out.trigger(processingTime=every)).start()


def color_verified(results: DataFrame, new_colors: DataFrame, stored_colors: DataFrame, least: float = CONF.color_min) -> DataFrame:
    """Identifications whose colours agree: known pieces whose histograms (piece_id, overall_histogram) are too unlike become 'new_unsolved'.

    Where either has no colours the identification stands.
    """
    a, b = new_colors.select("piece_id", F.col("overall_histogram").alias("ha")), stored_colors.select(F.col("piece_id").alias("known_id"), F.col("overall_histogram").alias("hb"))
    j = results.join(a, "piece_id", "left").join(b, "known_id", "left")
    like = match.histogram_likeness([F.col(f"ha.{c}") for c in "hsv"], [F.col(f"hb.{c}") for c in "hsv"])
    bad = (F.col("status") == "known") & F.coalesce(F.when(F.col("ha").isNotNull() & F.col("hb").isNotNull(), like <= least), F.lit(False))
    return j.select("piece_id", F.when(bad, "new_unsolved").otherwise(F.col("status")).alias("status"), F.when(~bad, F.col("known_id")).alias("known_id"), F.when(bad, F.lit(0.5)).otherwise(F.col("confidence")).alias("confidence"))


def arrivals(sides: DataFrame, at: str = "ingested_at") -> DataFrame:
    """Arrival order of pieces: when a piece is first and last delivered, and in how many rows."""
    g = sides.where(F.col("piece_id").isNotNull()).groupBy("piece_id").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n_rows"))
    return g.withColumn("arrival_no", F.row_number().over(Window.partitionBy(F.to_date("first_at")).orderBy("first_at", "piece_id")))


