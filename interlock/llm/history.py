"""Deduplicating new batches against all accepted history.

A piece is turned into a set of shape tokens (which sides they come from doesn't
matter, so any cyclic shift gives the same set), the set into minwise values, and
those into band keys.  The keys of accepted pieces are kept on disk, partitioned
by hash, each with a signature; outlines lie in tables beside them, partitioned by the pieces' hash.  A delivery probes only
the partitions its own keys fall into, fetches only the outlines of candidates, verifies them exactly, and appends what
it accepts.  History is never compared with itself.

The history is a list of runs.  A delivery is one run; ``FANOUT`` runs of a level are merged into one of the next.  A run has
as many partitions as keep each near ``ROWS_PER_PART`` rows, so what a delivery reads is bounded by its own keys, times
the size of a partition, times the number of runs (a logarithm of the deliveries), and not by the history.

A run counts from the moment the manifest names it: a delivery takes effect at once or not at all.  A delivery
with a name is ingested once; given again it returns what it returned, and what a broken try left is overwritten.

The signature holds the four sides' mean heights, sorted, as 16-bit numbers.  Sides at distance d
differ by at most d / sqrt(27) in it, so comparing signatures loses no pair.

Within a bucket a newcomer is first held against the bucket's leader (its earliest
member) alone, which settles repeats of any number in linear work.  Only those not settled
meet the remaining members, and of these only members whose signature lies in the same or a neighbouring cell.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from interlock.functions.outline import POINTS, side_distance, side_vectors
from interlock.operators.pieces import SIDES
from interlock.session import file_names, read_text, remove, scratch, scratch_ends, staged, write_text

BANDS, ROWS = 16, 6
#: Cell width of a token's coordinates, and how far along the side its second height lies.
CELL, APART = 0.15, 8
#: Share of a cell by which the grid is moved off zero, where edges lie.
SHIFT = 0.37
SCALE = 8192
#: Rows of a partition of a run (keys, or pieces), the most partitions of one, and how many runs of a level are merged.
ROWS_PER_PART, MOST_PARTS, FANOUT = 1_000_000, 1 << 16, 8
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit over all others."""
    x = x + np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def tokens(vectors: np.ndarray) -> np.ndarray:
    """Hashed shape tokens (n, 4 * 25) of pieces' side vectors (n, 4, 54)."""
    p = np.floor(vectors.reshape(len(vectors), SIDES, POINTS, 2) / CELL + SHIFT).astype(np.int64)
    inner = POINTS - 2
    j = np.arange(inner)
    h = _mix((p[:, :, 1 + j, 1] * 1000003 + j).view(np.uint64))
    h = _mix(h ^ p[:, :, 1 + (j + APART) % inner, 1].view(np.uint64))
    h = _mix(h ^ p[:, :, 1 + j, 0].view(np.uint64))
    return h.reshape(len(vectors), -1)


def band_keys(hashed: np.ndarray) -> np.ndarray:
    """Band keys (n, BANDS): each hashes ROWS minwise values and the band's number."""
    factors = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.empty((len(hashed), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(hashed), band, np.uint64)
        for f in factors[band * ROWS : (band + 1) * ROWS]:
            key = _mix(key ^ (hashed * f).min(axis=1))
        out[:, band] = key
    return out.view(np.int64)


def signatures(vectors: np.ndarray) -> np.ndarray:
    """Sorted mean heights of the four sides in one 64-bit number."""
    mean = np.sort(vectors.reshape(len(vectors), SIDES, POINTS, 2)[..., 1].mean(axis=2), axis=1)
    q = (np.clip(np.floor(mean * SCALE), -32768, 32767) + 32768).astype(np.uint64)
    return (q << (np.arange(SIDES, dtype=np.uint64) * np.uint64(16))).sum(axis=1, dtype=np.uint64).view(np.int64)


def close_signatures(a: Column, b: Column, distance: float) -> Column:
    """Whether two signatures allow all four sides to be within ``distance``."""
    slack = int(np.ceil(distance / np.sqrt(POINTS) * SCALE)) + 1
    ok = F.lit(True)
    for k in range(SIDES):
        x, y = (F.shiftrightunsigned(c, 16 * k).bitwiseAND(F.lit(65535)) for c in (a, b))
        ok &= F.abs(x - y) <= slack
    return ok


def keyed(pieces: DataFrame) -> DataFrame:
    """(piece_id, batch_id, outlines, sig, keys) of pieces; a piece with a side without
    length (first vertex = last) has no keys and is never the same as another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = side_vectors(batch.column("outlines").flatten().to_pylist()).reshape(-1, SIDES, 2 * POINTS)
            fine = ~np.isnan(vectors).any(axis=(1, 2))
            vectors = np.where(fine[:, None, None], vectors, 0)
            keys = band_keys(tokens(vectors))
            offsets = np.concatenate([[0], np.cumsum(np.where(fine, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("piece_id", "batch_id", "outlines")), pa.array(signatures(vectors)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[fine].ravel()))],
                names=["piece_id", "batch_id", "outlines", "sig", "keys"],
            )

    return pieces.select("piece_id", "batch_id", "outlines").mapInArrow(run, "piece_id long, batch_id long, outlines array<binary>, sig long, keys array<long>")


def _cells(sig: Column, distance: float, around: bool) -> Column:
    """Cells of the first two heights of a signature, as one number; with ``around`` all cells a close signature may lie in."""
    width = int(np.ceil(distance / np.sqrt(POINTS) * SCALE)) + 2
    x, y = (F.floor(F.shiftrightunsigned(sig, 16 * k).bitwiseAND(F.lit(65535)) / width) for k in (0, 1))
    steps = (-1, 0, 1) if around else (0,)
    return F.array(*[((x + i) * 65536 + y + j).cast("long") for i in steps for j in steps])


def same_pieces(pairs: DataFrame, new: DataFrame, pieces: DataFrame, distance: float) -> DataFrame:
    """Of ``pairs`` (x, y, ...), those whose sides are within ``distance`` under one cyclic shift; outlines of x come from ``new``, of y from ``pieces``."""
    left = new.select(F.col("piece_id").alias("x"), F.col("outlines").alias("ox"))
    right = pieces.select(F.col("piece_id").alias("y"), F.col("outlines").alias("oy"))
    kept = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = [*batch.column("ox").flatten().to_pylist(), *batch.column("oy").flatten().to_pylist()]
            known: dict[bytes, int] = {}
            at = np.array([known.setdefault(o, len(known)) for o in flat])
            v = side_vectors(list(known))[at].reshape(2, n, SIDES, 2 * POINTS)
            ok = np.zeros(n, bool)
            for shift in range(SIDES):
                d = side_distance(v[0][:, (np.arange(SIDES) + shift) % SIDES], v[1])
                ok |= (d <= distance).all(axis=1)
            yield batch.select(kept).filter(pa.array(ok))

    return pairs.join(left, "x").join(right, "y").select(*kept, "ox", "oy").mapInArrow(run, pairs.schema)


class History:
    """The accepted pieces of all deliveries so far, in a folder of their own, with one writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None, distance: float = 0.06) -> None:
        self.spark, self.path, self.distance = spark, path or scratch(spark, "history"), distance
        #: Partitions of the history the last delivery read, keys and outlines.
        self.partitions_read = 0

    # -- the list of runs

    def _state(self) -> tuple[int, dict]:
        names = [n for n in file_names(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        return (int(names[-1][:-5]), json.loads(read_text(self.spark, f"{self.path}/manifest/{names[-1]}"))) if names else (0, {"runs": [], "done": []})

    def _commit(self, number: int, state: dict) -> None:
        write_text(self.spark, f"{self.path}/manifest/{number:012d}.json", json.dumps(state))

    def accepted(self) -> DataFrame:
        """(piece_id, batch_id, sig, outlines) of all accepted pieces."""
        out = self.spark.createDataFrame([], _PIECE)
        for run in self._state()[1]["runs"]:
            out = out.unionByName(self._table(run, "pieces"))
        return out

    def _table(self, run: dict, name: str) -> DataFrame:
        schema = f"{_PIECE if name == 'pieces' else _BAND}, part int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/runs/{run['name']}/{name}").drop("part")

    def _write(self, name: str, level: int, pieces: DataFrame, bands: DataFrame) -> dict:
        at = f"{self.path}/runs/{name}"
        pieces, bands = staged(pieces, "run-pieces"), staged(bands, "run-bands")
        run = {"name": name, "level": level, "pieces": _parts(pieces.count()), "bands": _parts(bands.count())}
        for table, df, key in (("pieces", pieces, "piece_id"), ("bands", bands, "key")):
            # rebalanced, so that a partition with a hot key is written by several tasks
            laid = df.withColumn("part", _part(key, run[table])).hint("rebalance", "part").sortWithinPartitions("part", key)
            laid.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(f"{at}/{table}")
        return run

    def _probe(self, table: str, key: str, wanted: DataFrame) -> DataFrame | None:
        """Rows of all runs whose ``key`` is among ``wanted`` (a table of one column of that name), from the partitions it can lie in."""
        runs = self._state()[1]["runs"]
        if not runs:
            return None
        most = max(r[table] for r in runs)
        hit = [r[0] for r in wanted.select(_part(key, most)).distinct().collect()]  # at most MOST_PARTS numbers
        out = None
        for run in runs:
            parts = sorted({p % run[table] for p in hit})  # counts are powers of two
            schema = f"{_PIECE if table == 'pieces' else _BAND}, part int"
            df = self.spark.read.schema(schema).parquet(f"{self.path}/runs/{run['name']}/{table}").where(F.col("part").isin(parts))
            self.partitions_read += len(parts)
            out = df.drop("part") if out is None else out.unionByName(df.drop("part"))
        return out.join(wanted, key, "left_semi")

    # -- deliveries

    def ingest(self, pieces: DataFrame, delivery: str | None = None) -> DataFrame:
        """(x, y): each piece of the delivery that repeats an accepted piece of an earlier batch, and that piece.

        ``pieces`` has piece_id, batch_id and outlines.  A delivery may hold any
        number of batches, later ones than all before.  What repeats
        nothing is accepted and appended.  If several accepted pieces are alike, one
        is given, of the earliest batch and the smallest id among those found.
        Pieces with a null id or batch are neither cases nor accepted; an empty delivery changes nothing.
        A named ``delivery`` takes effect once, however often it is given.
        """
        name = delivery or uuid.uuid4().hex
        number, state = self._state()
        out = f"{self.path}/cases/{name}"
        if name not in state["done"]:
            self.partitions_read = 0
            with scratch_ends(self.spark):
                new = staged(keyed(pieces.where(F.col("piece_id").isNotNull() & F.col("batch_id").isNotNull())), "keyed")
                bands = new.select("piece_id", "batch_id", "sig", F.explode("keys").alias("key"))
                self._cases(new, bands).write.mode("overwrite").parquet(out)
                accepted = new.join(self.spark.read.schema(_CASE).parquet(out).select(F.col("x").alias("piece_id")), "piece_id", "left_anti")
                if not accepted.isEmpty():
                    run = self._write(name, 0, accepted.select("piece_id", "batch_id", "sig", "outlines"), bands.join(accepted.select("piece_id"), "piece_id", "left_semi"))
                    state["runs"].append(run)
            state["done"].append(name)
            self._commit(number + 1, state)
            self._merge()
        return self.spark.read.schema(_CASE).parquet(out)

    def _merge(self) -> None:
        """Merge the runs of a level while it has ``FANOUT``; each row is written once more a level."""
        while True:
            number, state = self._state()
            level = next((k for k in {r["level"] for r in state["runs"]} if sum(r["level"] == k for r in state["runs"]) >= FANOUT), None)
            if level is None:
                return
            old = [r for r in state["runs"] if r["level"] == level]
            both = []
            for table in ("pieces", "bands"):
                df = self._table(old[0], table)
                for r in old[1:]:
                    df = df.unionByName(self._table(r, table))
                both.append(df)
            with scratch_ends(self.spark):
                run = self._write(f"merged-{uuid.uuid4().hex}", level + 1, *both)
            state["runs"] = [r for r in state["runs"] if r["level"] != level] + [run]
            self._commit(number + 1, state)
            for r in old:
                remove(self.spark, f"{self.path}/runs/{r['name']}")

    def _outlines(self, new: DataFrame, pairs: DataFrame) -> DataFrame:
        """(piece_id, outlines) of all y: of the delivery itself, and fetched from the history."""
        mine = new.select("piece_id", "outlines")
        ids = staged(pairs.where("old").select(F.col("y").alias("piece_id")).distinct(), "ids")
        found = None if ids.isEmpty() else self._probe("pieces", "piece_id", ids)
        return mine if found is None else mine.unionByName(found.select("piece_id", "outlines"))

    def _cases(self, new: DataFrame, fresh: DataFrame) -> DataFrame:
        """(x, by, y)"""
        bands = fresh.withColumn("old", F.lit(False))
        past = self._probe("bands", "key", fresh.select("key").distinct())
        if past is not None:
            bands = bands.unionByName(past.select("piece_id", "batch_id", "sig", "key").withColumn("old", F.lit(True)))
            bands = staged(bands, "buckets")
        order = F.struct("batch_id", "piece_id", "sig", "old")
        leaders = bands.groupBy("key").agg(F.min(order).alias("lead"), F.max("batch_id").alias("last")).where(F.col("lead.batch_id") < F.col("last"))
        led = bands.where(~F.col("old")).join(leaders, "key").where(F.col("batch_id") > F.col("lead.batch_id"))
        probe = staged(
            led.select(
                F.col("piece_id").alias("x"),
                F.col("lead.piece_id").alias("y"),
                F.col("lead.batch_id").alias("by"),
                F.col("lead.old").alias("old"),
                close_signatures(F.col("sig"), F.col("lead.sig"), self.distance).alias("close"),
            ).distinct(),
            "probe",
        )
        exposed = probe.select("x").distinct()
        near = probe.where("close").select("x", "y", "by", "old")
        links = staged(same_pieces(near, new, self._outlines(new, near), self.distance), "links")
        # a leader that no earlier piece shares a bucket with is accepted for certain
        sure = links.join(exposed.select(F.col("x").alias("y")), "y", "left_anti")
        first = staged(_earliest(sure), "first")
        rest = staged(exposed.join(first.select("x"), "x", "left_anti"), "rest")
        if rest.isEmpty():
            return first
        fore = bands.where(~F.col("old")).join(rest.select(F.col("x").alias("piece_id")), "piece_id", "left_semi").select(
            "key", F.col("piece_id").alias("x"), F.col("batch_id").alias("bx"), F.col("sig").alias("sx"), F.explode(_cells(F.col("sig"), self.distance, True)).alias("cell")
        )
        back = bands.join(first.select(F.col("x").alias("piece_id")), "piece_id", "left_anti").select(
            "key", F.col("piece_id").alias("y"), F.col("batch_id").alias("by"), F.col("sig").alias("sy"), "old", _cells(F.col("sig"), self.distance, False)[0].alias("cell")
        )
        more = staged(fore.join(back, ["key", "cell"]).where((F.col("by") < F.col("bx")) & close_signatures(F.col("sx"), F.col("sy"), self.distance)).select("x", "y", "by", "old").distinct(), "more")
        left = staged(same_pieces(more, new, self._outlines(new, more), self.distance), "left")
        return self._settle(first, left)

    def _settle(self, first: DataFrame, links: DataFrame) -> DataFrame:
        """Follow links from the earliest batch on: a piece linked to an accepted one is a case; one whose
        links all lead to cases is accepted, and may make later ones cases.  One round for each link of the longest chain."""
        cases = first
        open_ = links
        while not open_.isEmpty():
            ends = open_.select("x").distinct()
            fixed = open_.join(ends.select(F.col("x").alias("y")), "y", "left_anti")  # their y is undisputed: accepted
            found = staged(_earliest(fixed), "found")
            cases = cases.unionByName(found)
            gone = found.select("x")
            open_ = staged(open_.join(gone, "x", "left_anti").join(gone.select(F.col("x").alias("y")), "y", "left_anti"), "open")
        return cases


_PIECE = "piece_id long, batch_id long, sig long, outlines array<binary>"
_BAND = "piece_id long, batch_id long, sig long, key long"
_CASE = "x long, y long"


def _parts(rows: int) -> int:
    """Partitions for so many rows: a power of two."""
    return min(MOST_PARTS, 1 << max(0, (rows // ROWS_PER_PART).bit_length()))


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part")


def _earliest(links: DataFrame) -> DataFrame:
    return links.groupBy("x").agg(F.min(F.struct("by", "y"))["y"].alias("y"))


def repeats(pieces: DataFrame, deliveries: int = 2, distance: float = 0.06, path: str | None = None) -> DataFrame:
    """(x, y) over all batches of ``pieces``, ingested in ``deliveries`` runs of batches in order."""
    history = History(pieces.sparkSession, path, distance)
    cuts = pieces.approxQuantile("batch_id", [k / deliveries for k in range(1, deliveries)], 0.01) if deliveries > 1 else []
    bounds = sorted({int(c) for c in cuts})
    out = None
    for k in range(len(bounds) + 1):
        part = pieces.where(F.col("batch_id") > bounds[k - 1]) if k else pieces
        part = part.where(F.col("batch_id") <= bounds[k]) if k < len(bounds) else part
        cases = history.ingest(part, f"delivery-{k}")
        out = cases if out is None else out.unionByName(cases)
    return out
