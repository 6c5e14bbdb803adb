"""The most similar outlines of every outline, by multi-index hashing.

Side vectors are centred, projected on their main axes and turned by a learned
rotation that spreads the variance evenly.  Every turned axis is cut at quantiles
into Gray-coded bits, so that a small move changes few of them.  Substrings of the code,
each the coarser bits of some of the axes, have an index of their own each.  Codes that agree in at
least one substring are retrieved; those further apart than ``RADIUS`` are passed over,
the rest reranked by the exact distance.

Substrings get longer with the logarithm of the collection, which keeps buckets small, by more axes and not by
finer bits, which change too easily; and the longer they are, the more there are of them (``SUBS`` up to
``SHORT`` bits, one more for each bit over it), so that recall hardly falls as the collection grows.  Axes are
dealt out at random, all of them before any again.  Equal outlines are one class, indexed once.

Buckets too large for a join are cut into cells along ``FINER`` of the turned axes.  These are at right angles, so sides within
the distance are within it along each, and lie in one cell if those near its upper end also go to the next: nothing is lost, and outlines are not copied.
Only cells that are still too large are compared in blocks, each of which passes on only the nearest of every member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlock.functions.outline import DIMS, pack, side_distance, side_vectors
from interlock.llm.history import _mix
from interlock.operators.pieces import packed_sides, usable_ids, valid_side
from interlock.session import staged

SUBS, SHORT, AXES, RADIUS = 6, 16, 30, 20
WORDS = 3
#: Bits an axis in a code at most (small collections have fewer), and how many of them, the coarsest, in a substring.
PLANES, COARSE = 4, 3
#: Bound of the sample the axes, the rotation and the cuts are learned from.
SAMPLE = 20_000
#: Buckets of more classes than this are compared in blocks of ``BLOCK``.
HOT, BLOCK = 1_000, 512
#: Axes along which hot buckets are cut, and the width of a cell in distances.
FINER, WIDE = 3, 2
_ROUNDS = 30


@dataclass
class Coder:
    """A learned code: vector -> ``planes`` bits an axis in ``WORDS`` 64-bit words, and substrings of ``bits`` of them."""

    mean: np.ndarray
    turn: np.ndarray
    cuts: np.ndarray
    bits: int

    @property
    def planes(self) -> int:
        return len(self.cuts).bit_length()

    @property
    def parts(self) -> list[list[int]]:
        """The places in the code of each substring's bits."""
        rng, pool, out, coarse = np.random.default_rng(5), [], [], min(COARSE, self.planes)
        for _ in range(SUBS + max(0, self.bits - SHORT)):
            n = math.ceil(self.bits / coarse)
            if len(pool) < n:
                pool += [int(a) for a in rng.permutation(AXES) if a not in pool]
            out.append([p * AXES + a for p in range(coarse) for a in pool[:n]][: self.bits])
            pool = pool[n:]
        return out

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Substring values (n, substrings) and code words (n, WORDS)."""
        y = (vectors - self.mean) @ self.turn
        level = np.zeros(y.shape, np.int64)
        for cut in self.cuts:
            level += y > cut
        gray = level ^ (level >> 1)
        flat = np.concatenate([(gray >> (self.planes - 1 - p)) & 1 for p in range(self.planes)], axis=1)
        subs = np.stack([flat[:, part] @ (1 << np.arange(len(part))[::-1]) for part in self.parts], axis=1)
        words = np.zeros((len(y), WORDS), np.int64)
        for j in range(flat.shape[1]):
            words[:, j // 64] |= flat[:, j] << (j % 64)
        return subs, words


def learn(vectors: np.ndarray, rows: int) -> Coder:
    """Axes, rotation and cuts for a collection of about ``rows`` from sampled vectors."""
    bits = min(32, max(10, math.ceil(math.log2(max(rows, 2)))))
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(DIMS)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred / max(1, len(vectors)))
    axes = axes[:, ::-1][:, :AXES]
    main = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(AXES, AXES)))[0]
    for _ in range(_ROUNDS):
        left, _, right = np.linalg.svd(main.T @ np.where(main @ turn >= 0, 1.0, -1.0))
        turn = left @ right
    levels = 1 << min(PLANES, math.ceil(SUBS * bits / AXES))
    cuts = np.quantile(main @ turn, np.arange(1, levels) / levels, axis=0) if len(vectors) else np.zeros((levels - 1, AXES))
    return Coder(mean, axes @ turn, cuts, bits)


def _sampled(sides: DataFrame) -> tuple[np.ndarray, int]:
    rows = sides.count()
    fraction = min(1.0, SAMPLE / max(rows, 1))
    some = sides.where(valid_side() & ~F.col("is_edge")).select("vertices").sample(False, fraction, 7).limit(2 * SAMPLE).toArrow()
    outlines = sorted({p for p in pack(some.column("vertices")) if p is not None}) if some.num_rows else []
    vectors = side_vectors(outlines)
    return vectors[~np.isnan(vectors).any(axis=1)], rows


def _coded(packed: DataFrame, coder: Coder) -> DataFrame:
    """sid, piece_id, side_index, outline and code words of sides that have a side vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = side_vectors(batch.column("outline").to_pylist())
            ok = ~np.isnan(vectors).any(axis=1)
            _, words = coder.encode(np.where(ok[:, None], vectors, 0))
            out = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(words[:, w]) for w in range(WORDS))], names=[*batch.schema.names, *(f"w{w}" for w in range(WORDS))])
            yield out.filter(pa.array(ok))

    return packed.mapInArrow(run, "piece_id long, side_index int, outline binary, w0 long, w1 long, w2 long")


def _index(classes: DataFrame, coder: Coder) -> DataFrame:
    """(sid, code words, key): one row for each substring of each class, its number and value hashed to one key."""
    words = [f"w{w}" for w in range(WORDS)]
    parts = coder.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            code = [batch.column(w).to_numpy().view(np.uint64) for w in words]
            keys = np.empty((n, len(parts)), np.uint64)
            for s, part in enumerate(parts):
                value = np.full(n, s, np.uint64)
                for j in part:
                    value = value << np.uint64(1) | (code[j // 64] >> np.uint64(j % 64) & np.uint64(1))
                keys[:, s] = _mix(_mix(value) ^ np.uint64(s))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(parts))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("sid", *words)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))], names=["sid", *words, "keys"])

    schema = ", ".join(f"{c} long" for c in ("sid", *words)) + ", keys array<long>"
    return classes.select("sid", *words).mapInArrow(run, schema).select("sid", *words, F.explode("keys").alias("key"))


def _hamming(a: str, b: str) -> Column:
    total = F.lit(0)
    for w in range(WORDS):
        total += F.bit_count(F.col(f"{a}.w{w}").bitwiseXOR(F.col(f"{b}.w{w}")))
    return total


def nearest_sides(sides: DataFrame, k: int = 5, distance: float = 0.06, size: int | None = None) -> DataFrame:
    """(piece_id, side_index, near_piece_id, near_side_index, distance) of usable pieces' sides that are no edge.

    Up to ``k`` sides of other pieces with the smallest side distance, at most
    ``distance``; ties to smaller piece, then side.  Rows with a null id, a null or true
    ``is_edge``, no whole outline, or an outline that ends where it starts take no part.  A side
    delivered twice counts once.  An empty table gives no rows.  ``size`` makes the code for a collection of so many sides; by
    default that of all rows, which is at least the number of classes.
    """
    vectors, rows = _sampled(sides)
    coder = learn(vectors, size or rows)
    packed = packed_sides(sides.where(~F.col("is_edge"))).select("piece_id", "side_index", "outline")
    coded = staged(_coded(packed, coder).withColumn("c1", F.xxhash64("outline")).withColumn("c2", F.xxhash64("outline", F.lit(1))), "coded")
    words = [f"w{w}" for w in range(WORDS)]
    members = staged(
        coded.select("piece_id", "side_index", "c1", "c2", *words).join(usable_ids(sides), "piece_id", "left_semi").distinct(), "members"
    )
    keep = k + 4  # up to three other sides and the side itself may be of the same piece
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("piece_id", "side_index"))).where(F.col("r") <= keep)
    classes = staged(
        ranked.groupBy("c1", "c2").agg(*[F.min(w).alias(w) for w in words], F.sort_array(F.collect_list(F.struct("piece_id", "side_index"))).alias("reps"))
        .withColumn("sid", F.col("reps")[0]["piece_id"] * 4 + F.col("reps")[0]["side_index"]),
        "classes",
    )
    outlines = coded.groupBy((F.col("piece_id") * 4 + F.col("side_index")).alias("sid")).agg(F.max("outline").alias("outline"))
    links = staged(_links(classes, outlines, coder, distance, keep), "near")
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("other"), "d"), F.struct(F.col("b").alias("sid"), F.col("a").alias("other"), "d"))).alias("l")).select("l.*")
    of_others = both.join(classes.select(F.col("sid").alias("other"), "reps"), "other").select("sid", "d", F.explode("reps").alias("n"))
    own = classes.where(F.size("reps") > 1).select("sid", F.lit(0.0).alias("d"), F.explode("reps").alias("n"))
    entries = of_others.unionByName(own).select("sid", "d", F.col("n.piece_id").alias("p"), F.col("n.side_index").alias("s"))
    best = entries.withColumn("r", F.row_number().over(Window.partitionBy("sid").orderBy("d", "p", "s"))).where(F.col("r") <= keep)
    lists = best.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("d", "p", "s"))).alias("near"))
    named = lists.join(classes.select("sid", "c1", "c2"), "sid").select("c1", "c2", "near")
    mine = members.select("piece_id", "side_index", "c1", "c2").join(named, ["c1", "c2"])
    other = F.slice(F.filter("near", lambda x: x["p"] != F.col("piece_id")), 1, k)
    return mine.select("piece_id", "side_index", F.explode(other).alias("n")).select(
        "piece_id", "side_index", F.col("n.p").alias("near_piece_id"), F.col("n.s").alias("near_side_index"), F.col("n.d").alias("distance")
    )


def _links(classes: DataFrame, outlines: DataFrame, coder: Coder, distance: float, keep: int) -> DataFrame:
    """(a, b, d): pairs of classes within ``distance``, from ordinary and from hot buckets."""
    index = _index(classes, coder)
    keys = index.select("key")
    # cells of keys are counted first: few and combined map-side; only full cells' keys one by one
    cells = max(1 << 16, 1 << max(0, (coder.bits - 2)))
    full = keys.groupBy(F.pmod("key", F.lit(cells)).alias("cell")).count().where(F.col("count") > HOT).select("cell")
    hot = staged(keys.withColumn("cell", F.pmod("key", F.lit(cells))).join(full, "cell", "left_semi").groupBy("key").count().where(F.col("count") > HOT), "hot")
    any_hot = not hot.isEmpty()
    cold = index.join(hot.select("key"), "key", "left_anti") if any_hot else index
    pairs = _pairs(cold)
    if not any_hot:
        return _rerank(pairs, outlines, distance)
    finer = staged(_cells(index.join(hot.select("key"), "key", "left_semi").join(outlines, "sid"), coder, distance), "finer")
    still = staged(finer.groupBy("key").count().where(F.col("count") > HOT), "still-hot")
    links = _rerank(pairs.unionByName(_pairs(finer.join(still.select("key"), "key", "left_anti"))).distinct(), outlines, distance)
    if not still.isEmpty():
        links = links.unionByName(_blocks(finer.select("sid", "key"), still, outlines, distance, keep)).distinct()
    return links


def _pairs(index: DataFrame) -> DataFrame:
    """(a, b), once each: classes of one bucket whose codes are within ``RADIUS``."""
    a, b = index.alias("a"), index.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.sid") < F.col("b.sid")) & (_hamming("a", "b") <= RADIUS)
    return a.join(b, on).select(F.col("a.sid").alias("a"), F.col("b.sid").alias("b")).distinct()


def _cells(rows: DataFrame, coder: Coder, distance: float) -> DataFrame:
    """(sid, key, code words): each row of a hot bucket in its cell, and in the next along an axis where it is near the end."""
    words = [f"w{w}" for w in range(WORDS)]
    step = WIDE * distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            y = (side_vectors(batch.column("outline").to_pylist()) - coder.mean) @ coder.turn[:, :FINER]
            low = np.floor(y / step).astype(np.int64)
            # distances are rounded to six decimals
            high = np.floor((y + distance + 1e-6) / step).astype(np.int64)
            at, cells = [], []
            for corner in range(1 << FINER):
                up = np.array([corner >> k & 1 for k in range(FINER)], bool)
                there = np.flatnonzero((~up | (high > low)).all(axis=1))
                at.append(there)
                cells.append(low[there] + up)
            where, cell = np.concatenate(at), np.concatenate(cells)
            taken = batch.select(["sid", "key", *words]).take(pa.array(where))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(cell[:, k]) for k in range(FINER))], names=[*taken.schema.names, *(f"c{k}" for k in range(FINER))])

    schema = ", ".join(f"{c} long" for c in ("sid", "key", *words, *(f"c{k}" for k in range(FINER))))
    found = rows.select("sid", "key", *words, "outline").mapInArrow(run, schema)
    return found.select("sid", F.xxhash64("key", *[f"c{k}" for k in range(FINER)]).alias("key"), *words)


def _rerank(pairs: DataFrame, outlines: DataFrame, distance: float) -> DataFrame:
    left, right = (outlines.select(F.col("sid").alias(c), F.col("outline").alias(f"o{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            known: dict[bytes, int] = {}
            at = [np.array([known.setdefault(o, len(known)) for o in batch.column(c).to_pylist()]) for c in ("oa", "ob")]
            v = side_vectors(list(known))
            d = side_distance(v[at[0]], v[at[1]])
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d)], names=["a", "b", "d"])
            yield out.filter(pa.array(d <= distance))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, d double")


def _blocks(index: DataFrame, hot: DataFrame, outlines: DataFrame, distance: float, keep: int) -> DataFrame:
    """Links of hot buckets, exact: every block against every block, ``keep`` nearest a member and block pair."""
    n = F.ceil(F.col("count") / BLOCK).cast("int")
    rows = (
        index.join(hot, "key")
        .withColumn("n", n)
        .withColumn("own", F.pmod(F.xxhash64("sid"), F.col("n")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"), "own", "sid")
        .join(outlines, "sid")
    )

    def run(table: pa.Table) -> pa.Table:
        sid, own = table.column("sid").to_numpy(), table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        v = side_vectors(table.column("outline").to_pylist())
        out = []
        for one, two in ((i, j), (j, i)) if i != j else ((i, i),):
            x, y = np.flatnonzero(own == one), np.flatnonzero(own == two)
            y = y[np.argsort(sid[y])]
            for r in x:
                d = side_distance(v[y], v[r])
                near = np.flatnonzero((d <= distance) & (sid[y] != sid[r]))
                near = near[np.lexsort((sid[y[near]], d[near]))][:keep]
                out.append((np.full(len(near), sid[r]), sid[y[near]], d[near]))
        a, b, d = (np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3))
        a, b = a.astype(np.int64), b.astype(np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": d.astype(float)})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long, d double")
