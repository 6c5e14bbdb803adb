"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

A source's texts fall into blocks by a hash of their ids, more blocks the more tokens it has (``PER_SHARD`` to an
output shard, at least ``BLOCKS`` a source).  Of the blocks, in a random order,
as many are drawn as bring the source's tokens nearest to its quota; what is beyond one
copy of everything comes from further copies, each in a fresh order.  The
drawn blocks of all sources are split among output shards by a binary tree: at each node the left
half's counts per source are drawn from the multivariate hypergeometric distribution, so
every leaf holds exact counts, each shard is a fair sample of the mix and no block goes to two
shards.  A shard's texts are then shuffled by themselves.

Every node of the tree has a random generator of its own, so each task works out the leaves of its shards
by itself, and the drawn blocks meet their shard in a join.  The driver sees one row a source; blocks, their order and the plan are tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from interlock.llm.tokens import VOCABULARY, token_counts
from interlock.session import staged

#: Blocks of a source at least, which bounds the step a share moves in; and blocks an output shard is made of at least, about.
BLOCKS, PER_SHARD = 1024, 8
#: More targets than this are refused: they are listed in the driver and broadcast.
MOST_SOURCES = 2_000
#: Tokens an output shard is meant to hold, and the most shards.
SHARD_TOKENS, MOST_SHARDS = 50_000_000, 1_000_000
#: Plans of more rows than this are joined, not broadcast.
PLAN_ROWS = 1_000_000
#: Bits of a block's random order by which running sums are first worked out.
_BINS = 12


def canonical(source: str = "source") -> Column:
    """Source names compare without case and outer white space."""
    return F.lower(F.regexp_replace(F.col(source), r"^\s+|\s+$", ""))


def leaves(counts: list[int], shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, start, count) of shards ``first`` to ``last``: exact parts of ``counts`` per source, shard sizes as even as can be.

    Parts lie one behind the other, shard by shard.  The same for any way the shards are dealt out to tasks.
    """
    todo = [(0, shards, np.zeros(len(counts), np.int64), np.array(counts, np.int64))]
    while todo:
        low, high, start, count = todo.pop()
        if high <= first or low > last:
            continue
        if high - low == 1:
            yield low, start, count
            continue
        left, total = (high - low) // 2, int(count.sum())
        take = total * left // (high - low)
        part = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(count, take, method="marginals") if total else count * 0
        todo += [(low + left, high, start + part, count - part), (low, low + left, start, part)]


def _parts(spark: SparkSession, sources: list[str], counts: list[int], shards: int, seed: int) -> DataFrame:
    """(mix_source, pos, shard) of every drawn block, by its place in its source's order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, int(start[i]), int(count[i]), k) for k, start, count in leaves(counts, shards, int(b["id"].min()), int(b["id"].max()), seed) for i, s in enumerate(sources) if count[i]]
            yield pd.DataFrame(rows, columns=["mix_source", "start", "count", "shard"])

    tasks = max(1, min(shards // 64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = spark.range(0, shards, 1, tasks).mapInPandas(run, "mix_source string, start long, count long, shard int")
    return found.select("mix_source", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("pos"), "shard")


def quotas(has: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens wanted of each source.

    ``targets`` has (source, share, most repeats).  Without ``total`` the mix is the largest in which every source with texts reaches its
    share.  Shares of sources without texts fall to the others in proportion.
    """
    goals = [(s, share, most) for s, share, most in sorted(targets) if has.get(s, 0) > 0 and share > 0 and most > 0]
    whole = sum(share for _, share, _ in goals)
    fits = min((has[s] * most * whole / share for s, share, most in goals), default=0.0)
    size = fits if total is None else min(total, fits)
    return {s: size * share / whole for s, share, _ in goals}


def planned(blocks: DataFrame, targets: list[tuple[str, float, int]], shards: int, seed: int, total: float | None = None) -> tuple[DataFrame, dict[str, tuple[int, int]], int]:
    """(mix_source, block, copy, shard, tokens) of all drawn blocks; (available, drawn) tokens per source; and how many rows the plan has.

    ``blocks`` has mix_source, block and tokens, each block once.
    """
    spark = blocks.sparkSession
    sums = {r[0]: (r[1], r[2]) for r in blocks.groupBy("mix_source").agg(F.count(F.lit(1)), F.sum("tokens")).collect()}  # one row a source
    wanted = quotas({s: t for s, (_, t) in sums.items()}, targets, total)
    most = {s: m for s, _, m in targets}
    have = {s: (t, 0) for s, (_, t) in sums.items()}
    full = {s: min(most[s], int(q // sums[s][1] + 1e-9)) for s, q in wanted.items()}
    rest = {s: q - full[s] * sums[s][1] if full[s] < most[s] else 0.0 for s, q in wanted.items()}
    empty = "mix_source string, block long, copy int, shard int, tokens long"
    if not wanted:
        return spark.createDataFrame([], empty), have, 0
    goals = spark.createDataFrame([(s, full[s], float(rest[s]), sums[s][0]) for s in wanted], "mix_source string, full int, rest double, n long")
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)))
    order = F.xxhash64("mix_source", "block", "copy", F.lit(seed))
    entries = staged(
        blocks.join(F.broadcast(goals), "mix_source").where("full > 0 or rest > 0").withColumn("copy", copies)
        .withColumn("h", order).withColumn("bin", F.shiftrightunsigned("h", 64 - _BINS)),
        "entries",
    )
    one = ["mix_source", "copy"]
    bins = entries.groupBy(*one, "bin").agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("t"))
    before = Window.partitionBy(*one).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** _BINS rows
    starts = bins.select(*one, "bin", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("k0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"))
    within = Window.partitionBy(*one, "bin").orderBy("h", "block")
    ranked = staged(
        entries.join(starts, [*one, "bin"])
        .withColumns({"rank": F.col("k0") + F.row_number().over(within), "end": F.col("t0") + F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))})
        .select(*one, "block", "tokens", "full", "rest", "n", "rank", "end"),
        "ranked",
    )
    last = ranked.where(F.col("copy") == F.col("full")).groupBy("mix_source").agg(F.min(F.struct(F.abs(F.col("end") - F.col("rest")).alias("off"), "rank")).alias("m"))
    some = {r[0]: r[1]["rank"] if r[1]["off"] < rest[r[0]] else 0 for r in last.collect()}  # one row a source
    takes = {s: full[s] * sums[s][0] + some.get(s, 0) for s in wanted}
    cut = spark.createDataFrame([(s, some.get(s, 0)) for s in wanted], "mix_source string, some long")
    chosen = staged(
        ranked.join(F.broadcast(cut), "mix_source").where((F.col("copy") < F.col("full")) | (F.col("rank") <= F.col("some")))
        .select(*one, "block", "tokens", (F.col("copy") * F.col("n") + F.col("rank") - 1).alias("pos")),
        "chosen",
    )
    names = sorted(takes)
    parts = _parts(spark, names, [takes[s] for s in names], shards, seed)
    plan = staged(chosen.join(parts, ["mix_source", "pos"]).select("mix_source", "block", "copy", "shard", "tokens"), "plan")
    drawn = {r[0]: r[1] for r in plan.groupBy("mix_source").agg(F.sum("tokens")).collect()}
    return plan, {s: (t, drawn.get(s, 0)) for s, (t, _) in have.items()}, sum(takes.values())


def _sized(documents: DataFrame, targets: DataFrame, id_: str, vocabulary: str, keep_text: bool) -> tuple[DataFrame, list[tuple[str, float, int]]]:
    goals = (
        targets.where(F.col("source").isNotNull() & F.col("target_share").isNotNull())
        .groupBy(canonical().alias("s")).agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most"))
        .limit(MOST_SOURCES + 1).collect()
    )
    if len(goals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} targets")
    wanted = [(r["s"], float(r["share"]), int(r["most"])) for r in goals]
    names = [s for s, _, _ in wanted]
    mine = documents.withColumn("mix_source", canonical()).where(F.col("mix_source").isin(names) & F.col("text").isNotNull() & F.col(id_).isNotNull())
    return staged(token_counts(mine.select(id_, "mix_source", "text"), keep_text=keep_text, vocabulary=vocabulary), "sizes"), wanted


def _blocks(sized: DataFrame, wanted: list[tuple[str, float, int]], id_: str, shards: int | None, seed: int, total: float | None) -> tuple[DataFrame, int]:
    """``sized`` with the block of each text, and the number of shards."""
    has = {r[0]: r[1] or 0 for r in sized.groupBy("mix_source").agg(F.sum("tokens")).collect()}  # one row a source
    size = sum(quotas(has, wanted, total).values())
    parts = shards or min(MOST_SHARDS, max(16, math.ceil(size / SHARD_TOKENS)))
    step = max(1.0, size / (parts * PER_SHARD))
    numbers = sized.sparkSession.createDataFrame([(s, max(BLOCKS, math.ceil(t / step))) for s, t in has.items()] or [("", 1)], "mix_source string, blocks long")
    block = F.pmod(F.xxhash64(F.col(id_), F.lit(seed)), F.col("blocks"))
    return sized.join(F.broadcast(numbers), "mix_source").withColumn("block", block).drop("blocks"), parts


def _report(spark: SparkSession, wanted: list[tuple[str, float, int]], got: dict[str, tuple[int, int]]) -> DataFrame:
    everything = sum(d for _, d in got.values())
    rows = [(s, share, most, *got.get(s, (0, 0)), got.get(s, (0, 0))[1] / everything if everything else 0.0) for s, share, most in sorted(wanted)]
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available long, tokens long, share double")


def shares(documents: DataFrame, targets: DataFrame, *, id_: str = "doc_id", shards: int | None = None, seed: int = 1, total: float | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """The report of ``mix`` alone, without moving a text."""
    sized, wanted = _sized(documents, targets, id_, vocabulary, keep_text=False)
    blocked, parts = _blocks(sized, wanted, id_, shards, seed, total)
    blocks = staged(blocked.groupBy("mix_source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    return _report(documents.sparkSession, wanted, planned(blocks, wanted, parts, seed, total)[1])


def mix(documents: DataFrame, targets: DataFrame, *, id_: str = "doc_id", shards: int | None = None, seed: int = 1, total: float | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The drawn texts and the report of shares.

    Texts: (id, source, copy, shard, pos, tokens, text), ``copy`` counting from 0 and ``pos`` from 1 within
    a shard.  Report: (source, target_share, max_repeats, available, tokens, share), one row
    a target, zeros for sources without texts.

    Texts of no target's source, without a source, an id or a text are never
    drawn; texts without tokens may be drawn and weigh nothing.  Rows that share an id share a block and are drawn
    together.  With no usable target both results are empty or zero.
    """
    sized, wanted = _sized(documents, targets, id_, vocabulary, keep_text=True)
    blocked, parts = _blocks(sized, wanted, id_, shards, seed, total)
    blocks = staged(blocked.groupBy("mix_source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    plan, got, size = planned(blocks, wanted, parts, seed, total)
    where = plan.select("mix_source", "block", "copy", "shard")
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.col(id_), F.col("copy"), F.lit(seed + 1)), id_)
    rows = blocked.join(F.broadcast(where) if size <= PLAN_ROWS else where.hint("merge"), ["mix_source", "block"]).withColumn("pos", F.row_number().over(order))
    return rows.select(id_, F.col("mix_source").alias("source"), "copy", "shard", "pos", "tokens", "text"), _report(documents.sparkSession, wanted, got)
