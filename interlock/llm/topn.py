"""The best N items of every group, by two-stage salted ranking.

Each group is hashed into subgroups by its items; a repeated item always meets
itself in one subgroup.  Every subgroup ranks its own and keeps N, and only those
survivors are ranked across the group.  The planner cuts to N before the shuffles too, so a
group of a third of all rows arrives in ``salts`` parts, each already cut.

Repeats of an item are put together map-side before the first shuffle, so an item that fills a third of all rows sends
one row a task.  That costs a shuffle of its own (by item), which partitioning by subgroup at once would
save, but then all rows of such an item would meet in one task.  ``salts`` bounds a subgroup's share of its group; 32
leaves about 1 % of all rows to a task for a group of a third of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: list[str], item: list[str], score: str, n: int, salts: int = 32, rank: str = "rank_no") -> DataFrame:
    """``group``, ``rank``, ``item``, ``score``: the ``n`` items with the smallest score.

    An item listed more than once counts once with its smallest score.  Ties go to
    the smaller item, column by column.  Rows with a null score or a null in ``item``
    don't count; null is a group value like any other.  Other columns are dropped,
    so their names can't clash.  An empty input or ``n`` < 1 gives no rows.
    """
    cols = [*group, *item]
    g, i = [f"g{k}" for k in range(len(group))], [f"i{k}" for k in range(len(item))]
    live: Column = F.col(score).isNotNull()
    for c in item:
        live &= F.col(c).isNotNull()
    rows = df.where(live).select(*[F.col(c).alias(a) for c, a in zip(cols, [*g, *i])], F.col(score).alias("s"))
    once = rows.groupBy(*g, F.pmod(F.xxhash64(*i), F.lit(salts)).cast("int").alias("salt"), *i).agg(F.min("s").alias("s"))
    order = [F.col("s"), *[F.col(c) for c in i]]
    part = once.withColumn("r", F.row_number().over(Window.partitionBy(*g, "salt").orderBy(*order))).where(F.col("r") <= n).drop("r", "salt")
    best = part.withColumn("r", F.row_number().over(Window.partitionBy(*g).orderBy(*order))).where(F.col("r") <= n)
    return best.select(*[F.col(a).alias(c) for c, a in zip(group, g)], F.col("r").alias(rank), *[F.col(a).alias(c) for c, a in zip(item, i)], F.col("s").alias(score))
