"""One group id for all records linked directly or through others.

Random contraction: in every round each vertex hooks to the vertex of
its closed neighbourhood that comes first in a fresh hash order, edges are relabelled by
the hooks and deduplicated, until none is left.  A constant share of the vertices vanishes in
a round (expected), so the rounds' tables shrink geometrically.  Then the hooks are
expanded from the last round back to the first.

Each round's tables are written to the shared folder; nothing is collected but a count.
Hot vertices only meet map-side combined aggregates and joins whose other side has one row a vertex,
which the adaptive planner splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlock.session import staged


def _order(vertex: str, round_: int) -> Column:
    return F.xxhash64(F.col(vertex), F.lit(round_ * 7919 + 13))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(id, root): every vertex with a link to another one, and its group's root.

    Links are undirected; repeated links, either order and a vertex linked to
    itself change nothing.  Links with a null end count for nothing.  ``root`` is
    some vertex of the group.  An empty input gives no rows.
    """
    edges = staged(
        links.where((F.col(a) != F.col(b)))
        .select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        if len(hooks) >= max_rounds:
            raise RuntimeError(f"{max_rounds} rounds did not contract the graph")
        k = len(hooks)
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e")).select("e.x", "e.y")
        first = ends.groupBy("x").agg(F.min_by("y", _order("y", k)).alias("y"))
        hook = staged(first.select("x", F.when(_order("x", k) < _order("y", k), F.col("x")).otherwise(F.col("y")).alias("to")), f"hooks{k}")
        hooks.append(hook)
        # the files are far smaller than the rows in memory: the planner would broadcast what is no longer small
        left = hook.select(F.col("x").alias("u"), F.col("to").alias("p")).hint("merge")
        right = hook.select(F.col("x").alias("v"), F.col("to").alias("q")).hint("merge")
        edges = staged(
            edges.join(left, "u").join(right, "v").where(F.col("p") != F.col("q")).select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(),
            f"edges{k}",
        )
    if not hooks:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    labels = hooks[-1].select(F.col("x").alias("id"), F.col("to").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = labels.select(F.col("id").alias("to"), "root").hint("merge")
        labels = hook.join(later, "to", "left").select(F.col("x").alias("id"), F.coalesce("root", "to").alias("root"))
    return staged(labels, "labels")


def smallest_member(labels: DataFrame) -> DataFrame:
    """(id, group_id) with the smallest id of each group for its name."""
    names = labels.groupBy("root").agg(F.min("id").alias("group_id"))
    return labels.join(names.hint("merge"), "root").select("id", "group_id")


def latest_decisions(pairs: DataFrame) -> DataFrame:
    """(a, b, confirmed), a <= b: of each unordered pair the row checked last.

    Pairs with a null id drop out; rows without a time count as oldest.  Should rows of one time
    disagree, true wins over false over null.
    """
    return (
        pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.max(F.struct("checked_at", "confirmed"))["confirmed"].alias("confirmed"))
    )


def view_groups(pairs: DataFrame, usable: DataFrame) -> DataFrame:
    """(piece_id, group_id) of every piece linked to another by confirmed decisions between usable pieces."""
    ok = latest_decisions(pairs).where(F.col("confirmed") & (F.col("a") != F.col("b")))
    ids = usable.select("piece_id")
    known = ok.join(ids.withColumnRenamed("piece_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("piece_id", "b"), "b", "left_semi")
    return smallest_member(connected_components(known)).select(F.col("id").alias("piece_id"), "group_id")
