"""Duplicate pieces: groups of confirmed pairs, the best of each, fused views, pieces lying on one spot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from interlock.operators.nearby import near_pairs
from interlock.session import staged


def linked_groups(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(id, group_id): the smallest id that direct or indirect links lead to.

    Smallest labels spread along links and are then followed one step further each round, so long chains shorten; the
    labels of a round are written to the shared folder.
    """
    both = pairs.where(F.col(a) != F.col(b)).select(F.explode(F.array(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), F.struct(F.col(b).alias("x"), F.col(a).alias("y")))).alias("e")).select("e.x", "e.y")
    edges = staged(both.distinct(), "links")
    labels = staged(edges.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("l")), "labels")
    for _ in range(max_rounds):
        near = edges.join(labels.select(F.col("x").alias("y"), F.col("l").alias("m")), "y").groupBy("x").agg(F.min("m").alias("m"))
        step = labels.join(near, "x").select("x", F.col("l").alias("was"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("x").alias("l"), F.col("l").alias("n"))
        new = staged(step.join(jump, "l", "left").select("x", "was", F.coalesce(F.least("l", "n"), "l").alias("l")), "labels")
        labels = new.select("x", "l")
        if new.where(F.col("was") != F.col("l")).isEmpty():
            return labels.select(F.col("x").alias("id"), F.col("l").alias("group_id"))
    raise RuntimeError("labels did not settle")


def best_of_group(members: DataFrame, score: Column, group: str = "group_id", id_: str = "id") -> DataFrame:
    """One member a group: the highest score, ties to the smaller id."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), id_)
    return members.withColumn("n", F.row_number().over(w)).where(F.col("n") == 1).drop("n")


def fused(members: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, fused, max_diff): element-wise mean of the members' arrays, places counted from the start, and the largest move it means."""
    rows = members.select(group, F.posexplode(vector).alias("pos", "v"))
    mean = rows.groupBy(group, "pos").agg(F.avg("v").alias("m"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    worst = F.max(F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")))
    return mean.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("fused"), worst.alias("max_diff"))


def spot_duplicates(places: DataFrame, distance: float, near_miss: float) -> DataFrame:
    """(a, b, distance, kind) of pieces of one batch lying on one spot, or suspiciously near it."""
    pairs = near_pairs(places, near_miss, by=["batch_id"])
    at = lambda n: places.select(F.col("piece_id").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    d = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return pairs.join(at("a"), "a").join(at("b"), "b").select("a", "b", d.alias("distance"), F.when(d < distance, "same").otherwise("near").alias("kind"))


def decided(pairs: DataFrame, ncc_min: float) -> DataFrame:
    """Pairs by smaller id first, with whether their correlation confirms them (a failed one, -1 or null, doesn't)."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "stage", "rot", "total_rmse", "ncc", F.coalesce(F.col("ncc") >= ncc_min, F.lit(False)).alias("confirms"))
