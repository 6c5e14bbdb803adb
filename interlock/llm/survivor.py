"""The best representative of each group, by iterative truth discovery.

Claims say which source gives which value for a field of an object, and when.  Source
reliability and value support are estimated in turn: a source's weight follows from the share of
its claims that carry the day; a value's support is its share of the weight of all latest claims of the field, plus
``EARLIER`` times its share of the weight of those before.  It ends when no weight moves more than a tolerance.

So lateness is part of the weighing: a value that alone is claimed latest has a support of at least 1, and
what came before adds up to ``EARLIER`` at most.  Where values compete for the latest time, the reliability of
their sources, learnt over all objects, decides, with what came before as further evidence.

Undisputed fields need no iteration: they add one constant count per source.
Only disputed claims are iterated, from a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlock.session import staged

#: Added to the right and wrong claims of each source, against weights of few claims.
PRIOR = 1.0
#: Most support that earlier claims give, against 1 for those of the latest time; below 1 the latest wins.
EARLIER = 0.5
#: From this round on each step is half as long as the one before, which ends the rare swing between two states.
COOLING = 10


def truth_discovery(claims: DataFrame, rounds: int = 40, tolerance: float = 1e-3) -> DataFrame:
    """(object, field, value): the highest-supported value of each field of each object.

    ``claims`` has object, field, source, value and perhaps ``at``, the time of the claim (none is older than any).  Claims with a null
    object, field or value count for nothing, repeats of a claim count once with their latest time, and null is a source like any
    other.  Equal support goes to the larger value.  Values must be of an orderable type.  Raises RuntimeError
    if ``rounds`` end before the weights settle.
    """
    at = F.col("at") if "at" in claims.columns else F.lit(None).cast("timestamp")
    live = claims.where(F.col("object").isNotNull() & F.col("field").isNotNull() & F.col("value").isNotNull()).withColumn("at", at)
    once = staged(live.groupBy("object", "field", "source", "value").agg(F.max("at").alias("at")), "claims")
    facts = staged(once.groupBy("object", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("at").alias("last")), "facts")
    calm = facts.where(F.col("lo") == F.col("hi")).select("object", "field", F.col("lo").alias("value"))
    disputed = facts.where(F.col("lo") != F.col("hi")).select("object", "field", "last")
    fought = staged(once.join(disputed, ["object", "field"]).select("object", "field", "source", "value", F.col("at").eqNullSafe(F.col("last")).alias("latest")), "disputed")
    if fought.isEmpty():
        return calm
    counts = once.join(disputed.select("object", "field", F.lit(1).alias("d")), ["object", "field"], "left").groupBy("source").agg(F.sum(F.col("d").isNull().cast("long")).alias("calm"))
    weights = staged(counts.withColumn("w", F.lit(1.0)), "weights")
    for k in range(rounds):
        best = _winners(fought, weights)
        won = fought.join(best.withColumnRenamed("value", "best"), ["object", "field"]).groupBy("source").agg(
            F.sum((F.col("value") == F.col("best")).cast("long")).alias("right"), F.count(F.lit(1)).alias("all")
        )
        share = (F.coalesce("right", F.lit(0)) + F.col("calm") + PRIOR) / (F.coalesce("all", F.lit(0)) + F.col("calm") + 2 * PRIOR)
        step = min(1.0, 0.5 ** (k - COOLING))
        new = staged(
            weights.alias("o").join(won.alias("n"), F.col("o.source").eqNullSafe(F.col("n.source")), "left")
            .select(F.col("o.source").alias("source"), "calm", F.col("o.w").alias("before"), (F.col("o.w") + step * (-F.log(1 - share) - F.col("o.w"))).alias("w")),
            f"weights{k}",
        )
        moved = new.agg(F.max(F.abs(F.col("w") - F.col("before")))).first()[0]
        weights = new.drop("before")
        if moved is None or moved <= tolerance:
            return calm.unionByName(_winners(fought, weights))
    raise RuntimeError(f"{rounds} rounds did not settle the sources' weights")


def _winners(fought: DataFrame, weights: DataFrame) -> DataFrame:
    w = weights.select(F.col("source").alias("by"), "w")
    by_value = fought.join(w, F.col("source").eqNullSafe(F.col("by"))).groupBy("object", "field", "value").agg(
        F.sum(F.when(F.col("latest"), F.col("w")).otherwise(0.0)).alias("now"), F.sum(F.when(F.col("latest"), 0.0).otherwise(F.col("w"))).alias("then")
    )
    total = by_value.groupBy("object", "field").agg(F.sum("now").alias("all_now"), F.sum("then").alias("all_then"))
    support = F.round(F.col("now") / F.col("all_now") + F.when(F.col("all_then") > 0, EARLIER * F.col("then") / F.col("all_then")).otherwise(0.0), 9)
    return by_value.join(total, ["object", "field"]).groupBy("object", "field").agg(F.max(F.struct(support.alias("support"), "value"))["value"].alias("value"))


def view_claims(sides: DataFrame) -> DataFrame:
    """Claims of delivered side rows on centroid, width and height of their piece.

    The source of a claim is the run of side files it came in with: the batch and the side index, which
    speaks for all pieces of the batch.  Values are arrays of doubles, so that one column holds all three fields.
    """

    def one(field: str, value: Column, ok: Column) -> Column:
        return F.when(ok, F.struct(F.lit(field).alias("field"), value.alias("value")))

    both = (F.size("photo_space_centroid") >= 2) & F.get("photo_space_centroid", 0).isNotNull() & F.get("photo_space_centroid", 1).isNotNull()
    fields = F.array_compact(
        F.array(
            one("centroid", F.slice("photo_space_centroid", 1, 2), both),
            one("width", F.array(F.col("photo_width").cast("double")), F.col("photo_width").isNotNull()),
            one("height", F.array(F.col("photo_height").cast("double")), F.col("photo_height").isNotNull()),
        )
    )
    return sides.select(F.col("piece_id").alias("object"), F.concat_ws("/", F.col("batch_id").cast("string"), F.col("side_index").cast("string")).alias("source"), F.col("ingested_at").alias("at"), F.explode(fields).alias("c")).select("object", "c.field", "source", "c.value", "at")


def fused_views(sides: DataFrame, groups: DataFrame) -> DataFrame:
    """(piece_id, group_id, centroid, width, height) of grouped pieces, the fields by truth discovery among the claims of their rows."""
    mine = sides.join(groups.select("piece_id"), "piece_id", "left_semi")
    truth = truth_discovery(view_claims(mine))
    wide = truth.groupBy(F.col("object").alias("piece_id")).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("centroid", "width", "height")])
    return groups.join(wide, "piece_id").select("piece_id", "group_id", "centroid", F.col("width")[0].alias("width"), F.col("height")[0].alias("height"))


def view_sources(sides: DataFrame) -> DataFrame:
    """(piece_id, source): batch and photo each piece was seen in; a photo speaks for all pieces in it."""
    rows = sides.where(F.col("piece_id").isNotNull()).groupBy("piece_id").agg(F.min("batch_id").cast("string").alias("b"), F.max("original_photo_name").alias("f"))
    return rows.select("piece_id", F.concat_ws("/", "b", F.coalesce("f", F.lit(""))).alias("source"))


def most_central(views: DataFrame) -> DataFrame:
    """(group_id, piece_id): of each group the view whose centroid is nearest to the middle of its photo.

    Views lacking a value drop out, and groups with none left; ties go to the smaller piece.
    """
    off = F.sqrt(F.pow(F.col("centroid")[0] - F.col("width") / 2, 2) + F.pow(F.col("centroid")[1] - F.col("height") / 2, 2))
    return views.withColumn("off", off).where(F.col("off").isNotNull()).groupBy("group_id").agg(F.min(F.struct("off", "piece_id"))["piece_id"].alias("piece_id"))


def fused_groups(views: DataFrame, sources: DataFrame) -> DataFrame:
    """(group_id, photo_space_centroid, photo_width, photo_height): one surviving record a group, every field the highest-supported among its views.

    ``sources`` says which photo a view comes from; photos are the sources, each with claims on many groups.  A centroid is a place in its own
    photo, so views of different photos differ by nature, and that of the most reliable photo survives.
    """
    fields = F.array(F.struct(F.lit("centroid").alias("field"), F.col("centroid").alias("value")), *[F.struct(F.lit(f).alias("field"), F.array(f).alias("value")) for f in ("width", "height")])
    named = views.join(sources, "piece_id", "left")
    claims = named.select(F.col("group_id").alias("object"), "source", F.explode(fields).alias("c")).select("object", "source", "c.field", "c.value").where(F.col("value").isNotNull() & F.get("value", 0).isNotNull())
    truth = truth_discovery(claims)
    pick = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    return truth.groupBy(F.col("object").alias("group_id")).agg(pick("centroid").alias("photo_space_centroid"), pick("width")[0].alias("photo_width"), pick("height")[0].alias("photo_height"))
