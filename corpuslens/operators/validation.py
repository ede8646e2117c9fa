"""Cross-validation of naive Bayes in one pass: a fold's model is the total's counts less the fold's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import hashed


def folded(units: DataFrame, block: Column, seed: int, folds: int = 5) -> DataFrame:
    """Adds fold, by the block's hash: units of a block, such as a family, are held out together."""
    return units.withColumn("fold", F.pmod(F.conv(F.substring(hashed(seed, block), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def _per_fold(folds: int) -> Column:
    """An array with the number of rows of each fold."""
    return F.array(*[F.sum((F.col("fold") == i).cast("long")) for i in range(folds)])


def group_scores(units: DataFrame, features: DataFrame, folds: int, groups: list) -> DataFrame:
    """(unit, truth, fold, label, prior, parts): each unit's Bernoulli score under the model of the other folds, one part a group of features.

    units: (unit, label, fold), a unit once; features: (unit, feature, grp), distinct,
    of the groups listed. prior is ln(n + 1); a part sums ln P of present and absent
    features of its group, add-one smoothed, over the features of all folds. A
    score is the prior plus the parts wanted, so any subset of groups is scored by
    the same pass. Units without features, and labels without units in the other
    folds, are scored too; a null label is a label.
    """
    at = F.sequence(F.lit(0), F.lit(folds - 1))
    n = units.groupBy("label").agg(F.count("*").alias("n"), _per_fold(folds).alias("own"))
    n = n.select("label", F.transform(at, lambda i: F.col("n") - F.get("own", i)).alias("rest"))  # a few labels
    seen = features.join(units, "unit").groupBy("grp", "feature", "label").agg(F.count("*").alias("c"), _per_fold(folds).alias("own"))
    grid = seen.select("grp", "feature").distinct().crossJoin(F.broadcast(n))
    same = [F.col("x.grp") == F.col("y.grp"), F.col("x.feature") == F.col("y.feature"), F.col("x.label").eqNullSafe(F.col("y.label"))]
    grid = grid.alias("x").join(seen.alias("y"), same, "left").select("x.grp", "x.feature", "x.label", "x.rest", F.coalesce("y.c", F.lit(0)).alias("c"), "y.own")
    had = F.transform(at, lambda i: F.col("c") - F.coalesce(F.get("own", i), F.lit(0)))
    weights = grid.withColumn("had", had).select(
        "grp", "feature", "label",
        F.transform(at, lambda i: F.ln((F.get("rest", i) - F.get("had", i) + 1) / (F.get("rest", i) + 2))).alias("absent"),
        F.transform(at, lambda i: F.ln((F.get("had", i) + 1) / (F.get("rest", i) - F.get("had", i) + 1))).alias("delta"),
    )
    base = weights.groupBy("label").agg(*[F.array(*[F.sum(F.when(F.col("grp") == g, F.get("absent", F.lit(i))).otherwise(0.0)) for i in range(folds)]).alias(f"b{k}") for k, g in enumerate(groups)])
    present = features.join(units.select("unit", "fold"), "unit").join(weights, ["grp", "feature"]).groupBy("unit", F.col("label").alias("guess"))
    present = present.agg(*[F.sum(F.when(F.col("grp") == g, F.get("delta", F.col("fold"))).otherwise(0.0)).alias(f"p{k}") for k, g in enumerate(groups)])
    cells = units.withColumnRenamed("label", "truth").crossJoin(F.broadcast(n.alias("n").join(base.alias("b"), F.col("n.label").eqNullSafe(F.col("b.label"))).select("n.label", "rest", *[f"b{k}" for k in range(len(groups))])))
    out = cells.alias("x").join(present.alias("y"), (F.col("x.unit") == F.col("y.unit")) & F.col("x.label").eqNullSafe(F.col("y.guess")), "left")
    part = lambda k: F.coalesce(F.col(f"p{k}"), F.lit(0.0)) + F.get(f"b{k}", F.col("fold"))
    return out.select("x.unit", "truth", "fold", "x.label", F.ln(F.get("rest", F.col("fold")) + 1).alias("prior"), F.array(*[part(k) for k in range(len(groups))]).alias("parts"))


def chosen(scores: DataFrame, score: Column, *keys: str) -> DataFrame:
    """(keys, label, conf): the best label, ties to the smaller, and its share of the labels' likelihoods."""
    best = F.max(F.struct(F.round(score, 9).alias("s"))).alias("top")
    per = scores.groupBy(*keys).agg(best, F.collect_list(F.struct("label", F.round(score, 9).alias("s"))).alias("all"))  # a few labels
    least = F.array_min(F.transform(F.filter("all", lambda x: x["s"] == F.col("top.s")), lambda x: x["label"]))
    share = 1 / F.aggregate("all", F.lit(0.0), lambda t, x: t + F.exp(F.greatest(x["s"] - F.col("top.s"), F.lit(-700.0))))
    return per.select(*keys, least.alias("label"), share.alias("conf"))
