"""Naive Bayes, centroids, association weights, calibration and scores, as counts and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nulls import hashed, ranked


def split(units: DataFrame, unit: Column, label: str, seed: int, share: float = 0.2) -> DataFrame:
    """Adds held_out: the first `share` of each label's units in hash order."""
    # Ids alone are ranked, by ranges of their hash.
    ids = units.select(unit.alias("_u"), F.col(label).alias("_l"), hashed(seed, unit).alias("_h"))
    n = ids.groupBy("_l").agg(F.count("*").alias("_n"))
    held = ranked(ids, ["_l"], F.substring("_h", 1, 3), ["_h", "_u"]).join(F.broadcast(n), "_l").where(F.col("_k") <= F.floor(F.col("_n") * share))  # one row a label
    held = held.select("_u", F.col("_l").alias("_l2"), F.lit(True).alias("_held")).distinct()
    return units.join(held, unit.eqNullSafe(F.col("_u")) & F.col(label).eqNullSafe(F.col("_l2")), "left").withColumn("held_out", F.coalesce("_held", F.lit(False))).drop("_u", "_l2", "_held")


def fold_of(unit: Column, seed: int, folds: int = 5) -> Column:
    return F.pmod(F.conv(F.substring(hashed(seed, unit), 1, 8), 16, 10).cast("long"), F.lit(folds))


def bernoulli_fit(train: DataFrame, features: DataFrame, unit: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Prior (label, prior, base) and weights (label, feature, delta) with add-one smoothing.

    prior = ln(n + 1); base sums ln P(absent) over all features, delta is what a
    present feature changes.
    """
    n = train.groupBy(label).agg(F.count("*").alias("n"))
    have = features.join(train.select(unit, label), unit).groupBy(label, "feature").agg(F.count("*").alias("n1"))
    grid = have.select("feature").distinct().crossJoin(F.broadcast(n))  # a few labels
    full = grid.join(have, [label, "feature"], "left").withColumn("n1", F.coalesce("n1", F.lit(0)))
    full = full.withColumn("l1", F.ln((F.col("n1") + 1) / (F.col("n") + 2))).withColumn("l0", F.ln((F.col("n") - F.col("n1") + 1) / (F.col("n") + 2)))
    base = full.groupBy(label).agg(F.sum("l0").alias("base"))
    prior = n.join(base, label).select(label, F.ln(F.col("n") + 1).alias("prior"), "base")
    return prior, full.select(label, "feature", (F.col("l1") - F.col("l0")).alias("delta"))


def bernoulli_scores(units: DataFrame, features: DataFrame, prior: DataFrame, weights: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, label, score)."""
    part = features.join(units.select(unit), unit).join(weights, "feature").groupBy(unit, label).agg(F.sum("delta").alias("d"))
    grid = units.select(unit).crossJoin(F.broadcast(prior))
    return grid.join(part, [unit, label], "left").select(unit, label, (F.col("prior") + F.col("base") + F.coalesce("d", F.lit(0.0))).alias("score"))


def multinomial_weights(bags: DataFrame, label: str, alpha: float = 1.0) -> DataFrame:
    """(label, feature, lw): smoothed log frequency over the features of all labels; bags has (label, feature, c)."""
    count = bags.groupBy(label, "feature").agg(F.sum("c").alias("c"))
    total = count.groupBy(label).agg(F.sum("c").alias("t"))
    v = count.select("feature").distinct().count()
    grid = count.select("feature").distinct().crossJoin(F.broadcast(total))
    return grid.join(count, [label, "feature"], "left").select(label, "feature", F.ln((F.coalesce("c", F.lit(0)) + alpha) / (F.col("t") + alpha * v)).alias("lw"))


def decide(scores: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, predicted, score, margin): the best label, ties to the smaller one, and its lead over the second."""
    by = Window.partitionBy(unit).orderBy(F.desc("score"), label)
    r = scores.withColumn("r", F.row_number().over(by)).where("r <= 2")
    pick = lambda c, k: F.max(F.when(F.col("r") == k, F.col(c)))
    return r.groupBy(unit).agg(pick(label, 1).alias("predicted"), pick("score", 1).alias("score"), (pick("score", 1) - pick("score", 2)).alias("margin"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("c"))


def class_scores(cells: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, n, hits, precision, recall, f1) from a confusion table."""
    rows = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col(truth) == F.col(predicted), F.col("c")).otherwise(0)).alias("hits"))
    cols = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("c").alias("guessed"))
    out = rows.join(cols, "label", "left").withColumn("guessed", F.coalesce("guessed", F.lit(0)))
    p, r = F.col("hits") / F.nullif(F.col("guessed"), F.lit(0)), F.col("hits") / F.col("n")
    return out.select("label", "n", "hits", F.coalesce(p, F.lit(0.0)).alias("precision"), r.alias("recall"), F.coalesce(2 * F.col("hits") / F.nullif(F.col("guessed") + F.col("n"), F.lit(0)), F.lit(0.0)).alias("f1"))


def overall(per_class: DataFrame) -> DataFrame:
    """(n, accuracy, balanced, macro_f1, majority)."""
    return per_class.agg(
        F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced"), F.avg("f1").alias("macro_f1"), (F.max("n") / F.sum("n")).alias("majority")
    )


def calibration(df: DataFrame, confidence: str, correct: Column, edges: tuple = (0.0, 0.5, 0.7, 0.9, 1.01), least: int = 5) -> DataFrame:
    """(bin, n, mean_confidence, accuracy, calibrated): bins of fewer rows keep their own confidence."""
    label = reduce(lambda c, i: c.when((F.col(confidence) >= edges[i]) & (F.col(confidence) < edges[i + 1]), i), range(len(edges) - 1), F)
    out = df.withColumn("bin", label).groupBy("bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(correct.cast("double")).alias("accuracy"))
    return out.withColumn("calibrated", F.when(F.col("n") >= least, F.col("accuracy")).otherwise(F.col("mean_confidence")))


def ppmi(cells: DataFrame, margins: DataFrame) -> DataFrame:
    """(a, b, c, ppmi) of counted cells (a, b, c) with positive association; margins (w, r) are those of all cells, seen or not."""
    n = margins.agg(F.sum("r").alias("n"))
    of = lambda x: margins.select(F.col("w").alias(x), F.col("r").alias(f"r{x}"))
    out = cells.join(of("a"), "a").join(of("b"), "b").crossJoin(F.broadcast(n))  # one row
    return out.select("a", "b", "c", F.ln(F.col("c") * F.col("n").cast("double") / F.col("ra") / F.col("rb")).alias("ppmi")).where("ppmi > 0")


def unit_vectors(df: DataFrame, unit: str, vec: str, *keep: str) -> DataFrame:
    """(unit, keep, v array<double>) of length 1; null, empty, non-finite and zero vectors are left out."""
    v = F.transform(vec, lambda x: x.cast("double"))
    good = df.where(F.col(vec).isNotNull()).select(unit, *keep, v.alias("v")).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return good.withColumn("_n", norm).where("_n > 0").select(unit, *keep, F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def centroids(vectors: DataFrame, label: str) -> DataFrame:
    """(label, j, x): the mean direction of each label, dimension by dimension, of length 1."""
    mean = vectors.select(label, F.posexplode("v").alias("j", "x")).groupBy(label, "j").agg(F.avg("x").alias("x"))
    norm = mean.groupBy(label).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return mean.join(norm, label).select(label, "j", (F.col("x") / F.col("n")).alias("x"))


def cosine_to(vectors: DataFrame, centres: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, label, score): cosine to each centre; centres are one row a label and dimension."""
    wide = centres.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "x"))), lambda s: s["x"]).alias("u"))
    both = vectors.select(unit, "v").crossJoin(F.broadcast(wide))  # a few labels
    return both.select(unit, label, F.aggregate(F.zip_with("v", "u", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("score"))


def left_out(bins: int, width: float):
    """A mapInArrow function: kernel densities of places 0..bins that leave a group's own cases out.

    A row has the group's counts and those of all groups (the same in every row),
    as lists of (y, b, c), y 0 or 1. Of each place where the group has cases come
    its counts and both classes' densities, null for a class without any case.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        z = np.subtract.outer(np.arange(bins + 1), np.arange(bins + 1)) / width
        kernel = np.exp(-0.5 * z * z)

        def table(lists, n):
            out, cells = np.zeros((n, 2, bins + 1)), lists.flatten()
            y, b, c = (cells.field(i).to_numpy() for i in range(3))
            out[np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), y, b] = c
            return out

        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                own, all_ = table(part.column(0), part.num_rows), table(part.column(1).slice(0, 1), 1)
                seen = all_[0].sum(axis=1) > 0
                d = (all_ - own) @ kernel
                at = np.nonzero(own.sum(axis=1))
                side = lambda y: pa.array(d[:, y][at], mask=np.full(len(at[0]), not seen[y]))
                yield pa.RecordBatch.from_arrays([*[pa.array(own[:, y][at].astype(np.int64)) for y in (1, 0)], side(1), side(0)], names=["pos", "neg", "d1", "d0"])

    return run
