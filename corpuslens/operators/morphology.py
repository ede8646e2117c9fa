"""Suffix screening, longest-suffix stems, paradigms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import hypergeometric_lower, hypergeometric_upper
from ..functions.text import suffixes


def splits(types: DataFrame, most: int = 3, stem: int = 3) -> DataFrame:
    """(w, stem, suffix) of all endings of 1..most letters that leave a stem of at least `stem` letters."""
    out = types.select("w", F.explode(suffixes(F.col("w"), most)).alias("suffix"))
    return out.withColumn("stem", F.left("w", F.length("w") - F.length("suffix"))).where(F.length("stem") >= stem)


def suffix_screen(types: DataFrame, most: int = 3, stem: int = 3, least: int = 20) -> DataFrame:
    """(suffix, n, support, expected, p, p_low): does stripping the suffix leave known words more often, or less, than stripping as many letters does?

    n words end in the suffix; support of these have a stem that is a word too.
    Drawn from all words of the vocabulary that can lose as many letters, the
    count would be hypergeometric; p is its upper tail, p_low its lower one.
    """
    known = types.select(F.col("w").alias("stem")).withColumn("known", F.lit(1))
    cut = splits(types, most, stem).join(known, "stem", "left").withColumn("k", F.length("suffix"))
    per = cut.groupBy("k", "suffix").agg(F.count("*").alias("n"), F.count("known").alias("support"))
    whole = per.groupBy("k").agg(F.sum("n").alias("total"), F.sum("support").alias("marked"))
    out = per.where(F.col("n") >= least).join(F.broadcast(whole), "k")
    law = [F.col(c) for c in ("support", "total", "marked", "n")]
    return out.select("suffix", "n", "support", (F.col("n") * F.col("marked") / F.col("total")).alias("expected"), hypergeometric_upper(*law).alias("p"), hypergeometric_lower(*law).alias("p_low"))


def longest_suffix(types: DataFrame, endings: DataFrame, stem: int = 3) -> DataFrame:
    """(w, suffix, stem): each word with the longest ending of the list that leaves a stem."""
    cut = splits(types, 4, stem).join(F.broadcast(endings.select("suffix")), "suffix")
    longest = Window.partitionBy("w").orderBy(F.desc(F.length("suffix")))
    return cut.withColumn("r", F.row_number().over(longest)).where("r = 1").select("w", "suffix", "stem")


def paradigms(assigned: DataFrame, least: int = 2) -> DataFrame:
    """(stem, n_suffixes, suffixes) of stems with several endings."""
    out = assigned.groupBy("stem").agg(F.array_sort(F.collect_set("suffix")).alias("s"))
    return out.where(F.size("s") >= least).select("stem", F.size("s").alias("n_suffixes"), F.array_join("s", "|").alias("suffixes"))


def pair_overlaps(assigned: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, n_both): for each pair of endings how many stems have each, and both.

    A stem's endings are few (the list's length at most), so pairs are made within a stem.
    """
    sets = assigned.groupBy("stem").agg(F.array_sort(F.collect_set("suffix")).alias("s"))
    pairs = sets.select(F.explode(F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    both = pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n_both"))
    size = sets.select(F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    a, b = size.select(F.col("x").alias("a"), F.col("c").alias("n_a")), size.select(F.col("x").alias("b"), F.col("c").alias("n_b"))
    return both.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "n_both")
