"""Exact tails, intervals and multiplicity corrections as Columns and small tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson interval of k of n."""
    p, d = k / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return middle - half, middle + half


def log_factorials(spark: SparkSession, most: int) -> DataFrame:
    """(k, lf) for 0..most: a table of logarithms of factorials for joins."""
    t = spark.range(most + 1).select(F.col("id").alias("k"), F.when(F.col("id") > 0, F.ln("id")).otherwise(0.0).alias("x"))
    return t.select("k", F.sum("x").over(Window.orderBy("k")).alias("lf"))


def ln_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from 16 on, to about 1e-13, and exactly below."""
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)]), F.least(n, F.lit(15)).cast("int") + 1)
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n < 16, small).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def hypergeometric_upper(x: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(at least x marked among `drawn` of `total`, `marked` of which are marked).

    From x on terms follow by their ratio, away from the mean: upwards if x lies
    over it, else downwards from x - 1, of which the sum is taken from one. Forty
    deviations on nothing is left that a double could hold.
    """
    d = lambda c: c.cast("double")
    total, marked, drawn = d(total), d(marked), d(drawn)
    low, top = F.greatest(marked + drawn - total, F.lit(0.0)), F.least(marked, drawn)
    mean = drawn * marked / total
    reach = 40 * F.sqrt(mean * (1 - marked / total)) + 50
    mass = lambda k: F.exp(ln_choose(marked, k) + ln_choose(total - marked, drawn - k) - ln_choose(total, drawn))
    up = lambda k: (marked - k) * (drawn - k) / ((k + 1) * (total - marked - drawn + k + 1))  # noqa: E731  the next term over this

    def tail(first: Column, steps: Column, ratio) -> Column:
        start = F.struct(mass(first).alias("term"), mass(first).alias("sum"), first.alias("k"))
        by = F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1.0)).cast("long"))

        def step(s, i):
            term = F.when(i <= steps, s["term"] * ratio(s["k"])).otherwise(0.0)
            return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"), (s["k"] + F.when(F.lit(ratio is up), 1.0).otherwise(-1.0)).alias("k"))

        return F.aggregate(by, start, step, lambda s: s["sum"])

    down = lambda k: 1 / up(k - 1)
    x = d(x)
    over = tail(x, F.least(top, F.floor(x + reach)) - x, up)
    under = tail(x - 1, x - 1 - F.greatest(low, F.ceil(x - 1 - reach)), down)
    return F.when(x > top, 0.0).when(x <= low, 1.0).when(x >= mean, F.least(over, F.lit(1.0))).otherwise(F.greatest(1 - under, F.lit(0.0)))


def hypergeometric_lower(x: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """P(at most x marked): the upper tail of the unmarked."""
    return hypergeometric_upper(drawn - x, total, total - marked, drawn)


def binomial_upper(x: Column, n: Column, p: float = 0.5) -> Column:
    """P(at least x of n) at success probability p."""
    mass = lambda k: F.exp(ln_choose(n, k) + k * math.log(p) + (n - k) * math.log(1 - p))
    return F.least(F.aggregate(F.sequence(x.cast("long"), n.cast("long")), F.lit(0.0), lambda s, k: s + mass(k)), F.lit(1.0))


@F.pandas_udf(DoubleType())
def stratified_lower(m: pd.Series, a: pd.Series, b: pd.Series, observed: pd.Series) -> pd.Series:
    """P(sum of strata's overlaps <= observed): the convolution of hypergeometric (m, a, b) laws.

    m, a and b are arrays with a number a stratum.
    """
    ln = np.frompyfunc(math.lgamma, 1, 1)

    def choose(n, k):
        return math.lgamma(n + 1) - ln(k + 1).astype(float) - ln(n - k + 1).astype(float)

    def law(m, a, b):
        k = np.arange(max(0, a + b - m), min(a, b) + 1)
        p = np.exp(choose(a, k) + choose(m - a, b - k) - (math.lgamma(m + 1) - math.lgamma(b + 1) - math.lgamma(m - b + 1)))
        return np.concatenate((np.zeros(k[0] if len(k) else 0), p))

    out = []
    for ms, xs, ys, o in zip(m, a, b, observed):
        p = np.ones(1)
        for z in zip(ms, xs, ys):
            p = np.convolve(p, law(*map(int, z)))
        out.append(min(1.0, float(p[: int(o) + 1].sum())))
    return pd.Series(out)


def benjamini_hochberg(df: DataFrame, p: str, out: str = "p_bh", by: tuple = (), ties: tuple = ()) -> DataFrame:
    """Adds the Benjamini-Hochberg adjusted p within each family `by` (families are small: one row a test)."""
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    rank = F.row_number().over(family.orderBy(p, *ties))
    raw = df.withColumn("_r", rank).withColumn("_x", F.col(p) * F.count("*").over(family) / F.col("_r"))
    least = F.min("_x").over(family.orderBy("_r").rowsBetween(0, Window.unboundedFollowing))
    return raw.withColumn(out, F.least(F.lit(1.0), least)).drop("_r", "_x")


def bonferroni(df: DataFrame, p: str, out: str = "p_bonferroni", by: tuple = ()) -> DataFrame:
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * F.count("*").over(family)))
