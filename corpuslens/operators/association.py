"""Contingency, mutual information, two-by-two association, shares, ratios and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contingency(df: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by, a, b, c)."""
    return df.groupBy(*by, a, b).agg(F.count("*").alias("c"))


def mutual_information(cells: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """(by, n, n_cells, mi): mutual information in nats from a contingency table (a, b, c).

    Marginals are aggregated and joined, not windowed, so a frequent value is
    no hot partition.
    """
    rows = cells.groupBy(*by, a).agg(F.sum("c").alias("ra"))
    cols = cells.groupBy(*by, b).agg(F.sum("c").alias("rb"))
    # sum c/n ln(c n / (ra rb)) = (sum c ln c - sum ra ln ra - sum rb ln rb) / n + ln n
    part = lambda df, x: df.groupBy(*by).agg(F.sum(F.col(x) * F.ln(x)).alias(f"s_{x}"))
    whole = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("n_cells"), F.sum(F.col("c") * F.ln("c")).alias("s_c"))
    join = lambda x, y: x.join(y, list(by)) if by else x.crossJoin(y)  # noqa: E731  one row each without groups
    out = join(join(whole, part(rows, "ra")), part(cols, "rb"))
    return out.select(*by, "n", "n_cells", ((F.col("s_c") - F.col("s_ra") - F.col("s_rb")) / F.col("n") + F.ln("n")).alias("mi"))


def top_share(cells: DataFrame, a: str, b: str) -> DataFrame:
    """(a, n_occ, top, share): for each a the b that has most of it, ties to the smaller b."""
    first = Window.partitionBy(a).orderBy(F.desc("c"), b)
    return (
        cells.withColumn("r", F.row_number().over(first)).groupBy(a)
        .agg(F.sum("c").alias("n_occ"), F.max(F.when(F.col("r") == 1, F.col(b))).alias("top"), F.max("c").alias("most"))
        .select(a, "n_occ", "top", (F.col("most") / F.col("n_occ")).alias("share"))
    )


def two_by_two(df: DataFrame, x, y, *by: str) -> DataFrame:
    """(by, n, n_x, n_y, n_both, precision, base, risk_ratio) of two boolean columns."""
    one = lambda c: F.sum(c.cast("long"))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), one(x).alias("n_x"), one(y).alias("n_y"), one(x & y).alias("n_both"))
    other = (F.col("n_y") - F.col("n_both")) / F.nullif(F.col("n") - F.col("n_x"), F.lit(0))
    precision = F.col("n_both") / F.nullif(F.col("n_x"), F.lit(0))
    return out.select(*by, "n", "n_x", "n_y", "n_both", precision.alias("precision"), (F.col("n_y") / F.col("n")).alias("base"), (precision / F.nullif(other, F.lit(0.0))).alias("risk_ratio"))


def type_token_ratio(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, n_types, ttr)."""
    per = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    return per.groupBy(*by).agg(F.sum("c").alias("n"), F.count("*").alias("n_types")).withColumn("ttr", F.col("n_types") / F.col("n"))


def rate_spread(df: DataFrame, hit, bin_col: str, *by: str, least: int = 1) -> DataFrame:
    """(by, n_bins, low, high, spread): range of hit's rate over bins of at least `least` rows."""
    rates = df.groupBy(*by, bin_col).agg(F.avg(hit.cast("double")).alias("rate"), F.count("*").alias("n")).where(F.col("n") >= least)
    return rates.groupBy(*by).agg(F.count("*").alias("n_bins"), F.min("rate").alias("low"), F.max("rate").alias("high")).withColumn("spread", F.col("high") - F.col("low"))


def majority(votes: DataFrame, key: str, label: str, priority=None) -> DataFrame:
    """(key, label, n_votes) from votes (key, label, c).

    Without priority a tie for the first place rejects the key; with it, a
    column where smaller wins, ties are settled.
    """
    if priority is None:
        by = Window.partitionBy(key).orderBy(F.desc("c"))
        ranked = votes.withColumn("r", F.rank().over(by)).where("r = 1")
        return ranked.groupBy(key).agg(F.min(label).alias(label), F.max("c").alias("n_votes"), F.count("*").alias("ties")).where("ties = 1").drop("ties")
    by = Window.partitionBy(key).orderBy(F.desc("c"), priority)
    return votes.withColumn("r", F.row_number().over(by)).where("r = 1").select(key, label, F.col("c").alias("n_votes"))


def fold_rare(df: DataFrame, label: str, least: int, to: str = "OTHER") -> DataFrame:
    """Labels of fewer than `least` rows become `to`."""
    rare = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") < least)
    return df.join(rare, label, "left").withColumn(label, F.when(F.col("_n").isNull(), F.col(label)).otherwise(to)).drop("_n")
