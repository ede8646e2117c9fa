"""The token fact table and counts over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def tokens(docs: DataFrame, *keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept columns, i, n, w): a row a token; i counts from 0, n is the record's length."""
    ws = docs.select(id_col, *keep, words(F.col(text_col)).alias("ws"))
    # Outer, as otherwise a filter on the words' number splits every text a second time.
    return ws.select(id_col, *keep, F.size("ws").alias("n"), F.posexplode_outer("ws").alias("i", "w")).where("w is not null")


def vocabulary(toks: DataFrame) -> DataFrame:
    """(w, freq)."""
    return toks.groupBy("w").agg(F.count("*").alias("freq"))


def census(toks: DataFrame, *by: str) -> DataFrame:
    """Tokens, types, words that occur once, per group.

    Types are counted through (group, word) counts, which combine before the
    shuffle, so no group's words gather in one place.
    """
    per = toks.groupBy(*by, "w").agg(F.count("*").alias("c"))
    return per.groupBy(*by).agg(F.sum("c").alias("n_tokens"), F.count("*").alias("n_types"), F.sum((F.col("c") == 1).cast("long")).alias("n_hapax"))


def duplicates(df: DataFrame, key, group_col: str) -> DataFrame:
    """(key, n_records, n_groups) of contents that several records have."""
    per = df.select(key.alias("key"), group_col).groupBy("key", group_col).agg(F.count("*").alias("c"))
    return per.groupBy("key").agg(F.sum("c").alias("n_records"), F.count("*").alias("n_groups")).where("n_records > 1")


def positions(toks: DataFrame, *by: str) -> DataFrame:
    """(by, w, n_occ, n_initial, n_second, n_final) over records of at least two tokens."""
    hit = lambda c: F.sum(c.cast("long"))
    return toks.where("n >= 2").groupBy(*by, "w").agg(
        F.count("*").alias("n_occ"), hit(F.col("i") == 0).alias("n_initial"), hit(F.col("i") == 1).alias("n_second"), hit(F.col("i") == F.col("n") - 1).alias("n_final")
    )


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows under a total order; each task keeps k before one merges them."""
    return df.orderBy(*order).limit(k)
