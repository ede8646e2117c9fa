"""Content-defined fingerprints of fixed-length windows, and what repeats share.

Of the k-grams of a window of n symbols, the one with the least hash (the
leftmost of equals) is the window's anchor. Equal windows have equal anchors at
equal offsets, so windows can be compared among the few places that share an
anchor. Neighbouring windows mostly share theirs: about 2 / (n - k + 2) of all
positions are anchors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, hot_join, range_hash, sliding_min_leftmost


def anchors(symbols: np.ndarray, owner: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, the anchor of each, hash of the k-gram at each position).

    Only windows that lie within one owner are returned.
    """
    m = len(symbols) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(symbols) - k + 1)
    grams = range_hash(symbols, at, at + k)
    best = sliding_min_leftmost(grams, n - k + 1)[:m]
    start = np.flatnonzero(owner[:m] == owner[n - 1:])
    return start, best[start], grams


def text_key() -> tuple:
    """Two hashes that identify a text; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), F.reverse(text)).alias("k2")


def first_texts(store: Store, docs: DataFrame, always: bool = False) -> tuple[DataFrame, bool]:
    """(doc_id, k1, k2, first, copies), written: which rows hold the first copy of their text; and whether ids repeat.

    Where no doc_id has two texts, (doc_id, k1) needs no k1: it is 0, which spares
    eight bytes in every row that carries it, unless keys must always have it.

    first is the smallest doc_id with the text, copies the number of rows that
    have it. Rows without doc_id stand alone (first null, copies 1).
    """
    keys = store.put(docs.select("doc_id", *text_key()), "text_keys")
    groups = store.put(keys.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "text_copies")
    out = hot_join(keys, groups, ["k1", "k2"], "copies", max(1, keys.count()))
    own = F.col("doc_id").isNotNull()
    repeats = always or keys.where(own).groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("n")).where("n > 1").limit(1).count() > 0
    out = out.select(
        "doc_id", "k1", "k2", F.when(own, F.coalesce("first", "doc_id")).alias("first"), F.when(own, F.coalesce("copies", F.lit(1))).otherwise(1).alias("copies")
    ).dropDuplicates(["doc_id", "k1", "k2"])
    out = store.put(out.withColumn("k1", F.col("k1") if repeats else F.lit(0).cast("long")), "texts")
    store.drop(keys, groups)
    return out, repeats


def with_keys(docs: DataFrame, repeats: bool) -> DataFrame:
    """docs' doc_id and text, and k1 as in first_texts."""
    k1 = text_key()[0] if repeats else F.lit(0).cast("long").alias("k1")
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), k1)
