"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are packed into blocks of posting lists: for every term (component)
the rows that have it and their weights. A sparse query row walks its terms and
scatters weight products into a dense score array over the block; a partition
selection keeps the block's k best, and the blocks' lists are merged. Both sides
are blocked, so no side is broadcast, and a cell (query block, candidate block)
is the unit that a lost executor costs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, tidy

BLOCK = 8192
QUERY_BLOCK = 2048


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of each component.

    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part. An empty vector takes part and scores 0. Products
    are 64-bit, so scaled components must stay below 2**31 in size.
    """
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("x"))
        .where("id is not null and x is not null")
        .where(F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y.cast("double")) & (F.abs(y.cast("double")) < float("inf"))))
        .select("id", F.transform("x", lambda y: F.floor(y.cast("double") * scale).cast("long")).alias("v"))
    )


def _pack(key: str):
    """Posting lists of one block, in a few binary columns."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        sizes = np.array([len(v) for v in pdf["v"]], np.int64)
        flat = np.concatenate([np.asarray(v, np.int64) for v in pdf["v"]]) if sizes.sum() else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keep = flat != 0
        row, term, flat = row[keep], term[keep], flat[keep]
        order = np.argsort(term, kind="stable")
        return pd.DataFrame({
            key: [int(pdf[key].iloc[0])], "ids": [pdf["id"].to_numpy(np.int64).tobytes()],
            "term": [term[order].astype(np.int32).tobytes()], "row": [row[order].astype(np.int32).tobytes()],
            "weight": [flat[order].astype(np.int32 if np.abs(flat).max(initial=0) < 2**31 else np.int64).tobytes()],
            "wide": [bool(np.abs(flat).max(initial=0) >= 2**31)],
        })

    return pack


def _blocks(df: DataFrame, key: str, n: int) -> DataFrame:
    return (
        df.withColumn(key, F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).groupBy(key)
        .applyInPandas(_pack(key), f"{key} int, ids binary, term binary, row binary, weight binary, wide boolean")
    )


def _read(ids, term, row, weight, wide):
    return (np.frombuffer(ids, np.int64), np.frombuffer(term, np.int32), np.frombuffer(row, np.int32),
            np.frombuffer(weight, np.int64 if wide else np.int32))


def score_cell(candidates, queries, k: int) -> pd.DataFrame:
    """Each query's k best of one candidate block, ties to the smaller id."""
    ids, term, row, weight = candidates
    q_ids, q_term, q_row, q_weight = queries
    n = len(ids)
    terms, at = np.unique(term, return_index=True)
    at = np.append(at, len(term))
    bound = float(np.abs(weight.astype(np.float64)).max(initial=0)) * float(np.abs(q_weight.astype(np.float64)).max(initial=0)) * max(1, len(terms))
    kind = np.int32 if bound < 2**31 else np.int64
    lists = {}
    for t, lo, hi in zip(terms.tolist(), at[:-1], at[1:]):
        if 4 * (hi - lo) >= n and row[lo:hi].max(initial=0) < n:  # a long list is kept dense: the scatter is then one addition
            dense = np.zeros(n, kind)
            dense[row[lo:hi]] = weight[lo:hi]
            lists[t] = (None, dense)
        else:
            lists[t] = (row[lo:hi], weight[lo:hi].astype(kind))
    order = np.argsort(q_row, kind="stable")
    q_term, q_row, q_weight = q_term[order], q_row[order], q_weight[order]
    cut = np.searchsorted(q_row, np.arange(len(q_ids) + 1))
    score, product = np.zeros(n, kind), np.zeros(n, kind)
    out_q, out_c, out_s = [], [], []
    for i, q in enumerate(q_ids.tolist()):
        score[:] = 0
        for t, w in zip(q_term[cut[i]:cut[i + 1]].tolist(), q_weight[cut[i]:cut[i + 1]]):
            if t in lists:
                rows, weights = lists[t]
                if rows is None:
                    np.multiply(weights, kind(w), out=product)
                    np.add(score, product, out=score)
                else:
                    score[rows] += weights * kind(w)
        own = np.flatnonzero(ids == q)
        m = n - len(own)
        if m <= 0:
            continue
        low = np.iinfo(kind).min
        score[own] = low
        if m > k:
            kth = np.partition(score, n - k)[n - k]
            above = np.flatnonzero(score > kth)
            equal = np.flatnonzero(score == kth)[: k - len(above)]  # ids ascend within a block
            best = np.concatenate((above, equal))
        else:
            best = np.setdiff1d(np.arange(n), own)
        out_q.append(np.full(len(best), q, np.int64))
        out_c.append(ids[best])
        out_s.append(score[best].astype(np.int64))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": join(out_q), "vec_id": join(out_c), "score": join(out_s)})


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products.

    vectors and queries have (id, v array<long>). A candidate with the query's
    id is its own row and is left out. Ties go to the smaller id. With fewer
    than k candidates all are returned; with none, none.
    """
    spark = vectors.sparkSession
    store = Store(spark)
    nc = max(1, -(-vectors.count() // block))
    nq = max(1, -(-queries.count() // query_block))
    c = store.put(_blocks(vectors, "cb", nc), "candidates")
    q = store.put(_blocks(queries, "qb", nq), "queries")
    names = ("ids", "term", "row", "weight", "wide")
    c = c.select("cb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.struct(*names).alias("c"))
    q = q.select("qb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"), F.struct(*names).alias("q"))
    cells = min(nc * nq * 2, 20_000)
    both = c.repartition(cells, "cb", "qb").join(q.repartition(cells, "cb", "qb"), ["cb", "qb"])

    def arrow(batches):
        for batch in batches:
            for r in batch.to_pylist():
                pdf = score_cell(_read(*(r["c"][x] for x in names)), _read(*(r["q"][x] for x in names)), k)
                yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    part = both.select("c", "q").mapInArrow(tidy(arrow), "query_id long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
