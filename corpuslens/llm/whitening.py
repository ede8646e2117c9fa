"""Whitening of embeddings: principal components of exact integers, scaled to unit variance.

Vectors become integers, so their sums and deviations are exact. The centred rows
are a distributed matrix whose singular values, over the square root of the
number of rows, are the components' deviations; the total variance comes from
the exact deviations, not from the decomposition. Workers add up dimensions'
sums and products in their tasks; the driver holds a square of the dimensions.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, tidy

#: Most dimensions: the driver holds a few dense matrices of their square.
DIMENSIONS = 4096
#: Components whose singular value is a smaller share of the first one's are of no variance.
RANK = 1e-9


def integers(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """(id, x): floor(scale * c) + shift of each entry c.

    Rows whose vector is null or holds a null or non-finite entry are left out,
    rows without an id stay. Repeated ids are rows of their own.
    """
    good = F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y.cast("double")) & (F.abs(y.cast("double")) < float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("v is not null").where(good)
    return rows.select("id", F.transform("v", lambda y: F.floor(y.cast("double") * scale).cast("long") + F.lit(shift).cast("long")).alias("x"))


def _matrix(column) -> np.ndarray:
    """A batch's list column, all of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(df: DataFrame, cells, width: int, kind: str) -> np.ndarray:
    """The sum over all rows of cells(batch), `width` numbers a batch.

    A task adds up its batches, and the tasks' cells meet by place.
    """

    def arrow(batches):
        total = None
        for b in batches:
            if b.num_rows:
                own = cells(b)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["at", "x"])

    rows = df.mapInArrow(tidy(arrow), f"at int, x {kind}").groupBy("at").agg(F.sum("x").alias("x")).collect()  # width rows
    out = np.zeros(width, np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["at"]] = r["x"]
    return out


def _squares(centred: np.ndarray) -> list:
    """The exact sum of squares of each row of integers, as Python integers."""
    if centred.size and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 2**63:
        return (centred * centred).sum(axis=1).tolist()
    return [sum(int(v) * int(v) for v in row) for row in centred]


def _components(x: DataFrame, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the covariance, divisor n, of rows x; those of no variance are left out."""
    d = len(sums)
    sum_of = F.array(*[F.lit(int(s)) for s in sums])
    # (n * x - sum) is exact; one division rounds.
    centred = x.select(array_to_vector(F.zip_with("x", sum_of, lambda a, s: (a * F.lit(n) - s).cast("double") / F.lit(float(n)))).alias("v"))
    # All d components: asked for a few, the library would iterate to a tolerance instead.
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, d).computeSVD(d, computeU=False, rCond=RANK)
    s = svd.s.toArray()
    s = s[s > 0]  # equal rows have a zero at the front
    return s * s / n, svd.V.toArray()[:, : len(s)]


def whiten(df: DataFrame, id_col: str, vec_col: str, components: int = 32, scale: int = 64, shift: int = 0) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): each vector on each of the first components.

    deviation is the exact sum over dimensions of (n * x - sum)^2, a decimal of 38
    digits (beyond them the job fails rather than round). explained is the
    component's share of the total variance; identity_error, one value for all, the
    largest entry of the whitened rows' covariance less the identity. Null and
    non-finite vectors take no part; of unequal lengths the most frequent one is
    taken, the longer of equals, and other rows are left out. Components without
    variance have no whitened values and are left out, so a single row, equal rows
    or an empty table give none. Other columns aren't read.
    """
    spark, most = df.sparkSession, components
    store = Store(spark)
    x = store.put(integers(df, id_col, vec_col, scale, shift), "integers")
    none = x.select(
        F.col("id").alias(id_col), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("decimal(38,0)").alias("deviation"), *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")]
    ).limit(0)
    length = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if not length or not length["d"]:
        return none
    d, n = length["d"], length["n"]
    if d > DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions: the covariance would not fit the driver")
    x = x.where(F.size("x") == d)
    sums = _added(x.select("x"), lambda b: _matrix(b.column("x")).sum(axis=0), d, "long")
    if n < 2:
        return none
    values, vectors = _components(x, n, sums)
    k = min(most, len(values))
    if not k:
        return none
    values, vectors = values[:k], vectors[:, :k]
    scaled = vectors / np.sqrt(values)

    def project(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                centred = _matrix(part.column("x")) * n - sums
                w = centred / n @ scaled
                deviation = pa.array([Decimal(v) for v in _squares(centred)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([part.column("id"), deviation, pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))], names=["id", "deviation", "w"])

    rows = store.put(x.mapInArrow(tidy(project), f"id {dict(x.dtypes)['id']}, deviation decimal(38,0), w array<double>"), "whitened")
    # sum of deviations = n^3 * trace, exactly.
    total = rows.agg(F.sum("deviation")).first()[0]
    if total is None:
        raise ArithmeticError("the sum of the deviations has more than 38 digits")
    trace = float(total) / n / n / n
    mean = _added(rows.select("w"), lambda b: _matrix(b.column("w")).sum(axis=0), k, "double") / n

    def products(b):
        m = _matrix(b.column("w")) - mean
        return (m.T @ m).ravel()

    covariance = _added(rows.select("w"), products, k * k, "double").reshape(k, k) / n
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    out = rows.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
