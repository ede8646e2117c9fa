"""Shared parts of the operators: the shared folder, lineage cuts, text hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
MASK = (1 << 64) - 1
#: Spark's setting under which a query's shuffle files go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch, at most, while a table is written: long texts must not add up in a worker.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where the session names none, a temporary folder serves a session on one
    machine, as in tests; on a cluster there must be one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="corpuslens-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Store:
    """Written intermediate tables in the shared folder, dropped when not needed.

    A written table cuts lineage, so a lost executor costs a read rather than a
    recomputation. What is left of them goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/corpuslens/{uuid.uuid4().hex}"
        self.n, self.kept = 0, False

    def _files(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        if not self.kept:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            self._files(self.root).mkdirs(at)
            self.kept = self._files(self.root).deleteOnExit(at)
        self.n += 1
        return f"{self.root}/{self.n:03d}_{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """df, written; the shuffle files of its plan go with the end of the write."""
        at = self.path(name)
        conf = self.spark.conf
        before = {CLEANUP: conf.get(CLEANUP, "false"), BATCH: conf.get(BATCH, "10000")}
        rows = int(before[BATCH])
        conf.set(CLEANUP, "true")
        conf.set(BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
        try:
            df.write.option("compression", "zstd").parquet(at)
        finally:
            for key, value in before.items():
                conf.set(key, value)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._corpuslens_path = at
        return out

    def drop(self, *tables) -> None:
        """Deletes written tables (DataFrames from put(), or paths)."""
        for x in tables:
            at = x if isinstance(x, str) else x._corpuslens_path
            self._files(at).delete(self.spark._jvm.org.apache.hadoop.fs.Path(at), True)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle whose count must be given."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


#: Most rows of a side that is broadcast whole; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast where its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hot_join(left: DataFrame, right: DataFrame, on, count: str, total: int, how: str = "left", share: int = 1000) -> DataFrame:
    """Joins left with right (one row a key) although a key may hold a third of left.

    right's column `count` says how many rows of left have the key. Keys with
    more than total/share rows, at most `share` of them, are broadcast; the
    others, none of which is large, are shuffled. Give a written right side: it
    is read twice.
    """
    keys = [on] if isinstance(on, str) else list(on)
    most = max(1, total // share)
    hot = right.where(F.col(count) > most)
    tagged = left.join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    a = tagged.where("_hot").drop("_hot").join(F.broadcast(hot), keys, how)
    b = tagged.where("_hot is null").drop("_hot").join(right.where(F.col(count) <= most), keys, how)
    return a.unionByName(b)


def salted_join(left: DataFrame, right: DataFrame, on, count: str, total: int, spread, how: str = "left_semi", share: int = 1000) -> DataFrame:
    """As hot_join, in one pass: rows of large keys are dealt out by `spread`, a hash of the row, and right's row of such a key is repeated."""
    keys = [on] if isinstance(on, str) else list(on)
    n, large = parallelism(left.sparkSession), F.col(count) > max(1, total // share)
    a = left.join(F.broadcast(right.where(large).select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    a = a.withColumn("_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(n)).cast("int")).otherwise(0)).drop("_hot")
    b = right.withColumn("_salt", F.explode(F.when(large, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def tidy(run):
    """run, a function of batches, giving freed memory back to the system at its end.

    Python workers outlive their tasks; without this an idle one keeps the
    largest heap it ever had, beside the tasks of the next stage.
    """

    def then(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return then


# ---- vectorised hashing of texts -------------------------------------------------

_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 1 << 64)
_pows: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n at least."""
    have = len(_pows["p"]) if _pows else 0
    if have < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for key, base in (("p", _B), ("q", _BINV)):
                out = np.ones(size, np.uint64)
                step, at = np.uint64(base), 1
                while at < size:
                    out[at:2 * at] = out[:at] * step
                    step = np.uint64((int(step) * int(step)) & MASK)
                    at *= 2
                _pows[key] = out
    return _pows["p"], _pows["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of values[start:end] for each pair; equal content, equal hash."""
    n = len(values)
    p, q = powers(n + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1 + seed)) * p[:n], out=h[1:])
        out = (h[ends] - h[starts]) * q[starts]
        return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined(texts: list, sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with a separator after each, and each text's start (one more for the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + len(sep) for r in raw], out=starts[1:])
    return np.frombuffer(sep.join([*raw, b""]), np.uint8), starts


def words_of(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends, and for each text the index of its first word (one more for the end)."""
    data, starts = joined(texts)
    if lower:
        data = _LOWER[data]
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    ws, we = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return data, ws, we, np.searchsorted(ws, starts)


def sliding_min_leftmost(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the index of the least, the leftmost of equals."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = h.copy(), np.arange(len(h)), 1
    while span < w:  # doubling; the last step overlaps
        step = min(span, w - span)
        m = len(best) - step
        right = best[step:] < best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        span += step
    return at[:n]
