"""Substring dedup with a log-structured fingerprint index.

Documents arrive in batches. A batch's winnowed window fingerprints are written
as an immutable run, sorted and bucketed by fingerprint, and merge-joined with
the runs of history without moving either. Runs of a level are compacted into
one of the next when there are `fan_in` of them. Matched fingerprints, of the
batch and of history, are verified: around them all windows are compared by
hashes of all their words, and the earliest of equal windows stays. An index with
a path outlives its session: it is opened again and fed the next batch.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Store, parallelism, range_hash, tidy, words_of
from .quality import _slices as slices
from .winnow import anchors, first_texts, with_keys

GRAM = 8
#: Names of manifests; the last one in order holds.
MANIFEST = re.compile(r"manifest-\d{12}")


class FingerprintIndex:
    """Sorted immutable runs of (fp, doc_id, k1, pos), each bucketed by fp.

    With a path, in a folder that the driver and all executors share, runs stay
    there and save() lists them in a numbered manifest, from the last of which the
    same path opens the index again, in any session; runs without any manifest are
    an error, not an empty index. Keys then always have k1. Without a path the
    runs go with close().
    """

    def __init__(self, spark: SparkSession, fan_in: int = 3, buckets: int | None = None, path: str | None = None):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets or parallelism(spark)
        self.store, self.path, self.runs, self.old = Store(spark), path, [], []  # (level, table); files that compaction left
        names = self._names() if path else []
        manifests = [x for x in names if MANIFEST.fullmatch(x)]
        if not manifests and any(x.startswith("corpuslens_run_") for x in names):
            raise ValueError(f"{path} has runs but no manifest: it was never saved, or lost its manifest")
        if manifests:
            text = spark.read.text(f"{path}/{max(manifests)}", wholetext=True).first()["value"]
            kept = json.loads(text)
            self.buckets = kept["buckets"]
            for level, at in kept["runs"]:
                name = f"corpuslens_run_{uuid.uuid4().hex}"
                spark.sql(f"create table {name} (fp bigint, doc_id bigint, k1 bigint, pos int) using parquet clustered by (fp) sorted by (fp) into {self.buckets} buckets location '{path}/{at}'")
                self.runs.append((level, name))

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self) -> list:
        files, path = self._files()
        return [x.getPath().getName() for x in files.listStatus(path(self.path))] if files.exists(path(self.path)) else []

    def _write(self, df: DataFrame) -> str:
        name = f"corpuslens_run_{uuid.uuid4().hex}"
        at = f"{self.path}/{name}" if self.path else self.store.path("run")
        (df.repartition(self.buckets, "fp").sortWithinPartitions("fp").write.bucketBy(self.buckets, "fp").sortBy("fp")
         .option("path", at).option("compression", "zstd").saveAsTable(name))
        return name

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds a batch as a run; returns (doc_id, k1, pos) of all places whose fingerprint now repeats because of it."""
        new = self._write(batch)
        now = self.spark.table(new)
        # Fingerprints are counted, not windowed: runs are bucketed, so counts and joins move nothing.
        twice = now.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
        found = [now.join(twice, "fp", "left_semi")]
        mine = now.select("fp").distinct()
        for _, old in self.runs:
            run = self.spark.table(old)
            found += [now.join(run.select("fp"), "fp", "left_semi"), run.join(mine, "fp", "left_semi")]
        self.runs.append((0, new))
        return reduce(DataFrame.unionByName, found).select("doc_id", "k1", "pos")

    def compact(self) -> None:
        """Merges levels that are full; the old runs go, those of a saved index when the manifest no longer names them."""
        level = 0
        while any(x[0] >= level for x in self.runs):
            full = [x for x in self.runs if x[0] == level]
            if len(full) >= self.fan_in:
                merged = self._write(reduce(DataFrame.unionByName, [self.spark.table(t) for _, t in full]))
                self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, merged)]
                self._drop([t for _, t in full], files=not self.path)
            level += 1

    def _place(self, table: str) -> str:
        return self.spark.sql(f"describe formatted {table}").where("col_name = 'Location'").first()["data_type"]

    def _drop(self, tables, files: bool) -> None:
        for t in tables:
            at = self._place(t)
            self.spark.sql(f"drop table {t}")
            self.store.drop(at) if files else self.old.append(at)

    def save(self) -> None:
        """Writes the next manifest beside the runs, under another name until it is whole; then older ones, and files that it doesn't name, go.

        At any moment the last manifest names whole runs, so a crash loses what was
        not saved and nothing else.
        """
        runs = [(level, self._place(t).rstrip("/").rsplit("/", 1)[1]) for level, t in self.runs]
        files, path = self._files()
        before = sorted(x for x in self._names() if MANIFEST.fullmatch(x))
        new = f"manifest-{int(before[-1][9:]) + 1 if before else 1:012d}"
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps({"buckets": self.buckets, "runs": runs}),)], "value string").coalesce(1).write.text(draft)
        if not files.rename(path(draft), path(f"{self.path}/{new}")):
            raise OSError(f"{draft} could not be renamed to {new}")
        self.store.drop(*[f"{self.path}/{x}" for x in before], *self.old)
        self.old = []

    def close(self) -> None:
        """Lets the runs' tables go; their files too, unless the index has a path."""
        self._drop([t for _, t in self.runs], files=not self.path)
        self.runs = []


def _words(texts):
    data, ws, we, first = words_of(texts)
    return data, ws, we, first, range_hash(data, ws, we), np.repeat(np.arange(len(texts)), np.diff(first))


def fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(fp, doc_id, k1, pos) of the anchors of all n-word windows of each text."""

    def run(batches):
        for b in batches:
            for part in slices(b.column("text")):
                piece = b.slice(*part)
                _, _, _, first, h, owner = _words(piece.column("text").to_pylist())
                _, best, grams = anchors(h, owner, n, min(GRAM, n))
                at = np.unique(best)
                who = owner[at] if len(at) else at
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), piece.column("doc_id").take(take), piece.column("k1").take(take), pa.array((at - first[who]).astype(np.int32))],
                    names=["fp", "doc_id", "k1", "pos"],
                )

    return docs.select("doc_id", "k1", "text").mapInArrow(tidy(run), "fp long, doc_id long, k1 long, pos int")


def _windows(docs: DataFrame, n: int) -> DataFrame:
    """(w1, w2, doc_id, k1, s, again) of the windows whose anchor is in at.

    again marks windows that repeat an earlier one among the same few documents;
    it spares a frequent window's rows the shuffle by window.
    """

    def run(batches):
        for b in batches:
            for part in slices(b.column("text")):
                piece = b.slice(*part)
                _, _, _, first, h, owner = _words(piece.column("text").to_pylist())
                start, best, _ = anchors(h, owner, n, min(GRAM, n))
                hit = np.zeros(len(h) + 1, bool)
                lists = piece.column("at")
                sizes = np.diff(lists.offsets.to_numpy())
                hit[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(first[:-1], sizes)] = True
                start = start[hit[best]]
                w1 = range_hash(h, start, start + n)
                w2 = range_hash(h, start, start + n, 77)
                who = owner[start] if len(start) else start
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
                again = _later(w1, w2, ids[who], piece.column("k1").to_numpy(zero_copy_only=False)[who], start - first[who])
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1.view(np.int64)), pa.array(w2.astype(np.uint32).view(np.int32)), piece.column("doc_id").take(take), piece.column("k1").take(take), pa.array((start - first[who]).astype(np.int32)), pa.array(again)],
                    names=["w1", "w2", "doc_id", "k1", "s", "again"],
                )

    return docs.select("doc_id", "k1", "text", "at").mapInArrow(tidy(run), "w1 long, w2 int, doc_id long, k1 long, s int, again boolean")


def _later(w1, w2, ids, k1, s) -> np.ndarray:
    """Whether an equal window stands at a smaller (id, k1, s)."""
    order = np.lexsort((s, k1, ids, w2, w1))
    a, b, i, k, t = w1[order], w2[order], ids[order], k1[order], s[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = (i != i[lead]) | (k != k[lead]) | (t != t[lead])
    return out


def _cut(n: int):
    """Drops from each text the words that windows starting at `gone` cover, or all words of a copy."""

    def run(batches):
        for b in batches:
            for part in slices(b.column("text")):
                piece = b.slice(*part)
                data, ws, we, first, _, _ = _words(piece.column("text").to_pylist())
                words = np.diff(first)
                lists = piece.column("gone")
                sizes = np.diff(lists.offsets.to_numpy())
                start = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(first[:-1], sizes)
                cover = np.bincount(start, minlength=len(ws) + n + 1)[: len(ws) + n + 1] - np.bincount(start + n, minlength=len(ws) + n + 1)[: len(ws) + n + 1]
                dead = np.cumsum(cover)[: len(ws)] > 0
                copy = piece.column("copy").to_numpy(zero_copy_only=False) & (words >= n)
                dead |= np.repeat(copy, words)
                out = data.copy()
                out[we] = 32
                fill = np.zeros(len(data) + 2, np.int32)
                fill[ws[~dead]] += 1
                fill[we[~dead] + 1] -= 1
                mask = np.cumsum(fill)[: len(data)] > 0
                kept_words = np.concatenate(([0], np.cumsum(~dead)))
                kept = kept_words[first[1:]] - kept_words[first[:-1]]
                bytes_of = np.concatenate(([0], np.cumsum(np.where(~dead, we - ws + 1, 0))))
                size = bytes_of[first[1:]] - bytes_of[first[:-1]]
                mask[we[~dead]] = True
                text = out[mask]
                ends = np.cumsum(size)
                last = np.ones(len(text), bool)
                last[ends[size > 0] - 1] = False  # the space after each text's last word
                text = text[last]
                offsets = np.concatenate(([0], np.cumsum(size - (size > 0)))).astype(np.int32)
                column = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), column, pa.array(words.astype(np.int64)), pa.array((words - kept).astype(np.int64))], names=["doc_id", "text", "n_words", "n_removed"]
                )

    return run


def repeated_windows(docs: DataFrame, n: int = 20, batches: int = 4, fan_in: int = 3, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The texts with their keys, and (doc_id, k1, copy, gone): for each text the starts of the n-word windows that also start earlier.

    Earlier means in history (the documents whose fingerprints index holds), or
    at a smaller doc_id, or in the same document at a smaller start. copy marks
    documents whose whole text has a smaller doc_id too; their windows are not
    listed. Rows that share a doc_id but not their text count as documents of
    their own, ordered by text hash; rows without doc_id match nothing and are
    left out.
    """
    spark = docs.sparkSession
    store = Store(spark)
    texts, repeats = first_texts(store, docs, index is not None)
    texts, keyed = texts.where("doc_id is not null"), with_keys(docs, repeats)
    cuts = texts.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"] or [] if batches > 1 else []
    lows = [None, *sorted(set(cuts))]
    own, hits = index is None, []
    index = index or FingerprintIndex(spark, fan_in)
    try:
        for low, high in zip(lows, [*lows[1:], None]):
            part = keyed.where("doc_id is not null")
            part = part.where(F.col("doc_id") > low) if low is not None else part
            part = part.where(F.col("doc_id") <= high) if high is not None else part
            hits.append(store.put(index.append(fingerprints(part, n)), "hits"))
            index.compact()
    finally:
        if own:
            index.close()
    copies = texts.where("doc_id <> first").select("doc_id", "k1")
    places = reduce(DataFrame.unionByName, hits).join(copies, ["doc_id", "k1"], "left_anti")
    places = store.put(places.groupBy("doc_id", "k1").agg(F.collect_set("pos").alias("at")), "places")
    store.drop(*hits)
    windows = _windows(keyed.join(places, ["doc_id", "k1"]), n).withColumn("new", F.lit(True))
    if history is not None:
        windows = windows.unionByName(_windows(with_keys(history, True).where("doc_id is not null").join(places, ["doc_id", "k1"]), n).withColumn("new", F.lit(False)))
    spread = F.when(F.col("again"), F.xxhash64("doc_id", "s")).otherwise(0)
    rank = F.rank().over(Window.partitionBy("w1", "w2", spread).orderBy("new", "doc_id", "k1", "s"))
    gone = windows.withColumn("rank", rank).where("new and (again or rank > 1)").groupBy("doc_id", "k1").agg(F.collect_set("s").alias("gone"))
    gone = store.put(texts.select("doc_id", "k1", (F.col("doc_id") > F.col("first")).alias("copy")).distinct().join(gone, ["doc_id", "k1"], "left").where("copy or gone is not null"), "gone")
    store.drop(places)
    return keyed, gone


def dedup(docs: DataFrame, n: int = 20, batches: int = 4, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_removed) of every row: words covered by repeated n-word windows go.

    Kept words are joined by one space. A null text has no words. With an index
    the documents are a new batch: history are the documents that it holds, of
    which only those with a matched fingerprint are looked at again; afterwards
    the index holds the batch too.
    """
    keyed, gone = repeated_windows(docs, n, batches, index=index, history=history)
    rows = keyed.join(gone, ["doc_id", "k1"], "left")
    rows = rows.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_cut(n)), f"doc_id {kind}, text string, n_words long, n_removed long")
