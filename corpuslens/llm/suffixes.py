"""Repeated byte strings by column-wise construction of collection suffix orders.

Windows of m bytes are compared where they share an anchor (see winnow). Around
an anchor each place gives a string, and the strings of an anchor, aligned at
it, are a collection. Their order is built column by column from the right: each
round reads the next column from sequential files and inserts one symbol per
string in front of its suffix. The symbols are read in the order of the suffixes;
a stable sort by symbol gives the new suffix order, and longest common prefixes
follow from the minima between equal symbols. A suffix whose common prefix with
a neighbour reaches a length starts a repeated window of that length. Only the
present round's order and common prefixes are kept, a few numbers a string: the
blocks of earlier rounds are not merged into one transform, because suffixes
that stand at different distances from an anchor need no comparison. Columns lie
in unnamed scratch files of the task, which a lost executor's retry writes anew.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, hot_join, joined, parallelism, range_hash, salted_join, tidy
from .quality import _slices as slices
from .winnow import anchors, first_texts, with_keys

GRAM = 128
#: Repeated strings of this many bytes are reported, although shorter than what is removed: 51 words have 300 or so.
NEAR = 256
#: Bytes of columns that a task orders at once; a collection is never parted.
CHUNK_BYTES = 48 << 20


class Columns:
    """Aligned strings as column files: appended in blocks, read a column at a time."""

    def __init__(self, width: int):
        self.width, self.blocks, self.file = width, [], tempfile.TemporaryFile()
        self.rows = 0

    def append(self, strings: list, lefts: np.ndarray) -> None:
        """Adds strings, the first symbol of each at column lefts; other places are empty (0)."""
        block = np.zeros((len(strings), self.width), np.uint16)
        sizes = np.array([len(s) for s in strings])
        flat = np.frombuffer(b"".join(strings), np.uint8)
        row = np.repeat(np.arange(len(strings)), sizes)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lefts, sizes)
        block[row, col] = flat.astype(np.uint16) + 1
        self.blocks.append((self.file.seek(0, 2), len(strings)))
        self.file.write(np.ascontiguousarray(block.T).tobytes())
        self.rows += len(strings)

    def column(self, c: int) -> np.ndarray:
        out = []
        for at, rows in self.blocks:
            self.file.seek(at + 2 * c * rows)
            out.append(np.frombuffer(self.file.read(2 * rows), np.uint16))
        return np.concatenate(out)


def repeated_starts(columns: Columns, group: np.ndarray, lengths: tuple, last: int) -> list:
    """For each length n, flags[string, c] for columns c <= last: a window of n symbols at c occurs in another string of the group, at c.

    group numbers the strings' collections in ascending order.
    """
    m, most = columns.rows, max(lengths)
    order, lcp = np.arange(m), np.zeros(m + 1, np.int32)
    border = np.ones(m + 1, bool)  # a place in the order where a group begins
    border[1:m] = group[1:] != group[:-1]
    flags = [np.zeros((last + 1, m), bool) for _ in lengths]
    base = group.astype(np.int64) << 16
    for c in range(columns.width - 1, -1, -1):
        symbol = columns.column(c)[order]  # the symbols that stand before this round's suffixes
        key = base + symbol
        same = key[1:] == key[:-1]
        if (same | border[1:m]).all():
            joined_to = same
            low = lcp[1:m]
        else:
            by = np.argsort(key, kind="stable")
            key, order = key[by], order[by]
            joined_to = key[1:] == key[:-1]
            low = np.zeros(m - 1, np.int32)
            j = np.flatnonzero(joined_to)
            if len(j):
                pair = np.empty(2 * len(j), np.int64)
                pair[0::2], pair[1::2] = by[j] + 1, by[j + 1] + 1
                low[j] = np.minimum.reduceat(lcp, pair)[::2]
        symbol_there = (key & 0xFFFF) > 0
        fresh = np.zeros(m + 1, np.int32)
        fresh[1:m] = np.where(joined_to & symbol_there[1:], np.minimum(low + 1, most), 0)
        lcp = fresh
        if c <= last:
            for n, there in zip(lengths, flags):
                there[c, order] = (lcp[:m] >= n) | (lcp[1:] >= n)
    return [x.T for x in flags]


def _pieces(docs: DataFrame, n: int, m: int, k: int) -> DataFrame:
    """For each place of an anchor in `at`: (fp, d1, d2, doc_id, k1, pos, back, last, reach, seg).

    The m-byte windows that select the anchor start at pos - back to pos + last.
    seg holds the bytes [pos - back, pos + reach) of the n-byte windows that
    start there, as far as the text goes, once per batch and content; d1 and d2
    identify them.
    """

    def run(batches):
        for b in batches:
            for part in slices(b.column("text")):
                piece = b.slice(*part)
                data, starts, owner = _bytes(piece.column("text").to_pylist())
                start, best, grams = anchors(data, owner, m, k)
                hit = np.zeros(len(data) + 1, bool)
                lists = piece.column("at")
                hit[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(starts[:-1], np.diff(lists.offsets.to_numpy()))] = True
                keep = hit[best]
                start, best = start[keep], best[keep]
                head = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1]))) if len(best) else np.zeros(0, int)
                tail = np.append(head[1:], len(best)) - 1 if len(best) else head
                a, last, at = start[head], start[tail], best[head]
                who = owner[at]
                z = np.minimum(last + n, starts[1:][who] - 1)
                d1, d2 = range_hash(data, a, z, 5), range_hash(data, a, z, 6)
                d1 = d1 ^ (at - a).astype(np.uint64)
                fp = grams[at]
                order = np.lexsort((d2, d1, fp))
                f, x, y = fp[order], d1[order], d2[order]
                lead = np.ones(len(order), bool)
                lead[1:] = (f[1:] != f[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
                shown = np.zeros(len(order), bool)
                shown[order] = lead
                raw = data.tobytes()
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(fp.view(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), piece.column("doc_id").take(take), piece.column("k1").take(take),
                        *[pa.array(x.astype(np.int32)) for x in (at - starts[who], at - a, last - at, z - at)],
                        pa.array([raw[p:q] if s else None for p, q, s in zip(a.tolist(), z.tolist(), shown.tolist())], pa.binary()),
                    ],
                    names=["fp", "d1", "d2", "doc_id", "k1", "pos", "back", "last", "reach", "seg"],
                )

    schema = "fp long, d1 long, d2 long, doc_id long, k1 long, pos int, back int, last int, reach int, seg binary"
    return docs.select("doc_id", "k1", "text", "at").mapInArrow(tidy(run), schema)


def _bytes(texts):
    data, starts = joined(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    owner[starts[1:] - 1] = -1 - np.arange(len(texts))  # separators belong to no text
    return data, starts, owner


def fingerprints(docs: DataFrame, n: int, k: int) -> DataFrame:
    """(fp, doc_id, k1, pos) of the anchors of all n-byte windows of each text."""

    def run(batches):
        for b in batches:
            for part in slices(b.column("text")):
                piece = b.slice(*part)
                data, starts, owner = _bytes(piece.column("text").to_pylist())
                _, best, grams = anchors(data, owner, n, k)
                at = np.unique(best)
                who = owner[at]
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[at].view(np.int64)), piece.column("doc_id").take(take), piece.column("k1").take(take), pa.array((at - starts[who]).astype(np.int32))], names=["fp", "doc_id", "k1", "pos"]
                )

    return docs.select("doc_id", "k1", "text").mapInArrow(tidy(run), "fp long, doc_id long, k1 long, pos int")


RUNS = "array<struct<a:int,b:int>>"


def _order(n: int, m: int, k: int):
    """(fp, d1, d2, runs, near) of strings sorted by (fp, d1, d2), whole collections at a time.

    runs are the window starts of repeated n-byte strings, near those of m bytes.
    """
    span = m - k  # the most that a window starts before its anchor
    schema = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def lists(flags):
        """For each string its runs of flagged columns, as places relative to the anchor."""
        framed = np.zeros((len(flags), span + 3), np.int8)
        framed[:, 1:span + 2] = flags
        edge = np.diff(framed, axis=1)
        row, a = np.nonzero(edge == 1)
        _, b = np.nonzero(edge == -1)
        offsets = np.searchsorted(row, np.arange(len(flags) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array((a - span).astype(np.int32)), pa.array((b - 1 - span).astype(np.int32))], names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(schema)

    def flush(columns, keys):
        keys = np.concatenate(keys, 1)
        if columns.rows > 1:
            group = np.cumsum(np.concatenate(([0], np.diff(keys[0]) != 0)))
            runs, near = repeated_starts(columns, group, (n, m), span)
            rows = np.flatnonzero(near.any(1))
            if len(rows):
                yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in keys), lists(runs[rows]), lists(near[rows])], names=["fp", "d1", "d2", "runs", "near"])
        columns.file.close()

    def run(batches):
        columns, keys, last = Columns(span + n), [], None
        for b in batches:
            now = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in ("fp", "d1", "d2")])
            if not len(b):
                continue
            before = np.concatenate((now[:, :1] if last is None else last, now[:, :-1]), 1)
            new = (now != before).any(0)
            new[0] |= last is None
            known = np.concatenate(([0], np.cumsum(new)))
            begins = np.flatnonzero(now[0] != before[0])  # of collections
            segs, lefts = b.column("seg"), span - b.column("back").to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(b):
                full = begins[(begins >= at) & ((columns.rows + known[begins] - known[at]) * 2 * columns.width > CHUNK_BYTES)]
                to = int(full[0]) if len(full) else len(b)
                rows = at + np.flatnonzero(new[at:to])
                if len(rows):
                    columns.append(segs.take(pa.array(rows)).to_pylist(), lefts[rows])
                    keys.append(now[:, rows])
                if len(full):
                    yield from flush(columns, keys)
                    columns, keys = Columns(span + n), []
                at = to
            last = now[:, -1:]
        if keys:
            yield from flush(columns, keys)

    return run


def _covered(piece, name: str, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of a batch's bytes the spans of a column cover."""
    lists = piece.column(name)
    base = np.repeat(starts[:-1], np.diff(lists.offsets.to_numpy()))
    pair = lists.flatten()
    cover = np.zeros(size + 1, np.int32)
    np.add.at(cover, pair.field("a").to_numpy(zero_copy_only=False) + base, 1)
    np.add.at(cover, pair.field("b").to_numpy(zero_copy_only=False) + base, -1)
    return np.cumsum(cover)[:size] > 0


def _cut(n: int, m: int):
    """Drops from each text the bytes that spans cover, or all bytes of a copy of at least n; counts those that near covers."""

    def run(batches):
        for b in batches:
            for part in slices(b.column("text")):
                piece = b.slice(*part)
                data, starts, _ = _bytes(piece.column("text").to_pylist())
                size = np.diff(starts) - 1
                copy = piece.column("copy").to_numpy(zero_copy_only=False)
                count = lambda x: (lambda c: c[starts[1:]] - c[starts[:-1]])(np.concatenate(([0], np.cumsum(x))))
                marked = []
                for name, least in (("spans", n), ("near", m)):
                    there = _covered(piece, name, starts, len(data)) | np.repeat(copy & (size >= least), size + 1)
                    there[starts[1:] - 1] = False
                    marked.append(there)
                dead, near = marked
                runs = np.bincount(np.searchsorted(starts, np.flatnonzero(dead & ~np.concatenate(([False], dead[:-1]))), side="right") - 1, minlength=len(size))
                gone, keep = count(dead), ~dead
                keep[starts[1:] - 1] = False
                kept = data[keep].tobytes()
                offsets = np.concatenate(([0], np.cumsum(size - gone)))
                column = pa.array([kept[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), column, *[pa.array(x.astype(np.int64)) for x in (size, gone, runs, count(near))]], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "n_repeated"]
                )

    return run


def repeated_spans(docs: DataFrame, n: int = 400, m: int = NEAR, k: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The texts with their keys, and (doc_id, k1, copy, spans, near) of those with any: bytes [a, b) covered by n-byte and by m-byte strings that occur elsewhere too.

    k <= m <= n. copy marks texts that several rows have: all their bytes repeat
    if there are enough of them. Rows without doc_id match nothing and are left
    out. Rows that repeat a doc_id are documents of their own.
    """
    store = Store(docs.sparkSession)
    texts, repeats = first_texts(store, docs)
    texts, rows = texts.where("doc_id is not null"), with_keys(docs, repeats)
    keyed = rows.where("doc_id is not null")
    prints = store.put(fingerprints(keyed, m, k), "prints")
    often = store.put(prints.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1"), "often")
    later = texts.where("doc_id <> first").select("doc_id", "k1")
    places = salted_join(prints, often, "fp", "c", prints.count(), F.xxhash64("doc_id", "pos")).join(later, ["doc_id", "k1"], "left_anti")
    places = store.put(places.groupBy("doc_id", "k1").agg(F.collect_set("pos").alias("at")), "places")
    store.drop(prints, often)
    pieces = store.put(_pieces(keyed.join(places, ["doc_id", "k1"]), n, m, k), "pieces")
    store.drop(places)
    keys = ["fp", "d1", "d2"]
    strings = pieces.where("seg is not null").select(*keys, "back", "seg").repartition(parallelism(docs.sparkSession), "fp").sortWithinPartitions(*keys)
    found = strings.mapInArrow(tidy(_order(n, m, k)), f"fp long, d1 long, d2 long, runs {RUNS}, near {RUNS}")
    # A string that several places have repeats whole; an ordered one, where its windows have neighbours.
    count = pieces.groupBy(*keys).agg(F.count_distinct("doc_id", "k1", "pos").alias("c"), *[F.max(x).alias(x) for x in ("reach", "back", "last")])
    whole = lambda end: F.when(end >= -F.col("back"), F.array(F.struct((-F.col("back")).alias("a"), end.cast("int").alias("b")))).otherwise(F.array().cast(RUNS))
    runs = count.join(found, keys, "left").select(
        *keys, "c", F.when(F.col("c") > 1, whole(F.col("reach") - n)).otherwise(F.col("runs")).alias("runs"), F.when(F.col("c") > 1, whole(F.col("last"))).otherwise(F.col("near")).alias("near")
    ).where("near is not null")
    runs = store.put(runs, "runs")
    spots = pieces.select(*keys, "doc_id", "k1", "pos")
    spans = hot_join(spots, runs, keys, "c", max(1, spots.count()), "inner")
    at = lambda name, size, near: F.transform(name, lambda r: F.struct(F.lit(near).alias("near"), F.struct((F.col("pos") + r["a"]).alias("a"), (F.col("pos") + r["b"] + size).alias("b")).alias("at")))
    spans = spans.select("doc_id", "k1", F.explode(F.concat(at("runs", n, False), at("near", m, True))).alias("x"))
    spans = spans.groupBy("doc_id", "k1").agg(F.collect_set(F.when(~F.col("x.near"), F.col("x.at"))).alias("spans"), F.collect_set(F.when(F.col("x.near"), F.col("x.at"))).alias("near"))
    copies = texts.where("copies > 1").select("doc_id", "k1", F.lit(True).alias("copy")).distinct()
    out = store.put(copies.join(spans, ["doc_id", "k1"], "full"), "spans")
    store.drop(pieces, runs)
    return rows, out


def dedup(docs: DataFrame, n: int = 400, m: int | None = None, k: int = GRAM) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans, n_repeated) of every row; a null text has no bytes.

    Bytes covered by n-byte strings that also start elsewhere go. n_repeated
    counts those that repeated strings of m bytes cover, which are reported and,
    below n, stay: passages of over 50 words are often shorter than 400 bytes.
    """
    m = min(NEAR, n) if m is None else m
    keyed, spans = repeated_spans(docs, n, m, k)
    rows = keyed.join(spans, ["doc_id", "k1"], "left")
    none = F.array().cast(RUNS)
    rows = rows.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("spans", none).alias("spans"), F.coalesce("near", none).alias("near"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_cut(n, m)), f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long, n_repeated long")
