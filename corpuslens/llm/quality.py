"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed per Arrow batch with numpy over the bytes of whole texts.
Trees are grown on the driver from a bounded sample of labelled rows, flattened
into arrays and carried to the executors, where all rows of a batch walk all
trees level by level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import joined, range_hash, tidy, words_of
from .html import STOP_WORDS

#: The most labelled rows that are fetched to the driver for fitting.
FIT_ROWS = 20_000
#: Bytes of text whose statistics are computed at once; workers keep what this takes.
SLICE = 1 << 18

FEATURES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "short_words", "upper", "digits", "symbols", "punctuation", "other_marks", "non_ascii",
    "spaces", "capital_words", "symbol_words", "digit_words", "letterless_words", "upper_words", "distinct_words", "top_word", "repeated_next", "stop_words",
    "distinct_pairs", "distinct_runs", "log_lines", "mean_line", "short_lines", "distinct_lines", "repeated_line_bytes", "ends", "words_per_end", "links", "at_signs",
    "sentence_case", "controls",
)


def _class(chars) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER, _DIGIT = _class(range(65, 91)), _class(range(97, 123)), _class(range(48, 58))
_SYMBOL = _class(b"#$%&*+<=>@\\^_`|~{}[]")
_PUNCT, _END, _OTHER = _class(b".,;:!?"), _class(b".!?"), _class(b"\"'()-/")
_LEAD, _BLANK, _CONTROL = _class(range(0xC0, 256)), _class([32, 9, 10, 11, 12, 13]), _class([*range(9), *range(14, 32), 127])
_LETTER = _UPPER | _LOWER | _class(range(128, 256))


def _distinct(owner: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each owner how many distinct keys it has, and how often the commonest occurs."""
    if not len(key):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((key, owner))
    o, k = owner[order], key[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (k[1:] != k[:-1])))
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(k)))
    most = np.zeros(n)
    np.maximum.at(most, o[at], runs)
    return np.bincount(o[at], minlength=n).astype(float), most


def features(texts: list) -> np.ndarray:
    """A row of FEATURES for each text; a null text counts as empty."""
    n = len(texts)
    data, ws, we, first = words_of(texts)
    _, starts = joined(texts)
    size = np.diff(starts) - 1
    total = lambda lut, a=None, b=None: _between(lut[data], starts[:-1] if a is None else a, starts[1:] - 1 if b is None else b)
    safe, words = np.maximum(size, 1), np.diff(first)
    wsafe = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    per = lambda x: np.bincount(owner, weights=x, minlength=n)
    length = (we - ws).astype(float)
    cols = [np.log1p(size), np.log1p(words)]
    mean = per(length) / wsafe
    cols += [mean, np.sqrt(np.maximum(per(length**2) / wsafe - mean**2, 0)), per(length > 12) / wsafe, per(length <= 2) / wsafe]
    cols += [total(x) / safe for x in (_UPPER, _DIGIT, _SYMBOL, _PUNCT, _OTHER, _LEAD, _BLANK)]
    in_word = lambda lut: _between(lut[data], ws, we)
    upper, letters, ends = in_word(_UPPER), in_word(_LETTER), in_word(_END)
    cols += [per(_UPPER[data[ws]]) / wsafe, per(in_word(_SYMBOL) > 0) / wsafe, per(in_word(_DIGIT) > 0) / wsafe, per(letters == 0) / wsafe, per((upper == length) & (length > 1)) / wsafe]
    key = range_hash(data, ws, we)
    kinds, top = _distinct(owner, key, n)
    same = np.concatenate((key[1:] == key[:-1], [False]))[: len(key)] if len(key) else np.zeros(0, bool)
    same &= np.concatenate((owner[1:] == owner[:-1], [False]))[: len(key)] if len(key) else same
    cols += [kinds / wsafe, top / wsafe, per(same) / wsafe, per(np.isin(key, _stops())) / wsafe]
    for k in (2, 4):
        if len(key) >= k:
            pair = range_hash(key, np.arange(len(key) - k + 1), np.arange(k, len(key) + 1))
            inside = owner[: len(pair)] == owner[k - 1:]
            own, pair = owner[: len(pair)][inside], pair[inside]
        else:
            own, pair = np.zeros(0, int), np.zeros(0, np.uint64)
        cols.append(_distinct(own, pair, n)[0] / np.maximum(np.bincount(own, minlength=n), 1))
    cut = np.flatnonzero(data == 10)  # each text ends with a line feed too
    begin = np.concatenate(([0], cut[:-1] + 1)).astype(np.int64)
    line_of = np.searchsorted(starts, begin, side="right") - 1
    span = cut - begin
    lines = np.maximum(np.bincount(line_of, minlength=n), 1)
    line_key = range_hash(data, begin, cut)
    different = _distinct(line_of, line_key, n)[0]
    order = np.lexsort((begin, line_key, line_of))
    again = np.zeros(len(begin), bool)
    again[order[1:]] = (line_key[order[1:]] == line_key[order[:-1]]) & (line_of[order[1:]] == line_of[order[:-1]])
    cols += [np.log1p(lines), size / lines, np.bincount(line_of, weights=span < 40, minlength=n) / lines, different / lines, np.bincount(line_of, weights=again * span, minlength=n) / safe]
    n_ends = per(ends > 0)
    cols += [n_ends / wsafe, words / np.maximum(n_ends, 1)]
    colon = (data[:-2] == 58) & (data[1:-1] == 47) & (data[2:] == 47) if len(data) > 2 else np.zeros(0, bool)
    cols += [np.bincount(np.searchsorted(starts, np.flatnonzero(colon), side="right") - 1, minlength=n) / wsafe, total(_class(b"@")) / wsafe]
    after_end = np.concatenate(([False], (ends[:-1] > 0) & (owner[1:] == owner[:-1]))) if len(key) else np.zeros(0, bool)
    cols += [per(after_end & (_UPPER[data[ws]] > 0)) / np.maximum(per(after_end), 1) if len(key) else np.zeros(n), total(_CONTROL) / safe]
    return np.stack([np.asarray(c, np.float64) for c in cols], 1).astype(np.float32)


def _between(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=c[1:], dtype=np.int32)
    return (c[b] - c[a]).astype(float)


_stop_hashes: list = []


def _stops() -> np.ndarray:
    if not _stop_hashes:
        data, ws, we, _ = words_of([" ".join(sorted(STOP_WORDS))])
        _stop_hashes.append(np.sort(range_hash(data, ws, we)))
    return _stop_hashes[0]


class Trees:
    """Gradient-boosted trees of a fixed depth, as arrays [tree, node]."""

    def __init__(self, base, feature, threshold, value, depth):
        self.base, self.feature, self.threshold, self.value, self.depth = base, feature, threshold, value, depth

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 5, rate: float = 0.1, bins: int = 64, l2: float = 2.0, least: float = 5.0) -> Trees:
        """Log-loss boosting on histograms of quantile bins; the same input gives the same trees."""
        n, m = x.shape
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
        base = np.log(p / (1 - p))
        feature, threshold, value = np.zeros((trees, 2**depth), np.int32), np.full((trees, 2**depth), np.inf, np.float32), np.zeros((trees, 2**depth), np.float32)
        if not n or y.min() == y.max():
            return Trees(base, feature, threshold, value, depth)
        edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)).astype(np.float32) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin b: x <= edge b
        flat = binned + np.arange(m) * bins
        score = np.full(n, base)
        for t in range(trees):
            q = 1 / (1 + np.exp(-score))
            g, h = q - y, np.maximum(q * (1 - q), 1e-6)
            node = np.ones(n, np.int64)
            for level in range(depth):
                width = 1 << level
                at = ((node - width)[:, None] * (m * bins) + flat).ravel()
                sg = np.bincount(at, weights=np.repeat(g, m), minlength=width * m * bins).reshape(width, m, bins).cumsum(2)
                sh = np.bincount(at, weights=np.repeat(h, m), minlength=width * m * bins).reshape(width, m, bins).cumsum(2)
                tg, th = sg[:, :, -1:], sh[:, :, -1:]
                gain = sg**2 / (sh + l2) + (tg - sg) ** 2 / (th - sh + l2) - tg**2 / (th + l2)
                gain[(sh < least) | (th - sh < least)] = -1
                for j, e in enumerate(edges):
                    gain[:, j, len(e):] = -1
                pick = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1)[np.arange(width), pick] > 1e-6
                f, b = pick // bins, pick % bins
                for k in np.flatnonzero(good):
                    feature[t, width + k], threshold[t, width + k] = f[k], edges[f[k]][b[k]]
                at = node
                node = 2 * node + (x[np.arange(n), feature[t, at]] > threshold[t, at])
            leaf = node - (1 << depth)
            value[t] = -rate * np.bincount(leaf, weights=g, minlength=1 << depth) / (np.bincount(leaf, weights=h, minlength=1 << depth) + l2)
            score += value[t, leaf]
        return Trees(base, feature, threshold, value, depth)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: all rows step through all trees together."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))[None, :]
        node = np.ones((len(x), len(self.feature)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        raw = self.base + self.value[trees, node - (1 << self.depth)].sum(1, dtype=np.float64)
        return 1 / (1 + np.exp(-raw))


def split_of(doc_id) -> F.Column:
    """crc32 of the id's decimal text, modulo 4; remainder 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, **how) -> Trees:
    """Trees from at most `rows` labelled documents, those of least id hash.

    Only rows outside the held-out split with a label of 0 or 1 are used; a
    document with several labels counts with the least of them. With no labelled
    rows the score is 0.5 everywhere.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (split_of(F.col("doc_id")) != 2))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)

    def stats(batches):
        for b in batches:
            for part in _slices(b.column("text"), SLICE):
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(*part), b.column("_y").slice(*part), pa.array([r.tobytes() for r in features(b.column("text").slice(*part).to_pylist())], pa.binary())],
                    names=["_id", "_y", "x"],
                )

    chosen = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "_id")
    got = chosen.select("_id", F.col("_y").cast("int").alias("_y"), "text").mapInArrow(tidy(stats), "_id long, _y int, x binary")
    got = got.orderBy("_id", "x").limit(4 * rows).toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, len(FEATURES))
    return Trees.fit(x, got["_y"].to_numpy(np.float64), **how)


def _slices(column, most: int = 1 << 20):
    """(offset, length) pieces of a text column of about a megabyte each."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // most
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(size)]))
    return [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def score(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """docs with a column score, in place of one of that name; a null or empty text is scored like any other."""
    docs = docs.drop("score")
    src = docs.withColumn("_scored_text", F.col(text_col).cast("string"))
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def run(batches):
        for b in batches:
            for part in _slices(b.column("_scored_text"), SLICE):
                piece = b.slice(*part)
                s = trees.score(features(piece.column("_scored_text").to_pylist()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(s, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return src.mapInArrow(tidy(run), schema)
