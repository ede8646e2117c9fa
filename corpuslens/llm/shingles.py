"""Words and word shingles in DataFrame functions alone."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SPACE


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words; an empty array for null, empty or blank text."""
    low = F.translate(text.cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    parts = F.split(low, SPACE)
    parts = F.when(F.element_at(parts, 1) == "", F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    parts = F.when(F.size(parts) == 0, parts).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.coalesce(parts, F.array().cast("array<string>"))


def hashes(w: Column, k: int) -> Column:
    """Hashes of the runs of k words; with 1 to k-1 words, of the whole sequence."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return (
        F.when(F.size(w) >= k, runs)
        .when(F.size(w) > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )


def texts(w: Column, k: int) -> Column:
    """The same runs as strings, words joined by one space."""
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) >= k, runs).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
