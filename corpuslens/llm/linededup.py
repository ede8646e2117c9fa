"""Line dedup with a suffix array over line-ID sequences, by distributed prefix doubling.

Every line is a symbol; a suffix is a position in a document up to the
document's end. Ranks are refined as in prefix doubling: a suffix's new rank is
its old rank plus the number of suffixes of the same old rank whose rank half a
prefix further is smaller. Each refinement is a count by (rank, second rank),
combined before the shuffle, and two running sums: over buckets of second ranks
and within a bucket, so a line that makes up a third of the corpus is spread over
many tasks. Rounds go on until every suffix has a rank of its own or shares it
with suffixes that are equal up to their documents' ends; documents without open
suffixes leave.

Suffixes of equal rank at a depth are an interval of the suffix array whose
common prefixes reach that depth. Each member but the first in corpus order is a
later copy of that many lines. A repeated run of any length is the union of the
members' prefixes at their greatest depths, so these, merged, are the maximal
runs, and they are deleted. Which lines go is settled at the first depth; the
greater ones tell how long a copy is and where it stands first. DataFrame
functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Store, hot_join

#: Most documents with deletions whose runs are broadcast to the texts; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
BEFORE = (Window.unboundedPreceding, -1)


KEY = ["doc_id", "k1"]


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with k1, which tells rows apart that repeat a doc_id with another text; and whether any doc_id repeats."""
    repeats = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    return docs.withColumn("k1", F.xxhash64(F.col("text").cast("string")) if repeats else F.lit(0).cast("long")), repeats


def lines_of(docs: DataFrame, long_words: int) -> DataFrame:
    """(doc_id, k1, i, s1, s2, long, blank): every line with two hashes of its content."""
    out = docs.where("doc_id is not null and text is not null").select(*KEY, F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("i", "line"))
    n_words = F.when(F.length("line") >= 2 * long_words - 1, F.regexp_count("line", F.lit(WORD))).otherwise(0)
    return out.select(
        *KEY, "i", F.xxhash64("line").alias("s1"), F.xxhash64(F.lit("second"), F.reverse("line")).alias("s2"),
        (n_words >= long_words).alias("long"), (~F.rlike("line", F.lit(WORD))).alias("blank"),
    )


def _refine(store: Store, df: DataFrame, bucket: Column, n: int, name: str) -> DataFrame:
    """Orders df's suffixes by (rank, s1, s2): the new rank, the size c of its class, the first of it in corpus order if c > 1, and whether the suffix is later than that.

    bucket must grow with s1 and split a rank into many parts; n bounds df's rows.
    """
    keys = ["rank", "s1", "s2"]
    counts = df.groupBy("rank", bucket.alias("bucket"), "s1", "s2").agg(F.count("*").alias("c"), F.min(F.struct(*KEY, "i")).alias("first"))
    sums = counts.groupBy("rank", "bucket").agg(F.sum("c").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(*BEFORE)), F.lit(0))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy("rank", "bucket").orderBy("s1", "s2").rowsBetween(*BEFORE)), F.lit(0))
    told = counts.withColumn("inner", inner).join(sums.select("rank", "bucket", offset.alias("offset")), ["rank", "bucket"])
    told = store.put(told.select(*keys, "c", F.when(F.col("c") > 1, F.col("first")).alias("first"), (F.col("rank") + F.col("offset") + F.col("inner")).alias("next")), f"{name}_classes")
    later = F.coalesce(F.struct(*KEY, "i") > F.col("first"), F.lit(False)).alias("later")
    out = hot_join(df, told, keys, "c", n, "inner").select(*[x for x in df.columns if x not in keys], F.col("next").alias("rank"), "c", "first", later)
    out = store.put(out, name)
    store.drop(told)
    return out


def intervals(lines: DataFrame, depth: int, store: Store):
    """Yields (d, members): the suffixes (doc_id, k1, i, rank, c, first, later) that agree in their first d lines with another.

    c is the size of the interval of the suffix array, rank the place of its first
    suffix, first the member that is first in corpus order, and later false for it. d is 1, then `depth`
    and its doublings. From `depth` on, suffixes whose first `depth` lines are
    blank or fewer are left out, and runs end before them. A table is gone when
    the next is asked for.
    """
    n = max(1, lines.count())
    one = _refine(store, lines.withColumn("rank", F.lit(0).cast("long")), F.shiftright("s1", 52), n, "rank_1")
    yield 1, one
    hollow = one.where("blank").select(*KEY, F.explode(F.sequence(F.col("i") - depth + 1, "i")).alias("i")).groupBy(*KEY, "i").agg(F.count("*").alias("m"))
    hollow = store.put(hollow.where(F.col("m") == depth).drop("m"), "hollow")
    have, now, kept = 1, (one if depth > 1 else one.where("not blank")).select(*KEY, "i", "rank", "c"), [one]
    bucket = F.floor(F.col("s1") * 4096 / n)
    while True:
        step = min(have, depth - have) if have < depth else have
        follow = now.select(*KEY, (F.col("i") - step).alias("i"), F.col("rank").alias("s1"))
        still = now.where("c > 1").select(*KEY, "i", "rank").join(follow, [*KEY, "i"]).withColumn("s2", F.lit(0).cast("long"))
        still = store.put(still, "open")
        told = _refine(store, still, bucket, n, f"rank_{have + step}")
        store.drop(still)
        have += step
        shared = told.where("c > 1")
        if have == depth:
            shared = store.put(shared.join(hollow, [*KEY, "i"], "left_anti"), "shared")
            kept += [shared, hollow]
        if have >= depth:
            if not shared.limit(1).count():
                store.drop(told, *kept)
                return
            yield have, shared
        # A suffix whose rank is its own at a depth stays alone at every greater one.
        # Of documents with open suffixes all ranks are needed, as what follows them.
        ranks = shared.drop("first", "later").unionByName(told.where("c = 1").drop("first", "later")).unionByName(now.where("c = 1"))
        following = store.put(ranks.join(shared.select(*KEY).distinct(), KEY, "left_semi"), "ranks")
        store.drop(told, *kept)
        now, kept = following, [following]


def repeated_runs(docs: DataFrame, min_lines: int = 2, long_words: int = 50) -> DataFrame:
    """(doc_id, k1, runs, copy): the maximal runs of lines to delete, array<struct<a,b>>, ordered, and the longest copy among them.

    copy is struct<lines, at, first_doc_id, first_line>: of the places that agree
    with an earlier one at the greatest depth (min_lines and its doublings; 1 for a
    long line alone) the first, and the first place in the corpus that it agrees with.

    docs: doc_id, k1, text. A line is deleted if it lies in a run of min_lines lines
    that also starts earlier (smaller doc_id, or the same document and an earlier
    line), or if it has long_words words and occurs earlier. Lines are compared
    whole and unchanged, runs of blank lines alone are left, and matches never
    cross documents. Null texts and rows without doc_id have no lines.
    """
    store = Store(docs.sparkSession)
    lines = store.put(lines_of(docs, long_words), "lines")
    spans = []
    for depth, members in intervals(lines, min_lines, store):
        if depth == 1:
            store.drop(lines)
            members = members.where("long") if min_lines > 1 else members.where("long or not blank")
        copy = F.struct(F.lit(depth).alias("lines"), (-F.col("i")).alias("back"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.i").alias("first_line"))
        found = members.where("later").select(*KEY, F.col("i").alias("a"), (F.col("i") + depth - 1).alias("b"), copy.alias("copy"))
        spans.append(store.put(found, f"later_{depth}"))
    spans = reduce(DataFrame.unionByName, spans)
    # Spans of a document that overlap or touch are one run.
    by = Window.partitionBy(*KEY).orderBy("a", "b")
    reach = F.max("b").over(by.rowsBetween(*BEFORE))
    spans = spans.withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = spans.groupBy(*KEY, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("copy").alias("copy"))
    runs = runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"), F.max("copy").alias("copy"))
    return runs.withColumn("copy", F.struct("copy.lines", (-F.col("copy.back")).alias("at"), "copy.first_doc_id", "copy.first_line"))


def dedup(docs: DataFrame, min_lines: int = 2, long_words: int = 50) -> DataFrame:
    """docs with text without later copies, and n_lines, n_deleted, n_runs, copy in place of columns so named.

    copy is that of repeated_runs(), null where nothing goes.

    A null text has 0 lines and stays null; an empty one has one empty line.
    Rows without doc_id stay as they are. Rows that repeat a doc_id with another
    text are documents of their own, in the order of their texts' hashes; rows
    equal in both are one document, and each keeps what it keeps.
    """
    docs = docs.drop("n_lines", "n_deleted", "n_runs", "copy", "_runs", "_k1", "_copy")
    store = Store(docs.sparkSession)
    rows, repeats = _keyed(docs.select("doc_id", "text"))
    runs = repeated_runs(rows.dropDuplicates(KEY) if repeats else rows, min_lines, long_words)
    runs = store.put(runs.select("doc_id", F.col("k1").alias("_k1"), F.col("runs").alias("_runs"), F.col("copy").alias("_copy")), "runs")
    few = runs.count() <= BROADCAST_ROWS and (runs.agg(F.sum(F.size("_runs"))).first()[0] or 0) <= 4 * BROADCAST_ROWS
    lines = F.split(F.col("text").cast("string"), "\n")
    gone = lambda x, i: F.exists("_runs", lambda r: (r["a"] <= i) & (i <= r["b"]))
    keyed = docs.withColumn("_k1", F.xxhash64(F.col("text").cast("string")) if repeats else F.lit(0).cast("long"))
    out = keyed.join(F.broadcast(runs) if few else runs, ["doc_id", "_k1"], "left")
    kept = F.array_join(F.filter(lines, lambda x, i: ~gone(x, i)), "\n")
    n_deleted = F.aggregate("_runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1)
    return out.select(
        *[F.when(F.col("_runs").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(n_deleted, F.lit(0)).cast("long").alias("n_deleted"), F.when(F.col("_runs").isNull(), 0).otherwise(F.size("_runs")).cast("long").alias("n_runs"),
        F.col("_copy").alias("copy"),
    )
