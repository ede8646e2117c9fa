"""Ordered sequences: sections, runs, fills, blocks, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sections(df: DataFrame, by: str, order: list, mark: Column) -> DataFrame:
    """Adds section: how many runs of marked rows have begun up to a row; a first row never begins one."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.lag(mark).over(w)
    out = df.withColumn("_start", (mark & ~F.coalesce(before, F.lit(True))).cast("int"))
    return out.withColumn("section", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def forward_fill(df: DataFrame, by: str, order: list, value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def interpolate(df: DataFrame, by: str, order: list, at: Column, value: Column, name: str) -> DataFrame:
    """Fills missing values on the line between the last and the next known one; at the ends the nearest."""
    w = Window.partitionBy(by).orderBy(*order)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known_at = F.when(value.isNotNull(), at)
    x0, y0 = F.last(known_at, ignorenulls=True).over(back), F.last(value, ignorenulls=True).over(back)
    x1, y1 = F.first(known_at, ignorenulls=True).over(on), F.first(value, ignorenulls=True).over(on)
    out = df.select("*", x0.alias("_x0"), y0.alias("_y0"), x1.alias("_x1"), y1.alias("_y1"))
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (at - F.col("_x0")) / F.nullif(F.col("_x1") - F.col("_x0"), F.lit(0))
    return out.withColumn(name, F.coalesce(line, F.col("_y0"), F.col("_y1"))).drop("_x0", "_y0", "_x1", "_y1")


def blocks(df: DataFrame, by: str, order: list, size: int = 5) -> DataFrame:
    """Adds block: the row's number within its group, in blocks of `size`."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w) - 1).withColumn("block", F.floor(F.col("place") / size).cast("long"))


def adjacent(df: DataFrame, by: str, order: list, value: str) -> DataFrame:
    """(by, a, b): values of neighbouring rows."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.select(by, F.col(value).alias("a"), F.lead(value).over(w).alias("b")).where("b is not null")


def window_cells(records: DataFrame, ws: str, reach: int = 2, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cells (a, b, c): how often a and b stand at different places at most `reach` apart, either way, if `least` times or more; and margins (w, r) of all cells.

    Pairs are zipped from slices of a record's array, without a sort of tokens, and
    counted once in one order; only cells that are kept are turned. A word's margin
    is the number of neighbours of its places, so it needs no pair.
    """
    w, n = F.col(ws), F.size(ws)
    near = [F.arrays_zip(F.slice(w, F.lit(1), F.greatest(n - k, F.lit(0))).alias("a"), F.slice(w, F.lit(k + 1), F.greatest(n - k, F.lit(0))).alias("b")) for k in range(1, reach + 1)]
    half = records.where(n > 1).select(F.explode(F.concat(*near)).alias("p")).groupBy(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).agg(F.count("*").alias("c"))
    half = half.withColumn("c", F.when(F.col("a") == F.col("b"), F.col("c") * 2).otherwise(F.col("c"))).where(F.col("c") >= least)
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    cells = half.select(F.explode(ways).alias("x"), "c").select("x.a", "x.b", "c")
    at = records.select(n.alias("n"), F.posexplode(w).alias("i", "w"))
    beside = F.least(F.col("i"), F.lit(reach)) + F.least(F.col("n") - 1 - F.col("i"), F.lit(reach))
    return cells, at.groupBy("w").agg(F.sum(beside).alias("r"))


def offsets(anchors: DataFrame, columns: DataFrame, book: str) -> DataFrame:
    """(book, col, offset, filled): of every column the median of pos - line over its anchors, rounded down.

    A column without anchors lies after the one before it, by that column's `lines`;
    or, if only the next one has anchors, before that by its own; else after the
    nearest column before it that has an offset by then. A book's columns are a
    window. columns: (book, col, lines); anchors: (book, col, line, pos).
    """
    known = anchors.groupBy(book, "col").agg(F.floor(F.median(F.col("pos") - F.col("line"))).alias("o"))
    by = Window.partitionBy(book).orderBy("col")
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), F.col("lines")
    t = columns.join(known, [book, "col"], "left").withColumn("m", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    near = F.coalesce("o", F.lag("o").over(by) + F.lag("lines").over(by), F.lead("o").over(by) - rest)
    t = t.withColumn("near", near)
    # A chain of columns adds up their lines, so the last offset less the lines before it is carried.
    chain = F.last(F.col("near") - F.col("m"), ignorenulls=True).over(before) + F.col("m")
    out = t.withColumn("offset", F.coalesce("near", chain)).where("offset is not null")
    return out.select(book, "col", F.col("offset").cast("long").alias("offset"), F.col("o").isNull().alias("filled"))


def promoted(anchors: DataFrame, rows: DataFrame, columns: DataFrame, book: str, cut) -> DataFrame:
    """(book, key, col, pos, filled, round): rows of a known column and line but only an interval of places, put where their column's offset says.

    rows: (book, key, col, line, a, b). A row is promoted if offset + line lies in
    a..b and no anchor or earlier promotion has that place; of rows for one place
    the least key is. Promoted rows are anchors of the next round, which estimates
    all offsets anew, until a round promotes none. Books are apart, and one without
    a promotion has none in later rounds either, so a round sees only the books of
    the last one's. cut() ends lineage.
    """
    have, left, columns, out, n = cut(anchors.select(book, "col", "line", "pos")), cut(rows), cut(columns), None, 0
    while True:
        n += 1
        told = left.join(offsets(have, columns, book), [book, "col"]).withColumn("pos", F.col("offset") + F.col("line")).where("pos between a and b")
        told = told.join(have.select(book, "pos"), [book, "pos"], "left_anti")
        one = told.groupBy(book, "pos").agg(F.min(F.struct("key", "col", "line", "filled")).alias("x"))
        new = cut(one.select(book, "x.key", "x.col", "x.line", "pos", "x.filled", F.lit(n).alias("round")))
        out = new if out is None else out.unionByName(new)
        if not new.limit(1).count():
            return out.select(book, "key", "col", "pos", "filled", "round")
        still = cut(new.select(book).distinct())
        have = cut(have.join(still, book, "left_semi").unionByName(new.select(book, "col", "line", "pos")))
        left = cut(left.join(still, book, "left_semi").join(new.select(book, "key"), [book, "key"], "left_anti"))
        columns = cut(columns.join(still, book, "left_semi"))
