"""A Merkle manifest of a dataset: every row a leaf, a tree a group, a tree over the groups.

Each parent is kept with its preimage, its children's digests as text one after
another. A leaf's path is the preimages of its ancestors with its own slot in
each; the siblings are what is left when the 64 characters of the slot are cut
out, and folding puts another digest into the slot and hashes. Paths are joined
from the top down, and leaves meet them once, with at most `fan` leaves a key,
so no group, however large, is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, parallelism

FAN, DIGEST = 16, 64


def framed(c: Column) -> Column:
    """A value's text in a leaf: '-' for null, else its length in UTF-8 bytes, ':' and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def _numbered(rows: DataFrame, order: list, store: Store) -> DataFrame:
    """rows, written, with pos and n: each row's number, from 0, in its group g under an order, and the group's size.

    Rows are range-sorted over all groups; a range's counts of groups give the
    offsets, so a group of all rows is many tasks.
    """
    parts = parallelism(rows.sparkSession)
    ranged = rows.repartitionByRange(parts, "g", *order).withColumn("part", F.spark_partition_id())
    ranged = store.put(ranged, "ranged")
    sizes = store.put(ranged.groupBy("g", "part").agg(F.count("*").alias("here")), "sizes")
    of = Window.partitionBy("g")  # at most a row a range
    before = F.coalesce(F.sum("here").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    at = sizes.select("g", "part", before.alias("before"), F.sum("here").over(of).alias("n"))
    own = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order)) - 1
    out = store.put(ranged.withColumn("own", own).join(at, ["g", "part"]).withColumn("pos", F.col("before") + F.col("own")).drop("part", "own", "before"), "numbered")
    store.drop(ranged, sizes)
    return out


def _levels(nodes: DataFrame, fan: int, store: Store) -> list:
    """Written levels (g, pos, n, pre, digest) over nodes (g, pos, n, digest), until every group has one node; n counts the group's nodes of the level."""
    out, top = [], nodes.agg(F.max("n")).first()[0] or 0
    while top > 1:
        runs = nodes.where("n > 1").groupBy("g", F.floor(F.col("pos") / fan).alias("pos"), F.ceil(F.col("n") / fan).alias("n")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("run"))
        pre = F.array_join(F.transform("run", lambda x: x["digest"]), "")
        nodes = store.put(runs.select("g", "pos", "n", pre.alias("pre")).withColumn("digest", F.sha2("pre", 256)), "level")
        out.append(nodes)
        top = -(-top // fan)
    return out


def _paths(leaves: DataFrame, levels: list, tops: DataFrame, fan: int, keep: list) -> DataFrame:
    """leaves with path and the columns of tops (g, path, ...): from the root of each group down, joined by parent."""
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = None
    for nodes, names in [(x, ["pre"]) for x in reversed(levels)] + [(leaves, keep)]:
        down = nodes.where("n = 1").select("g", "pos", *names).join(tops, "g")
        if above is not None:
            a = above.select("g", F.col("pos").alias("_up"), "pre", F.col("path").alias("_path"), *more)
            b = nodes.where("n > 1").select("g", "pos", *[F.col(c).alias(f"_own_{c}") for c in names], F.floor(F.col("pos") / fan).alias("_up"))
            step = F.array(F.struct(F.col("pre").alias("pre"), F.pmod(F.col("pos"), F.lit(fan)).cast("int").alias("slot")))
            b = b.join(a, ["g", "_up"]).select("g", "pos", *[F.col(f"_own_{c}").alias(c) for c in names], F.concat(step, "_path").alias("path"), *more)
            down = down.select(*b.columns).unionByName(b)
        above = down
    return above


_PATH = "array<struct<pre:string,slot:int>>"


def manifest(docs: DataFrame, fields: tuple = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", fan: int = FAN, also: dict | None = None) -> DataFrame:
    """(order, leaf, subroot, root, path, also...): every row as a leaf under its group's subroot and the root.

    A null group is a group, before all others; groups ascend bytewise. In a group
    leaves ascend by `order`, nulls first, ties by digest, so that rows that repeat
    in all fields are leaves of their own with equal proofs. Null, empty and long
    values are framed by their length; other columns aren't read, but for `also`,
    further columns by name. An empty table has no leaves and no root. path has a
    struct<pre, slot> for each ancestor, from the parent to the root; a lone leaf,
    or a lone subroot, is its own parent and adds none.
    """
    store, also = Store(docs.sparkSession), also or {}
    # Of rows equal in all that is ordered the number decides; it is written, so it stays what it is.
    rows = docs.select(
        F.concat(F.lit("s"), F.col(group)).alias("g"), F.col(order).alias("o"), leaf_of(*[F.col(c) for c in fields]).alias("digest"), *[c.alias(f"_also_{name}") for name, c in also.items()]
    )
    rows = rows.withColumn("g", F.coalesce("g", F.lit(""))).withColumn("row", F.monotonically_increasing_id())
    rows = store.put(rows, "rows")
    leaves = _numbered(rows, ["o", "digest", "row"], store)
    store.drop(rows)
    levels = _levels(leaves, fan, store)
    roots = leaves.where("n = 1").select("g", "digest")
    for x in levels:
        roots = roots.unionByName(x.where("n = 1").select("g", "digest"))
    groups = _numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), ["of"], store)
    upper = _levels(groups, fan, store)
    top = (upper[-1] if upper else groups).select("g", F.lit(None).cast(_PATH).alias("path"), F.col("digest").alias("root"))
    top = F.broadcast(top.withColumn("path", F.coalesce("path", F.array().cast(_PATH))))  # one row
    tops = _paths(groups, upper, top, fan, ["of", "digest"]).select(F.col("of").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    if upper:
        tops = store.put(tops, "subroots")
    out = _paths(leaves, levels, tops, fan, ["o", "digest", *[f"_also_{name}" for name in also]])
    return out.select(F.col("o").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", *[F.col(f"_also_{name}").alias(name) for name in also])


def siblings(path: Column) -> Column:
    """The digests beside a leaf's way to the root, as one text: each preimage without the leaf's own slot."""
    cut = lambda x: F.concat(F.substr(x["pre"], F.lit(1), x["slot"] * DIGEST), F.substr(x["pre"], x["slot"] * DIGEST + DIGEST + 1))
    return F.array_join(F.transform(path, cut), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to, with its path's siblings."""
    put = lambda h, x: F.sha2(F.concat(F.substr(x["pre"], F.lit(1), x["slot"] * DIGEST), h, F.substr(x["pre"], x["slot"] * DIGEST + DIGEST + 1)), 256)
    return F.aggregate(path, leaf, put)
