"""Near duplicates by a grouped prefix join on word-shingle sets.

Equal sets are one node. Shingles are ordered so that frequent ones come last,
and by hash otherwise; if two sets reach the similarity, their prefixes under
this order share a shingle. Nodes of equal size whose prefixes agree in all
shingles that any other node's prefix has form a group, and groups meet in the
lists of their prefix shingles. Only neighbours in a list or group are compared
at first. When the links found have been closed to components, lists that span
several are searched whole: pairs of groups are filtered by size and position,
then expanded to members, of which those that are still apart are filtered by a
parity bitmap and verified on whole sets. No filter loses a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, hot_join, parallelism, range_hash, sized, tidy, words_of
from .components import components
from .quality import _slices as slices

#: A shingle in more documents than this comes last in the order.
FREQUENT = 40
#: The most frequent shingles that are told to the executors (8 bytes each).
FREQUENT_MOST = 1 << 20
#: Shingle hashes under this share of their range are counted; those above come after them in the order.
COUNTED = 0.4
STAR = 256
#: Longer lists are compared in parts.
LIST = 20_000


def shingle_sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ordered by text and hash, and each text's first place."""
    n = len(texts)
    data, ws, we, first = words_of(texts, lower=True)
    h, words = range_hash(data, ws, we), np.diff(first)
    owner = np.repeat(np.arange(n), words)
    if len(h) >= k:
        at = np.flatnonzero(owner[: len(h) - k + 1] == owner[k - 1:])
        runs, own = range_hash(h, at, at + k), owner[at]
    else:
        runs, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((words > 0) & (words < k))
    runs = np.concatenate((runs, range_hash(h, first[short], first[short + 1]) if len(short) else runs[:0]))
    own = np.concatenate((own, short))
    order = np.lexsort((runs, own))
    runs, own = runs[order], own[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (own[1:] != own[:-1])
    runs, own = runs[new], own[new]
    return runs, np.searchsorted(own, np.arange(n + 1))


def _scan(docs: DataFrame, make, schema: str, *cols: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for part in slices(b.column("text")):
                yield from make(b.slice(*part))

    return docs.select(*cols, F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """The shingle hashes, of the counted range, that more than FREQUENT documents have; ascending."""
    limit = np.uint64(int(COUNTED * 2**64))

    def low(b):
        runs, _ = shingle_sets(b.column("text").to_pylist(), k)
        yield pa.RecordBatch.from_arrays([pa.array(runs[runs < limit].view(np.int64))], names=["t"])

    top = _scan(docs, low, "t long").groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") > FREQUENT)
    got = top.orderBy(F.desc("c"), "t").limit(FREQUENT_MOST).select("t").toPandas()["t"]
    return np.sort(got.to_numpy(np.int64).view(np.uint64))


def least_overlap(a, b, pct: int):
    """The fewest common shingles of sets of sizes a and b at the similarity pct / 100."""
    return -(-pct * (a + b) // (100 + pct))


def prefixes(docs: DataFrame, k: int, pct: int, often: np.ndarray) -> DataFrame:
    """(doc_id, n, d1, d2, prefix array<long>, bits binary) of each row: size, digests, ordered prefix, parity bitmap."""
    limit = np.uint64(int(COUNTED * 2**64))

    def make(b):
        runs, at = shingle_sets(b.column("text").to_pylist(), k)
        size = np.diff(at)
        own = np.repeat(np.arange(len(size)), size)
        kind = (runs >= limit).astype(np.int8)
        if len(often) and len(runs):
            where = np.minimum(np.searchsorted(often, runs), len(often) - 1)
            kind[often[where] == runs] = 2
        order = np.lexsort((runs, kind, own))
        place = np.arange(len(runs)) - at[own]
        # Sets x and y with y no smaller share at least ceil(pct/100 * |x|), so |x| - that + 1 of x hold a common one.
        length = np.where(size > 0, size - -(-pct * size // 100) + 1, 0)
        chosen = runs[order][place < length[own]]
        offsets = np.concatenate(([0], np.cumsum(length))).astype(np.int32)
        d1, d2 = range_hash(runs, at[:-1], at[1:], 11), range_hash(runs, at[:-1], at[1:], 12)
        bits = [bitmap(runs[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(chosen.view(np.int64))), pa.array(bits, pa.binary())],
            names=["doc_id", "n", "d1", "d2", "prefix", "bits"],
        )

    return _scan(docs, make, "doc_id long, n long, d1 long, d2 long, prefix array<long>, bits binary", "doc_id")


def bitmap(runs: np.ndarray) -> bytes:
    """For each of 2**b places the parity of the shingles that fall there; 2**b >= their number.

    Differing places are at most as many as shingles in one set alone.
    """
    size = max(64, 1 << int(max(1, len(runs)) - 1).bit_length())
    counts = np.bincount((runs >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _fold(a: np.ndarray, size: int) -> np.ndarray:
    while len(a) > size:
        a = a[: len(a) // 2] ^ a[len(a) // 2:]
    return a


def may_reach(a: bytes, b: bytes, na: int, nb: int, pct: int) -> bool:
    """False only if the bitmaps prove that the sets are less similar."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
    return apart <= na + nb - 2 * least_overlap(na, nb, pct)


def _neighbours(df: DataFrame, key: str, pct: int) -> DataFrame:
    """Pairs (x, y) of members of a list with the head of their block of the list, or with the member before."""
    by = Window.partitionBy(key).orderBy("n", "node")
    block = df.withColumn("rn", F.row_number().over(by) - 1).withColumn("pn", F.lag("n").over(by)).withColumn("pnode", F.lag("node").over(by))
    block = block.withColumn("block", (F.col("rn") / STAR).cast("long"))
    head = Window.partitionBy(key, "block").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    block = block.withColumn("hn", F.first("n").over(head)).withColumn("hnode", F.first("node").over(head))
    far = (F.col("hnode") == F.col("node")) | (F.col("hn") * 100 < F.col("n") * pct)
    block = block.withColumn("x", F.when(far, F.col("pnode")).otherwise(F.col("hnode"))).withColumn("xn", F.when(far, F.col("pn")).otherwise(F.col("hn")))
    block = block.where((F.col("x") != F.col("node")) & (F.col("xn") * 100 >= F.col("n") * pct))
    return block.select(F.least("x", "node").alias("x"), F.greatest("x", "node").alias("y")).distinct()


def _apart(lists: DataFrame, pct: int, nearest: bool) -> DataFrame:
    """(t, x, ys): for list members the members of other components that size, position and bitmaps allow.

    A list's members of equal size and shape are a group. Pairs of groups are
    filtered by size and position first, and only those left are expanded to
    members, whose components and bitmaps decide. With nearest, only each
    member's pair of least bitmap distance in a list. Pairs are tried within the
    task; a member leaves it with the array of those that pass all filters.
    """

    def pairs(t, part, node, n, i, comp, shape, minor, bits):
        order = np.lexsort((node, shape, n))
        node, n, i, comp, shape, minor, bits = (x[order] for x in (node, n, i, comp, shape, minor, bits))
        width = np.array([len(x) for x in bits])
        tables, row = {}, np.zeros(len(bits), np.int64)
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            row[own] = np.arange(len(own))
            tables[w] = np.frombuffer(b"".join(bits[own]), np.uint8).reshape(len(own), w)
        folded = {}
        head = np.flatnonzero(np.concatenate(([True], (n[1:] != n[:-1]) | (shape[1:] != shape[:-1]))))
        bound, size, first = np.append(head, len(n)), n[head], np.minimum.reduceat(i, head)
        end = np.searchsorted(size * pct, 100 * size, side="right")  # groups h >= g with pct * size[h] <= 100 * size[g]
        for g in range(len(head)):
            h = np.arange(g, end[g])
            h = h[1 + np.minimum(size[g] - first[g] - 1, size[h] - first[h] - 1) >= least_overlap(size[g], size[h], pct)]
            many = bound[h + 1] - bound[h]
            members = np.repeat(bound[h] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            for j in range(bound[g], bound[g + 1]):
                z = members[members > j]
                z = z[comp[z] != comp[j]]
                if part[0] and minor[j]:
                    z = z[~minor[z]]
                if not len(z):
                    continue
                need = least_overlap(n[j], n[z], pct)
                mine = tables[int(width[j])][row[j]]
                keep, far = [], []
                for w in np.unique(width[z]).tolist():
                    if (w, len(mine)) not in folded:
                        folded[w, len(mine)] = _fold(tables[w].T, len(mine)).T if w >= len(mine) else None
                    there = width[z] == w
                    table = folded[w, len(mine)]
                    if table is None:  # a larger set never has a smaller bitmap
                        keep.append(z[there])
                        far.append(np.zeros(len(keep[-1]), np.int64))
                        continue
                    apart = np.bitwise_count(table[row[z[there]]] ^ mine).sum(1)
                    near = apart <= n[j] + n[z[there]] - 2 * need[there]
                    keep.append(z[there][near])
                    far.append(apart[near])
                z = np.concatenate(keep)
                if nearest and len(z):
                    z = z[[np.concatenate(far).argmin()]]
                if len(z):
                    yield t[0], node[j], node[z]

    names = ("t", "part", "node", "n", "i", "comp", "shape", "minor", "bits")

    def run(batches):
        held: list = []

        def flush(final):
            nonlocal held
            if not held:
                return
            cols = [np.concatenate([h[c] for h in held]) for c in range(len(names))]
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            edges = np.concatenate(([0], cut, [len(cols[0])]))
            last = len(edges) - 1 if final else len(edges) - 2
            ts, xs, ys, many = [], [], [], 0
            for a, b in zip(edges[:last], edges[1:last + 1]):
                for t, x, y in pairs(*(c[a:b] for c in cols)):
                    ts.append(t), xs.append(x), ys.append(y)
                    many += len(y)
                    if many > 100_000:
                        yield batch_of(ts, xs, ys)
                        ts, xs, ys, many = [], [], [], 0
            held = [] if final else [[c[edges[last]:] for c in cols]]
            if xs:
                yield batch_of(ts, xs, ys)

        def batch_of(ts, xs, ys):
            offsets = np.concatenate(([0], np.cumsum([len(y) for y in ys]))).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(ts, pa.int64()), pa.array(xs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ys)))], names=["t", "x", "ys"])

        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in names])
            if sum(len(h[0]) for h in held) > 30_000:
                yield from flush(False)
        yield from flush(True)

    return lists.select(*names).mapInArrow(tidy(run), "t long, x long, ys array<long>")


def _split(marked: DataFrame, open_: DataFrame, store: Store) -> DataFrame:
    """The members of open lists, with the part of its list that each goes to, and whether it is in the minority.

    open_: (t, m), lists of m members in several components. Members of one
    component need no comparison, so in a list of more than LIST members those of
    its largest component are dealt out over parts, and the others, the
    minority, go to every part; pairs within the minority are left to part 0.
    """
    plain = marked.join(open_.where(F.col("m") <= LIST).select("t"), "t", "left_semi").withColumns({"part": F.lit(0), "minor": F.lit(False)})
    long = store.put(open_.where(F.col("m") > LIST), "long_lists")
    if not long.limit(1).count():
        return plain
    of = marked.join(long, "t").groupBy("t", "m", "comp").agg(F.count("*").alias("c")).groupBy("t", "m").agg(F.max(F.struct("c", "comp")).alias("top"))
    of = store.put(of.select("t", F.col("top.comp").alias("top"), F.ceil(F.col("top.c") / LIST).cast("int").alias("parts")), "long_lists")
    rows = marked.join(sized(of, of.count()), "t").withColumn("minor", F.col("comp") != F.col("top"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("minor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    return plain.unionByName(rows.select(*plain.columns))


def _pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs (x, y), x < y; a member's arrays are merged before pairs are rows."""
    merged = found.groupBy("x").agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"))
    pairs = merged.select("x", F.explode("ys").alias("y"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, pct: int, store: Store) -> DataFrame:
    """The pairs that reach the similarity: bitmaps first, then whole sets."""

    def with_both(df, side, cols):
        a = side.select(F.col("node").alias("x"), *[F.col(c).alias(f"{c}_x") for c in cols])
        b = side.select(F.col("node").alias("y"), *[F.col(c).alias(f"{c}_y") for c in cols])
        return df.join(a, "x").join(b, "y")

    def filtered(test, cols):
        def run(batches):
            for b in batches:
                keep = [test(*r) for r in zip(*(b.column(c).to_pylist() for c in cols))]
                yield b.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

        return run

    near = with_both(pairs, nodes, ["n", "bits"])
    near = near.mapInArrow(tidy(filtered(lambda a, b, na, nb: may_reach(a, b, na, nb, pct), ["bits_x", "bits_y", "n_x", "n_y"])), "x long, y long")
    near = store.put(near, "near")

    def reach(a, b):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
        return 100 * common >= pct * (len(x) + len(y) - common)

    links = with_both(near, sets(near), ["set"]).mapInArrow(tidy(filtered(reach, ["set_x", "set_y"])), "x long, y long")
    return store.put(links, "links")


def linked(docs: DataFrame, k: int = 4, pct: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    Two documents link when 100 * |common| >= pct * |union| of their distinct
    k-word shingles (A-Z lower-cased; with fewer words the whole sequence is one
    shingle). n_links counts links found on the way to the components, a
    spanning part of all. Documents without words link with nothing. Rows that
    repeat a doc_id are one document, which links where any of its sets does, and
    have a row for each different set; rows without doc_id have a null component.
    """
    spark = docs.sparkSession
    store = Store(spark)
    often = frequent(docs, k)
    rows = store.put(prefixes(docs, k, pct, often), "prefixes")
    alone = store.put(rows.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")), "without_id")
    version = store.put(rows.where("doc_id is not null").select("doc_id", "n", "d1", "d2").distinct(), "versions")
    several = version.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count() > 0
    repeats = several or version.count() < rows.where("doc_id is not null").count()
    same = version.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"))
    # A set's node is its smallest doc_id, or, where a doc_id may have several sets, a hash of the set.
    same = store.put(same.withColumn("node", F.col("d1") if several else F.col("low")), "nodes")
    twins = None
    if several:
        lead = version.where("n > 0").groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("m")).where("x < m").drop("m")
        twins = store.put(version.where("n > 0").select("doc_id", F.col("d1").alias("y")).join(lead, "doc_id").where("x < y").select("x", "y").distinct(), "twins")
    found = rows.join(same.select(F.col("low").alias("doc_id"), "d1", "d2", "node"), ["doc_id", "d1", "d2"])
    found = found.dropDuplicates(["node"]) if repeats else found
    nodes = store.put(found.select("node", "n", "prefix", "bits"), "prefix_nodes")
    store.drop(rows)
    # Lists of at least two nodes; a shingle of one prefix alone can link nothing.
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("i", "t"))
    entries = store.put(entries.withColumn("m", F.count("*").over(Window.partitionBy("t"))).where("m > 1").drop("m"), "entries")
    shape = entries.groupBy("node", "n").agg(F.xxhash64(F.sort_array(F.collect_list("t"))).alias("shape"))
    shape = store.put(shape, "shapes")
    group = shape.groupBy("n", "shape").agg(F.min("node").alias("group"), F.count("*").alias("members"))
    member = store.put(shape.join(group.where("members > 1"), ["n", "shape"]).select("node", "n", "group"), "members")
    heads = entries.join(member.where("node <> group").select("node"), "node", "left_anti")
    first = _neighbours(member.withColumnRenamed("group", "t"), "t", pct).unionByName(_neighbours(heads.select("t", "node", "n"), "t", pct)).distinct()
    first = store.put(first, "first_pairs")
    side = nodes.select("node", "n", "bits")

    def sets(pairs):
        wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
        wanted = store.put(wanted.join(same.select("node", "low", "d1"), "node"), "wanted")
        few = wanted.count() <= 200_000
        ids = F.broadcast(wanted) if few else wanted

        def make(b):
            runs, at = shingle_sets(b.column("text").to_pylist(), k)
            d1 = range_hash(runs, at[:-1], at[1:], 11).view(np.int64)
            keep = pa.array(d1 == b.column("d1").to_numpy(zero_copy_only=False))
            raw = pa.array([runs[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("node"), raw], names=["node", "set"]).filter(keep)

        text = docs.select(F.col("doc_id").alias("low"), "text").join(ids, "low")
        return store.put(_scan(text, make, "node long, set binary", "node", "d1").dropDuplicates(["node"]), "sets")

    links = _verified(first, side, sets, pct, store)
    close = lambda links: components(links if twins is None else links.unionByName(twins), store)
    tried, comp = first, close(links)
    # Lists whose members lie in several components: first the nearest pairs, which join
    # what is dense, then all that are still apart. A list without any pair that passes
    # the filters at first has none later, as components only grow.
    hopeful = None
    for nearest in (True, False):
        marked = entries.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_ = marked.groupBy("t").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m")).where("a <> b").select("t", "m")
        open_ = store.put(open_ if hopeful is None else open_.join(hopeful, "t", "left_semi"), "open_lists")
        lists = _split(marked, open_, store).join(nodes.select("node", "bits"), "node").join(shape.select("node", "shape"), "node")
        lists = lists.repartition(parallelism(spark), "t", "part").sortWithinPartitions("t", "part")
        found = store.put(_apart(lists, pct, nearest), "found")
        hopeful = found.select("t").distinct()
        rest = store.put(_pairs(found).join(tried, ["x", "y"], "left_anti"), "rest")
        links = store.put(links.unionByName(_verified(rest, side, sets, pct, store)), "all_links")
        tried = store.put(tried.unionByName(rest), "tried")
        comp = close(links)
    n_links = links.select(F.col("x").alias("node")).unionByName(links.select(F.col("y").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    of = same.join(comp, "node", "left").join(n_links, "node", "left").select("d1", "d2", "n", "copies", "low", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of = store.put(of, "set_components")
    if several:  # from hashes of sets to the smallest doc_id
        of = store.put(of.join(of.groupBy("comp").agg(F.min("low").alias("least")), "comp").drop("comp").withColumnRenamed("least", "comp"), "set_components")
    out = hot_join(version, of, ["d1", "d2", "n"], "copies", max(1, version.count()))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"), (F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"))
    return out.unionByName(alone.withColumn("n_links", F.lit(0).cast("long")))
