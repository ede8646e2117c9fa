"""Null models by hash-ordered resampling.

Randomness is md5(seed:replicate:unit): the same on any engine and partitioning,
without a generator's state. Units are shrunk before they are multiplied by
replicates, and all statistics of a family read the same permuted world.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import hashes


def hashed(*parts) -> Column:
    """md5 of parts joined by colons, as hexadecimal text."""
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def uniform(*parts) -> Column:
    """A number in [0, 1) from the first 12 hex digits of the hash."""
    return F.conv(F.substring(hashed(*parts), 1, 12), 16, 10).cast("double") / float(16**12)


def replicates(spark: SparkSession, r: int) -> DataFrame:
    return spark.range(1, r + 1).select(F.col("id").alias("rep"))


def repeated(units: DataFrame, r: int) -> DataFrame:
    """Every unit once a replicate: an explode, so no join is needed."""
    return units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(r)).cast("array<bigint>")))


def ranked(df: DataFrame, group: list, bucket: Column, order: list, name: str = "_k") -> DataFrame:
    """Adds each row's number, from 1, in its group under an order.

    bucket must grow with the order. Rows are numbered within buckets, and the
    buckets' counts give the offsets, so a group of all rows is many tasks.
    """
    out = df.withColumn("_b", bucket)
    sizes = out.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    out = out.join(sizes.select(*group, "_b", offset), [*group, "_b"])
    return out.withColumn(name, F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order))).drop("_b", "_before")


def bucket_of(df: DataFrame, unit: Column) -> Column:
    """A number or prefix that grows with unit: 4096 equal ranges of numbers, three letters of text."""
    kind = df.select(unit.alias("u")).schema["u"].dataType
    if not isinstance(kind, NumericType):
        return F.left(unit.cast("string"), F.lit(3))
    low, high = df.agg(F.min(unit), F.max(unit)).first()
    return F.floor((unit - F.lit(low or 0)) * 4096 / F.lit(float((high or 0) - (low or 0)) + 1))


#: Most units of a run on average, and of a chunk of the units that a run is dealt to.
RUN, CHUNK = 32_768, 4096


def shuffled(units: DataFrame, r: int, seed: int, value: str, unit: Column, strata: tuple = (), n: int | None = None) -> DataFrame:
    """(rep, strata, _at, _vs): the values in the order of their units' hashes, a row a run of a replicate's stratum.

    A run is an array, and _at counts what comes before it, so that ranks need a
    row a run. The units times replicates are shuffled once: hash and value are
    one column, which lets the runs and their sizes read the same shuffle.
    """
    n = units.count() if n is None else n
    digits = 0
    while n > RUN * 16**digits:
        digits += 1
    keys = ["rep", *strata, "_b"]
    base = repeated(units.select(*strata, unit.alias("_u"), F.col(value).alias("_v")), r).withColumn("_h", hashed(seed, F.col("rep"), F.col("_u")))
    rows = base.select("rep", *strata, F.substring("_h", 1, digits).alias("_b"), F.struct(F.unhex("_h").alias("h"), F.col("_v").alias("v")).alias("_x")).repartition(*keys)
    sizes = rows.groupBy(*keys).agg(F.sum(F.size(F.array("_x"))).alias("_n"))  # a count that reads the whole column
    before = Window.partitionBy("rep", *strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    bare = F.transform(F.sort_array("_xs"), lambda x: x["v"])
    return rows.groupBy(*keys).agg(F.collect_list("_x").alias("_xs")).select(*keys, bare.alias("_vs")).join(sizes, keys).drop("_b")


def permute(units: DataFrame, r: int, seed: int, value: str, unit: Column, strata: tuple = ()) -> DataFrame:
    """Units times replicates, `value` permuted among the units of a stratum in each replicate.

    A unit's number by id is found once and serves all replicates. Units lie in
    chunks of such numbers, which meet the runs of shuffled values as arrays:
    only the values are sent once a replicate, not the units.
    """
    n = units.count()
    size = min(CHUNK, max(64, n // 64))
    keep = [c for c in units.columns if c != value and c not in strata]
    a = ranked(units, list(strata), bucket_of(units, unit), [unit]).withColumn("_j", F.floor((F.col("_k") - 1) / size))
    chunks = a.groupBy(*strata, "_j").agg(F.sort_array(F.collect_list(F.struct("_k", *keep))).alias("_us"))
    end = F.col("_at") + F.size("_vs")
    runs = shuffled(units, r, seed, value, unit, strata, n).withColumn("_j", F.explode(F.sequence(F.floor(F.col("_at") / size), F.floor((end - 1) / size))))
    start = F.greatest("_at", F.col("_j") * size)
    runs = runs.select("rep", *strata, "_j", start.alias("_at"), F.slice("_vs", (start - F.col("_at") + 1).cast("int"), (F.least(end, (F.col("_j") + 1) * size) - start).cast("int")).alias("_vs"))
    met = F.slice("_us", (F.col("_at") - F.col("_j") * size + 1).cast("int"), F.size("_vs"))
    # The runs hold all replicates' values: arrays that look small in the plan must not be broadcast.
    out = runs.join(chunks.hint("merge"), [*strata, "_j"]).select("rep", *strata, F.explode(F.arrays_zip(met.alias("u"), F.col("_vs").alias("v"))).alias("_z"))
    return out.select("rep", *[F.col(c) if c in strata else F.col("_z.v").alias(c) if c == value else F.col(f"_z.u.{c}").alias(c) for c in units.columns])


#: Units that are hashed at once, units of a run on average, and those of a chunk, as dealt() has them.
LANES, LONG_RUN, SLOTS = 1 << 14, 1 << 18, 1 << 16


def coded(values: DataFrame, value: str) -> tuple[DataFrame, int]:
    """(value, _c): numbers from 1 for the distinct values that aren't null, in their order; how many there are."""
    names = values.select(value).where(F.col(value).isNotNull()).distinct()
    return ranked(names, [], bucket_of(names, F.col(value)), [value], "_c"), names.count()


def dealt(units: DataFrame, r: int, seed: int, code: str, most: int, unit: str, f: Callable, schema: str, cut: Callable, whole: str | None = None) -> DataFrame:
    """What f(slots, worlds) makes of each chunk of units, in the order of `unit`; `code`, of 0 to `most`, is permuted as by permute().

    slots is the chunk's rows of units as an Arrow table, worlds an array with a
    row of codes for the observed world and each replicate. A unit and replicate
    are 64 bits of the hash behind those of its run and a code, packed in binaries,
    and later a code alone. A chunk has all units of a value of `whole`; the driver
    holds a number a run and a chunk. Units are not null.
    """
    import numpy as np
    import pyarrow as pa

    kind = ">u1" if most < 1 << 8 else ">u2" if most < 1 << 16 else ">u4"
    width, chunk = np.dtype(kind).itemsize, max(256, min(SLOTS, (1 << 22) // (most + 1)))
    units = cut(units)
    n = units.count()
    bits = max(0, (max(n, 1) - 1) // LONG_RUN).bit_length()
    prefixes = [(k, f"{seed}:{k}:".encode()) for k in range(1, r + 1)]

    def some(texts, codes):
        made = {}
        parts = [texts[i:i + LANES] for i in range(0, len(texts), LANES)]
        for k, prefix in prefixes:
            if len(prefix) not in made:
                made[len(prefix)] = [hashes.blocks(x, len(prefix)) for x in parts]
            both = [hashes.md5_one_by_one(x, prefix) if m is None else hashes.md5(m, prefix) for x, m in zip(parts, made[len(prefix)])]
            key, low = (np.concatenate(x) for x in zip(*both))
            run = np.zeros(len(key), np.uint16)
            if bits:
                run = (key >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
                key = key << np.uint64(bits) | low >> np.uint64(64 - bits)
            order = np.argsort(run, kind="stable")
            ends = np.searchsorted(run[order], np.arange((1 << bits) + 1))
            there = np.flatnonzero(np.diff(ends))
            cell = lambda x, size: pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer((np.r_[ends[there], len(run)] * size).astype(np.int32)), pa.py_buffer(x[order].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), k, np.int32)), pa.array(there.astype(np.int32)), cell(key, 8), cell(codes.astype(kind), width)], names=["rep", "b", "k", "c"])

    def packed(batches):
        kept, size = [], 0
        for batch in batches:
            kept.append((np.array([x.encode() for x in batch.column(0).to_pylist()]), batch.column(1).to_numpy(zero_copy_only=False).astype(kind)))
            size += batch.num_rows
            if size >= 8 * LANES:
                yield from some(*(np.concatenate(x) for x in zip(*kept)))
                kept, size = [], 0
        if size:
            yield from some(*(np.concatenate(x) for x in zip(*kept)))

    def joined(column, of):
        return np.frombuffer(b"".join(column.to_pylist()), of)

    def ordered(t):
        return pa.table({"rep": t["rep"][:1], "b": t["b"][:1], "c": pa.array([joined(t["c"], kind)[np.argsort(joined(t["k"], np.uint64), kind="stable")].tobytes()])})

    spread = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * r * (8 + width) >> 26)
    rows = units.select(F.col(unit).cast("string"), code).mapInArrow(packed, "rep int, b int, k binary, c binary").repartition(spread, "rep", "b")
    runs = cut(rows.groupBy("rep", "b").applyInArrow(ordered, "rep int, b int, c binary"))
    at = np.zeros((r + 1, (1 << bits) + 1), np.int64)
    for rep, b, size in runs.select("rep", "b", (F.octet_length("c") / width).cast("long")).toLocalIterator():
        at[rep, b + 1] = size
    at = at.cumsum(axis=1)

    numbered = ranked(units, [], bucket_of(units, F.col(unit)), [unit]).withColumn("_k", F.col("_k") - 1)
    first = F.col("_k") if whole is None else F.when(F.col(whole).isNull(), F.col("_k")).otherwise(F.min("_k").over(Window.partitionBy(whole)))
    slots = cut(numbered.withColumn("_j", F.floor(first / chunk)))
    begun = slots.groupBy("_j").agg(F.min("_k").alias("k")).orderBy("_j").collect()
    names, starts = np.array([x["_j"] for x in begun], np.int64), np.array([x["k"] for x in begun], np.int64)

    def sliced(batches):
        for batch in batches:
            for rep, b, c in zip(*(x.to_pylist() for x in batch.columns)):
                low, high = int(at[rep, b]), int(at[rep, b + 1])
                js = np.arange(np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, high, "left"))
                from_ = np.maximum(starts[js], low)
                to = np.minimum(np.r_[starts, n][js + 1], high)
                cells = [c[(x - low) * width:(y - low) * width] for x, y in zip(from_.tolist(), to.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names[js]), pa.array(np.full(len(js), rep, np.int32)), pa.array(from_), pa.array(cells, pa.binary())], names=["_j", "rep", "at", "c"])

    def made(slots, pieces):
        slots = slots.sort_by("_k")
        worlds = np.zeros((r + 1, slots.num_rows), kind)
        worlds[0] = slots[code].to_numpy()
        low = slots["_k"][0].as_py()
        for rep, x, c in zip(*(pieces[k].to_pylist() for k in ("rep", "at", "c"))):
            worlds[rep, x - low:x - low + len(c) // width] = np.frombuffer(c, kind)
        return f(slots, worlds)

    pieces = runs.mapInArrow(sliced, "_j long, rep int, at long, c binary")
    return slots.groupBy("_j").cogroup(pieces.groupBy("_j")).applyInArrow(made, schema)


def vectors(units: DataFrame, r: int, seed: int, value: str, unit: Column, cut: Callable = lambda df: df) -> DataFrame:
    """(unit, vec): each unit's values as observed and in all replicates of permute(), as one binary of equally wide numbers; 0 stands for null. Units are distinct."""
    codes, most = coded(units, value)
    own = units.select(unit.alias("unit"), value).join(codes, value, "left").select("unit", F.coalesce("_c", F.lit(0)).cast("long").alias("_c"))

    def turned(slots, worlds):
        import numpy as np
        import pyarrow as pa

        each = np.ascontiguousarray(worlds.T)
        size = each.itemsize * each.shape[1]
        vec = pa.Array.from_buffers(pa.binary(), len(each), [None, pa.py_buffer(np.arange(len(each) + 1, dtype=np.int32) * size), pa.py_buffer(each.tobytes())])
        return pa.table({"unit": slots["unit"], "vec": vec})

    return dealt(own, r, seed, "_c", most, "unit", turned, f"unit {own.schema['unit'].dataType.simpleString()}, vec binary", cut)


def permute_within(toks: DataFrame, r: int, seed: int, record: str, place: str) -> DataFrame:
    """Tokens times replicates with a new place in their record, one shared permutation a record and replicate."""
    base = repeated(toks, r)
    order = Window.partitionBy("rep", record).orderBy(hashed(seed, F.col("rep"), F.col(record), F.col(place)), place)
    return base.withColumn("new_place", F.row_number().over(order) - 1)


def openings(rows: DataFrame, r: int, seed: int, group: str, unit: str, value: str) -> DataFrame:
    """(rep, value, stat): how many groups a row of each value opens when their rows are put in the order of md5(seed:rep:group:unit).

    A task reads its groups once, in batches, and hashes a batch's texts for all
    replicates; it sends on counts. Of a group that goes on in the next batch
    only the rows that lead in some replicate are kept, so none is held whole.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col(unit).cast("string"))
    side = rows.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), F.substr(text, F.lit(len(str(seed)) + 2)).alias("s"), F.coalesce(F.concat(F.lit("="), F.col(value).cast("string")), F.lit("")).alias("v"))
    reps = [(k, f"{seed}:{k}:".encode()) for k in range(1, r + 1)]

    def leaders(g, s, v):
        """Starts of the groups, names of values and, by replicate, the row that leads each group."""
        import numpy as np

        n, starts = len(g), np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        names, code = np.unique(v, return_inverse=True)
        sizes = np.diff(np.r_[starts, n])
        most, place = np.uint64(2**64 - 1), code.astype(np.int64) * n + np.arange(n)
        made, out = {}, []
        for _, prefix in reps:
            if len(prefix) not in made:
                made[len(prefix)] = hashes.blocks(s, len(prefix))
            words = made[len(prefix)]
            high, low = hashes.md5_one_by_one(s, prefix) if words is None else hashes.md5(words, prefix)
            hit = high == np.repeat(np.minimum.reduceat(high, starts), sizes)
            if np.count_nonzero(hit) > len(starts):
                low = np.where(hit, low, most)
                hit &= low == np.repeat(np.minimum.reduceat(low, starts), sizes)
            out.append(np.minimum.reduceat(np.where(hit, place, len(names) * n), starts) % n)
        return starts, names, code, np.stack(out)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts, kept = {}, None

        def add(names, code, lead):
            for (k, _), row in zip(reps, lead):
                for c, m in zip(*np.unique(code[row], return_counts=True)):
                    counts[k, names[c]] = counts.get((k, names[c]), 0) + int(m)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.array([x.encode() for x in batch.column(i).to_pylist()]) for i in range(3)]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols)]
            starts, names, code, lead = leaders(*cols)
            add(names, code, lead[:, :-1])
            kept = [x[np.unique(lead[:, -1])] for x in cols]
        if kept is not None:
            add(*leaders(*kept)[1:])
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int64()), pa.array([x[1:].decode() if x else None for _, x in keys], pa.string()), pa.array([counts[x] for x in keys], pa.int64())], names=["rep", value, "stat"])

    part = side.repartition("g").sortWithinPartitions("g").mapInArrow(run, f"rep long, {value} string, stat long")
    return part.groupBy("rep", value).agg(F.sum("stat").alias("stat"))


def add_one(observed: DataFrame, simulated: DataFrame, keys: list, stat: str = "stat", r: int | None = None, tolerance: float = 1e-12) -> DataFrame:
    """(keys, stat, p): (simulated >= observed, +1) / (R + 1); replicates that lack a key count as below."""
    joined = observed.join(simulated.select(*keys, "rep", F.col(stat).alias("_sim")), keys, "left")
    hits = F.sum(F.when(F.col("_sim") >= F.col(stat) - tolerance, 1).otherwise(0))
    return joined.groupBy(*keys, stat).agg(((hits + 1) / (r + 1)).alias("p"))


def min_p(observed: DataFrame, simulated: DataFrame, key: str, r: int) -> DataFrame:
    """(key, stat, p, p_adj): Westfall-Young adjustment over tests that share their replicates.

    simulated has a row for every test and replicate. A simulated value's own p
    is its rank from above among the test's replicates, ties included.
    """
    above = Window.partitionBy(key).orderBy(F.desc("stat")).rangeBetween(Window.unboundedPreceding, 0)
    own = simulated.withColumn("p", (F.count("*").over(above) + 1) / (r + 1))
    least = own.groupBy("rep").agg(F.min("p").alias("m"))
    raw = add_one(observed, simulated, [key], r=r)
    mins = least.groupBy().agg(F.sort_array(F.collect_list("m")).alias("ms"))  # one number a replicate
    hits = F.size(F.filter("ms", lambda m: m <= F.col("p") + 1e-12))
    return raw.crossJoin(F.broadcast(mins)).select(key, "stat", "p", ((hits + 1) / (r + 1)).alias("p_adj"))


def cyclic_shifts(rows: DataFrame, order: str, value: str, by: str) -> DataFrame:
    """(by, shift, order, value) for all shifts of a short vector, enumerated exactly."""
    v = rows.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("v"))
    v = v.withColumn("shift", F.explode(F.sequence(F.lit(0), F.size("v") - 1)))
    turned = F.concat(F.slice("v", F.size("v") - F.col("shift") + 1, F.col("shift")), F.slice("v", F.lit(1), F.size("v") - F.col("shift")))
    return v.select(by, "shift", F.posexplode(turned).alias(order, value))


def draws(pool: DataFrame, need: DataFrame, r: int, seed: int, item: str, cls: str) -> DataFrame:
    """(rep, item): in each replicate as many items of each class as need(cls, k) says, without replacement."""
    base = repeated(pool, r).withColumn("_h", hashed(seed, F.col("rep"), F.col(item)))
    base = ranked(base, ["rep", cls], F.substring("_h", 1, 3), ["_h", item])
    return base.join(F.broadcast(need), cls).where("_k <= k").select("rep", item)  # one row a class


def bootstrap(clusters: DataFrame, r: int, seed: int, cluster: str) -> DataFrame:
    """(rep, cluster, times): clusters drawn with replacement, as many as there are."""
    distinct = clusters.select(cluster).distinct()
    numbered = ranked(distinct, [], bucket_of(distinct, F.col(cluster)), [cluster]).withColumn("_k", (F.col("_k") - 1).cast("int"))
    n = numbered.count()
    slots = repeated(numbered.select(F.col("_k").alias("slot")), r)
    drawn = slots.withColumn("_k", F.floor(uniform(seed, F.col("rep"), F.col("slot")) * n).cast("int"))
    return drawn.groupBy("rep", "_k").agg(F.count("*").alias("times")).join(numbered, "_k").select("rep", cluster, "times")
