"""Benchmark decontamination by size-partitioned MinHash containment search.

An item's sketch is its least shingle hashes under one MinHash permutation. How
many depends on the item's size class: if a document holds at least
ceil(t * q) of an item's q shingles, it misses at most q - ceil(t * q), so of the
item's s least hashes it must hold at least s - (q - ceil(t * q)). That count is
the class's least number of sketch hits; it never loses a pair. A document is
reduced to its shingles under the largest hash of the sketches of the classes it
is long enough for. Pairs with enough hits are verified by exact containment of
shingle texts. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, sized
from .shingles import hashes, texts, words

def contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment) of pairs with containment >= threshold.

    docs: doc_id, text; items: item_id, text. Containment is the share of the
    item's distinct k-word shingles that the document has; a text of fewer than
    k words is one shingle. Rows without id, and items without words, take no
    part. Rows that repeat an id count as one text with the shingles of all.
    """
    spark = docs.sparkSession
    store = Store(spark)
    pct = round(threshold * 100)
    it = (
        items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w"))
        .select("item_id", F.explode(F.arrays_zip(hashes(F.col("w"), k).alias("h"), texts(F.col("w"), k).alias("s"))).alias("x"))
        .select("item_id", F.col("x.h").alias("h"), F.col("x.s").alias("s")).distinct()
    )
    it = store.put(it, "items")
    sizes = it.groupBy("item_id").agg(F.count("*").alias("q"), F.sort_array(F.collect_set("h")).alias("hs"))
    missing = F.col("q") - F.ceil(F.col("q") * pct / 100)
    # The size class: items of (2**(c-1), 2**c] shingles share the sketch length of the largest of them.
    sizes = sizes.withColumn("class", F.ceil(F.log2("q")).cast("int")).withColumn("missing", missing.cast("int"))
    length = F.least(F.col("q").cast("int"), 2 * F.max("missing").over(Window.partitionBy("class")) + 1)
    sizes = sizes.withColumn("s", length).withColumn("sketch", F.slice("hs", 1, F.col("s"))).withColumn("need", F.col("s") - F.col("missing"))
    sketch = store.put(
        sizes.select("item_id", "q", "class", "need", F.explode("sketch").alias("h"))
        .withColumn("ceiling", F.max("h").over(Window.partitionBy("class"))), "sketches",
    )
    n_sketch = sketch.count()
    top = sketch.agg(F.max("ceiling").alias("c"), F.min("q").alias("q")).first()
    if top["c"] is None:
        return docs.select("doc_id").limit(0).select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("item_id", items.schema["item_id"].dataType), ("n_item", "long"), ("n_common", "long"), ("containment", "double"))])
    base = docs.where("doc_id is not null").select("doc_id", "text")
    low = base.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.explode(hashes(F.col("w"), k)).alias("h")).where(F.col("h") <= F.lit(top["c"]))
    hit = low.join(sized(sketch, n_sketch), "h").where((F.col("h") <= F.col("ceiling")) & (F.greatest(F.col("n"), F.lit(1)) * 100 >= F.col("q") * pct))
    pairs = hit.groupBy("doc_id", "item_id", "need").agg(F.count_distinct("h").alias("hits")).where("hits >= need").select("doc_id", "item_id")
    pairs = store.put(pairs, "candidates")
    n_pairs = pairs.count()
    wanted = pairs.select("doc_id").distinct()
    there = base.join(sized(wanted, n_pairs), "doc_id", "left_semi")
    there = there.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(texts(F.col("w"), k)).alias("s"))
    n_items = it.count()
    common = (
        there.join(sized(it.select("item_id", "s"), n_items), "s").groupBy("doc_id", "item_id").agg(F.count_distinct("s").alias("n_common"))
        .join(sized(pairs, n_pairs), ["doc_id", "item_id"], "left_semi")
    )
    n_item = it.groupBy("item_id").agg(F.count_distinct("s").alias("n_item"))
    out = common.join(sized(n_item, n_items), "item_id").where(F.col("n_common") * 100 >= F.col("n_item") * pct)
    return out.select("doc_id", "item_id", "n_item", "n_common", F.round(F.col("n_common") / F.col("n_item"), 6).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows whose document contains an item; a null doc_id is kept."""
    store = Store(docs.sparkSession)
    found = store.put(contained(docs.select("doc_id", "text"), items, k, threshold).select("doc_id").distinct(), "contaminated")
    return docs.join(sized(found, found.count()), "doc_id", "left_anti")
