"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Native DataFrame functions only. Words are runs of letters and digits of the lower-cased text; a shingle is five words,
and a text of one to four words has one shingle of all its words (so a tiny item matches only a text that equals it).

A plain MinHash signature of fixed length can't see a 40-word item inside a 20,000-word document (their Jaccard is below
0.01), so the sketches are of the kind whose length follows the set: the shingle hashes below a bound. Items are
partitioned by size, [2^p, 2^(p+1)) shingles, and each partition has its own bound: all hashes below 2 * SKETCH shingles,
a share SKETCH / 2^p beyond. A document is sketched once at the widest bound in use. One shared sketch hash makes a
candidate. An item of up to 31 shingles with a containment of at least 0.8 is never missed; one of 32 to 63 is missed with a
probability below 3e-8, one of 64 or more with one below 3e-6 (3.2e-7 at 64, 2.5e-6 at 1,024, e^-12.8 in the limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declq.llm.common import SIMILARITY, cut, plain, small_side

SKETCH = 16
#: Bits of a hash that are compared with a partition's bound.
BOUND_BITS = 20
#: Hashes of items that are broadcast at most (some 30 MB as a hash table); with more, both sides are shuffled by hash.
BROADCAST_HASHES = 500_000


def with_shingles(texts: DataFrame, text: str = "text") -> DataFrame:
    """`texts` with column `shingles`: array of 64-bit hashes, in the order of the text, repeats included; empty for no words.

    Explode it with explode_outer: explode would infer a size filter that Catalyst pushes to the scan, with all of the hashing.
    Hashes of two, four and five words are built from each other, so each word costs four hash calls however long the text.
    """
    part = lambda x, start, less: F.slice(x, start, F.greatest(F.col("_n") - less, F.lit(0)))
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    return (
        texts.withColumn("_words", F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), ""))
        .withColumn("_n", F.size("_words"))
        .withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_h2", pair(part("_h1", 1, 1), part("_h1", 2, 1)))
        .withColumn("_h4", pair(part("_h2", 1, 3), part("_h2", 3, 3)))
        .withColumn("_h5", pair(part("_h4", 1, 4), part("_h1", 5, 4)))
        .withColumn("shingles", F.when(F.col("_n") >= 5, F.col("_h5")).when(F.col("_n") > 0, F.array(F.xxhash64(F.concat_ws(" ", "_words"), "_n"))).otherwise(F.array().cast("array<bigint>")))
        .drop("_words", "_n", "_h1", "_h2", "_h4", "_h5")
    )


def _below(h: Column, bound: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BOUND_BITS) < bound


def item_sets(benchmark: DataFrame) -> DataFrame:
    """(item_id, h, n_item, bound): the distinct shingles of every item, its set size and the bound of its size partition."""
    each = with_shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null"))
    each = each.select("item_id", F.explode_outer("shingles").alias("h")).where("h is not null").distinct()
    sizes = each.groupBy(F.col("item_id").alias("id")).agg(F.count(F.lit(1)).alias("n_item"))
    low = F.pow(F.lit(2.0), F.floor(F.log2("n_item")))
    sizes = sizes.withColumn("bound", F.least(F.lit(1 << BOUND_BITS), F.ceil(F.lit(SKETCH << BOUND_BITS) / low)).cast("long"))
    return cut(each.join(sizes, each.item_id == sizes.id).select("item_id", "h", "n_item", "bound"))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): items of which a document holds at least `threshold` of the shingles.

    Null or empty texts and items without words match nothing; rows that share a doc_id are one document; rows without a
    doc_id are left out. The item side is broadcast only while its count is small, else both sides are shuffled by hash.
    """
    items = item_sets(benchmark)
    widest = items.agg(F.max("bound")).first()[0] or 0
    texts = plain(docs).where("doc_id is not null")
    sketch = with_shingles(texts).select("doc_id", F.explode_outer("shingles").alias("h")).where(_below(F.col("h"), F.lit(widest)))
    sketch_items = small_side(items.where(_below(F.col("h"), F.col("bound"))).select("item_id", F.col("h").alias("ih")), BROADCAST_HASHES)
    candidates = cut(sketch.join(sketch_items, sketch.h == F.col("ih")).select("doc_id", "item_id").distinct())
    wanted = small_side(cut(candidates.select(F.col("doc_id").alias("want")).distinct()))
    again = with_shingles(texts.join(wanted, texts.doc_id == F.col("want"), "left_semi")).select("doc_id", F.explode_outer("shingles").alias("h"))
    full = small_side(items.select(F.col("item_id").alias("full_id"), F.col("h").alias("ih"), "n_item"), BROADCAST_HASHES)
    hits = again.join(full, again.h == F.col("ih")).select("doc_id", "full_id", "n_item", "h").distinct()
    counted = hits.groupBy("doc_id", "full_id", "n_item").agg(F.count(F.lit(1)).alias("n_shared"))
    pairs = candidates.select(F.col("doc_id").alias("cd"), F.col("item_id").alias("ci"))
    checked = counted.join(pairs, (counted.doc_id == pairs.cd) & (counted.full_id == pairs.ci), "left_semi")
    containment = F.col("n_shared") / F.col("n_item")
    return checked.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item")).select("doc_id", F.col("full_id").alias("item_id"), "n_item", "n_shared", containment.alias("containment"))
