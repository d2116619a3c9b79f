"""Proportional stratified interleaving: every shard gets each source in its share of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declq.llm.common import cut

#: Rows that a window partition has on average; the number of hash ranges follows from it and the number of rows.
ROWS_PER_RANGE = 100_000
#: Bits of the hash that places a source's first row.
OFFSET_BITS = 20
#: Ranges at least, so that a hot source is spread over tasks even on small tables.
LEAST_RANGES = 256


def interleave(docs: DataFrame, shards: int = 16, seed: str = "shuffle-1") -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, shard, slot for every row of `docs`.

    Rows of a source are ranked in the order of a seeded hash; the row of rank r (from 0) of n sits at (r + u) / n, u a
    seeded hash of the source in (0, 1): a source of many rows has its share of every stretch whatever u is, and sources of a few
    rows, which would all sit at the same fractions, are spread as one source of their rows together would be.
    All rows are sorted by that fraction and cut into `shards` runs whose row counts differ by one at most; slot counts
    from 0 in each run. Ties in the fraction go by the row's hash, so no source always comes first.
    Null text has size 1; null source is a source of its own; repeated rows stay separate rows; of a long text only the size
    and the checksum are shuffled; an empty table gives an empty one.
    Ranking never gathers a source in one task: rows are dealt by hash range, counted per range, and ranked inside it. The
    order of the whole is ranked the same way, by ranges of (fraction, hash).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32"), F.col("size")))
    rows = cut(rows)  # small columns only; every pass below reads this instead of the texts
    n = rows.count()
    ranges = LEAST_RANGES
    while ranges * ROWS_PER_RANGE < n:
        ranges *= 2
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_RANGE))
    ranged = rows.withColumn("r", F.pmod(F.shiftright("h", 20), F.lit(ranges)).cast("int"))
    before = Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    counts = ranged.groupBy("source", "r").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select(F.col("source").alias("s"), F.col("r").alias("q"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(whole).alias("n"))
    offset = (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << OFFSET_BITS)) + 0.5) / (1 << OFFSET_BITS)
    inside = Window.partitionBy("source", "r").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = ranged.withColumn("k", F.row_number().over(inside))
    placed = ranked.join(counts, ranked.source.eqNullSafe(counts.s) & (ranked.r == counts.q)).withColumn("fraction", (F.col("base") + F.col("k") - 1 + offset) / F.col("n"))
    placed = placed.select("doc_id", "source", "size", "text_crc32", "h", "fraction")
    # Ranges of the whole order, fraction and hash, so that no fraction that many rows share is one task's work.
    placed = cut(placed.repartitionByRange(parts, "fraction", "h", "source", "doc_id", "text_crc32", "size").withColumn("g", F.spark_partition_id()))
    cells = placed.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    cells = cells.select(F.col("g").alias("cell"), F.coalesce(F.sum("c").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    order = Window.partitionBy("g").orderBy("fraction", "h", "source", "doc_id", "text_crc32", "size")
    at = F.col("start") + F.row_number().over(order) - 1
    out = placed.join(cells, placed.g == cells.cell).withColumn("p", at)
    each, more = divmod(n, shards)  # the first `more` shards have one row more
    wide = more * (each + 1)
    shard = F.when(F.col("p") < wide, F.floor(F.col("p") / (each + 1))).otherwise(more + F.floor((F.col("p") - wide) / max(each, 1))).cast("int")
    slot = F.when(F.col("p") < wide, F.col("p") % (each + 1)).otherwise((F.col("p") - wide) % max(each, 1)).cast("long")
    return out.select("doc_id", "source", "size", "text_crc32", "fraction", shard.alias("shard"), slot.alias("slot"))
