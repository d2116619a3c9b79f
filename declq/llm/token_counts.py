"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declq.llm.common import cut

#: Lengths per block of the two-level suffix sums; a block is one window partition, and block totals are the other level.
BLOCK = 1024


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """(length, n_docs): one row per encoded length. Map-side combining, so a hot length costs one row per task."""
    return lengths.groupBy(F.col(column).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs")).where("length is not null")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length L of the histogram, taken as a context limit:

    n_docs (of just L), docs_ge and tokens_ge (documents of L tokens or more and their tokens), total_docs, total_tokens,
    truncated_tokens = sum of min(length, L), fits_docs (length <= L), quantile = fits_docs / total_docs.
    Suffix sums run inside blocks of BLOCK lengths; block totals are summed over (longest length / BLOCK) rows.
    An empty histogram gives no rows. The histogram is cut first: it is read twice, and its texts should be encoded once.
    """
    histogram = cut(histogram)
    cells = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).cast("long").alias("block"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = cells.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("total_docs"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    here = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = cells.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(here) + F.col("docs_after")).alias("docs_ge"),
        (F.sum("tokens").over(here) + F.col("tokens_after")).alias("tokens_ge"),
        "total_docs",
        "total_tokens",
    )
    fits = F.col("total_docs") - F.col("docs_ge") + F.col("n_docs")
    return out.select(
        "length",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"),
        fits.alias("fits_docs"),
        (fits / F.col("total_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Sum of min(length, limit) for any limit, also one that is no length of the histogram: one row (limit, truncated_tokens)."""
    reached = F.when(F.col("length") >= limit, F.col("length"))
    row = sums.agg(F.max("total_tokens").alias("total"), F.min_by("docs_ge", reached).alias("d"), F.min_by("tokens_ge", reached).alias("t"))
    return row.select(F.lit(limit).cast("long").alias("limit"), (F.coalesce("total", F.lit(0)) - F.coalesce("t", F.lit(0)) + limit * F.coalesce("d", F.lit(0))).alias("truncated_tokens"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents do not exceed: one row (length), null if there is none."""
    return sums.where(F.col("quantile") >= q).agg(F.min("length").alias("length"))
