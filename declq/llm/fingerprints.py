"""Document fingerprints by SpotSigs: chains of content words that follow common words, compared by Jaccard similarity.

Native DataFrame functions only. Words are runs of letters and digits of the lower-cased text. A word of ANCHORS is an anchor,
any other a content word. Every anchor makes a signature: itself and the CHAIN content words that follow it, other anchors left
out (fewer or none at the end of the text). So that texts of few common words have signatures too, each GAP-th content word of
a run without an anchor begins a chain of its own, counted from the last anchor or the beginning.

A fingerprint is the MD5 of the set of signatures, sorted and joined. Sets are partitioned by their length, partition p holding
those of 2^p to 2^(p+1) - 1 signatures. The Jaccard similarity of two sets is at most the ratio of their lengths, so sets that
are APART partitions or more apart (below 1/8) are not compared and have likeness 0; equal fingerprints have likeness 1; all
others are compared exactly. Only texts without words have no signature; their fingerprint is that of the empty set.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declq.llm.common import cut, small_side

#: Common words of English, French, German and Spanish (fixed list).
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux avec dans de des du en est et la le les ne ou par pas pour que qui sur un une "
    "als auch auf das dem den der die ein eine im ist mit nicht sich sie und von zu "
    "al como con del el es lo los las no para se su una y"
).split()
CHAIN, GAP = 2, 4
#: Length partitions at which two sets are not compared.
APART = 4
#: Rows of a range of the document order on average, and ranges at least.
ROWS_PER_RANGE, LEAST_RANGES = 20_000, 64


def signatures(text: Column) -> Column:
    """The distinct signatures of a text as an array of text, in no order; empty for a null text or one without words.

    A signature costs a few array look-ups: the anchors before a content word are its place in the text less its place among
    content words, and the other way round.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.get(F.transform(F.array(words), _of_words), F.lit(0))


def _of_words(words: Column) -> Column:
    """Lambdas over one-element arrays name what is used more than once, so that it is worked out once."""
    common = F.transform(words, lambda w: w.isin(*ANCHORS))
    return F.get(F.transform(F.array(F.struct(words.alias("w"), common.alias("c"))), lambda x: _of_marked(x["w"], x["c"])), F.lit(0))


def _of_marked(words: Column, common: Column) -> Column:
    places = F.transform(words, lambda w, i: i)
    anchors, others = F.filter(places, lambda i: F.get(common, i)), F.filter(places, lambda i: ~F.get(common, i))
    content = F.filter(words, lambda w, i: ~F.get(common, i))
    parts = F.struct(anchors.alias("a"), others.alias("o"), content.alias("k"))
    return F.get(F.transform(F.array(parts), lambda x: _chains(words, x["a"], x["o"], x["k"])), F.lit(0))


def _chains(words: Column, anchors: Column, others: Column, content: Column) -> Column:
    chain = lambda at, n: F.concat_ws(" ", *[F.get(content, at + j) for j in range(n)])
    spots = F.transform(anchors, lambda p, j: F.concat(F.get(words, p), F.lit(":"), chain(p - j, CHAIN)))
    run = lambda p, q: p - F.coalesce(F.when(p > q, F.get(anchors, p - q - 1)) + 1, F.lit(0))
    begins = lambda p, q: (run(p, q) % GAP == 0) & ((run(p, q) > 0) | (p == q))
    gaps = F.transform(others, lambda p, q: F.when(begins(p, q), F.concat(F.lit(":"), chain(q, CHAIN + 1))))
    return F.array_distinct(F.array_compact(F.concat(spots, gaps)))


def fingerprint(signs: Column) -> Column:
    """Hexadecimal digest of a set of signatures, whatever its order."""
    return F.md5(F.array_join(F.array_sort(signs), "\n").cast("binary"))


def hashed(signs: Column) -> Column:
    """The set as 64-bit hashes, which is what is shuffled and compared."""
    return F.transform(signs, lambda s: F.xxhash64(s))


def length_partition(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """Pruned Jaccard similarity of two sets (arrays of hashes), 0 to 1. Two empty sets are alike."""
    n, m = F.size(a), F.size(b)
    far = (n == 0) | (m == 0) | (F.abs(length_partition(n) - length_partition(m)) >= APART)
    shared = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when(far, F.lit(0.0)).otherwise(shared / (n + m - shared))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points), n_signatures, length_partition (null for none), fingerprint of every row. Null text is empty. No shuffle."""
    rows = _plain(docs).withColumn("s", signatures(F.col("text")))
    size = F.size("s")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), size.alias("n_signatures"), F.when(size > 0, length_partition(size)).alias("length_partition"), fingerprint(F.col("s")).alias("fingerprint"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _place() -> Column:
    """What rows are sorted by, ascending: doc_id downwards, rows without one last; then a hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.xxhash64("text").alias("h"))


def range_starts(places: DataFrame) -> DataFrame:
    """(place, range): the places at which the ranges of the order begin, from all rows of `places` (place). A row a range."""
    count = places.agg(F.count(F.lit(1))).first()[0]
    n = max(LEAST_RANGES, math.ceil(count / ROWS_PER_RANGE))
    starts = cut(places.distinct().repartitionByRange(n, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("place")).select("place"))
    return cut(starts.withColumn("range", F.row_number().over(Window.orderBy("place")) - 1))


def with_next(rows: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """add(rows), with every column c of it once more as next_c: those of the row that follows in descending doc_id; the first follows the last.

    `rows` has doc_id and text. Rows without doc_id come last; rows of one doc_id go by a hash of the text, equal ones in any
    order. The order is cut into ranges at places taken from all rows, so a doc_id of many texts is cut too. A row is shuffled
    once, to its range; the first row of each range goes to the end of the range before as well.
    """
    rows = rows.withColumn("place", _place())
    starts = range_starts(rows.select("place"))
    # A row's range is found among every STEP-th start and then among those that follow it.
    every = starts.agg(F.sort_array(F.collect_list("place"))).scalar()
    step = F.ceil(F.sqrt(F.size("_starts"))).cast("int")
    known = rows.withColumn("_starts", every).withColumn("_step", step)
    begun = lambda some: F.size(F.filter(some, lambda x: x <= F.col("place")))
    block = begun(F.transform(F.sequence(F.lit(0), F.size("_starts") - 1, F.col("_step")), lambda i: F.get("_starts", i))) - 1
    known = known.withColumn("_block", block * F.col("_step"))
    ranged = known.withColumn("range", F.col("_block") + begun(F.slice("_starts", F.col("_block") + 1, F.col("_step"))) - 1).drop("_starts", "_step", "_block")
    n = starts.agg(F.count(F.lit(1))).scalar()
    first = starts.select(F.col("place").alias("_at"), F.pmod(F.col("range") - 1, n).cast("int").alias("range"))
    heads = rows.join(small_side(first), F.col("place") == F.col("_at")).drop("_at").dropDuplicates(["range"])
    both = add(ranged.withColumn("_head", F.lit(False)).unionByName(heads.withColumn("_head", F.lit(True))))
    order = Window.partitionBy("range").orderBy("_head", "place")
    names = [c for c in both.columns if c not in ("place", "range", "_head")]
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in names}).where(~F.col("_head")).drop("place", "range", "_head")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, whose last third is replaced by the beginning of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness to the edited text's set and
    to the next document's). Null and empty texts are empty; texts without a word are alike. Rows without doc_id and rows
    of one doc_id stand in the order of with_next; a single row is its own next one. Further columns do not matter; an empty
    table gives an empty one.
    """
    signed = lambda df: df.withColumn("signs", signatures(F.col("text"))).withColumn("fingerprint", fingerprint(F.col("signs"))).withColumn("signs", hashed(F.col("signs")))
    rows = with_next(_plain(docs), signed).drop("next_doc_id", "next_fingerprint").withColumn("n", F.length("text"))
    third = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_signs", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), hashed(F.col("edited_signs"))).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )
