"""Total orders cut into ranges, and what can be worked out over them when one key holds most rows.

A window over a key sends all of its rows to one task. Here the order of (key, sort columns) is cut into ranges of about equal
numbers of rows, whatever the keys; a window runs inside a range, and a row a range carries over what a key has before it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declq.checkpoint import cut

#: Rows of a range on average; places that are sampled for each range, on average.
ROWS_PER_RANGE, SAMPLED = 200_000, 256
#: Rows that may be broadcast, about; a larger side is shuffled.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast only if a count shows at most `rows` rows. Pass a table that is cheap to count."""
    return F.broadcast(df) if df.count() <= rows else df


def starts(places: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(place): where ranges of the order of `places` (one column, place) begin, the least place of the sample first. A row a range.

    Starts come from a sample of all rows, so ranges hold about equal numbers of rows; that every row belongs to one range does
    not depend on the sample. Equal places are never parted. The table is written once, so that all its readers see the same.
    """
    count = places.agg(F.count(F.lit(1))).first()[0]
    n = max(math.ceil(count / rows_per_range), 1)
    some = places if count <= n * SAMPLED else places.sample(n * SAMPLED / count, seed=1)
    dealt = some.distinct().repartitionByRange(n, "place")
    return cut(dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("place").alias("place")).select("place"))


def in_ranges(rows: DataFrame, order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """`rows` with `range`: the number of the range that a row's place in the ascending order of the columns `order` lies in.

    Nulls come first. A place is looked up among every STEP-th start and then among those that follow: twice the root of the
    number of ranges comparisons a row. Needs no shuffle of `rows`, but reads their order columns once more.
    """
    place = F.struct(*order)
    begun = starts(rows.select(place.alias("place")), rows_per_range)
    known = rows.withColumn("_starts", begun.agg(F.sort_array(F.collect_list("place"))).scalar()).withColumn("_place", place)
    known = known.withColumn("_step", F.ceil(F.sqrt(F.size("_starts"))).cast("int"))
    reached = lambda some: F.size(F.filter(some, lambda x: x <= F.col("_place")))
    block = reached(F.transform(F.sequence(F.lit(0), F.greatest(F.size("_starts") - 1, F.lit(0)), F.greatest(F.col("_step"), F.lit(1))), lambda i: F.get("_starts", i)))
    known = known.withColumn("_block", F.greatest(block - 1, F.lit(0)) * F.col("_step"))
    inside = reached(F.slice("_starts", F.col("_block") + 1, F.col("_step"))) - 1
    return known.withColumn("range", F.greatest(F.col("_block") + inside, F.lit(0))).drop("_starts", "_place", "_step", "_block")


def offsets(cells: DataFrame, by: list[str], amounts: list[str]) -> DataFrame:
    """(range, by, <amount>_before): the sum of each amount over a key's earlier ranges, for keys that lie in several.

    `cells` has a row a range and key. A key has as many rows here as ranges, so the window holds no rows of the data.
    """
    before = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = cells.select("range", *by, *[F.sum(a).over(before).alias(f"{a}_before") for a in amounts])
    return sums.where(F.col(f"{amounts[0]}_before").isNotNull())


def same_cell(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on range and key; null keys meet. `right` has a row a range and key that others of the key precede: few rows."""
    named = cut(right.select(F.col("range").alias("_range"), *[F.col(k).alias(f"_of_{k}") for k in by], *[c for c in right.columns if c != "range" and c not in by]))
    on = F.col("range") == F.col("_range")
    for k in by:
        on &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(small_side(named), on, "left").drop("_range", *[f"_of_{k}" for k in by])


def number_rows(rows: DataFrame, by: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """`rows` with `number`: 1, 2, 3, ... inside each key in the order of the columns, which should be unique.

    Like row_number over (partition by key), but no task holds a key: rows are numbered inside their range, and the key's rows
    in earlier ranges, counted once, are added.
    """
    ranged = in_ranges(rows, [*by, *order], rows_per_range)
    cells = ranged.groupBy("range", *by).agg(F.count(F.lit(1)).alias("n"))
    local = F.row_number().over(Window.partitionBy("range", *by).orderBy(*order))
    out = same_cell(ranged.withColumn("_local", local), offsets(cells, by, ["n"]), by)
    return out.withColumn("number", (F.col("_local") + F.coalesce("n_before", F.lit(0))).cast("long")).drop("_local", "n_before", "range")


def value_ranks(rows: DataFrame, by: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(by, order, n, rank, dense_rank, rank_desc, total): ranks of the distinct values of each key, ties alike.

    Equal values are counted before anything is shuffled, so neither a key nor a value of most rows is one task's work.
    rank_desc is the rank in the descending order, total the key's rows.
    """
    values = cut(rows.groupBy(*by, *order).agg(F.count(F.lit(1)).alias("n")))
    ranged = in_ranges(values, [*by, *order], rows_per_range)
    cells = cut(ranged.groupBy("range", *by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values")))
    whole = cells.groupBy(*[F.col(k).alias(f"_of_{k}") for k in by]).agg(F.sum("n").alias("total")) if by else cells.agg(F.sum("n").alias("total"))
    inside = Window.partitionBy("range", *by).orderBy(*order)
    local = ranged.withColumn("_below", F.coalesce(F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_place", F.row_number().over(inside))
    out = same_cell(local, offsets(cells.withColumn("places", F.col("values")), by, ["n", "places"]), by)
    on: Column = F.lit(True)
    for k in by:
        on &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    out = out.join(whole, on) if by else out.withColumn("total", whole.scalar())
    below = F.col("_below") + F.coalesce("n_before", F.lit(0))
    dense = F.col("_place") + F.coalesce("places_before", F.lit(0))
    return out.select(*by, *order, "n", (below + 1).alias("rank"), dense.cast("long").alias("dense_rank"), (F.col("total") - below - F.col("n") + 1).alias("rank_desc"), "total")


def rank_rows(rows: DataFrame, by: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """`rows` with rank, dense_rank, rank_desc and total (see value_ranks): one join on the value, which adaptive execution splits where it is hot."""
    ranks = value_ranks(rows, by, order, rows_per_range)
    named = ranks.select(*[F.col(c).alias(f"_of_{c}") for c in (*by, *order)], "rank", "dense_rank", "rank_desc", "total")
    on: Column = F.lit(True)
    for c in (*by, *order):
        on &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(named, on).drop(*[f"_of_{c}" for c in (*by, *order)])


def moving(rows: DataFrame, by: list[str], order: list[str], preceding: int, rows_per_range: int = ROWS_PER_RANGE, **frames: Column) -> DataFrame:
    """`rows` with aggregates over each row and the `preceding` rows before it in its key: moving(..., total=F.sum("x")).

    Rows are numbered (see number_rows) and cut into stretches of a fixed number of rows; the last `preceding` of a stretch are
    copied to the next one, so a frame is whole in its stretch, and no task holds a key.
    """
    size = max(preceding, 1) * 4 + rows_per_range
    numbered = number_rows(rows, by, order, rows_per_range)
    at = F.col("number") - 1
    home, last = F.floor(at / size), at % size >= size - preceding
    homes = F.when(last, F.array(home, home + 1)).otherwise(F.array(home))
    dealt = numbered.select("*", home.alias("_home"), F.explode(homes).alias("_stretch"))
    frame = Window.partitionBy(*by, "_stretch").orderBy("number").rowsBetween(-preceding, Window.currentRow)
    out = dealt.withColumns({name: f.over(frame) for name, f in frames.items()})
    return out.where("_home = _stretch").drop("_home", "_stretch")
