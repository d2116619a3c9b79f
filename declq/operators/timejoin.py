"""Joins by time: the last row before another (as-of), and rows whose intervals overlap. Neither is an inequality join in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declq.operators.ranges import ROWS_PER_RANGE, in_ranges, same_cell


def _apart(left: DataFrame, right: DataFrame) -> None:
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if shared:
        raise ValueError(f"both sides have {sorted(shared)}; rename one")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    by: list[tuple[str, str]] | None = None,
    ties: list[str] | None = None,
    within: Column | None = None,
    how: str = "left",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Every row of `left` with the last row of `right` of the same key at its time or before; nulls where there is none.

    by: pairs of a left and a right key column; none for one order over all rows. ties: columns of `right` that decide between
    rows of one time, the greatest wins. within: an interval (F.make_dt_interval, F.expr("INTERVAL ...")) that the match may be
    old at most. how="inner" leaves out rows without a match. Rows with a null key or time match nothing.

    Both sides become one frame, ordered by key and time and cut into ranges of equal numbers of rows; inside a range the last
    right row is a running state, and the last one of each range is carried to the ranges after it that begin with its key. A
    key of most rows is dealt over as many tasks as its rows fill ranges.
    """
    _apart(left, right)
    by, ties = by or [], ties or []
    keys = [f"k{i}" for i in range(len(by))]
    tied = [f"u{i}" for i in range(len(ties))]
    mine = left.select(F.struct(*left.columns).alias("left"), *[F.col(a).alias(k) for k, (a, _) in zip(keys, by)], F.col(left_time).alias("t"), F.lit(1).alias("side"))
    whole = right.where(F.col(right_time).isNotNull())
    for _, b in by:
        whole = whole.where(F.col(b).isNotNull())
    other = whole.select(F.struct(*right.columns).alias("right"), *[F.col(b).alias(k) for k, (_, b) in zip(keys, by)], F.col(right_time).alias("t"), F.lit(0).alias("side"), *[F.col(c).alias(u) for u, c in zip(tied, ties)])
    both = mine.unionByName(other, allowMissingColumns=True)
    order = ["t", "side", *tied]  # at one time the right rows come first
    ranged = in_ranges(both, [*keys, *order], rows_per_range)
    running = Window.partitionBy("range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("_found", F.last("right", ignorenulls=True).over(running))
    carried = same_cell(found.where("side = 1").drop("right"), _carried(ranged, keys, order), keys)
    match = F.coalesce("_found", "carry")
    if within is not None:
        match = F.when(match[right_time] + within >= F.col("t"), match)
    out = carried.select("left", match.alias("right"))
    out = out.where("right is not null") if how == "inner" else out
    return out.select("left.*", *[F.col("right")[c].alias(c) for c in right.columns])


def _carried(ranged: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(range, keys, carry): the last right row of a range's first key in the ranges before it. Made of a row a range."""
    key = F.struct(F.lit(0).alias("one"), *keys)
    is_right = F.col("side") == 0
    ends = ranged.groupBy("range").agg(
        F.min(key).alias("first"),
        F.max(key).alias("last"),
        F.max_by(F.struct(key.alias("key"), "right"), F.when(is_right, F.struct(*keys, *order))).alias("r"),
    )
    asks = ends.select("range", F.col("first").alias("key"), F.lit(0).alias("tells"), F.lit(None).cast(ranged.schema["right"].dataType).alias("right"))
    tells = ends.select("range", F.col("last").alias("key"), F.lit(1).alias("tells"), F.when(F.col("r.key") == F.col("last"), F.col("r.right")).alias("right"))
    before = Window.partitionBy("key").orderBy("range", "tells").rowsBetween(Window.unboundedPreceding, -1)
    known = asks.unionByName(tells).withColumn("carry", F.last("right", ignorenulls=True).over(before))
    return known.where("tells = 0 and carry is not null").select("range", *[F.col(f"key.{k}").alias(k) for k in keys], "carry")


def _points(c: Column) -> Column:
    """Times and dates as microseconds, whole numbers as they are."""
    return c.cast("long")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], by: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of a left and a right row of one key whose half-open spans [from, to) share a point, each pair once.

    Spans are pairs of whole-number columns (F.unix_micros of times). Null and empty spans meet nothing; a point p is [p, p + 1).

    A span has the level p of its length, 2^(p-1) < length <= 2^p, and touches at most two bins of width 2^p. A pair meets on the
    level of its longer span: the longer side is in its own bins, the shorter in those of every level above its own that the
    other side has, so a row is repeated twice a level in use, never once a bin that a long span covers. The pair counts in the
    bin of its later start alone. Levels, at most 64, are the only thing that comes to the driver.
    """
    _apart(left, right)
    by = by or []
    a, b = _leveled(left, left_span, "a"), _leveled(right, right_span, "b")
    levels = {side: sorted(r[0] for r in df.select(f"{side}_level").distinct().collect()) for side, df in (("a", a), ("b", b))}
    # The longer side is the left one where levels are equal.
    parts = [_meet(_own(a, "a"), _above(b, "b", levels["a"], 0), by), _meet(_above(a, "a", levels["b"], 1), _own(b, "b"), by)]
    met = parts[0].unionByName(parts[1])
    return met.select(*left.columns, *right.columns)


def _leveled(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
    low, high = (F.col(c).cast("long") for c in span)
    rows = df.withColumns({f"{side}_low": low, f"{side}_high": high}).where(F.col(f"{side}_low") < F.col(f"{side}_high"))
    return rows.withColumn(f"{side}_level", F.length(F.bin(F.col(f"{side}_high") - F.col(f"{side}_low") - 1)) - F.when(F.col(f"{side}_high") - F.col(f"{side}_low") == 1, 1).otherwise(0))


def _binned(df: DataFrame, side: str, level: Column) -> DataFrame:
    """A row for each bin of `level` that the span touches; shifts are floors, below zero too."""
    df = df.withColumn("level", level)
    at = lambda c: F.call_function("shiftright", c, F.col("level"))
    return df.withColumn("bin", F.explode(F.sequence(at(F.col(f"{side}_low")), at(F.col(f"{side}_high") - 1))))


def _own(df: DataFrame, side: str) -> DataFrame:
    return _binned(df, side, F.col(f"{side}_level").cast("int"))


def _above(df: DataFrame, side: str, levels: list[int], more: int) -> DataFrame:
    """Rows once for each of `levels` that is their own (more = 0) or above."""
    wanted = F.filter(F.array(*[F.lit(p) for p in levels]).cast("array<int>"), lambda p: p >= F.col(f"{side}_level") + more)
    return _binned(df.withColumn("_p", F.explode(wanted)), side, F.col("_p")).drop("_p")


def _meet(a: DataFrame, b: DataFrame, by: list[tuple[str, str]]) -> DataFrame:
    a = a.withColumnsRenamed({"level": "a_at", "bin": "a_bin"})
    b = b.withColumnsRenamed({"level": "b_at", "bin": "b_bin"})
    on = (F.col("a_at") == F.col("b_at")) & (F.col("a_bin") == F.col("b_bin"))
    for x, y in by:
        on &= F.col(x) == F.col(y)
    both = (F.col("a_low") < F.col("b_high")) & (F.col("b_low") < F.col("a_high"))
    once = F.call_function("shiftright", F.greatest("a_low", "b_low"), F.col("a_at")) == F.col("a_bin")
    return a.join(b, on & both & once)
