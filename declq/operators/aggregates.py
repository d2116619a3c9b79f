"""Aggregates that stay whole at any size: mergeable sketches, exact percentiles by histograms, grouping sets with distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declq.checkpoint import cut
from declq.operators.ranges import small_side

#: Registers of a distinct sketch as a power of two; its relative standard error is about 1.04 / sqrt(2^LG_K), 1.6 %.
LG_K = 12
#: Size parameter of a quantile sketch; the rank of an estimate is off by about 1.65 % at most, with 99 % certainty.
QUANTILE_K, RANK_ERROR = 200, 0.0165
#: Cells that a group's span of values is cut into in one pass of the exact percentile.
CELLS = 1024


# --- sketches --------------------------------------------------------------------------------------------------------


def distinct_states(rows: DataFrame, by: list[str], column: str, lg_k: int = LG_K) -> DataFrame:
    """(by, n_rows, state): a HyperLogLog state of the column's values in each group, a few KB however many they are. Nulls don't count."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.hll_sketch_agg(column, lg_k).alias("state"))


def merge_distinct(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, state): states of finer groups, read from anywhere, joined into those of coarser ones without their rows."""
    return states.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("state").alias("state"))


def distinct_estimate(state: Column) -> Column:
    """From the registers alone: a state joined with itself has the same ones, but no more the history of its rows' order.

    A state that one task built from rows estimates from that history, a joined one cannot; equal registers would differ.
    """
    return F.hll_sketch_estimate(F.hll_union(state, state))


def quantile_states(rows: DataFrame, by: list[str], column: str, k: int = QUANTILE_K) -> DataFrame:
    """(by, n_rows, state): a KLL state of the column's values as doubles in each group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(k)).alias("state"))


def merge_quantiles(states: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_rows, state): as merge_distinct, for quantile states."""
    return states.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.kll_merge_agg_double("state").alias("state"))


def quantile_estimate(state: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(state, F.lit(q))


# --- exact percentiles -----------------------------------------------------------------------------------------------


def percentiles(rows: DataFrame, by: list[str], column: str, qs: list[float]) -> DataFrame:
    """(by, q, value): the least value of each group whose share of the group's values at or below it is q or more.

    Nulls don't count; a group without values has none. Values are doubles (whole numbers up to 2^53 are exact).

    A pass counts the values of each group in CELLS cells of its span, combined before the shuffle, and keeps the least and
    greatest value of a cell. The cell of the wanted rank becomes the span of the next pass, until it holds one value: two or
    three passes for most columns, and values of most rows cost what others do. Nothing is sorted, and no task holds a group.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    values = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(column).cast("double").alias("v")).where("v is not null")
    ends = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    q = F.explode(F.array(*[F.lit(float(x)) for x in qs])).alias("q")
    # Rank by the same double arithmetic as other engines: n less what lies above.
    rank = F.greatest(F.lit(1), (F.col("n") - F.floor(F.col("n") - F.col("q") * F.col("n"))).cast("long"))
    open_spans = cut(ends.select(*keys, "n", "low", "high", q).select(*keys, "q", rank.alias("rank"), "low", "high"))
    done = None
    while True:
        closed = open_spans.where("low = high").select(*keys, "q", F.col("low").alias("value"))
        done = closed if done is None else done.unionByName(closed)
        open_spans = open_spans.where("low < high")
        if open_spans.isEmpty():
            break
        open_spans = _narrowed(values, open_spans, keys)
    return done.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "q", "value")


def _narrowed(values: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Each span cut down to the cell that holds its rank; ranks count from the beginning of the span."""
    wanted = small_side(spans.select(*[F.col(k).alias(f"of{k}") for k in keys], "q", "low", "high"))
    on: Column = F.col("v").between(F.col("low"), F.col("high"))
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"of{k}"))
    # Half of each end first: the difference of two doubles may be beyond their range.
    width = F.col("high") / 2 - F.col("low") / 2
    cell = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / width * CELLS), F.lit(CELLS - 1))
    cells = values.join(wanted, on).groupBy(*keys, "q", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    below = F.sum("n").over(Window.partitionBy(*keys, "q").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    asked = spans.select(*[F.col(k).alias(f"of{k}") for k in keys], F.col("q").alias("of_q"), "rank")
    same: Column = F.col("q") == F.col("of_q")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of{k}"))
    hit = cells.withColumn("below", below).join(asked, same).where("below < rank and rank <= below + n")
    return cut(hit.select(*keys, "q", (F.col("rank") - F.col("below")).alias("rank"), F.col("least").alias("low"), F.col("greatest").alias("high")))


# --- grouping sets ---------------------------------------------------------------------------------------------------


def cube(dims: list[str]) -> list[list[str]]:
    """Every set of the dimensions."""
    return [[d for i, d in enumerate(dims) if not m >> i & 1] for m in range(1 << len(dims))]


def rollup(dims: list[str]) -> list[list[str]]:
    """All dimensions, then one less from the end each time."""
    return [dims[:k] for k in range(len(dims), -1, -1)]


def grouping_sets(rows: DataFrame, dims: list[str], sets: list[list[str]], sums: dict[str, str] | None = None, distinct: dict[str, str] | None = None) -> DataFrame:
    """(dims, grouping_id, n_rows, sums..., distinct...): the rows of GROUP BY GROUPING SETS, also with distinct counts.

    sums and distinct map result names to columns. grouping_id has a bit for each dimension, the first one highest, that is set
    where the dimension is left out; a null of the data has it clear, so nulls and totals are told apart.

    The rows are aggregated once, to the cells of all dimensions (and of each distinct column's values); only those cells are
    repeated a set, not the rows. A value counts once a group as its cells are grouped by set, dimensions and value before
    they are counted, so no group's values are gathered.
    """
    sums, distinct = sums or {}, distinct or {}
    if any(d not in dims for s in sets for d in s):
        raise ValueError("a grouping set has a column that is no dimension")
    top = 1 << len(dims)
    ids = sorted({sum(top >> (i + 1) for i, d in enumerate(dims) if d not in s) for s in sets})
    gid = F.explode(F.array(*[F.lit(i) for i in ids])).alias("grouping_id")
    kept = [F.when(F.shiftright("grouping_id", len(dims) - 1 - i).bitwiseAND(1) == 0, F.col(d)).alias(d) for i, d in enumerate(dims)]

    def repeated(cells: DataFrame, *more: str) -> DataFrame:
        return cells.select("*", gid).select("grouping_id", *kept, *more)

    total = [F.sum(c).alias(name) for name, c in sums.items()]
    cells = rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_rows"), *total)
    again = [F.sum(name).alias(name) for name in ("n_rows", *sums)]
    out = repeated(cells, "n_rows", *sums).groupBy("grouping_id", *dims).agg(*again)
    for name, column in distinct.items():
        values = rows.where(F.col(column).isNotNull()).select(*dims, F.col(column).alias("_value")).distinct()
        counted = repeated(values, "_value").distinct().groupBy(F.col("grouping_id").alias("_id"), *[F.col(d).alias(f"_of_{d}") for d in dims]).agg(F.count(F.lit(1)).alias("_n"))
        on: Column = F.col("grouping_id") == F.col("_id")
        for d in dims:
            on &= F.col(d).eqNullSafe(F.col(f"_of_{d}"))
        out = out.join(counted, on, "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_id", "_n", *[f"_of_{d}" for d in dims])
    return out
