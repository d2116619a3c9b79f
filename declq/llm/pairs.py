"""Exact checks inside candidate components without a row per pair: components are cut into blocks, blocks meet in pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declq.llm.common import cut, small_side

#: Members of a block. A task holds two blocks, whatever the size of the component.
BLOCK = 512


def block_pairs(members: DataFrame, component: str, key: str) -> DataFrame:
    """`members` with lo, hi, block: a component of n members has about n / BLOCK hashed blocks, and every two blocks meet once.

    A member is repeated once per block of its component, never once per other member. `members` should be cheap to read
    twice (see cut): sizes are counted first, and only components above BLOCK members are joined, by a small side.
    """
    large = members.groupBy(F.col(component).alias("_large")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    large = small_side(cut(large))
    n_blocks = F.coalesce(F.ceil(F.col("_n") / BLOCK), F.lit(1)).cast("int")
    dealt = members.join(large, members[component] == F.col("_large"), "left").withColumn("_b", n_blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.col("_b")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return dealt.withColumns({"lo": F.least("block", "_o"), "hi": F.greatest("block", "_o")}).drop("_large", "_n", "_b", "_o")


def map_groups(df: DataFrame, keys: list[str], function: Callable[[dict[str, list]], Iterator[pa.RecordBatch]], schema: str, also_sort: tuple[str, ...] = ()) -> DataFrame:
    """Apply `function` to the columns of each group of `keys`. Groups stream through a sorted partition, one in memory at a time."""

    def each(groups: Iterator[dict[str, list]]) -> Iterator[pa.RecordBatch]:
        for group in groups:
            yield from function(group)

    return map_all_groups(df, keys, each, schema, also_sort)


def map_all_groups(df: DataFrame, keys: list[str], function: Callable[[Iterator[dict[str, list]]], Iterator[pa.RecordBatch]], schema: str, also_sort: tuple[str, ...] = ()) -> DataFrame:
    """As map_groups, with a `function` that takes all groups of a partition one after the other and may work on several together."""
    parts: list[Column] = [F.col(k) for k in keys]

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        held: dict[str, list] = {}
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            change[0] = last is not None and tuple(c[0] for c in columns) != last
            rows, start = batch.to_pydict(), 0
            for at in [*np.flatnonzero(change), batch.num_rows]:
                for k, values in rows.items():
                    held.setdefault(k, []).extend(values[start:at])
                if at < batch.num_rows and held[keys[0]]:
                    yield held
                    held = {}
                start = at
            last = tuple(c[-1] for c in columns)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(grouped(batches))

    # A number of its own keeps adaptive execution from merging partitions that are small in bytes: their work is not.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *parts).sortWithinPartitions(*keys, *also_sort).mapInArrow(run, schema)


def roots(n: int, linked: np.ndarray) -> np.ndarray:
    """Least index of each node's component in a symmetric boolean matrix."""
    label = np.arange(n)
    while True:
        low = label.copy()
        for lo in range(0, n, 512):  # bounded copies of the matrix
            low[lo : lo + 512] = np.minimum(low[lo : lo + 512], np.where(linked[lo : lo + 512], label[None, :], n).min(1, initial=n))
        low = low[low]
        if (low == label).all():
            return label
        label = low
