"""User-defined aggregates as update, merge and finish over Arrow batches, and lateral table functions.

A fold that needs all values of a group in one row is replaced by three functions: `start` gives an empty state, `update` takes
a state and a batch of the group's rows, `merge` joins two states, `finish` makes the result. Every task folds its own rows to a
state a group, so only states are shuffled; a group of most rows has no more states than there are tasks, and these are joined in
a tree. States are whatever Python pickles; they should be small.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declq.checkpoint import cut

#: Groups that a task holds states of at once; beyond it they are sent on and begun anew. States that one merging task joins.
HELD, FAN_IN = 50_000, 64


@dataclass(frozen=True)
class Aggregator:
    """start() -> state; update(state, rows: pa.RecordBatch) -> state; merge(state, state) -> state; finish(state) -> dict of the result's columns."""

    start: Callable[[], Any]
    update: Callable[[Any, pa.RecordBatch], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], dict[str, Any]]


def _keys_of(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each key of a batch with its rows, in their order."""
    if not keys:
        yield (), batch
        return
    table = pa.table({k: batch.column(batch.schema.get_field_index(k)) for k in keys}).append_column("_at", pa.array(range(batch.num_rows), pa.int32()))
    groups = table.group_by(keys, use_threads=False).aggregate([("_at", "list")])
    names = [groups.column(k).to_pylist() for k in keys]
    for *key, at in zip(*names, groups.column("_at_list")):
        yield tuple(key), batch.take(at.values)


def aggregate(rows: DataFrame, by: list[str], aggregator: Aggregator, result: str) -> DataFrame:
    """(by, result): one row a group; `result` is the schema of what finish gives. No rows give no row.

    Rounds: states of a task's rows (no shuffle), then joined by (group, salt) until no group has more than about FAN_IN states,
    then by group. The states, which are few, are written once and counted; the salts follow from the largest number.
    """
    spark = rows.sparkSession
    key_fields = [f for f in rows.schema.fields if f.name in by]
    key_schema = T.StructType([next(f for f in key_fields if f.name == k) for k in by])
    state_schema = T.StructType([*key_schema.fields, T.StructField("state", T.BinaryType())])
    out_schema = T.StructType([*key_schema.fields, *T.StructType.fromDDL(result).fields])
    columns = [f.name for f in out_schema.fields[len(by) :]]

    def emit(batch_schema: pa.Schema, keys: list[tuple], last: list[tuple[str, list, pa.DataType | None]]) -> pa.RecordBatch:
        named = {k: pa.array([x[i] for x in keys], batch_schema.field(k).type) for i, k in enumerate(by)}
        return pa.RecordBatch.from_pydict(named | {name: pa.array(v, kind) for name, v, kind in last})

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Any] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for key, some in _keys_of(batch, by):
                held[key] = aggregator.update(held[key] if key in held else aggregator.start(), some)
            if len(held) > HELD:
                yield emit(schema, list(held), [("state", [pickle.dumps(s) for s in held.values()], pa.binary())])
                held = {}
        if held:
            yield emit(schema, list(held), [("state", [pickle.dumps(s) for s in held.values()], pa.binary())])

    def joined(finish: bool, kinds: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Sorted states of a group follow each other; one state is held."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state, fresh = None, None, True
            schema = None
            for batch in batches:
                schema = batch.schema
                done: list[tuple[tuple, Any]] = []
                keys = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in [*by, "salt"]]))
                for key, raw in zip(keys, batch.column(batch.schema.get_field_index("state")).to_pylist()):
                    if fresh or key != now:
                        if not fresh:
                            done.append((now, state))
                        now, state, fresh = key, pickle.loads(raw), False
                    else:
                        state = aggregator.merge(state, pickle.loads(raw))
                if done:
                    yield give(schema, done)
            if not fresh:
                yield give(schema, [(now, state)])

        def give(schema: pa.Schema, done: list[tuple[tuple, Any]]) -> pa.RecordBatch:
            if not finish:
                return emit(schema, [k for k, _ in done], [("state", [pickle.dumps(s) for _, s in done], pa.binary())])
            results = [aggregator.finish(s) for _, s in done]
            return emit(schema, [k for k, _ in done], [(c, [r[c] for r in results], kinds.field(c).type) for c in columns])

        return run

    def merged(states: DataFrame, finish: bool) -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = states.repartition(n, *by, "salt").sortWithinPartitions(*by, "salt")
        return dealt.mapInArrow(joined(finish, out_arrow), out_schema if finish else state_schema)

    out_arrow = spark.createDataFrame([], out_schema).toArrow().schema
    states = cut(rows.mapInArrow(update, state_schema))
    most = states.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while most > FAN_IN:
        most = -(-most // FAN_IN)
        states = merged(states.withColumn("salt", F.pmod(F.xxhash64("state"), F.lit(most)).cast("int")), finish=False)
    return merged(states.withColumn("salt", F.lit(0)), finish=True)


def lateral(rows: DataFrame, function: Callable[[pa.RecordBatch], Iterator[tuple[int, dict[str, Any]]]], result: str) -> DataFrame:
    """`rows` with the columns of a table function: for each row as many as it gives, none drops the row.

    function takes a batch and gives (index of the row in it, columns of `result`). One map over batches, no shuffle.
    """
    added = T.StructType.fromDDL(result)
    schema = T.StructType([*rows.schema.fields, *added.fields])
    kinds = rows.sparkSession.createDataFrame([], added).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = [], {c: [] for c in kinds.names}
            for i, values in function(batch):
                at.append(i)
                for c in columns:
                    columns[c].append(values.get(c))
            left = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*left.columns, *[pa.array(columns[c], kinds.field(c).type) for c in kinds.names]], [*batch.schema.names, *kinds.names])

    return rows.mapInArrow(run, schema)
