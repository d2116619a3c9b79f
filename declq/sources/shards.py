"""A data source of sharded JSON lines for spark.read.format("shards"): splits planned by size, filters tested in the source, Arrow batches.

    spark.dataSource.register(Shards)
    with_filters(spark)
    spark.read.format("shards").schema("page_id long, url string").load(folder).where("page_id > 7")

A folder holds files of one JSON object a line, plain or .gz. Plain files are cut into splits of `split_bytes` at most, a gzip
file is one. Only the fields of the schema are read from an object. Comparisons with constants and null tests are taken over by
the source and drop lines before they become rows; Spark tests all others. The folder must be one that all executors can open.
"""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

SPLIT_BYTES, BATCH_ROWS, BATCH_BYTES = 32 << 20, 4096, 8 << 20
Test = Callable[[dict[str, Any]], bool]


@dataclass
class Split(InputPartition):
    """The lines of a file that begin at byte `start` or after, and before `end`."""

    path: str
    start: int
    end: int


def test_of(f: Filter) -> Test | None:
    """What a filter asks of an object; None if the source does not know it. A null never satisfies a comparison."""
    if isinstance(f, Not):
        inner = test_of(f.child)
        known = isinstance(f.child, (EqualTo, In))
        return (lambda row: row.get(f.child.attribute[0]) is not None and not inner(row)) if inner and known and len(f.child.attribute) == 1 else None
    if len(getattr(f, "attribute", ())) != 1:
        return None
    name = f.attribute[0]
    simple: dict[type, Callable[[Any], bool]] = {IsNull: lambda v: v is None, IsNotNull: lambda v: v is not None}
    if type(f) in simple:
        return lambda row: simple[type(f)](row.get(name))
    if isinstance(f, In):
        return lambda row: row.get(name) in f.value and row.get(name) is not None
    want = f.value
    compare: dict[type, Callable[[Any], bool]] = {
        EqualTo: lambda v: v == want,
        EqualNullSafe: lambda v: v == want,
        GreaterThan: lambda v: v > want,
        GreaterThanOrEqual: lambda v: v >= want,
        LessThan: lambda v: v < want,
        LessThanOrEqual: lambda v: v <= want,
        StringStartsWith: lambda v: v.startswith(want),
        StringEndsWith: lambda v: v.endswith(want),
        StringContains: lambda v: want in v,
    }
    test = compare.get(type(f))
    if test is None or not isinstance(want, (int, float, str, bool)):  # dates and decimals are text in a line
        return None
    return lambda row: row.get(name) is not None and test(row[name])


class ShardReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.options = schema, options
        self.tests: list[Test] = []
        self.taken: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 - name of the interface
        plain = {f.name: f.dataType.simpleString() for f in self.fields}
        for f in filters:
            name = getattr(getattr(f, "child", f), "attribute", ("",))[0]
            test = test_of(f) if plain.get(name) in ("bigint", "int", "string", "boolean", "double") else None
            if test is None:
                yield f
            else:
                self.tests.append(test)
                self.taken.append(repr(f))

    def partitions(self) -> list[InputPartition]:
        """Splits in the order of the files' names. Only names and sizes are read here."""
        folder, size = self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES))
        folder = folder.removeprefix("file:")
        names = sorted(n for n in os.listdir(folder) if n[0] not in "._") if os.path.isdir(folder) else [""]
        out: list[InputPartition] = []
        for n in names:
            path = os.path.join(folder, n) if n else folder
            length = os.path.getsize(path)
            step = max(length, 1) if path.endswith(".gz") else size
            out += [Split(path, at, min(at + step, length)) for at in range(0, length, step)]
        return out

    def lines(self, split: Split) -> Iterator[bytes]:
        if split.path.endswith(".gz"):
            with gzip.open(split.path, "rb") as file:
                yield from file
            return
        with open(split.path, "rb") as file:
            if split.start:
                file.seek(split.start - 1)
                file.readline()  # the rest of a line that began before
            while file.tell() < split.end:
                yield file.readline()

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.fields)
        rows: list[dict[str, Any]] = []
        size = 0
        for line in self.lines(partition):
            if not line.strip():
                continue
            found = json.loads(line)
            if all(t(found) for t in self.tests):
                rows.append({n: found.get(n) for n in schema.names})
                size += len(line)
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> str:
        raise ValueError("name the fields to read: spark.read.format('shards').schema(...)")

    def reader(self, schema: StructType) -> DataSourceReader:
        return ShardReader(schema, dict(self.options))


def with_filters(spark: SparkSession) -> None:
    """Register the source and let Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Shards)
