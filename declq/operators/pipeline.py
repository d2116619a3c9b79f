"""Ordered collection pipelines (filter, map, flatMap, takeWhile, collectors, numeric streams) as DataFrame plans.

A Pipeline is a frame with a value column and an order key that is unique and stands for the encounter order. Functions take
and return Columns, so stages stay in one plan and run lazily; only an ordered fold needs all values in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from declq.checkpoint import cut
from declq.operators.ranges import number_rows

#: Values or partial results that a fold with a combiner holds in one row; distinct values that a comparator sorts in one row; values
#: that are sampled for each splitter.
FOLD, BUCKET, OVERSAMPLED = 4096, 4096, 8
Fn = Callable[[Column], Column]
_REGISTRY: dict[str, Callable[..., Any]] = {}


def register(name: str, operation: Callable[..., Any]) -> None:
    """Add an operation, called as pipeline.apply(name, ...) with the pipeline first."""
    _REGISTRY[name] = operation


def _true(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def _call(f: Callable[..., Any], *args: Column) -> Column:
    """The Column that a stage's function gives; anything else is a wrong kind of function."""
    if not callable(f):
        raise TypeError(f"a function is needed, not {f!r}")
    out = f(*args)
    if not isinstance(out, Column):
        raise TypeError(f"the function of a stage gives a Column, not {out!r}")
    return out


def _backward(c: Column, kind: T.DataType) -> Column:
    """A value whose ascending order is the descending order of `c`, for every type that has an order. Nulls stay first."""
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(c)  # the negative would overflow at the least value
    if isinstance(kind, T.NumericType):
        return -c
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, T.DateType):
        return F.bitwise_not(F.unix_date(c))
    if isinstance(kind, T.TimestampType):
        return F.bitwise_not(F.unix_micros(c))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        # Bytes as digits, each turned round, and an end above all digits: a longer text comes before its own beginning.
        return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    raise TypeError(f"no descending order of {kind.simpleString()}")


class Pipeline:
    V, K = "value", "key"

    def __init__(self, df: DataFrame, value: Column | str, key: list[Column | str] | Column | str):
        keys = key if isinstance(key, list) else [key]
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        one = as_column(keys[0]) if len(keys) == 1 else F.struct(*map(as_column, keys))
        self.df = df.select(as_column(value).alias(self.V), one.alias(self.K))
        self.kind: str | None = None

    def _of(self, df: DataFrame, kind: str | None = None) -> Pipeline:
        """The next stage. kind: the type of a primitive stream, which its maps narrow to; other streams have none."""
        out = object.__new__(type(self))
        out.df = df.select(self.V, self.K)
        out.kind = kind or self.kind
        return out

    @classmethod
    def range(cls, spark: SparkSession, start: int, end: int) -> Pipeline:
        return cls(spark.range(start, end), F.col("id").cast("int"), F.col("id")).cast("int")

    @property
    def v(self) -> Column:
        return F.col(self.V)

    def apply(self, name: str, *args: Any) -> Any:
        if name not in _REGISTRY:
            raise KeyError(f"no operation {name}")
        return _REGISTRY[name](self, *args)

    # stages
    def _test(self, p: Fn) -> Column:
        """A predicate as a condition; null is false, and a Column of another type than boolean is an error."""
        c = _call(p, self.v)
        kind = self.df.select(c).schema[0].dataType
        if not isinstance(kind, (T.BooleanType, T.NullType)):
            raise TypeError(f"a predicate is boolean, not {kind.simpleString()}")
        return _true(c)

    def filter(self, p: Fn) -> Pipeline:
        return self._of(self.df.where(self._test(p)))

    def map(self, f: Fn) -> Pipeline:
        """On a primitive stream (see cast) the result is narrowed to the stream's own type."""
        c = _call(f, self.v)
        return self._of(self.df.withColumn(self.V, c.cast(self.kind) if self.kind else c))

    def map_to_obj(self, f: Fn) -> Pipeline:
        """From a primitive stream to one of any values."""
        return self.boxed().map(f)

    def flat_map(self, f: Fn) -> Pipeline:
        """f gives an array; its elements follow each other at the place of the value. Nulls and empty arrays vanish."""
        return self._of(self.df.select(F.col(self.K).alias("k0"), F.posexplode(_call(f, self.v)).alias("pos", self.V)).withColumn(self.K, F.struct("k0", "pos")))

    def _first_failure(self, p: Fn) -> DataFrame:
        """One row: the least key that fails, null if none does. A map-side minimum, not a window over everything."""
        return self.df.where(~self._test(p)).agg(F.min(self.K).alias("stop"))

    def take_while(self, p: Fn) -> Pipeline:
        return self._of(self.df.join(F.broadcast(self._first_failure(p)), F.col("stop").isNull() | (F.col(self.K) < F.col("stop"))))

    def drop_while(self, p: Fn) -> Pipeline:
        return self._of(self.df.join(F.broadcast(self._first_failure(p)), F.col(self.K) >= F.col("stop")))

    def peek(self, name: str, *metrics: Column) -> Pipeline:
        """Observes metrics of the rows that pass; the rows are unchanged."""
        return self._of(self.df.observe(name, *(metrics or (F.count(F.lit(1)).alias("n"),))))

    def distinct(self) -> Pipeline:
        """Keeps the first of equal values."""
        return self._of(self.df.groupBy(self.V).agg(F.min(self.K).alias(self.K)))

    def sorted(self, key: Fn | None = None, descending: bool = False) -> Pipeline:
        """Stable: equal sort keys keep their order. The new order key is (sort key, old key)."""
        by = _call(key, self.v) if key else self.v
        if descending:
            by = _backward(by, self.df.select(by).schema[0].dataType)
        return self._of(self.df.withColumn(self.K, F.struct(by.alias("by"), F.col(self.K).alias("then"))))

    def sorted_with(self, compare: Callable[[Column, Column], Column], per_bucket: int = BUCKET) -> Pipeline:
        """Stable order of any comparator: compare(a, b) is a number, below, equal to or above 0.

        A comparator has no sort key, so the values are dealt by it: about one value in `per_bucket`, sorted with it, are
        splitters; a value goes behind all splitters that are not above it, and each bucket is sorted with the comparator. A
        bucket is one row of about `per_bucket` values, equal values counted together. Values may not be null.
        """
        kinds = self.df.groupBy(self.V).agg(F.count(F.lit(1)).alias("n")).select(self.V)
        kinds = cut(kinds)
        total = kinds.count()
        share = min(OVERSAMPLED * (total // per_bucket) / max(total, 1), 1.0)
        sign = lambda a, b: F.when(_call(compare, a, b) < 0, -1).when(compare(a, b) > 0, 1).otherwise(0)
        some = kinds.sample(share, seed=1) if share else kinds.where(F.lit(False))
        ranked = cut(some.agg(F.array_sort(F.collect_list(self.V), sign).alias("all")))
        splitters = ranked.select(F.filter("all", lambda x, i: i % OVERSAMPLED == OVERSAMPLED - 1)).scalar()
        bucket = F.size(F.filter(F.col("_splitters"), lambda s: sign(s, self.v) <= 0))
        buckets = kinds.withColumn("_splitters", splitters).select(self.V, bucket.alias("bucket")).groupBy("bucket").agg(F.array_sort(F.collect_list(self.V), sign).alias("all"))
        # Values that compare as equal share a rank, so that their old order decides.
        step = lambda a, x: F.struct(F.array_append(a["ranks"], F.when(F.size(a["ranks"]) == 0, 0).otherwise(F.element_at(a["ranks"], -1) + F.when(sign(a["last"], x) == 0, 0).otherwise(1))).alias("ranks"), x.alias("last"))
        ranks = F.aggregate("all", F.struct(F.array().cast("array<int>").alias("ranks"), F.get("all", F.lit(0)).alias("last")), step)["ranks"]
        placed = buckets.select("bucket", F.explode(F.arrays_zip(F.col("all"), ranks.alias("ranks"))).alias("x")).select(F.col("x.all").alias("_of"), F.struct("bucket", F.col("x.ranks").alias("rank")).alias("by"))
        joined = self.df.join(placed, self.v == F.col("_of"))
        return self._of(joined.withColumn(self.K, F.struct("by", F.col(self.K).alias("then"))))

    def limit(self, n: int) -> Pipeline:
        return self._of(self.df.orderBy(self.K).limit(n))

    def skip(self, n: int) -> Pipeline:
        """Rows above the n-th key. The first n keys are sorted apart, so n should be small against all rows."""
        if n <= 0:
            return self
        last = self.df.select(F.col(self.K).alias("k")).orderBy("k").limit(n).agg(F.max("k").alias("stop"), F.count(F.lit(1)).alias("skipped"))
        return self._of(self.df.join(F.broadcast(last), (F.col("skipped") == n) & (F.col(self.K) > F.col("stop"))))

    def cast(self, to: str) -> Pipeline:
        """mapToInt, mapToLong, mapToDouble, asLongStream, asDoubleStream: floating values narrow toward zero and saturate."""
        kind = self.df.schema[self.V].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)) and to in ("int", "bigint"):
            from declq.functions.scalar import saturate

            return self._of(self.df.withColumn(self.V, saturate(self.v, to)), to)
        return self._of(self.df.withColumn(self.V, self.v.cast(to)), to)

    def boxed(self) -> Pipeline:
        """The values as a stream that maps to any type."""
        out = self._of(self.df)
        out.kind = None
        return out

    # results: one-row or grouped frames
    def rows(self) -> DataFrame:
        return self.df.orderBy(self.K).select(self.V)

    def for_each(self, f: Callable[[Any], None]) -> None:
        """Calls f on the executors with every value, in no order; a row at a time, as f is any Python function."""
        self.df.select(self.V).foreach(lambda r: f(r[0]))

    def _agg(self, **columns: Column) -> DataFrame:
        return self.df.agg(*[c.alias(n) for n, c in columns.items()])

    def count(self) -> DataFrame:
        return self._agg(count=F.count(F.lit(1)))

    def to_list(self) -> DataFrame:
        """One row with all values in order: for small results."""
        pairs = F.sort_array(F.collect_list(F.struct(F.col(self.K).alias("k"), F.col(self.V).alias("v"))))
        return self._agg(list=F.transform(pairs, lambda x: x["v"]))

    def to_set(self) -> DataFrame:
        return self._agg(set=F.sort_array(F.collect_set(self.V)))

    def find_first(self) -> DataFrame:
        return self.df.orderBy(self.K).limit(1).select(self.V)

    find_any = find_first

    def any_match(self, p: Fn) -> DataFrame:
        return self._agg(any=F.coalesce(F.bool_or(self._test(p)), F.lit(False)))

    def all_match(self, p: Fn) -> DataFrame:
        return self._agg(all=F.coalesce(F.bool_and(self._test(p)), F.lit(True)))

    def none_match(self, p: Fn) -> DataFrame:
        return self._agg(none=F.coalesce(F.bool_and(~self._test(p)), F.lit(True)))

    def min(self, key: Fn | None = None) -> DataFrame:
        """The first of the least; null of nothing."""
        by = F.struct((key or (lambda x: x))(self.v).alias("by"), F.col(self.K).alias("then"))
        return self._agg(min=F.min_by(self.v, by))

    def max(self, key: Fn | None = None) -> DataFrame:
        return self._agg(max=F.max_by(self.v, F.struct((key or (lambda x: x))(self.v).alias("by"), F.col(self.K).alias("then"))))

    def reduce(self, op: Callable[[Column, Column], Column], identity: Any = None, combine: Callable[[Column, Column], Column] | None = None, finish: Fn | None = None) -> DataFrame:
        """Ordered fold. Without identity an empty input is null.

        With `combine`, which joins two partial results (op itself if it is associative), stretches of FOLD values are folded
        apart, and FOLD partial results at a time until one is left: no row holds more than FOLD. Without it any operation is
        right, but all values meet in one row. `finish` is applied to the result. A combiner needs an identity.
        """
        if combine is not None and identity is None:
            raise TypeError("reduce with a combiner needs an identity")
        kind = self.df.schema[self.V].dataType
        if combine is not None:
            folded = self._tree(op, identity, combine)
            return folded.select((finish(F.col("v")) if finish else F.col("v")).alias("reduced"))
        values = self.to_list().select(F.col("list"))
        if identity is None:
            folded = F.aggregate(F.slice("list", F.lit(2), F.greatest(F.size("list") - 1, F.lit(0))), F.get("list", F.lit(0)), lambda a, x: op(a, x).cast(kind))
        else:
            folded = F.aggregate("list", F.lit(identity), lambda a, x: op(a, x))
        return values.select((finish(folded) if finish else folded).alias("reduced"))

    def _tree(self, op: Callable[[Column, Column], Column], identity: Any, combine: Callable[[Column, Column], Column]) -> DataFrame:
        """(v): the fold of all values, one row, also of none. Values are numbered over ranges of the order, never in one task."""
        start = identity if isinstance(identity, Column) else F.lit(identity)
        ordered = F.sort_array(F.collect_list(F.struct("at", "v")))
        level = lambda at: F.floor((F.col(at) - 1) / FOLD) + 1
        numbered = number_rows(self.df.select(F.col(self.V).alias("v"), F.col(self.K).alias("k")), [], ["k"])
        parts = numbered.withColumn("at", F.col("number")).groupBy(level("number").alias("place")).agg(F.aggregate(ordered, start, lambda a, x: op(a, x["v"])).alias("v"))
        left = self.df.count()
        while left > FOLD:
            left = -(-left // FOLD)
            parts = parts.withColumnRenamed("place", "at").groupBy(level("at").alias("place")).agg(F.aggregate(ordered, start, lambda a, x: combine(a, x["v"])).alias("v"))
        last = parts.withColumnRenamed("place", "at").agg(ordered.alias("list"))
        return last.select(F.aggregate("list", start, lambda a, x: combine(a, x["v"])).alias("v"))

    def collect(self, supplier: Column, accumulator: Callable[[Column, Column], Column], combiner: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """Any ordered accumulation. With a combiner of two states as in reduce; without one all values meet in one row."""
        if combiner is not None:
            return self._tree(accumulator, supplier, combiner).select(F.col("v").alias("collected"))
        return self.to_list().select(F.aggregate("list", supplier, accumulator).alias("collected"))

    def listed(self) -> DataFrame:
        """(place, value): the list as rows, places from 0 in order. No task holds all of them."""
        return number_rows(self.df, [], [self.K]).select((F.col("number") - 1).alias("place"), self.V)

    def grouped(self, key: Fn) -> DataFrame:
        """(group, place, value): the lists of group_by as rows; no task holds a group."""
        rows = self.df.withColumn("group", _call(key, self.v))
        return number_rows(rows, ["group"], [self.K]).select("group", (F.col("number") - 1).alias("place"), self.V)

    def group_by(self, key: Fn) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct(F.col(self.K).alias("k"), F.col(self.V).alias("v"))))
        return self.df.groupBy(key(self.v).alias("group")).agg(F.transform(pairs, lambda x: x["v"]).alias("values"))

    def group_count(self, key: Fn) -> DataFrame:
        return self.df.groupBy(key(self.v).alias("group")).agg(F.count(F.lit(1)).alias("count"))

    def partition_by(self, p: Fn) -> DataFrame:
        """Counts for true and for false, both always present."""
        hit = self._test(p).cast("int")
        sides = F.array(F.struct(F.lit(False).alias("side"), (F.count(F.lit(1)) - F.coalesce(F.sum(hit), F.lit(0))).alias("count")), F.struct(F.lit(True).alias("side"), F.coalesce(F.sum(hit), F.lit(0)).alias("count")))
        return self._agg(sides=sides).select(F.inline("sides"))

    def partition_lists(self, p: Fn) -> DataFrame:
        """(side, values): the values for true and for false in order, both sides always present."""
        pairs = F.sort_array(F.collect_list(F.struct(F.col(self.K).alias("k"), F.col(self.V).alias("v"))))
        lists = self.df.groupBy(self._test(p).alias("s")).agg(F.transform(pairs, lambda x: x["v"]).alias("values"))
        sides = self.df.sparkSession.createDataFrame([(False,), (True,)], "side boolean")
        none = F.array().cast(T.ArrayType(self.df.schema[self.V].dataType))
        return sides.join(lists, F.col("side") == F.col("s"), "left").select("side", F.coalesce("values", none).alias("values"))

    # numeric streams
    def sum(self) -> DataFrame:
        return self._agg(sum=F.coalesce(F.sum(self.v), F.lit(0)))

    def average(self) -> DataFrame:
        return self._agg(average=F.avg(self.v))

    def summary(self) -> DataFrame:
        return self._agg(count=F.count(self.V), sum=F.coalesce(F.sum(self.v), F.lit(0)), min=F.min(self.V), max=F.max(self.V), average=F.avg(self.v))
