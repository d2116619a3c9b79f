"""Scalar semantics of the expression language as Column builders: null rules, truthiness, integer arithmetic, comparison."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numeric types from narrow to wide (fixed order).
WIDTHS = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def literal(value: Any, type_name: str | None = None) -> Column:
    """Bool, int, long, double, string, date or null; a null takes `type_name`."""
    c = F.lit(value)
    return c.cast(type_name) if type_name else c


def widest(*types: str) -> str:
    return max(types, key=WIDTHS.index)


def arith(op: str, a: Column, b: Column, types: tuple[str, str]) -> Column:
    """+ - * / % in the wider type; integer / and % truncate toward zero; a zero divisor gives null (no error in ANSI mode).

    The types must be those of the columns (see arith_in, which takes them from a frame).
    """
    to = widest(*types)
    a, b = a.cast(to), b.cast(to)
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op].cast(to)
    if op == "%":
        return F.try_mod(a, b).cast(to)
    if to in ("float", "double"):
        return F.try_divide(a, b).cast(to)
    whole = F.try_divide((a - F.try_mod(a, b)).cast("decimal(20,0)"), b.cast("decimal(20,0)"))  # exact for longs too
    return whole.cast(to)


def types_in(df: DataFrame, *columns: Column) -> tuple[str, ...]:
    """Names of the columns' types; one that is no number is an error."""
    kinds = [f.dataType for f in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).schema.fields]
    for k in kinds:
        if not isinstance(k, (T.NumericType, T.NullType)):
            raise TypeError(f"a number is needed, not {k.simpleString()}")
    return tuple("int" if isinstance(k, T.NullType) else "double" if isinstance(k, T.DecimalType) else k.simpleString() for k in kinds)


def arith_in(df: DataFrame, op: str, a: Column, b: Column) -> Column:
    """arith with the types that the columns have in `df`."""
    return arith(op, a, b, types_in(df, a, b))  # type: ignore[arg-type]


def exact_in(df: DataFrame, op: str, a: Column, b: Column) -> Column:
    """+ - * of whole numbers that never overflow: bigint where every result in `df` fits it, else decimal(38,0) for all of them.

    One pass over `df` for the least and the greatest result decides; 38 digits hold what any two longs give.
    """
    x, y = (c.cast("bigint").cast("decimal(19,0)") for c in (a, b))
    out = {"+": x + y, "-": x - y, "*": x * y}[op].cast("decimal(38,0)")
    ends = [v for v in df.agg(F.min(out), F.max(out)).first() if v is not None]
    return out.cast("bigint") if all(-(2**63) <= v < 2**63 for v in ends) else out


def minus(c: Column) -> Column:
    """Unary minus; the least integer has no negative and gives null."""
    return F.try_subtract(F.lit(0), c)


def ordered_in(df: DataFrame, op: str, a: Column, b: Column) -> Column:
    """< <= > >= of numbers; another type is an error, null is false."""
    types_in(df, a, b)
    return F.coalesce({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], F.lit(False))


def instance_of(c: Column, kind: str) -> Column:
    """Whether a value that is not null has this Spark type."""
    return c.isNotNull() & (F.typeof(c) == kind)


def saturate(c: Column, to: str = "int") -> Column:
    """Narrowing as the reference language does it: NaN is 0, out of range is the nearest bound."""
    low, high = {"int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}[to]
    bound = lambda v: F.lit(v).cast(to)
    return F.when(F.isnan(c), bound(0)).when(c >= float(high), bound(high)).when(c <= float(low), bound(low)).otherwise(c.try_cast(to))


def concat(*parts: Column) -> Column:
    """String +: a null prints as 'null'."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])


def equal(a: Column, b: Column) -> Column:
    """== : null equals null, and nothing else."""
    return a.eqNullSafe(b)


def not_equal(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; both null is 0, one null is null."""
    return F.when(a.isNull() & b.isNull(), F.lit(0)).when(a < b, F.lit(-1)).when(a > b, F.lit(1)).when(a == b, F.lit(0))


def truthy(c: Column) -> Column:
    """A null condition is false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def both(a: Column, b: Column) -> Column:
    return truthy(a) & truthy(b)


def either(a: Column, b: Column) -> Column:
    return truthy(a) | truthy(b)


def negate(c: Column) -> Column:
    return ~truthy(c)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def choose(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(truthy(condition), yes).otherwise(no)


def item(array: Column, index: int | Column) -> Column:
    """Array access counted from 0; out of range is null."""
    return F.get(array, F.lit(index) if isinstance(index, int) else index)


def is_empty(c: Column, kind: str) -> Column:
    """Strings, arrays and maps; null is empty."""
    return F.coalesce(F.length(c) == 0 if kind == "string" else F.size(c) == 0, F.lit(True))


def parses_as(c: Column, to: str) -> Column:
    """Whether a text reads as a value of type `to`."""
    return c.try_cast(to).isNotNull()


def default_value(kind: T.DataType) -> Column:
    """What a variable of this type holds before it is set."""
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def sample_value(kind: T.DataType) -> Any:
    """A value that differs from the default, per type."""
    table: list[tuple[type, Any]] = [
        (T.BooleanType, True), (T.StringType, "sample"), (T.DecimalType, Decimal(1)), (T.FractionalType, 1.0),
        (T.IntegralType, 1), (T.DateType, date(2024, 1, 1)), (T.TimestampType, datetime(2024, 1, 1)),
    ]
    return next((v for k, v in table if isinstance(kind, k)), None)
