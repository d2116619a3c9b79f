"""Methods of the expression language that queries call: String, Math, dates, Optional, List, Set and Map, as Column builders.

call("substring", s, 1, 3) is s.substring(1, 3): the scope comes first, arguments may be values or Columns, positions count
from 0. A null scope or argument gives null, where the language would fail. The list is closed; another name is an error.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from declq.functions import scalar
from declq.plans.catalog import ConversionError


def _substring(s: Column, begin: Column, end: Column | None = None) -> Column:
    size = F.length(s) if end is None else end
    return F.when((begin >= 0) & (size <= F.length(s)) & (begin <= size), F.substring(s, begin + 1, size - begin))


def _same(s: Column, other: Column) -> Column:
    return F.coalesce(s == other, F.lit(False))


STRING: dict[str, Callable[..., Column]] = {
    "length": F.length,
    "toUpperCase": F.upper,
    "toLowerCase": F.lower,
    "trim": F.trim,
    "isEmpty": lambda s: F.length(s) == 0,
    "isBlank": lambda s: F.length(F.trim(s)) == 0,
    "equals": _same,
    "equalsIgnoreCase": lambda s, x: _same(F.lower(s), F.lower(x)),
    "contains": lambda s, x: F.contains(s, x),
    "startsWith": lambda s, x: F.startswith(s, x),
    "endsWith": lambda s, x: F.endswith(s, x),
    "indexOf": lambda s, x: F.position(x, s) - 1,
    "charAt": lambda s, i: _substring(s, i, i + 1),
    "substring": _substring,
    "concat": F.concat,
    "replace": lambda s, a, b: F.replace(s, a, b),
    "repeat": lambda s, n: F.repeat(s, n),
    "valueOf": lambda x: scalar.concat(x),
}
MATH: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "max": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
    "min": lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
    "pow": lambda a, b: F.pow(a.cast("double"), b.cast("double")),
    "sqrt": F.sqrt,
    "floor": lambda a: F.floor(a).cast("double"),
    "ceil": lambda a: F.ceil(a).cast("double"),
    "round": lambda a: F.floor(a + F.lit(0.5)).cast("bigint"),
    "signum": F.signum,
}
DATE: dict[str, Callable[..., Column]] = {
    "of": lambda y, m, d: F.make_date(y, m, d),
    "plusDays": lambda d, n: F.date_add(F.to_date(d), n),
    "minusDays": lambda d, n: F.date_sub(F.to_date(d), n),
    "plusMonths": lambda d, n: F.add_months(F.to_date(d), n),
    "getYear": F.year,
    "getMonthValue": F.month,
    "getDayOfMonth": F.dayofmonth,
    "isBefore": lambda a, b: a < b,
    "isAfter": lambda a, b: a > b,
}
#: An Optional is a value that may be null.
OPTIONAL: dict[str, Callable[..., Column]] = {
    "isPresent": lambda x: x.isNotNull(),
    "isEmpty": lambda x: x.isNull(),
    "orElse": lambda x, other: F.coalesce(x, other),
}
#: Lists are arrays and are never changed: what adds or removes gives the new list. A position outside the list gives null.
LIST: dict[str, Callable[..., Column]] = {
    "size": F.size,
    "isEmpty": lambda x: F.size(x) == 0,
    "get": lambda x, i: F.get(x, i),
    "getFirst": lambda x: F.get(x, F.lit(0)),
    "getLast": lambda x: F.get(x, F.size(x) - 1),
    "contains": lambda x, v: F.coalesce(F.exists(x, lambda y: y.eqNullSafe(v)), F.lit(False)),
    "containsAll": lambda x, y: F.size(F.array_except(y, x)) == 0,
    "indexOf": lambda x, v: F.coalesce(F.array_position(x, v), F.lit(0)) - 1,
    "lastIndexOf": lambda x, v: F.when(F.array_contains(x, v), F.size(x) - F.array_position(F.reverse(x), v)).otherwise(F.lit(-1)),
    "subList": lambda x, begin, end: F.when((begin >= 0) & (begin <= end) & (end <= F.size(x)), F.slice(x, begin + 1, end - begin)),
    "add": lambda x, v: F.concat(x, F.array(v)),
    "addAll": lambda x, y: F.concat(x, y),
    "removeAll": lambda x, y: F.filter(x, lambda v: ~F.coalesce(F.array_contains(y, v), F.lit(False))),
    "reversed": F.reverse,
}
#: Maps likewise; a key that is missing gives null.
MAP: dict[str, Callable[..., Column]] = {
    "size": F.size,
    "isEmpty": lambda m: F.size(m) == 0,
    "get": lambda m, k: F.try_element_at(m, k),
    "getOrDefault": lambda m, k, other: F.when(F.map_contains_key(m, k), F.try_element_at(m, k)).otherwise(other),
    "containsKey": lambda m, k: F.map_contains_key(m, k),
    "containsValue": lambda m, v: F.exists(F.map_values(m), lambda x: x.eqNullSafe(v)),
    "keySet": F.map_keys,
    "values": F.map_values,
    "put": lambda m, k, v: F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v)),
    "remove": lambda m, k: F.map_filter(m, lambda x, _: x != k),
}
KINDS = {"String": STRING, "Math": MATH, "LocalDate": DATE, "Optional": OPTIONAL, "List": LIST, "Set": LIST, "Map": MAP}


def call(kind: str, name: str, *args: Any) -> Column:
    """kind.name of the scope and its arguments."""
    if kind not in KINDS or name not in KINDS[kind]:
        raise ConversionError("UNSUPPORTED_CONSTRUCT", f"{kind}.{name}")
    return KINDS[kind][name](*[a if isinstance(a, Column) else F.lit(a) for a in args])
