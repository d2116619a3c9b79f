"""A parsed method name and its arguments as a DataFrame: Column expressions only, so Catalyst sees the whole plan."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declq.plans.catalog import Catalog, ConversionError, Entity
from declq.plans.methodname import Condition, Method, parse


def column_of(entity: Entity, df: DataFrame, prop: str, reached: Mapping[str, str] | None = None) -> Column:
    """The column of a property; `reached` has those of properties that relations lead to."""
    name = (reached or {}).get(prop) or entity.column(prop)
    if name not in df.columns:
        raise ConversionError("UNKNOWN_PROPERTY", f"{entity.name}.{prop} ({name})")
    return df[f"`{name}`"]


def reach(catalog: Catalog, entity: Entity, df: DataFrame, props: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with a column for each property of a related entity (customer_Name), and their names.

    A path is walked where it starts with a relation. Each step is one left join by the key that it refers to, so no row is
    repeated; steps that several properties share are joined once, and the key itself needs no join. A relation to many is
    an error.
    """
    names: dict[str, str] = {}
    joined: set[str] = set()
    for prop in dict.fromkeys(props):
        *steps, last = [x[:1].lower() + x[1:] for x in prop.split("_")]
        if not steps or steps[0] not in entity.relations:
            continue
        owner, prefix = entity, ""
        for k, step in enumerate(steps):
            relation = catalog.relation(owner, step)
            if relation.many:
                raise ConversionError("UNSUPPORTED_CONSTRUCT", f"{owner.name}.{step} leads to many")
            target = catalog.entity(relation.target)
            if k == len(steps) - 1 and target.column(last) == relation.referenced:
                names[prop] = prefix + relation.column
                break
            at = f"{prefix}{step}."
            if at not in joined:
                rows = catalog.frame(target)
                rows = rows.select(*[rows[c].alias(at + c) for c in rows.columns])
                df = df.join(rows, df[f"`{prefix}{relation.column}`"] == rows[f"`{at}{relation.referenced}`"], "left")
                joined.add(at)
            owner, prefix = target, at
        else:
            names[prop] = prefix + owner.column(last)
    return df, names


def predicate(c: Column, cond: Condition, args: list[Any], compat: bool = False) -> Column:
    """One condition. compat: contains, starts and ends are a plain LIKE of the value, and case is not ignored."""
    op = cond.op
    if op in ("null", "not_null"):
        return c.isNull() if op == "null" else c.isNotNull()
    if op in ("true", "false"):
        return c == F.lit(op == "true")
    fold = (lambda x: F.lower(x)) if cond.ignore_case and not compat else (lambda x: x)
    c = fold(c)
    if op in ("in", "not_in"):
        values = [fold(F.lit(v)) for v in args[0]]
        found = c.isin(*values) if values else F.lit(False)
        return ~found if op == "not_in" else found
    v = fold(F.lit(args[0]))
    if op in ("like", "not_like") or (compat and op in ("starts", "ends", "contains", "not_contains")):
        out = F.call_function("like", c, v)
        return ~out if op.startswith("not_") else out
    if op == "between":
        return c.between(v, fold(F.lit(args[1])))
    make = {
        "eq": lambda: c == v, "ne": lambda: c != v, "lt": lambda: c < v, "le": lambda: c <= v, "gt": lambda: c > v, "ge": lambda: c >= v,
        "starts": lambda: c.startswith(v), "ends": lambda: c.endswith(v), "contains": lambda: c.contains(v), "not_contains": lambda: ~c.contains(v),
    }
    return make[op]()


def conditions(method: Method, entity: Entity, df: DataFrame, args: list[Any], compat: bool = False, reached: Mapping[str, str] | None = None) -> list[list[Column]]:
    """The predicate of each condition, alternatives apart; arguments are taken in order and must be used up."""
    if len(args) != method.n_args:
        raise ConversionError("MISSING_PARAMETER", f"{method.n_args} arguments needed, {len(args)} given")
    rest = list(args)
    out = []
    for part in method.where:
        out.append([predicate(column_of(entity, df, c.prop, reached), c, [rest.pop(0) for _ in range(c.n_args)], compat) for c in part])
    return out


def any_all(parts: list[list[Column]]) -> Column:
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, p) for p in parts])


def ordered(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    """Nulls come last upward and first downward, as in the databases that the language was made for."""
    return df.orderBy(*[c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in keys])


def derive(catalog: Catalog, entity_name: str, name: str, *args: Any, compat: bool = False, on_error: str = "raise") -> DataFrame:
    """The rows of a derived query.

    select: the entity's columns. count: column count. exists: column exists. delete: the rows that survive. insert: the
    table and one row of nulls. on_error="log" turns a name that can't be parsed into a full scan.
    """
    entity = catalog.entity(entity_name)
    df = catalog.frame(entity)
    try:
        method = parse(name)
    except ConversionError:
        if on_error != "log":
            raise
        return df
    if method.kind == "insert":
        blank = df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        return df.unionByName(blank)
    own = df.columns
    df, reached = reach(catalog, entity, df, [c.prop for part in method.where for c in part] + [o.prop for o in method.order])
    if method.by_id:
        ids = list(args[0]) if method.by_id == "list" else [args[0]]
        key = df[entity.columns.get("id", entity.key)]
        where = key.isin(*ids) if ids else F.lit(False)
    else:
        parts = conditions(method, entity, df, list(args), compat, reached)
        where = any_all(parts) if parts else None
    if method.kind == "delete":
        return df.where(~F.coalesce(where, F.lit(False))).select(*own) if where is not None else df.limit(0).select(*own)
    out = df if where is None else df.where(where)
    if method.kind == "count":
        return out.agg(F.count(F.lit(1)).alias("count"))
    if method.kind == "exists":
        return out.limit(1).agg((F.count(F.lit(1)) > 0).alias("exists"))
    keys = [(column_of(entity, df, o.prop, reached), o.descending) for o in method.order]
    if method.distinct:
        out = out.distinct()
    if keys:
        out = ordered(out, keys)
    out = out if method.limit is None else out.limit(method.limit)
    return out.select(*own) if reached else out
