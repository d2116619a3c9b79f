"""Query relaxation: drop predicates on parameters until rows appear, and read values for the parameters from them."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declq.plans.catalog import Catalog, ConversionError
from declq.plans.derive import any_all, column_of, conditions, ordered
from declq.plans.methodname import Condition, parse


def relaxed(catalog: Catalog, entity_name: str, name: str, keep: Collection[str] = (), values: dict[str, Any] | None = None) -> tuple[DataFrame, list[Condition]]:
    """The query without its predicates on parameters, and the conditions dropped.

    Only a conjunction is relaxed. Kept: its conditions without arguments, those on a property in `keep` and those with a
    value in `values`; both need their arguments there (a list a property), a kept condition without any is an error.
    Alternatives (Or) are left as they are and need the arguments of all their conditions; nothing of them is dropped.
    """
    entity, method = catalog.entity(entity_name), parse(name)
    df, given = catalog.frame(entity), values or {}
    dropped: list[Condition] = []
    parts: list[tuple[Condition, ...]] = []
    for part in method.where:
        stays = [c for c in part if len(method.where) > 1 or c.n_args == 0 or c.prop in keep or c.prop in given]
        dropped += [c for c in part if c not in stays]
        parts.append(tuple(stays))
    args = {k: list(v) for k, v in given.items()}
    taken: list[Any] = []
    for c in [c for part in parts for c in part]:
        if len(args.get(c.prop, [])) < c.n_args:
            raise ConversionError("MISSING_PARAMETER", c.prop)
        taken += [args[c.prop].pop(0) for _ in range(c.n_args)]
    if not any(parts):
        return df, dropped
    return df.where(any_all(conditions(replace(method, where=tuple(parts)), entity, df, taken))), dropped


def sample_arguments(catalog: Catalog, entity_name: str, name: str, order: str, rows: int = 1, **options: Any) -> DataFrame:
    """For each dropped condition a value of its column, from the first `rows` rows of the relaxed query by property `order`."""
    found, dropped = relaxed(catalog, entity_name, name, **options)
    entity = catalog.entity(entity_name)
    columns: list[Column] = [column_of(entity, found, c.prop).alias(c.prop) for c in dropped]
    return ordered(found, [(column_of(entity, found, order), False)]).limit(rows).select(*columns)


def matching(catalog: Catalog, entity_name: str, arguments: DataFrame) -> DataFrame:
    """The entity's rows that have the values of any row of `arguments` (columns named by properties, see sample_arguments).

    The correlated look-up of later calls: one semi-join for all argument rows, nulls being equal; no row comes twice.
    """
    entity = catalog.entity(entity_name)
    rows = catalog.frame(entity)
    wanted = arguments.select(*[F.col(c).alias(f"argument {c}") for c in arguments.columns])
    on: Column = F.lit(True)
    for c in arguments.columns:
        on &= column_of(entity, rows, c).eqNullSafe(F.col(f"`argument {c}`"))
    return rows.join(wanted, on, "left_semi")


def hit_and_miss(catalog: Catalog, entity_name: str, name: str) -> DataFrame:
    """Row counts of both paths of a caller, (path, n): the relaxed query, and a contradiction that is always empty."""
    rows, _ = relaxed(catalog, entity_name, name)
    count = lambda df, path: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(path).alias("path"), "n")
    return count(rows.limit(1), "present").unionByName(count(rows.where(F.lit(False)), "empty"))
