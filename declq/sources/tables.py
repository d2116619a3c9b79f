"""Sources and sinks: Parquet folders as catalogs, JDBC where a driver is there, display, entity rows and writes."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from declq.plans.catalog import Catalog, ConversionError, Entity
from declq.plans.params import bind


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def parquet_catalog(spark: SparkSession, folder: str, entities: list[Entity]) -> Catalog:
    return Catalog(entities, lambda table: parquet(spark, folder, table))


def jdbc(spark: SparkSession, url: str, table: str, schema: str | None = None, **options: str) -> DataFrame:
    """A table over JDBC; partitioning options pass through, so that reads are split and predicates pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=f"{schema}.{table}" if schema else table, **options).load()


def _literal(value: Any) -> str:
    """A bound value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S}'"
    if isinstance(value, date):
        return f"DATE '{value:%Y-%m-%d}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    raise ConversionError("UNSUPPORTED_CONSTRUCT", f"a parameter of type {type(value).__name__}")


def prepared(sql: str, args: list[Any] | Mapping[str, Any] | None = None) -> str:
    """A SELECT with its parameters as literals, for a reader that can't bind. Any other statement is an error."""
    if not re.match(r"\s*(select|with)\b", sql, re.I):
        raise ConversionError("UNSUPPORTED_CONSTRUCT", sql.split()[0] if sql.split() else "nothing")
    text, values = bind(sql.strip().rstrip(";"), args if args is not None else {})
    if "<=>" in text:
        raise ConversionError("UNSUPPORTED_CONSTRUCT", "NOT IN of an empty list")
    return re.sub(r"('(?:[^']|'')*')|:([A-Za-z_]\w*)", lambda m: m[1] or _literal(values[m[2]]), text)


def jdbc_query(spark: SparkSession, database: Mapping[str, Any], sql: str, args: list[Any] | Mapping[str, Any] | None = None) -> DataFrame | None:
    """The rows of a prepared SELECT on the database of the settings (url, user, password, schema, driver, run_queries).

    The database runs the query; a schema is entered when the session opens. Without run_queries nothing runs: None.
    """
    if not database.get("run_queries"):
        return None
    options = {k: str(database[k]) for k in ("url", "user", "password", "driver") if database.get(k)}
    if database.get("schema"):
        switch = "ALTER SESSION SET CURRENT_SCHEMA =" if "oracle" in options["url"] else "SET SCHEMA"
        options["sessionInitStatement"] = f"{switch} {database['schema']}"
    return spark.read.format("jdbc").options(query=prepared(sql, args), **options).load()


def head(df: DataFrame, n: int = 10) -> str:
    """Header and the first rows, tab separated: a display of at most n rows."""
    lines = ["\t".join(df.columns)] + ["\t".join(str(v) for v in row) for row in df.limit(n).collect()]
    return "\n".join(lines)


def entity_rows(df: DataFrame, entity: Entity, n: int | None = None) -> DataFrame:
    """Rows under the property names of an entity."""
    out = df.select(*[df[c].alias(p) for p, c in entity.columns.items() if c in df.columns])
    return out if n is None else out.limit(n)


def optional(df: DataFrame) -> DataFrame:
    """First column of one row, or no row."""
    return df.select(df.columns[0]).limit(1)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def is_write(method: str) -> bool:
    """Names that change data."""
    return any(word in method.lower() for word in ("save", "delete", "update", "remove"))


def cached(df: DataFrame, cache: dict[Any, DataFrame], key: Any, most: int = 16) -> DataFrame:
    """The frame under `key`, cached on first use. Of more than `most` frames the one that was not asked for longest is given up."""
    cache[key] = cache.pop(key) if key in cache else df.cache()  # the latest is last
    while len(cache) > most:
        cache.pop(next(iter(cache))).unpersist()
    return cache[key]


def register_views(spark: SparkSession, folder: str, names: list[str] | Mapping[str, str]) -> None:
    for name in names:
        parquet(spark, folder, name).createOrReplaceTempView(name)
