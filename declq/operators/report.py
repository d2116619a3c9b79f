"""Processing report: a roll-up of classes and their methods, its JSON, and the greatest version of a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_report(methods: DataFrame) -> DataFrame:
    """(class, status, methods array): from (class, class_status, method, status, tests)."""
    cells = F.sort_array(F.collect_list(F.struct("method", "status", "tests")))
    return methods.groupBy("class").agg(F.max("class_status").alias("status"), cells.alias("methods"))


def summary(report: DataFrame) -> DataFrame:
    """One row. A class counts as skipped or failed if it, or any of its methods, is."""
    is_or_has = lambda s: (F.col("status") == s) | F.exists("methods", lambda m: m["status"] == s)
    n_of = lambda s: F.coalesce(F.sum(F.size(F.filter("methods", lambda m: m["status"] == s))), F.lit(0)).cast("long")
    tests = F.aggregate("methods", F.lit(0).cast("long"), lambda a, m: a + m["tests"])
    return report.agg(
        F.count(F.lit(1)).alias("classes"),
        F.count_if(is_or_has("SKIPPED")).alias("classes_skipped"),
        F.count_if(is_or_has("FAILED")).alias("classes_failed"),
        F.coalesce(F.sum(F.size("methods")), F.lit(0)).cast("long").alias("methods"),
        n_of("SUCCESS").alias("methods_ok"),
        n_of("SKIPPED").alias("methods_skipped"),
        n_of("FAILED").alias("methods_failed"),
        F.coalesce(F.sum(tests), F.lit(0)).alias("tests"),
    )


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))


def version_key(version: Column) -> Column:
    """Numbers of a dotted version; other parts count as 0, so that arrays compare as versions do."""
    return F.transform(F.split(version, r"[.\-]"), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def latest_version(df: DataFrame, version: str, *by: str) -> DataFrame:
    """Greatest version per group."""
    return df.groupBy(*by).agg(F.max_by(version, version_key(F.col(version))).alias("latest"))
