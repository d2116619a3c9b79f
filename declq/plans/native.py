"""Native SQL: telling it from object queries, cleaning its text, running it with bound values."""

from __future__ import annotations

import logging
import re
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from declq.plans.catalog import ConversionError
from declq.plans.params import bind

#: Fixed patterns of either kind; those of object queries are asked first.
OBJECT_MARKS = [r"\bNEW\s+[\w.]+\s*\(", r"\bJOIN\s+(?:FETCH\s+)?[a-z]\w*\.[a-z]", r":#\{", r"\bFROM\s+[A-Z]\w*[a-z]\w*(?:\s+(?:AS\s+)?[a-z]\w*)?\s*(?:$|\b(?:WHERE|JOIN|LEFT|INNER|GROUP|ORDER)\b)"]
NATIVE_MARKS = [r"\bCOUNT\s*\(\s*\*\s*\)", r"\bFROM\s*\(\s*SELECT\b", r"\bFROM\s+[a-z]+(?:_[a-z0-9]+)+\b.*\bJOIN\s+[a-z]+(?:_[a-z0-9]+)+\b", r"[\"`]\w+[\"`]"]


def is_native(text: str) -> bool:
    """True if only marks of native SQL are found (tables in snake case count in FROM and JOIN together only); words are matched in any case, names as written."""
    words = re.sub(r"\b(select|from|join|where|left|inner|group|order|new|as|count|fetch)\b", lambda m: m[0].upper(), text, flags=re.I)
    return not any(re.search(p, words) for p in OBJECT_MARKS) and any(re.search(p, words, re.S) for p in NATIVE_MARKS)


def clean(text: str) -> str:
    """Text of a source literal: escapes resolved, continuation lines joined, quotes around names and a last semicolon dropped."""
    text = text.replace("\\\n", " ").replace("\\n", " ").replace("\\t", " ").replace('\\"', '"')
    return re.sub(r"\s+", " ", text.replace('"', "")).strip().rstrip(";").strip()


def run(spark: SparkSession, text: str, args: list[Any] | dict[str, Any] | None = None, on_error: str = "raise") -> DataFrame | None:
    """The rows of a native query. on_error="log" skips one whose parameters or text can't be used: it is logged and gives None."""
    try:
        sql, values = bind(clean(text), args if args is not None else {})
        return spark.sql(sql, values)
    except (ConversionError, AnalysisException) as e:  # a ParseException is an AnalysisException
        if on_error != "log":
            raise
        logging.getLogger(__name__).warning("query skipped, %s: %s", e, text)
        return None
