"""Query parameters: positional (?, ?1), named (:name), nested (:#{#filter.name}) and LIKE wildcards (%:name%)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from declq.plans.catalog import ConversionError

_TEXT = r"'(?:[^']|'')*'"
_NESTED = re.compile(r":#\{\s*#?([\w.()]+)\s*\}")
_NOT_IN_NOTHING = re.compile(rf"({_TEXT})|\bNOT\s+IN\s*\(\s*NULL\s*\)", re.I)
_TOKEN = re.compile(rf"({_TEXT})|(%?):([A-Za-z_]\w*)(%?)|\?(\d*)")


def getter_name(path: str) -> str:
    """Last part of a nested path as a parameter name: #filter.getStatus() -> status."""
    last = path.replace("()", "").split(".")[-1]
    if m := re.fullmatch(r"get([A-Z]\w*)", last):
        last = m[1][:1].lower() + m[1][1:]
    return last


def lookup(path: str, values: Mapping[str, Any]) -> Any:
    """A dotted path through mappings, attributes or getters of the arguments."""
    at: Any = values
    for part in path.replace("()", "").split("."):
        name = getter_name(part)
        if isinstance(at, Mapping) and (part in at or name in at):
            at = at[part] if part in at else at[name]
        elif hasattr(at, part) or hasattr(at, name):
            at = getattr(at, part) if hasattr(at, part) else getattr(at, name)
            at = at() if callable(at) else at
        else:
            raise ConversionError("MISSING_PARAMETER", path)
    return at


def bind(sql: str, args: list[Any] | Mapping[str, Any]) -> tuple[str, dict[str, Any]]:
    """Text with only :name markers, and their values, ready for spark.sql(text, args).

    Lists become one marker per element (an empty list a NULL, which matches nothing; NOT IN of an empty list holds for every
    row, as it does in a derived query); wildcards around a marker become a
    concatenation; string literals are left alone. Every marker needs a value, which is bound and never printed into the text.
    """
    values: dict[str, Any] = {}
    named = dict(args) if isinstance(args, Mapping) else {}
    given = list(args) if not isinstance(args, Mapping) else []
    used = 0

    def marker(name: str, value: Any) -> str:
        if isinstance(value, (list, tuple, set)):
            for i, v in enumerate(value):
                values[f"{name}_{i}"] = v
            return ", ".join(f":{name}_{i}" for i in range(len(value))) or "NULL"
        values[name] = value
        return f":{name}"

    nested: dict[str, str] = {}

    def flatten(m: re.Match[str]) -> str:
        name = getter_name(m[1])
        while name in nested and nested[name] != m[1]:
            name += "_"
        nested[name] = m[1]
        named[name] = lookup(m[1], args if isinstance(args, Mapping) else {})
        return f":{name}"

    sql = _NESTED.sub(flatten, sql)

    def swap(m: re.Match[str]) -> str:
        nonlocal used
        if m[1]:
            return m[1]
        if m[3]:
            if m[3] not in named:
                raise ConversionError("MISSING_PARAMETER", m[3])
            out = marker(m[3], named[m[3]])
            parts = (["'%'"] if m[2] else []) + [out] + (["'%'"] if m[4] else [])
            return f"CONCAT({', '.join(parts)})" if len(parts) > 1 else out
        used += not m[5]
        at = int(m[5]) if m[5] else used
        if at > len(given):
            raise ConversionError("MISSING_PARAMETER", f"?{at}")
        return marker(f"p{at}", given[at - 1])

    # x NOT IN (NULL) would match nothing; x <=> NULL IS NOT NULL holds whatever x is.
    return _NOT_IN_NOTHING.sub(lambda m: m[1] or "<=> NULL IS NOT NULL", _TOKEN.sub(swap, sql)), values


def markers(sql: str) -> list[str]:
    """Names or numbers of the markers, in order, outside of literals."""
    found = [m for m in _TOKEN.finditer(_NESTED.sub(lambda m: ":" + getter_name(m[1]), sql)) if not m[1]]
    return [m[3] or m[5] or str(i) for i, m in enumerate(found, 1)]
