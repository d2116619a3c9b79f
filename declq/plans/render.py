"""Method names as SQL text for a dialect: for display and comparison only, execution never goes through it."""

from __future__ import annotations

import re

from declq.functions.naming import snake
from declq.plans.methodname import Method, parse

#: Booleans, concatenation and sequences of the two dialects (fixed values).
DIALECTS = {
    "postgresql": {"true": "true", "false": "false", "concat": "||", "next": "nextval('{0}')"},
    "oracle": {"true": "1", "false": "0", "concat": "||", "next": "{0}.NEXTVAL"},
}
_OPS = {
    "eq": "{} = ?", "ne": "{} != ?", "lt": "{} < ?", "le": "{} <= ?", "gt": "{} > ?", "ge": "{} >= ?", "between": "{} BETWEEN ? AND ?",
    "null": "{} IS NULL", "not_null": "{} IS NOT NULL", "in": "{} IN (?)", "not_in": "{} NOT IN (?)", "true": "{} = true", "false": "{} = false",
    **dict.fromkeys(("like", "starts", "ends", "contains"), "{} LIKE ?"), **dict.fromkeys(("not_like", "not_contains"), "{} NOT LIKE ?"),
}


def dialect_of(url: str) -> str:
    return "oracle" if "oracle" in url.lower() else "postgresql"


def column_name(prop: str) -> str:
    return snake(prop.rpartition("_")[2])


def where_text(method: Method) -> str:
    return " OR ".join(" AND ".join(_OPS[c.op].format(column_name(c.prop)) for c in part) for part in method.where)


def limited(sql: str, n: int | None, dialect: str = "postgresql") -> str:
    """PostgreSQL: LIMIT at the end. Oracle: a ROWNUM condition around the ordered query, so that the limit comes last."""
    if n is None:
        return sql
    if dialect == "postgresql":
        return f"{sql} LIMIT {n}"
    if "ORDER BY" in sql:
        return f"SELECT * FROM ({sql}) WHERE ROWNUM <= {n}"
    return f"{sql} {'AND' if ' WHERE ' in sql else 'WHERE'} ROWNUM <= {n}"


def to_sql(name: str, table: str, dialect: str = "postgresql") -> str:
    m = parse(name)
    if m.kind == "insert":
        return f"INSERT INTO {table} DEFAULT VALUES"
    where = {"list": "id IN (?)", "one": "id = ?"}.get(m.by_id or "", where_text(m))
    tail = f" WHERE {where}" if where else ""
    if m.kind == "delete":
        return for_dialect(f"DELETE FROM {table}{tail}", dialect)
    if m.kind == "exists":
        return for_dialect(f"SELECT EXISTS (SELECT 1 FROM {table}{tail})", dialect)
    what = "COUNT(*)" if m.kind == "count" else "DISTINCT *" if m.distinct else "*"
    if m.order:
        tail += " ORDER BY " + ", ".join(f"{column_name(o.prop)} {'DESC' if o.descending else 'ASC'}" for o in m.order)
    return limited(for_dialect(f"SELECT {what} FROM {table}{tail}", dialect), m.limit, dialect)


def for_dialect(sql: str, dialect: str) -> str:
    for word in ("true", "false"):
        sql = re.sub(rf"\b{word}\b", DIALECTS[dialect][word], sql, flags=re.I)
    return sql


def numbered(sql: str) -> str:
    """? to ?1, ?2 ... in order."""
    parts = sql.split("?")
    return "".join(p + (f"?{i}" if i < len(parts) else "") for i, p in enumerate(parts, 1))


_LITERAL = r"'(?:[^']|'')*'"


def unnumbered(sql: str) -> str:
    """?1, ?2 ... to ?, outside of literals."""
    return re.sub(rf"({_LITERAL})|\?\d+", lambda m: m[1] or "?", sql)


def placeholders(sql: str) -> int:
    """How many positional parameters a text has, outside of literals."""
    return sum(m[0] == "?" for m in re.finditer(rf"{_LITERAL}|\?", sql))


def tidy(sql: str) -> str:
    """A relaxed text for reading: parameters without numbers, and conditions that are always true ('1' IN ('1'), 1 = 1) gone.

    A condition goes with the AND that joins it; one that is all there is stays.
    """
    true = r"(?:'(\w+)'\s+IN\s*(?:\(\s*'\1'\s*\)|'\1')|(\b\d+)\s*=\s*\2\b)"
    sql = unnumbered(sql)
    sql = re.sub(rf"{true}\s+AND\s+", "", sql, flags=re.I)
    return re.sub(rf"\s+AND\s+{true}", "", sql, flags=re.I)
