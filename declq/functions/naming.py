"""Names: two snake-case rules, in Python and as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_HUMP = re.compile(r"([a-z])([A-Z]+)")


def snake(name: str) -> str:
    """Splits where a lower-case letter meets capitals; digits don't split: userID -> user_id, address2Line -> address2line."""
    return _HUMP.sub(r"\1_\2", name).lower()


def snake_each(name: str) -> str:
    """Every capital but the first letter starts a word: userID -> user_i_d."""
    return "".join(f"_{c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(name))


def snake_column(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, _HUMP.pattern, "$1_$2"))


def snake_each_column(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?<=.)([A-Z])", "_$1"))
