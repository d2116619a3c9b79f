"""A query as it is declared: its text, possibly in pieces, and whether it is native; run by the language it is written in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from declq.plans import native, objectql
from declq.plans.catalog import Catalog


@dataclass(frozen=True)
class QuerySpec:
    """value: the text, or pieces that are joined as they are. is_native: None lets the text tell."""

    value: str | Sequence[str]
    is_native: bool | None = None

    @property
    def text(self) -> str:
        return native.clean(self.value if isinstance(self.value, str) else "".join(self.value))

    @property
    def native(self) -> bool:
        return native.is_native(self.text) if self.is_native is None else self.is_native

    def run(self, spark: SparkSession, catalog: Catalog, args: list[Any] | dict[str, Any] | None = None, on_error: str = "raise") -> DataFrame | None:
        """The rows; tables that a native text names must be views of the session. on_error="log" gives None for a query that can't run."""
        if self.native:
            return native.run(spark, self.text, args, on_error)
        return objectql.run(spark, catalog, self.text, args, on_error)
