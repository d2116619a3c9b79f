"""Entities over tables: property-to-column maps, relations, and frames. A catalog is immutable and holds no session state."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from declq.functions.naming import snake


class ConversionError(ValueError):
    """A query that can't be turned into a plan; `reason` is one of REASONS."""

    REASONS = ("PARSE_ERROR", "UNKNOWN_ENTITY", "UNKNOWN_PROPERTY", "UNSUPPORTED_CONSTRUCT", "MISSING_PARAMETER", "AMBIGUOUS_NAME")

    def __init__(self, reason: str, message: str):
        assert reason in self.REASONS
        super().__init__(f"{reason}: {message}")
        self.reason = reason


@dataclass(frozen=True)
class Relation:
    """A property that leads to another entity. column: on this side; referenced: on the other; optional decides the join."""

    target: str
    column: str = ""
    referenced: str = "id"
    optional: bool = True
    many: bool = False

    @property
    def how(self) -> str:
        return "left" if self.optional or self.many else "inner"


@dataclass(frozen=True)
class Parent:
    """Joined inheritance: the parent's row has the value of `column` of this entity's table in its column `referenced`."""

    entity: str
    column: str
    referenced: str


@dataclass(frozen=True)
class Entity:
    name: str
    table: str = ""
    key: str = "id"
    columns: Mapping[str, str] = field(default_factory=dict)
    relations: Mapping[str, Relation] = field(default_factory=dict)
    discriminator: tuple[str, str] | None = None
    parent: Parent | None = None

    def __post_init__(self) -> None:
        if not self.table:
            object.__setattr__(self, "table", snake(self.name))

    def column(self, prop: str) -> str:
        """Mapped name, else snake case; of a path only the last part counts when no relation is meant."""
        if prop in self.columns:
            return self.columns[prop]
        last = prop.replace("_", ".").split(".")[-1]
        last = last[:1].lower() + last[1:]
        return self.columns.get(last, snake(last))


class Catalog:
    """Entities by name and a loader of their tables."""

    def __init__(self, entities: list[Entity], load: Callable[[str], DataFrame]):
        names = [e.name for e in entities]
        if len(set(names)) != len(names):
            raise ValueError("an entity is registered twice")
        self.entities, self._load = {e.name: e for e in entities}, load

    def entity(self, name: str) -> Entity:
        """By name, else by the last part of a qualified name, else by a unique suffix."""
        found = self.entities.get(name) or self.entities.get(name.rpartition(".")[2])
        if found:
            return found
        ends = [e for n, e in self.entities.items() if n.endswith(name)]
        if len(ends) > 1:
            raise ConversionError("AMBIGUOUS_NAME", name)
        if not ends:
            raise ConversionError("UNKNOWN_ENTITY", name)
        return ends[0]

    def frame(self, entity: str | Entity) -> DataFrame:
        """The entity's rows: its table, less other types of a shared table, with the parents' columns that it doesn't have itself."""
        e = entity if isinstance(entity, Entity) else self.entity(entity)
        df = self._load(e.table)
        df = df.where(df[e.discriminator[0]] == e.discriminator[1]) if e.discriminator else df
        if not e.parent:
            return df
        above = self.frame(e.parent.entity)
        own = {c.lower() for c in df.columns}
        joined = df.join(above, df[e.parent.column] == above[e.parent.referenced])
        return joined.select(*[df[c] for c in df.columns], *[above[c] for c in above.columns if c.lower() not in own])

    def relation(self, entity: Entity, prop: str) -> Relation:
        """The relation with its column filled in (default: property and _id)."""
        if prop not in entity.relations:
            raise ConversionError("UNKNOWN_PROPERTY", f"{entity.name}.{prop}")
        r = entity.relations[prop]
        return r if r.column else Relation(r.target, f"{snake(prop)}_id", r.referenced, r.optional, r.many)
