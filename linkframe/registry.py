"""Entity types: their fields, inheritance, and the Spark schema that follows from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SCALARS = {"string": T.StringType(), "text": T.StringType(), "enum": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}


@dataclass(frozen=True)
class Field:
    """A field. kind: string, text, enum, number, boolean, date, link or list.

    A link names its target types and may be many-valued, and its reverse direction may have a name. A list has either
    items of one scalar kind (``of``) or rows with fields of their own (``fields``).
    """

    name: str
    kind: str = "string"
    target: tuple[str, ...] = ()
    many: bool = False
    reverse: str | None = None
    of: str | None = None
    fields: tuple[Field, ...] = ()
    values: tuple[str, ...] = ()
    required: bool = False
    title: bool = False
    column: str | None = None
    calculated: bool = False

    def __post_init__(self):
        if self.kind not in {*SCALARS, "link", "list"}:
            raise ValueError(f"{self.name}: unknown kind {self.kind}")
        if self.kind == "link" and not self.target:
            raise ValueError(f"{self.name}: a link needs a target")
        if self.kind == "list" and bool(self.of) == bool(self.fields):
            raise ValueError(f"{self.name}: a list has items of one kind, or rows with fields")
        if self.kind == "enum" and not self.values:
            raise ValueError(f"{self.name}: an enum needs values")

    def spark(self) -> T.DataType:
        if self.kind == "link":
            return T.ArrayType(T.StringType()) if self.many else T.StringType()
        if self.kind == "list":
            if self.of:
                return T.ArrayType(SCALARS[self.of])
            return T.ArrayType(T.StructType([T.StructField(f.name, f.spark()) for f in self.fields]))
        return SCALARS[self.kind]


@dataclass(frozen=True)
class EntityType:
    name: str
    own: tuple[Field, ...] = ()
    extends: str | None = None
    abstract: bool = False
    prefix: str | None = None
    source: str | None = None


@dataclass
class Registry:
    """Entity types by name; ``enums`` (values) and ``records`` (fields of list rows) may be declared by name for fields to share."""

    types: dict[str, EntityType] = field(default_factory=dict)

    def __init__(self, *types: EntityType, enums: dict[str, tuple[str, ...]] | None = None, records: dict[str, tuple[Field, ...]] | None = None):
        self.types, self.enums, self.records = {}, enums or {}, records or {}
        for t in types:
            self.add(t)

    def add(self, t: EntityType) -> None:
        """A type's parent comes first; it may not declare a parent's field again."""
        if t.name in self.types:
            raise ValueError(f"{t.name} is declared twice")
        if t.extends and t.extends not in self.types:
            raise ValueError(f"{t.name} extends {t.extends}, which isn't declared")
        names = [f.name for f in (*(self.fields(t.extends) if t.extends else ()), *t.own)]
        if twice := {n for n in names if names.count(n) > 1 or n in ("id", "type")}:
            raise ValueError(f"{t.name} declares again: {', '.join(sorted(twice))}")
        self.types[t.name] = t

    def get(self, name: str) -> EntityType:
        if name not in self.types:
            raise ValueError(f"unknown type {name}")
        return self.types[name]

    def fields(self, name: str) -> tuple[Field, ...]:
        """The parent's fields, then its own."""
        t = self.get(name)
        return (*(self.fields(t.extends) if t.extends else ()), *t.own)

    def field(self, name: str, of: str) -> Field | None:
        return next((f for f in self.fields(name) if f.name == of), None)

    def prefix(self, name: str) -> str | None:
        t = self.get(name)
        return t.prefix or (self.prefix(t.extends) if t.extends else None)

    def ancestors(self, name: str) -> list[str]:
        """The type and all that it extends."""
        t = self.get(name)
        return [name, *(self.ancestors(t.extends) if t.extends else ())]

    def is_a(self, name: str, other: str) -> bool:
        return other in self.ancestors(name)

    def concrete(self, *names: str) -> list[str]:
        """The non-abstract types that the names stand for, in order of declaration; ``any`` is all of them."""
        for n in names:
            if n != "any":
                self.get(n)
        return [t for t, d in self.types.items() if not d.abstract and any(n == "any" or self.is_a(t, n) for n in names)]

    def struct(self, name: str) -> T.StructType:
        return T.StructType([T.StructField("id", T.StringType()), *[T.StructField(f.name, f.spark()) for f in self.fields(name) if not f.calculated]])

    def links(self, name: str) -> list[tuple[str | None, Field]]:
        """Link fields of a type: (list or None, field)."""
        own = [(None, f) for f in self.fields(name) if f.kind == "link"]
        return own + [(f.name, g) for f in self.fields(name) if f.kind == "list" for g in f.fields if g.kind == "link"]

    def facet(self, reverse: str) -> list[tuple[str, str | None, Field]]:
        """The link fields (type, list, field) that a reverse name stands for, once each where they are declared."""
        out = []
        for t, d in self.types.items():
            for f in d.own:
                for where, g in ((None, f), *((f.name, g) for g in f.fields)):
                    if g.kind == "link" and g.reverse == reverse:
                        out.append((t, where, g))
        return out
