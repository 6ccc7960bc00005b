"""Conditions on entities, built as small trees and compiled to Columns and joins.

Own fields and the rows of nested lists become expressions, without a shuffle; links, facets and unrelated entities become
semi joins (inner joins where an inner test reads an outer entity). Every test holds or doesn't: a blank
value is never null to the outside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .closure import closure, reaching, saved
from .model import Model

COMPARE: dict[str, Callable[[Any, Any], Column]] = {
    "equals": lambda a, b: a == b,
    "greater_than": lambda a, b: a > b,
    "less_than": lambda a, b: a < b,
    "greater_or_equal": lambda a, b: a >= b,
    "less_or_equal": lambda a, b: a <= b,
}


@dataclass(frozen=True)
class Outer:
    """A field of an enclosing entity: ``up`` levels out (0: the same item)."""

    name: str
    up: int = 0


class Cond:
    def __and__(self, other: Cond) -> Cond:
        return all_of(self, other)

    def __or__(self, other: Cond) -> Cond:
        return any_of(self, other)


@dataclass(frozen=True)
class Test(Cond):
    name: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Group(Cond):
    parts: tuple[Cond, ...]
    every: bool


@dataclass(frozen=True)
class Sub(Cond):
    """A sub-query over rows of a list, linked entities, a facet, or entities of given types."""

    how: str  # row, link, facet, of
    name: str | tuple[str, ...]
    where: Cond | None = None
    transitive: bool = False
    negate: bool = False
    agg: str | None = None
    read: str | None = None
    op: str | None = None
    value: Any = None


@dataclass(frozen=True)
class _FieldRef:
    name: str

    def _test(self, op: str, value: Any, value_of: str | Outer | None) -> Test:
        if value_of is not None:
            value = value_of if isinstance(value_of, Outer) else Outer(value_of)
        return Test(self.name, op, value)

    def equals(self, value: Any = None, value_of: str | Outer | None = None) -> Test:
        return self._test("equals", value, value_of)

    def not_equals(self, value: Any = None, value_of: str | Outer | None = None) -> Test:
        return self._test("not_equals", value, value_of)

    def greater_than(self, value: Any = None, value_of: str | Outer | None = None) -> Test:
        return self._test("greater_than", value, value_of)

    def less_than(self, value: Any = None, value_of: str | Outer | None = None) -> Test:
        return self._test("less_than", value, value_of)

    def greater_or_equal(self, value: Any = None, value_of: str | Outer | None = None) -> Test:
        return self._test("greater_or_equal", value, value_of)

    def less_or_equal(self, value: Any = None, value_of: str | Outer | None = None) -> Test:
        return self._test("less_or_equal", value, value_of)

    def not_in(self, values: list[Any]) -> Test:
        return Test(self.name, "not_in", tuple(values))

    def exists(self) -> Test:
        return Test(self.name, "exists")

    def missing(self) -> Test:
        return Test(self.name, "missing")


def field(name: str) -> _FieldRef:
    return _FieldRef(name)


def outer(name: str, up: int = 1) -> Outer:
    return Outer(name, up)


def type_is_a(name: str) -> Test:
    return Test("type", "is_a", name)


def all_of(*conds: Cond) -> Cond:
    flat = [p for c in conds for p in (c.parts if isinstance(c, Group) and c.every else (c,))]
    return Group(tuple(flat), True)


def any_of(*conds: Cond) -> Cond:
    return Group(tuple(conds), False)


def some_row(within: str, *where: Cond) -> Sub:
    return Sub("row", within, all_of(*where) if where else None)


def some_linked(link: str, *where: Cond) -> Sub:
    return Sub("link", link, all_of(*where) if where else None)


def some_linking(facet: str, *where: Cond) -> Sub:
    return Sub("facet", facet, all_of(*where) if where else None)


def some_of(types: list[str] | tuple[str, ...], *where: Cond) -> Sub:
    return Sub("of", tuple(types), all_of(*where) if where else None)


def none_linked(link: str, *where: Cond) -> Sub:
    return Sub("link", link, all_of(*where) if where else None, negate=True)


def none_linking(facet: str, *where: Cond) -> Sub:
    return Sub("facet", facet, all_of(*where) if where else None, negate=True)


def none_of(types: list[str] | tuple[str, ...], *where: Cond) -> Sub:
    return Sub("of", tuple(types), all_of(*where) if where else None, negate=True)


def reaches(name: str, *where: Cond, facet: bool = False) -> Sub:
    return Sub("facet" if facet else "link", name, all_of(*where) if where else None, transitive=True)


def aggregate(how: str, name: str, agg: str, op: str, value: Any, read: str | None = None, where: Cond | None = None, transitive: bool = False) -> Sub:
    """A test on count, sum, min, max or avg over the items of a sub-query (how: row, link or facet)."""
    if agg not in ("count", "sum", "min", "max", "avg") or (agg == "count") == bool(read):
        raise ValueError("count reads no field; sum, min, max and avg read one")
    return Sub(how, name, where, transitive, False, agg, read, op, value)


def from_dict(d: dict | list) -> Cond:
    """A condition from plain data, so that rules can be stored: lists are all-of, ``any_of`` holds alternatives."""
    if isinstance(d, list):
        return all_of(*map(from_dict, d))
    if "any_of" in d:
        return any_of(*map(from_dict, d["any_of"]))
    where = from_dict(d["where"]) if "where" in d else None
    if "how" in d:
        if "agg" in d:
            return aggregate(d["how"], d["name"], d["agg"], d["op"], d["value"], d.get("read"), where, d.get("transitive", False))
        name = tuple(d["name"]) if d["how"] == "of" else d["name"]
        return Sub(d["how"], name, where, d.get("transitive", False), d.get("negate", False))
    value = Outer(d["value_of"].lstrip("^"), len(d["value_of"]) - len(d["value_of"].lstrip("^"))) if "value_of" in d else d.get("value")
    return Test(d["field"], d["op"], tuple(value) if isinstance(value, list) else value)


@dataclass
class Level:
    """What a test can read of one item: columns by field name, and their types."""

    get: Callable[[str], Column]
    types: dict[str, T.DataType]
    links: Callable[[str], tuple[DataFrame, list[str]]] | None = None
    entity: tuple[str, ...] = ()
    prefix: str = ""


def _literal(v: Any, kind: T.DataType | None) -> Column:
    got = F.lit(v)
    return got.cast(kind) if kind is not None and isinstance(kind, (T.DateType, T.TimestampNTZType, T.DoubleType)) else got


def _same_kind(a: T.DataType | None, b: T.DataType | None) -> bool:
    number = lambda t: isinstance(t, T.NumericType)
    return a is None or b is None or a == b or number(a) and number(b)


def _test(t: Test, levels: list[Level], model: Model) -> Column:
    level = levels[-1]
    if t.name not in level.types:
        return F.lit(t.op in ("not_equals", "not_in", "missing"))
    c, kind = level.get(t.name), level.types[t.name]
    many = isinstance(kind, T.ArrayType)
    item = kind.elementType if many else kind
    if t.op == "exists":
        return F.coalesce(F.size(c), F.lit(0)) > 0 if many else c.isNotNull()
    if t.op == "missing":
        return F.coalesce(F.size(c), F.lit(0)) <= 0 if many else c.isNull()
    if t.op == "is_a":
        return c.isin(model.registry.concrete(t.value))
    if t.op == "not_in":
        hit = F.exists(c, lambda x: x.isin(list(t.value))) if many else c.isin([_literal(v, item) for v in t.value])
        return ~F.coalesce(hit, F.lit(False))
    op = "equals" if t.op == "not_equals" else t.op
    if op != "equals" and isinstance(item, T.BooleanType):
        raise ValueError(f"{t.name}: {op} needs numbers, dates or text")
    if isinstance(t.value, Outer):
        if t.value.up >= len(levels):
            raise ValueError(f"{t.value.name}: there is no item {t.value.up} levels out")
        other = levels[-1 - t.value.up]
        if t.value.name not in other.types:
            return F.lit(t.op == "not_equals")
        right, right_kind = other.get(t.value.name), other.types[t.value.name]
        right_many = isinstance(right_kind, T.ArrayType)
        if not _same_kind(item, right_kind.elementType if right_many else right_kind):
            raise ValueError(f"{t.name} and {t.value.name} are of different kinds")
    else:
        right, right_many = _literal(t.value, item), False
    compare = COMPARE[op]
    if many and right_many:
        hit = F.exists(c, lambda x: F.exists(right, lambda y: compare(x, y)))
    elif many:
        hit = F.exists(c, lambda x: compare(x, right))
    elif right_many:
        hit = F.exists(right, lambda y: compare(c, y))
    else:
        hit = compare(c, right)
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if t.op == "not_equals" else hit


def _reads_outside(c: Cond | None, depth: int = 0) -> bool:
    """Whether a condition, ``depth`` items in, reads an item outside of the one it is on."""
    if isinstance(c, Test):
        return isinstance(c.value, Outer) and c.value.up > depth
    if isinstance(c, Group):
        return any(_reads_outside(p, depth) for p in c.parts)
    if isinstance(c, Sub):
        return isinstance(c.value, Outer) and c.value.up > depth or _reads_outside(c.where, depth + 1)
    return False


def _row_level(c: Column, kind: T.StructType) -> Level:
    return Level(lambda n: c[n], {f.name: f.dataType for f in kind.fields})


def _local(c: Cond | None, levels: list[Level], model: Model) -> Column | None:
    """The condition as a Column, or None where it needs a join."""
    if c is None:
        return F.lit(True)
    if isinstance(c, Test):
        if levels[-1].entity and c.name not in levels[-1].types and c.op in ("exists", "missing") and model.registry.facet(c.name):
            return None
        return _test(c, levels, model)
    if isinstance(c, Group):
        parts = [_local(p, levels, model) for p in c.parts]
        if any(p is None for p in parts):
            return None
        return reduce(lambda a, b: a & b if c.every else a | b, parts, F.lit(c.every)) if parts else F.lit(c.every)
    if isinstance(c, Sub) and c.how == "row":
        kind = levels[-1].types.get(c.name)
        if kind is None:
            return F.lit(c.negate) if not c.agg else _number_test(F.lit(0 if c.agg in ("count", "sum") else None).cast("double"), c, levels, model)
        holder = levels[-1].get(c.name)
        inner = lambda r: _local(c.where, [*levels, _row_level(r, kind.elementType)], model)
        if inner(F.lit(None).cast(kind.elementType)) is None:
            return None
        found = F.coalesce(F.filter(holder, inner), F.array().cast(kind))
        if not c.agg:
            hit = F.coalesce(F.exists(holder, inner), F.lit(False))
            return ~hit if c.negate else hit
        if c.agg == "count":
            return _number_test(F.size(found).cast("double"), c, levels, model)
        values = F.filter(F.transform(found, lambda r: r[c.read].cast("double")), lambda v: v.isNotNull())
        return _number_test(finite(array_number(c.agg, values)), c, levels, model)
    return None


def array_number(agg: str, values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return {"sum": lambda: total, "min": lambda: F.array_min(values), "max": lambda: F.array_max(values), "avg": lambda: F.try_divide(total, F.size(values))}[agg]()


def finite(c: Column) -> Column:
    """NaN and infinities are blank."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def _number_test(c: Column, s: Sub, levels: list[Level], model: Model) -> Column:
    level = Level(lambda n: c, {"n": T.DoubleType()})
    value = Outer(s.value.name, s.value.up + 1) if isinstance(s.value, Outer) else s.value
    return _test(Test("n", s.op, value), [*levels, level], model)


def _entity_level(df: DataFrame, depth: int, types: tuple[str, ...]) -> Level:
    p = f"l{depth}__"
    kinds = {f.name.removeprefix(p): f.dataType for f in df.schema.fields if f.name.startswith(p)}
    return Level(lambda n: F.col(p + n), kinds, entity=types, prefix=p)


def _named(df: DataFrame, depth: int) -> DataFrame:
    return df.select(*[F.col(c).alias(f"l{depth}__{c}") for c in df.columns])


def _pairs(model: Model, level: Level, s: Sub, closed: bool = True) -> tuple[DataFrame, tuple[str, ...]]:
    """(src, dst) that a link or facet gives for entities of the level, and the types of dst. A transitive one is closed, unless told otherwise."""
    reg = model.registry
    if s.how == "link":
        found = [(t, f) for t in reg.concrete(*level.entity) if (f := reg.field(t, s.name)) is not None and f.kind == "link"]
        if not found:
            raise ValueError(f"{s.name} is no link of {', '.join(level.entity)}")
        target = tuple(dict.fromkeys(x for _, f in found for x in f.target))
        if s.transitive:  # follow the field through every type that has it
            found = [(t, f) for t in reg.concrete("any") if t in model.tables and (f := reg.field(t, s.name)) is not None and f.kind == "link"]
            target = tuple(dict.fromkeys(x for _, f in found for x in f.target))
        parts = [model.edges(t, s.name).select("src", "dst") for t, _ in found if t in model.tables]
        pairs = reduce(lambda a, b: a.union(b), parts)
    else:
        pairs = model.facet(s.name).select(F.col("id").alias("src"), F.col("src").alias("dst"))
        target = tuple(dict.fromkeys(t for t, _, _ in reg.facet(s.name)))
    return (closure(pairs) if s.transitive and closed else pairs), target


def _keys(depth: int) -> list[str]:
    return [f"l{i}__id" for i in range(depth + 1)]


def _matching(df: DataFrame, c: Cond | None, levels: list[Level], model: Model) -> DataFrame:
    """The rows of ``df`` on which the condition holds."""
    col = _local(c, levels, model)
    if col is not None:
        return df.where(col)
    if isinstance(c, Group) and c.every:
        for p in sorted(c.parts, key=lambda p: _local(p, levels, model) is None):  # own tests before joins
            df = _matching(df, p, levels, model)
        return df
    keys = [k for k in df.columns if k.endswith("__id") or k.endswith("__pos")]
    if isinstance(c, Group):
        hits = reduce(lambda a, b: a.union(b), [_matching(df, p, levels, model).select(*keys) for p in c.parts])
        return _semi(df, hits.distinct(), keys)
    if isinstance(c, Test):  # exists or missing on a facet
        return _matching(df, Sub("facet", c.name, negate=c.op == "missing"), levels, model)
    assert isinstance(c, Sub)
    if not c.agg and (c.how == "of" or c.transitive and not _reads_outside(c.where)):
        found = _unrelated(df, c, levels, model) if c.how == "of" else _reaching(df, c, levels, model)
        if found is not None:
            return found
    items, own, inner_levels = _items(df, c, levels, model, keys)
    if c.agg:
        return _aggregated(df, items, c, levels, inner_levels, model, own)
    found = _matching(items, c.where, inner_levels, model)
    return _semi(df, found.select(*own).distinct() if c.how == "of" else found.select(*own), own, "left_anti" if c.negate else "left_semi")


def _semi(df: DataFrame, hits: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    named = hits.select(*[F.col(k).alias(f"__{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) if k.endswith("__pos") else F.col(k) == F.col(f"__{k}") for k in keys]
    return df.join(named, reduce(lambda a, b: a & b, on) if on else F.lit(True), how)


def _alone(depth: int, inner: Level) -> list[Level]:
    """Levels for a condition that reads nothing of the enclosing items."""
    return [*([Level(lambda n: F.lit(None), {})] * depth), inner]


def _reaching(df: DataFrame, c: Sub, levels: list[Level], model: Model) -> DataFrame:
    """Entities from which some matching one can be reached: a search backwards from those that match."""
    level, depth = levels[-1], len(levels)
    pairs, types = _pairs(model, level, Sub(c.how, c.name, c.where, transitive=True), closed=False)
    target = _named(model.table(*types), depth)
    found = _matching(target, c.where, _alone(depth, _entity_level(target, depth, types)), model)
    hits = reaching(pairs, found.select(F.col(f"l{depth}__id").alias("id")))
    return _semi(df, hits.select(F.col("id").alias(f"{level.prefix}id")).hint("merge"), [f"{level.prefix}id"], "left_anti" if c.negate else "left_semi")


def _unrelated(df: DataFrame, c: Sub, levels: list[Level], model: Model) -> DataFrame | None:
    """A sub-query over unrelated entities without pairing them, or None where its tests don't allow that.

    One that reads nothing outside is one value. Else its tests may be on the item alone, equalities with an enclosing item (the key), and
    one order test or inequality with it, which holds for some item if it does for the least or the greatest of its key; or an order test and one more of
    either kind (``_dominated``).
    """
    depth = len(levels)
    target = _named(model.table(*c.name), depth)
    inner = _entity_level(target, depth, c.name)
    if not _reads_outside(c.where):
        hit = _matching(target, c.where, _alone(depth, inner), model).exists()
        return df.where(~hit if c.negate else hit)
    parts = c.where.parts if isinstance(c.where, Group) and c.where.every else (c.where,)
    own, same, other = [], [], []
    for t in parts:
        if not _reads_outside(t):
            own.append(t)
            continue
        if not isinstance(t, Test) or t.name not in inner.types or t.value.up > depth:
            return None
        far = levels[-t.value.up]
        if t.value.name not in far.types or isinstance(inner.types[t.name], T.ArrayType) or isinstance(far.types[t.value.name], T.ArrayType):
            return None
        _test(t, [*levels, inner], model)  # for what it says of mistakes
        (same if t.op == "equals" else other).append((inner.get(t.name), far.get(t.value.name), t.op))
    if len(other) > 2 or len(other) == 2 and all(op == "not_equals" for _, _, op in other):
        return None
    found = _matching(target, all_of(*own), _alone(depth, inner), model)
    keys = [f"__k{i}" for i in range(len(same))]
    found = found.select(*[x.alias(k) for k, (x, _, _) in zip(keys, same, strict=True)], *[x.alias(n) for (x, _, _), n in zip(other, ("__x", "__z"), strict=False)]).dropna(subset=keys) if keys or other else found
    on = [F.col(k) == y for k, (_, y, _) in zip(keys, same, strict=True)]
    how = "left_anti" if c.negate else "left_semi"
    if not other:
        return df.join(found.distinct(), reduce(lambda a, b: a & b, on), how)
    if len(other) == 2:
        hits = _dominated(df, found, keys, [y for _, y, _ in same], other)
        return df.join(hits, reduce(lambda a, b: a & b, [y.eqNullSafe(F.col(n)) for y, n in zip([*[y for _, y, _ in same], *[y for _, y, _ in other]], hits.columns, strict=True)]), how)
    _, y, op = other[0]
    ends = [F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.bool_or(F.col("__x").isNull()).alias("__none")]
    lo, hi, none = F.col("__lo"), F.col("__hi"), F.col("__none")
    if not keys:
        one = found.agg(*ends)
        lo, hi, none = (one.select(x).scalar() for x in ("__lo", "__hi", "__none"))
    hit = _by_ends(op, lo, hi, none, y)
    if not keys:
        return df.where(~hit if c.negate else hit)
    return df.join(found.groupBy(*keys).agg(*ends), reduce(lambda a, b: a & b, [*on, hit]), how)


def _by_ends(op: str, lo: Column, hi: Column, none: Column, y: Column) -> Column:
    """Whether the test holds with y for some of the values whose least and greatest are these; ``none``: whether one is blank, null if there are no values."""
    if op == "not_equals":  # blank is unequal to everything, itself too
        hit = none | (none.isNotNull() & y.isNull()) | (lo != y) | (hi != y)
    else:
        hit = COMPARE[op](hi if op.startswith("greater") else lo, y)
    return F.coalesce(hit, F.lit(False))


def _dominated(df: DataFrame, found: DataFrame, keys: list[str], same: list[Column], other: list[tuple[Column, Column, str]]) -> DataFrame:
    """The distinct (keys, y1, y2) of ``df`` for which some row of ``found`` (keys, __x, __z) passes both tests. The first of them that orders is swept.

    Both sides are put in ranges of key and swept value, so that whatever passes the sweep's test lies before: then the least and greatest of the other value
    up to each row answer the second test. They run inside a range, and are carried over ranges by a row for each range and key; no pairs are built.
    """
    sweep = 0 if other[0][2] != "not_equals" else 1
    (_, y1, op1), (_, y2, op2) = other[sweep], other[1 - sweep]
    v, w = ("__x", "__z") if sweep == 0 else ("__z", "__x")
    asked = df.select(*[y.alias(k) for y, k in zip(same, keys, strict=True)], y1.alias("__v"), y2.alias("__w")).distinct().where(F.col("__v").isNotNull())
    ends = [F.min(w).alias("__lo"), F.max(w).alias("__hi"), F.bool_or(F.col(w).isNull()).alias("__none")]
    facts = found.where(F.col(v).isNotNull()).groupBy(*keys, F.col(v).alias("__v")).agg(*ends)
    kinds = {n: asked.schema[n].dataType for n in ("__v", "__w")}
    first, last = (0, 1) if op1.endswith("_or_equal") else (1, 0)  # of equal values those of facts count, or don't
    facts = facts.select(*keys, F.col("__v").cast(kinds["__v"]).alias("__v"), F.lit(first).alias("__side"), F.lit(None).cast(kinds["__w"]).alias("__w"), "__lo", "__hi", "__none")
    null = lambda n: F.lit(None).cast(facts.schema[n].dataType).alias(n)
    rows = facts.union(asked.select(*keys, "__v", F.lit(last).alias("__side"), "__w", null("__lo"), null("__hi"), null("__none")))
    by = [*[F.col(k).asc() for k in keys], F.desc("__v") if op1.startswith("greater") else F.asc("__v"), F.asc("__side")]
    rows = saved(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    running = [F.min("__lo"), F.max("__hi"), F.max("__none")]
    here = Window.partitionBy("__part", *keys)
    upto = here.orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = ("__lo", "__hi", "__none")
    swept = rows.select("*", *[a.over(upto).alias(f"{n}1") for a, n in zip(running, names, strict=True)])
    parts = rows.groupBy("__part", *keys).agg(*[a.alias(n) for a, n in zip(running, names, strict=True)])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("__part").alias("__part2"), *[F.col(k).alias(f"{k}b") for k in keys], *[a.over(before).alias(f"{n}0") for a, n in zip(running, names, strict=True)])
    on = reduce(lambda a, b: a & b, [F.col("__part") == F.col("__part2"), *[F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys]])
    got = swept.where(F.col("__side") == last).join(parts, on)
    lo, hi, none = F.least("__lo0", "__lo1"), F.greatest("__hi0", "__hi1"), F.greatest("__none0", "__none1")
    got = got.where(_by_ends(op2, lo, hi, none, F.col("__w")))
    out = [F.col("__v"), F.col("__w")] if sweep == 0 else [F.col("__w"), F.col("__v")]
    return got.select(*[F.col(k).alias(f"__same{i}") for i, k in enumerate(keys)], *[c.alias(f"__y{i}") for i, c in enumerate(out)]).distinct()


def _items(df: DataFrame, c: Sub, levels: list[Level], model: Model, keys: list[str]) -> tuple[DataFrame, list[str], list[Level]]:
    """The items of a sub-query beside the keys (and, where read, the columns) of the rows they belong to."""
    level, depth = levels[-1], len(levels)
    if c.how == "row":
        kind = level.types[c.name].elementType
        p = f"l{depth}__"
        wide = df.select("*", F.posexplode(level.get(c.name)).alias(f"{p}pos", f"{p}row"))
        wide = wide.withColumn(f"{p}id", F.concat_ws("/", F.col(keys[-1]), F.col(f"{p}pos"))).select("*", *[F.col(f"{p}row.{f.name}").alias(f"{p}{f.name}") for f in kind.fields]).drop(f"{p}row")
        links = {g.name: g for t in level.entity for f in model.registry.fields(t) if f.name == c.name for g in f.fields}
        inner = Level(lambda n: F.col(p + n), {f.name: f.dataType for f in kind.fields}, prefix=p)
        inner.links = lambda n: (links[n].target, links[n].many)
        return wide, keys, [*levels, inner]
    outside = _reads_outside(c.where, 0) if c.where else False
    if c.how == "of":
        target = _named(model.table(*c.name), depth)
        inner = _entity_level(target, depth, c.name)
        if not outside:
            raise ValueError("a sub-query that reads no enclosing item has no items of its own for each")
        return _correlated(df, target, c, levels, inner, model), keys, [*levels, inner]
    if level.links and c.how == "link":  # a link on a list row
        types, many = level.links(c.name)
        src = df.select(*(df.columns if outside else keys), (F.explode(level.get(c.name)) if many else level.get(c.name)).alias("__dst"))
        target = _named(model.table(*types), depth)
        return src.join(target, src["__dst"] == target[f"l{depth}__id"]), keys, [*levels, _entity_level(target, depth, types)]
    pairs, types = _pairs(model, level, c)
    target = _named(model.table(*types), depth)
    inner = _entity_level(target, depth, types)
    me = f"{level.prefix}id"
    if outside:
        wide = df.join(pairs, df[me] == pairs["src"]).join(target, F.col("dst") == F.col(f"l{depth}__id")).drop("src", "dst")
        return wide, keys, [*levels, inner]
    if c.where is not None:  # innermost first: filter the targets before they meet the edges
        target = _matching(target, c.where, _alone(depth, inner), model)
    wide = pairs.join(target, pairs["dst"] == target[f"l{depth}__id"]).withColumnRenamed("src", me).drop("dst")
    return wide, [me], [*levels, inner]


def _correlated(df: DataFrame, target: DataFrame, c: Sub, levels: list[Level], inner: Level, model: Model) -> DataFrame:
    """Unrelated entities: equality with an enclosing item is the join key, so Spark needs no nested loop."""
    parts = c.where.parts if isinstance(c.where, Group) and c.where.every else (c.where,)
    on = []
    for t in parts:
        if isinstance(t, Test) and t.op == "equals" and isinstance(t.value, Outer) and 0 < t.value.up <= len(levels) and t.name in inner.types:
            far = levels[-t.value.up]
            if t.value.name in far.types and not isinstance(far.types[t.value.name], T.ArrayType) and not isinstance(inner.types[t.name], T.ArrayType):
                on.append(inner.get(t.name) == far.get(t.value.name))
    if not on:
        raise ValueError("a sub-query over unrelated entities needs an equality with an enclosing item, or up to two tests with it of which one orders")
    return df.join(target, reduce(lambda a, b: a & b, on))


def _aggregated(df: DataFrame, items: DataFrame, c: Sub, levels: list[Level], inner: list[Level], model: Model, own: list[str]) -> DataFrame:
    found = _matching(items, c.where, inner, model)
    item = f"l{len(levels)}__id"
    if c.agg == "count":
        sums = found.groupBy(*own).agg(F.countDistinct(item).cast("double").alias("__n"))
    else:
        value = inner[-1].get(c.read)
        if isinstance(inner[-1].types[c.read], T.ArrayType):
            found = found.withColumn("__v", F.explode(value))
        else:
            found = found.withColumn("__v", value)
        found = found.select(*own, item, F.col("__v").cast("double")).dropDuplicates([*own, item, "__v"])
        sums = found.groupBy(*own).agg(finite({"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[c.agg]("__v")).alias("__n"))
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in own], "__n")
    n = F.coalesce(F.col("__n"), F.lit(0.0)) if c.agg in ("count", "sum") else F.col("__n")
    wide = df.join(sums, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in own]), "left").withColumn("__n", n)
    return wide.where(_number_test(F.col("__n"), c, levels, model)).select(*df.columns)


def unrelated_items(model: Model, sub: Sub) -> DataFrame:
    """(item): the entities that an unrelated sub-query which reads nothing outside finds; they are the same for every entity."""
    target = _named(model.table(*sub.name), 1)
    return _matching(target, sub.where, _alone(1, _entity_level(target, 1, sub.name)), model).select(F.col("l1__id").alias("item"))


def select(model: Model, types: str | list[str], where: Cond | None = None) -> DataFrame:
    """The entities of the types on which the condition holds, with their columns."""
    names = (types,) if isinstance(types, str) else tuple(types)
    df = _named(model.table(*names), 0)
    out = _matching(df, where, [_entity_level(df, 0, names)], model)
    return out.select(*[F.col(c).alias(c.removeprefix("l0__")) for c in out.columns if c.startswith("l0__")])


def match_items(model: Model, types: str | list[str], sub: Sub) -> DataFrame:
    """(id, item): for each match of a sub-query, the rows (``list/pos``) or entities that made it true."""
    names = (types,) if isinstance(types, str) else tuple(types)
    df = _named(model.table(*names), 0)
    level = _entity_level(df, 0, names)
    if sub.how == "row" and (kind := level.types.get(sub.name)) is not None:
        p = "l1__"
        wide = df.select("*", F.posexplode(level.get(sub.name)).alias(f"{p}pos", f"{p}row")).withColumn("l1__id", F.concat_ws("/", F.lit(sub.name), F.col("l1__pos"))).select("*", *[F.col(f"{p}row.{f.name}").alias(f"{p}{f.name}") for f in kind.elementType.fields])
        inner = Level(lambda n: F.col(p + n), {f.name: f.dataType for f in kind.elementType.fields}, prefix=p)
        found = _matching(wide, sub.where, [level, inner], model)
    else:
        items, _, levels = _items(df, sub, [level], model, ["l0__id"])
        found = _matching(items, sub.where, levels, model)
        found = found.join(df.select("l0__id"), "l0__id", "left_semi")
    return found.select(F.col("l0__id").alias("id"), F.col("l1__id").alias("item")).distinct()


def order_entities(df: DataFrame, *fields: str) -> DataFrame:
    """Ascending, missing values last, then by id."""
    for f in fields:
        if isinstance(df.schema[f].dataType, T.ArrayType):
            raise ValueError(f"{f} has several values; it gives no order")
    return df.orderBy(*[F.col(f).asc_nulls_last() for f in fields], "id")


def project(df: DataFrame, mode: str) -> DataFrame:
    """Results as ``full`` rows, ``id`` alone, or ``field:x``."""
    if mode == "full":
        return df
    if mode == "id":
        return df.select("id")
    if mode.startswith("field:"):
        return df.select("id", mode.removeprefix("field:"))
    raise ValueError(f"unknown mode {mode}")


def collect(model: Model, df: DataFrame, name: str, *links: str) -> DataFrame:
    """Entities at the end of a path of links, each once, in order of id."""
    ids, at = df.select("id"), (name,)
    for link in links:
        if facet := model.registry.facet(link):
            pairs, to = model.facet(link).select(F.col("id").alias("src"), F.col("src").alias("dst")), tuple(t for t, _, _ in facet)
        else:
            found = [(t, f) for t in model.registry.concrete(*at) if t in model.tables and (f := model.registry.field(t, link)) is not None]
            pairs = reduce(lambda a, b: a.union(b), [model.edges(t, link).select("src", "dst") for t, _ in found])
            to = tuple(dict.fromkeys(x for _, f in found for x in f.target))
        ids = ids.join(pairs, ids["id"] == pairs["src"]).select(F.col("dst").alias("id")).distinct()
        at = to
    return ids.join(model.table(*at), "id").dropDuplicates(["id"]).orderBy("id")
