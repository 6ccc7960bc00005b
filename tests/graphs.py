"""Random entity tables about music, and a plain evaluator of conditions over them."""

import datetime as dt
import random

from linkframe.operators import cond as c
from linkframe.operators.model import Model
from linkframe.registry import EntityType, Field, Registry

GENRES = ("folk", "jazz", "noise", "opera")


def tables(spark, registry, rows):
    out = {}
    for name, found in rows.items():
        schema = registry.struct(name)
        out[name] = spark.createDataFrame([tuple(r.get(f, None) for f in schema.fieldNames()) for r in found], schema)
    return out


def music_registry():
    track = (Field("secs", "number"), Field("tone"), Field("taped", "date"), Field("singer", "link", ("Band",)))
    return Registry(
        EntityType("Act", (Field("name", title=True), Field("genre", "enum", values=GENRES), Field("heat", "number")), abstract=True),
        EntityType("Band", (Field("born_of", "link", ("Band", "Solo"), reverse="offshoots"),), extends="Act"),
        EntityType("Solo", (Field("tours", "boolean"),), extends="Act"),
        EntityType("Album", (Field("price", "number"), Field("live", "boolean"), Field("issued", "date"), Field("by", "link", ("Act",), reverse="albums"), Field("guests", "link", ("Act",), many=True, reverse="features"), Field("moods", "list", of="string"), Field("tracks", "list", fields=track))),
    )


def music(seed=0, bands=9, solos=5, albums=22):
    """Rows by type: dictionaries with ids; many values are absent, some links lead nowhere, some chains are cycles."""
    r = random.Random(seed)
    maybe = lambda v, p=0.8: v if r.random() < p else None
    day = lambda: dt.date(2020, 1 + r.randrange(4), 1 + r.randrange(3))
    acts = [f"B{i}" for i in range(bands)] + [f"S{i}" for i in range(solos)]
    act = lambda i: {"id": i, "name": maybe(r.choice(["Ox", "Elm", "Fig"])), "genre": maybe(r.choice(GENRES)), "heat": maybe(float(r.randrange(6)))}
    track = lambda: (maybe(float(r.randrange(60, 66))), maybe(r.choice("XYZ")), maybe(day()), maybe(r.choice(acts[:bands])))
    cycle = {"B1": "B2", "B2": "B1"}
    return {
        "Band": [act(i) | {"born_of": cycle.get(i) or maybe(r.choice([*acts, "B99"]), 0.7)} for i in acts[:bands]],
        "Solo": [act(i) | {"tours": maybe(r.random() < 0.5)} for i in acts[bands:]],
        "Album": [
            {
                "id": f"A{i}", "price": maybe(float(r.randrange(5))), "live": maybe(r.random() < 0.5), "issued": maybe(day()), "by": maybe(r.choice([*acts, "gone"])),
                "guests": maybe(r.sample(acts, r.randrange(3))), "moods": maybe([r.choice("mno") for _ in range(r.randrange(3))]), "tracks": maybe([track() for _ in range(r.randrange(4))]),
            }
            for i in range(albums)
        ],
    }


def music_model(spark, rows):
    reg = music_registry()
    return Model(reg, tables(spark, reg, rows))


COMPARE = {"equals": lambda a, b: a == b, "greater_than": lambda a, b: a > b, "less_than": lambda a, b: a < b, "greater_or_equal": lambda a, b: a >= b, "less_or_equal": lambda a, b: a <= b}


class Plain:
    """Conditions tried on one item after the other."""

    def __init__(self, rows):
        self.reg = music_registry()
        self.items = {x["id"]: x | {"type": t, "tracks": self.tracks(x)} for t, found in rows.items() for x in found}

    def tracks(self, x):
        return None if x.get("tracks") is None else [dict(zip(("secs", "tone", "taped", "singer"), v, strict=True)) for v in x["tracks"]]

    def of(self, *types):
        return [x for x in self.items.values() if x["type"] in self.reg.concrete(*types)]

    def select(self, types, where):
        return {x["id"] for x in self.of(*([types] if isinstance(types, str) else types)) if where is None or self.holds(where, [x])}

    def targets(self, x, link):
        v = x.get(link)
        return [self.items[i] for i in ([] if v is None else v if isinstance(v, list) else [v]) if i in self.items]

    def sources(self, x, facet):
        out = []
        for t, _, f in self.reg.facet(facet):
            if x["type"] in self.reg.concrete(*f.target):
                out += [y for y in self.of(t) if x in self.targets(y, f.name) and y not in out]
        return out

    def reached(self, x, step):
        seen, todo = [], step(x)
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.append(y)
                todo += step(y)
        return seen

    def found(self, s, stack):
        x = stack[-1]
        if s.how == "row":
            items = x.get(s.name) or []
        elif s.how == "of":
            items = self.of(*s.name)
        else:
            step = (lambda y: self.targets(y, s.name)) if s.how == "link" else lambda y: self.sources(y, s.name)
            items = self.reached(x, step) if s.transitive else step(x)
        return [y for y in items if s.where is None or self.holds(s.where, [*stack, y])]

    def holds(self, t, stack):
        if isinstance(t, c.Group):
            return (all if t.every else any)(self.holds(p, stack) for p in t.parts)
        if isinstance(t, c.Test):
            return self.test(t, stack)
        hits = self.found(t, stack)
        if not t.agg:
            return bool(hits) != t.negate
        if t.agg == "count":
            n = float(len(hits))
        else:
            values = [h[t.read] for h in hits if h.get(t.read) is not None]
            n = {"sum": sum, "min": min, "max": max, "avg": lambda v: sum(v) / len(v)}[t.agg](values) if values else (0.0 if t.agg == "sum" else None)
        value = stack[-1 - t.value.up].get(t.value.name) if isinstance(t.value, c.Outer) else t.value
        return n is not None and value is not None and COMPARE[t.op](n, value)

    def test(self, t, stack):
        x = stack[-1]
        v = x.get(t.name)
        if t.name not in x and self.reg.facet(t.name) and "type" in x:
            v = self.sources(x, t.name)
        if t.op in ("exists", "missing"):
            return (v is not None and v != []) == (t.op == "exists")
        if t.op == "is_a":
            return v in self.reg.concrete(t.value)
        mine = [] if v is None else v if isinstance(v, list) else [v]
        if t.op == "not_in":
            return not any(y in t.value for y in mine)
        other = stack[-1 - t.value.up].get(t.value.name) if isinstance(t.value, c.Outer) else t.value
        theirs = [] if other is None else other if isinstance(other, list) else [other]
        hit = any(COMPARE["equals" if t.op == "not_equals" else t.op](a, b) for a in mine for b in theirs)
        return hit != (t.op == "not_equals")
