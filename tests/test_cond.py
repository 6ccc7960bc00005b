"""Conditions compiled to Columns and joins, against a plain evaluator on random tables."""

import datetime as dt
import random

import graphs
import pytest

from linkframe.operators import cond as c
from linkframe.operators.cond import aggregate, all_of, any_of, field, match_items, none_linked, none_linking, order_entities, outer, reaches, select, some_linked, some_linking, some_of, some_row, type_is_a

CUT = dt.date(2020, 2, 2)

#: By name: (types, condition). Each holds for some entities of some seed and not for others.
CONDITIONS = {
    "text": ("Act", field("genre").equals("jazz")),
    "blank is unequal": ("Act", field("genre").not_equals("jazz")),
    "number": ("Album", all_of(field("price").greater_or_equal(1.0), field("price").less_than(4.0))),
    "date": ("Album", field("issued").less_or_equal(CUT)),
    "list item": ("Album", field("moods").equals("m")),
    "no list item": ("Album", field("moods").not_in(["m", "n"])),
    "absent list": ("Album", field("tracks").missing()),
    "present flag": ("Album", field("live").exists()),
    "field of some types": (["Band", "Solo"], field("tours").not_equals(True)),
    "by type": ("any", any_of(type_is_a("Act"), field("id").equals("A3"))),
    "same row": ("Album", some_row("tracks", field("tone").equals("X"), field("secs").greater_than(62.0))),
    "two rows": ("Album", all_of(some_row("tracks", field("tone").equals("X")), some_row("tracks", field("secs").less_than(62.0)))),
    "row against its entity": ("Album", some_row("tracks", field("taped").greater_than(value_of=outer("issued")))),
    "row against itself": ("Album", some_row("tracks", field("tone").not_equals(value_of="tone"))),
    "row link": ("Album", some_row("tracks", some_linked("singer", field("heat").greater_than(2.0)))),
    "row link against the album": ("Album", some_row("tracks", some_linked("singer", field("id").equals(value_of=outer("by", 2))))),
    "link": ("Album", some_linked("by", field("genre").equals("folk"))),
    "many link": ("Album", some_linked("guests", field("heat").less_than(2.0))),
    "link to its own": ("Band", some_linked("born_of", field("genre").equals(value_of=outer("genre")))),
    "two links": ("Album", some_linked("guests", some_linked("born_of", field("name").exists()))),
    "facet": ("Act", some_linking("albums", field("live").equals(True))),
    "two facets": ("Solo", some_linking("offshoots", some_linking("albums"))),
    "there and back": ("Album", some_linked("by", some_linking("albums", field("id").not_equals(value_of=outer("id", 2))))),
    "facet there": ("Act", field("features").exists()),
    "facet not there": ("Act", field("features").missing()),
    "none linked": ("Album", none_linked("guests", field("genre").equals("opera"))),
    "none linking": ("Act", none_linking("albums", field("price").greater_than(2.0))),
    "either side of a join": ("Act", any_of(some_linking("albums", field("live").equals(False)), field("heat").equals(3.0), none_linking("features"))),
    "count": ("Act", aggregate("facet", "features", "count", "greater_than", 1)),
    "count none": ("Act", aggregate("facet", "albums", "count", "equals", 0)),
    "sum": ("Act", aggregate("facet", "albums", "sum", "greater_or_equal", 4.0, read="price")),
    "average": ("Act", aggregate("facet", "albums", "avg", "less_than", 2.5, read="price", where=field("live").exists())),
    "least": ("Album", aggregate("link", "guests", "min", "less_than", 2.0, read="heat")),
    "greatest of rows": ("Album", aggregate("row", "tracks", "max", "greater_than", 62.0, read="secs")),
    "rows counted": ("Album", aggregate("row", "tracks", "count", "equals", 2, where=field("secs").exists())),
    "another of the same name": ("Act", some_of(["Act"], field("name").equals(value_of=outer("name")), field("id").not_equals(value_of=outer("id")))),
    "another, blank or not": ("Act", some_of(["Act"], field("genre").equals(value_of=outer("genre")), field("heat").not_equals(value_of=outer("heat")))),
    "a hotter one of the genre": ("Act", some_of(["Act"], field("genre").equals(value_of=outer("genre")), field("heat").greater_than(value_of=outer("heat")))),
    "a dearer one anywhere": ("Album", some_of(["Album"], field("price").greater_than(value_of=outer("price")), field("live").equals(True))),
    "none cheaper": ("Album", c.Sub("of", ("Album",), all_of(field("price").less_than(value_of=outer("price"))), negate=True)),
    "two orders by key": ("Album", some_of(["Album"], field("live").equals(value_of=outer("live")), field("price").greater_or_equal(value_of=outer("price")), field("issued").less_than(value_of=outer("issued")))),
    "an order and another": ("Album", some_of(["Album"], field("by").not_equals(value_of=outer("by")), field("price").less_or_equal(value_of=outer("price")))),
    "no two orders": ("Album", c.none_of(["Album"], field("issued").greater_or_equal(value_of=outer("issued")), field("price").greater_than(value_of=outer("price")))),
    "two orders": ("Album", some_of(["Album"], field("price").greater_than(value_of=outer("price")), field("issued").less_than(value_of=outer("issued")))),
    "somewhere else": ("Solo", some_of(["Album"], field("price").equals(4.0))),
    "nowhere": ("Solo", c.Sub("of", ("Album",), all_of(field("price").equals(40.0)), negate=True)),
    "reaches": ("Band", reaches("born_of", field("genre").equals("folk"))),
    "reaches itself": ("Band", reaches("born_of", field("id").equals(value_of=outer("id")))),
    "reaches another type": ("Band", reaches("born_of", type_is_a("Solo"))),
    "is reached": ("Act", reaches("offshoots", field("heat").greater_than(3.0), facet=True)),
    "reaches none": ("Band", c.Sub("link", "born_of", all_of(field("genre").equals("jazz")), transitive=True, negate=True)),
    "how many it reaches": ("Band", aggregate("link", "born_of", "count", "greater_than", 2, transitive=True)),
    "stored": ("Album", c.from_dict([{"how": "link", "name": "by", "where": {"field": "id", "op": "equals", "value_of": "^by"}}, {"any_of": [{"field": "live", "op": "exists"}, {"field": "price", "op": "equals", "value": 1.0}]}])),
}


@pytest.fixture(scope="module")
def worlds(spark):
    out = []
    for seed in range(2):
        rows = graphs.music(seed)
        model = graphs.music_model(spark, rows)
        model.tables = {k: v.cache() for k, v in model.tables.items()}
        out.append((model, graphs.Plain(rows)))
    return out


@pytest.mark.parametrize("name", CONDITIONS)
def test_against_plain(worlds, name):
    types, where = CONDITIONS[name]
    for model, plain in worlds:
        got = [r["id"] for r in select(model, types, where).collect()]
        assert sorted(got) == sorted(plain.select(types, where))


def test_conditions_tell_apart(worlds):
    """What is tested above isn't empty or everything throughout."""
    for name, (types, where) in CONDITIONS.items():
        sizes = [(len(p.select(types, where)), len(p.select(types, None))) for _, p in worlds]
        assert any(n for n, _ in sizes) and (any(n < k for n, k in sizes) or name in ("somewhere else", "nowhere", "row against itself")), (name, sizes)


@pytest.mark.parametrize("seed", range(8))
def test_random_conditions(worlds, seed):
    """Trees of tests and sub-queries, three levels deep."""
    r = random.Random(seed)
    own = {"Act": [("genre", graphs.GENRES), ("heat", (1.0, 3.0)), ("name", ("Ox",))], "Album": [("price", (1.0, 3.0)), ("issued", (CUT,)), ("moods", ("m",))], "row": [("secs", (62.0, 64.0)), ("tone", "XY")]}
    ways = {"Act": [("facet", "albums", "Album"), ("facet", "features", "Album")], "Album": [("link", "by", "Act"), ("link", "guests", "Act"), ("row", "tracks", "row")], "row": [("link", "singer", "Act")]}

    def tree(kind, depth):
        if depth and r.random() < 0.6:
            if r.random() < 0.4:
                return r.choice([all_of, any_of])(*(tree(kind, depth - 1) for _ in range(2)))
            how, name, to = r.choice(ways[kind])
            return c.Sub(how, name, tree(to, depth - 1), negate=r.random() < 0.3)
        name, values = r.choice(own[kind])
        ops = ["equals", "not_equals", "exists", "missing"] + (["less_than", "greater_or_equal"] if name in ("heat", "price", "secs", "issued") else [])
        op = r.choice(ops)
        return c.Test(name, op, None if op in ("exists", "missing") else r.choice(values))

    model, plain = worlds[seed % 2]
    for kind in ("Album", "Act"):
        where = tree(kind, 3)
        assert {x["id"] for x in select(model, kind, where).collect()} == plain.select(kind, where), where


def test_no_products(worlds):
    """Sub-queries over unrelated entities are aggregates, sweeps and semi joins; what has no such form is refused."""
    model, _ = worlds[0]
    three = [field(n).not_equals(value_of=outer(n)) for n in ("price", "issued", "by")]
    with pytest.raises(ValueError, match="needs an equality"):
        select(model, "Album", some_of(["Album"], *three))
    for name in ("two orders", "two orders by key", "an order and another", "no two orders", "another of the same name", "another, blank or not", "a hotter one of the genre", "a dearer one anywhere", "none cheaper", "somewhere else", "nowhere", "reaches"):
        plan = select(model, *CONDITIONS[name])._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, (name, plan)


def test_order(worlds):
    model, plain = worlds[0]
    got = [r["id"] for r in order_entities(model.table("Album"), "price", "issued").collect()]
    key = lambda x: (x["price"] is None, x["price"] or 0, x["issued"] is None, x["issued"] or CUT, x["id"])
    assert got == [x["id"] for x in sorted(plain.of("Album"), key=key)]
    with pytest.raises(ValueError, match="several values"):
        order_entities(model.table("Album"), "moods")


def test_witness(worlds):
    model, plain = worlds[1]
    rows = some_row("tracks", field("secs").greater_than(63.0))
    want = {(x["id"], f"tracks/{i}") for x in plain.of("Album") for i, t in enumerate(x["tracks"] or []) if (t["secs"] or 0) > 63}
    assert {tuple(r) for r in match_items(model, "Album", rows).collect()} == want
    links = some_linked("guests", field("heat").exists())
    want = {(x["id"], y["id"]) for x in plain.of("Album") for y in plain.targets(x, "guests") if y["heat"] is not None}
    assert {tuple(r) for r in match_items(model, "Album", links).collect()} == want


def test_collect(worlds):
    model, plain = worlds[0]
    want = sorted({z["id"] for x in plain.of("Album") for y in plain.targets(x, "guests") for z in plain.targets(y, "born_of")})
    assert [r["id"] for r in c.collect(model, model.table("Album"), "Album", "guests", "born_of").collect()] == want


def test_mistakes(worlds):
    model, _ = worlds[0]
    for where, message in [
        (field("live").equals(value_of="issued"), "different kinds"),
        (field("price").equals(value_of=outer("price")), "levels out"),
        (field("live").less_than(False), "needs numbers"),
        (some_linked("label"), "no link"),
        (some_of(["Act"], field("heat").equals(value_of=outer("issued"))), "different kinds"),
    ]:
        with pytest.raises(ValueError, match=message):
            select(model, "Album", where)
