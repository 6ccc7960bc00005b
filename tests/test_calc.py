"""Formulas against plain Python, where None is blank."""

import math
import random

import pytest
from graphs import tables
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkframe.functions import calc as k
from linkframe.operators.model import Model
from linkframe.registry import EntityType, Field, Registry

TANKS = Registry(
    EntityType(
        "Tank",
        (
            Field("level", "number"), Field("room", "number"), Field("fluid"), Field("open", "boolean"), Field("dips", "list", of="number"), Field("drains_to", "link", ("Tank",), reverse="fed_by"),
            Field("vents", "link", ("Tank",), many=True), Field("valves", "list", fields=(Field("bore", "number"), Field("leads_to", "link", ("Tank",)))),
        ),
    )
)


def rows(seed):
    r = random.Random(seed)
    maybe = lambda v: v if r.random() < 0.75 else None
    names = [f"T{i}" for i in range(30)]
    number = lambda: maybe(float(r.choice([0, 1, 2, 4, 7.5, -3])))
    return [
        {
            "id": n, "level": number(), "room": number(), "fluid": maybe(r.choice(["oil", "brine"])), "open": maybe(r.random() < 0.5), "dips": maybe([float(r.randrange(5)) for _ in range(r.randrange(4))]),
            "drains_to": maybe(r.choice([*names, "none"])), "vents": maybe(r.sample(names, r.randrange(4))), "valves": maybe([(number(), maybe(r.choice(names))) for _ in range(r.randrange(4))]),
        }
        for n in names
    ]


def both(f):
    """A function of values that is blank where one of them is."""
    return lambda *xs: None if any(x is None for x in xs) else f(*xs)


def and_(a, b):
    return False if a is False or b is False else None if a is None or b is None else True


#: name: (Column, plain value of a row)
FORMULAS = {
    "both together": (lambda: k.add(F.col("level"), F.col("room")), lambda x: both(lambda a, b: a + b)(x["level"], x["room"])),
    "what is free": (lambda: k.sub(F.col("room"), k.mul(F.col("level"), k.lit(3))), lambda x: both(lambda a, b: b - 3 * a)(x["level"], x["room"])),
    "share": (lambda: k.div(F.col("level"), F.col("room")), lambda x: both(lambda a, b: a / b if b else None)(x["level"], x["room"])),
    "below": (lambda: k.neg(F.col("level")), lambda x: both(lambda a: -a)(x["level"])),
    "same": (lambda: k.eq(F.col("level"), F.col("room")), lambda x: both(lambda a, b: a == b)(x["level"], x["room"])),
    "other": (lambda: k.ne(F.col("level"), F.col("room")), lambda x: both(lambda a, b: a != b)(x["level"], x["room"])),
    "less": (lambda: k.lt(F.col("level"), F.col("room")), lambda x: both(lambda a, b: a < b)(x["level"], x["room"])),
    "more": (lambda: k.gt(F.col("level"), F.col("room")), lambda x: both(lambda a, b: a > b)(x["level"], x["room"])),
    "at most": (lambda: k.le(F.col("level"), F.col("room")), lambda x: both(lambda a, b: a <= b)(x["level"], x["room"])),
    "at least": (lambda: k.ge(F.col("level"), F.col("room")), lambda x: both(lambda a, b: a >= b)(x["level"], x["room"])),
    "number is no text": (lambda: k.eq(F.col("level"), F.col("fluid"), same_kind=False), lambda x: both(lambda a, b: False)(x["level"], x["fluid"])),
    "number isn't text": (lambda: k.ne(F.col("level"), F.col("fluid"), same_kind=False), lambda x: both(lambda a, b: True)(x["level"], x["fluid"])),
    "number and text have no order": (lambda: k.ge(F.col("level"), F.col("fluid"), same_kind=False), lambda x: None),
    "which": (lambda: k.if_(F.col("open"), F.col("fluid"), k.lit("shut")), lambda x: both(lambda c: x["fluid"] if c else "shut")(x["open"])),
    "which, if any": (lambda: k.if_(F.col("open"), F.col("fluid")), lambda x: both(lambda c: x["fluid"] if c else "false")(x["open"])),
    "all": (lambda: k.and_(F.col("open"), k.gt(F.col("level"), k.lit(1))), lambda x: and_(x["open"], both(lambda a: a > 1)(x["level"]))),
    "any": (lambda: k.or_(F.col("open"), k.gt(F.col("level"), k.lit(1))), lambda x: both(lambda v: not v)(and_(both(lambda v: not v)(x["open"]), both(lambda a: a <= 1)(x["level"])))),
    "not": (lambda: k.not_(F.col("open")), lambda x: both(lambda v: not v)(x["open"])),
    "blank": (lambda: k.isblank(F.col("fluid")), lambda x: x["fluid"] is None),
    "blank list": (lambda: k.isblank(F.col("dips"), many=True), lambda x: not x["dips"]),
    "dips together": (lambda: k.sum_(k.values(F.col("dips"), many=(True,))), lambda x: sum(x["dips"] or [])),
    "dips": (lambda: k.count_(k.values(F.col("dips"), many=(True,))), lambda x: len(x["dips"] or [])),
    "middle dip": (lambda: k.avg_(k.values(F.col("dips"), many=(True,))), lambda x: sum(x["dips"]) / len(x["dips"]) if x["dips"] else None),
    "least dip or level": (lambda: k.min_(k.values(F.col("dips"), F.col("level"), many=(True, False))), lambda x: min([*(x["dips"] or []), *([] if x["level"] is None else [x["level"]])], default=None)),
    "widest valve": (lambda: k.max_(k.values(k.row_values(F.col("valves"), "bore"), many=(True,))), lambda x: max((v[0] for v in x["valves"] or [] if v[0] is not None), default=None)),
    "flow of valves": (
        lambda: k.sum_(k.values(k.row_values(k.row_calc(F.col("valves"), "flow", lambda v: k.mul(v["bore"], v["bore"])), "flow"), many=(True,))),
        lambda x: sum(v[0] ** 2 for v in x["valves"] or [] if v[0] is not None),
    ),
}


@pytest.mark.parametrize("seed", [1, 2])
def test_formulas(spark, seed):
    found = rows(seed)
    t = tables(spark, TANKS, {"Tank": found})["Tank"]
    got = {r["id"]: r for r in t.select("id", *[f().alias(n) for n, (f, _) in FORMULAS.items()]).collect()}
    for x in found:
        for name, (_, plain) in FORMULAS.items():
            a, b = got[x["id"]][name], plain(x)
            assert (a is None) == (b is None) and (a == b or isinstance(a, float) and math.isclose(a, b)), (name, x, a, b)


def test_paths(spark):
    """Values through a link, many links, a facet, and links of list rows."""
    found = rows(3)
    at = {x["id"]: x for x in found}
    m = Model(TANKS, tables(spark, TANKS, {"Tank": found}))
    t = m.tables["Tank"]
    one = k.through_link(t.select("id", "drains_to"), "drains_to", t, "level", "below")
    vents = m.edges("Tank", "vents").select("src", "dst")
    fed = m.facet("fed_by").select(F.col("id").alias("src"), F.col("src").alias("dst"))
    for name, agg in (("vent_sum", "sum"), ("vent_avg", "avg"), ("vent_most", "max")):
        one = k.through_many(one, vents, t, "level", name, agg)
    one = k.through_many(one, fed, t, "id", "feeders", "count")
    rows_ = {r["id"]: r["rooms"] for r in k.through_rows(t, "valves", "leads_to", t, "room", "rooms").collect()}
    for r in one.collect():
        x = at[r["id"]]
        far = [at[v]["level"] for v in x["vents"] or [] if at[v]["level"] is not None]
        assert r["below"] == at.get(x["drains_to"], {}).get("level")
        assert (r["vent_sum"], r["vent_most"]) == (sum(far), max(far, default=None)) and r["vent_avg"] == (pytest.approx(sum(far) / len(far)) if far else None)
        assert r["feeders"] == sum(y["drains_to"] == x["id"] for y in found)
        want = [at[v[1]]["room"] for v in x["valves"] or [] if v[1] and at[v[1]]["room"] is not None]
        assert rows_[x["id"]] == (want or None)


def test_infinite_is_blank(spark):
    got = spark.range(1).select(k.mul(F.lit(1e300), F.lit(1e300)).alias("a"), k.sub(F.lit(float("nan")), F.lit(2.0)).alias("b")).first()
    assert got["a"] is None and got["b"] is None


def test_order_and_loops():
    assert k.order_of({"total": {"net"}, "net": {"gross"}, "gross": set()}) == ["gross", "net", "total"]
    with pytest.raises(ValueError, match="x -> y -> x"):
        k.order_of({"x": {"y"}, "y": {"x"}})


def test_title_case(spark):
    cases = {"SpareWheelCover": "Spare Wheel Cover", "lord_of_the_dance": "Lord of the Dance", "HTTPPort": "HTTP Port", "log-in": "Log In", "the end": "The End", "": ""}
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    assert {r["s"]: r["t"] for r in df.select("s", k.title_case(F.col("s")).alias("t")).collect()} == cases


def test_shown_and_short(spark):
    h = "fedcba98" * 5
    df = spark.createDataFrame([(3.0, False, ["x", "y", "z"], h), (0.25, True, [], h + "-dirty"), (None, None, None, "fedcba98")], "n double, b boolean, l array<string>, h string")
    got = df.select(k.shown(F.col("n"), T.DoubleType()).alias("n"), k.shown(F.col("b"), T.BooleanType()).alias("b"), k.shown(F.col("l"), T.ArrayType(T.StringType())).alias("l"), k.short(F.col("h")).alias("h"))
    assert [tuple(r) for r in got.collect()] == [("3", "false", "x, y, z", "fedcba9"), ("0.25", "true", "", "fedcba9-dirty"), ("", "", "", "fedcba98")]


def test_single_value(spark):
    df = spark.createDataFrame([("p", 4), ("p", 4), ("q", 1), ("q", 9), ("r", None)], "k string, v int")
    assert sorted(map(tuple, k.single_value(df, "k", "v").collect())) == [("p", 4, False), ("q", None, True)]
