"""Saved selections: rows that select entities, and values derived from one another."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkframe.functions.calc import order_of

from .closure import meet, saved

#: A table of at most so many new rows is sent to every task, so that what it is held against isn't shuffled.
SENT_ROWS = 100_000
#: Ranges that targets are put into where selections have nothing but an order test.
RANGES = 256
ORDERED = {"less_than": lambda a, b: a < b, "less_or_equal": lambda a, b: a <= b, "greater_than": lambda a, b: a > b, "greater_or_equal": lambda a, b: a >= b}
TESTS = ORDERED | {"equals": lambda a, b: a == b, "not_equals": lambda a, b: a != b}


def materialise(holders: DataFrame, specs: dict[str, Callable[[DataFrame], DataFrame]], order: dict[str, list[str]] | None = None, field: str = "scope") -> DataFrame:
    """(holder, field, result, pos): each holder's selection by its ``spec``; one correlated join per spec that is declared.

    A spec gets the holders that have it and returns (holder, id and the columns it is ordered by). pos follows the spec's order, then id.
    A spec that isn't declared is an error. Selections that differ in their values alone are one ``Shape`` instead, however many there are.
    """
    unknown = holders.where(F.col("spec").isNotNull() & ~F.col("spec").isin(*specs)).select("spec").first()
    if unknown:
        raise ValueError(f"unknown selection {unknown['spec']}")
    parts = [_placed(specs[s](holders.where(F.col("spec") == s)), (order or {}).get(s, []), field) for s in sorted(specs)]
    if not parts:
        return holders.sparkSession.createDataFrame([], "holder string, field string, result string, pos int")
    return reduce(lambda a, b: a.union(b), parts)


def _placed(got: DataFrame, order: list[str] | tuple[str, ...], field: str) -> DataFrame:
    by = [F.col(c).asc_nulls_last() for c in order]
    pos = F.row_number().over(Window.partitionBy("holder").orderBy(*by, "id")) - 1
    return got.withColumn("pos", pos).select("holder", F.lit(field).alias("field"), F.col("id").alias("result"), "pos")


@dataclass(frozen=True)
class Shape:
    """What selections have in common. ``links``: (column of the holder, column of the target) that are equal. ``tests``: (column of the target, test), each
    against the spec's parameter p0, p1, ... in turn. ``order``: columns of the target that results are ordered by."""

    links: tuple[tuple[str, str], ...] = ()
    tests: tuple[tuple[str, str], ...] = ()
    order: tuple[str, ...] = ()


def materialise_shape(holders: DataFrame, specs: DataFrame, targets: DataFrame, shape: Shape, field: str = "scope") -> DataFrame:
    """(holder, field, result, pos) as ``materialise``, for any number of selections of one shape: they are rows of a table and one plan tests them all.

    holders: holder, spec and the columns of the links. specs: spec, p0, p1, ...; a spec that is there twice is the union of both. targets: id and what the shape names.
    Links and equalities are the join's keys. Without any, the first order test is: targets are put into ``RANGES`` ranges, each spec meets those its
    parameter lets through, and only that at the edge has rows to drop. A null value or parameter passes no test. Holders of an unknown spec select nothing.
    """
    wanted = holders.select("holder", "spec", *[F.col(h).alias(f"__l{i}") for i, (h, _) in enumerate(shape.links)]).join(specs, "spec").drop("spec")
    there = targets.select("id", *[F.col(t).alias(f"__m{i}") for i, (_, t) in enumerate(shape.links)], *[F.col(t).alias(f"__t{i}") for i, (t, _) in enumerate(shape.tests)], *[F.col(c).alias(f"__o{i}") for i, c in enumerate(shape.order)])
    on = [F.col(f"__l{i}") == F.col(f"__m{i}") for i in range(len(shape.links))] + [F.col(f"__t{i}") == F.col(f"p{i}") for i, (_, op) in enumerate(shape.tests) if op == "equals"]
    if not on:
        first = next((i for i, (_, op) in enumerate(shape.tests) if op in ORDERED), None)
        if first is None:
            raise ValueError("a shape needs a link, an equality or an order test")
        cuts = there.select(F.expr(f"percentile_approx(CAST(__t{first} AS DOUBLE), array({', '.join(f'{k / RANGES}' for k in range(1, RANGES))}), 10000)")).first()[0] or []
        edges = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]).cast("array<double>")
        of = lambda c: F.size(F.filter(edges, lambda e: e <= F.col(c).cast("double")))
        last = F.lit(len(set(cuts)))
        up = shape.tests[first][1].startswith("greater")
        ranges = F.sequence(of(f"p{first}"), last) if up else F.sequence(F.lit(0), of(f"p{first}"))
        wanted = wanted.where(F.col(f"p{first}").isNotNull()).withColumn("__r", F.explode(ranges))
        there = there.where(F.col(f"__t{first}").isNotNull()).withColumn("__s", of(f"__t{first}"))
        on = [F.col("__r") == F.col("__s")]
    rest = [TESTS[op](F.col(f"__t{i}"), F.col(f"p{i}")) for i, (_, op) in enumerate(shape.tests) if op != "equals"]
    got = wanted.join(there, reduce(lambda a, b: a & b, on + rest)).select("holder", "id", *[f"__o{i}" for i in range(len(shape.order))]).distinct()
    return _placed(got, [f"__o{i}" for i in range(len(shape.order))], field)


def summarise_shape(holders: DataFrame, specs: DataFrame, targets: DataFrame, test: tuple[str, str]) -> DataFrame:
    """(holder, n, first): how many targets, and the least id, ``materialise_shape`` gives for a shape with nothing but one order test; holders without any have no row.

    No pairs are made. A target counts from its value that passes soonest, a holder by its spec's parameter that lets most through. Values and parameters lie in ranges; a
    running count inside each and the totals of the ranges before it give the answer. holders: holder, spec. specs: spec, p0. targets: id, the column of the test.
    """
    column, op = test
    up, sign = op.startswith("less"), F.lit(1.0 if op.startswith("less") else -1.0)
    nearest, widest = (F.min, F.max) if up else (F.max, F.min)
    values = targets.where(F.col(column).isNotNull()).groupBy("id").agg((sign * nearest(F.col(column).cast("double"))).alias("v")).groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    values = saved(values)
    asked = saved(holders.select("holder", "spec").join(specs.select("spec", "p0"), "spec").where("p0 is not null").groupBy("holder").agg((sign * widest(F.col("p0").cast("double"))).alias("v")))
    cuts = values.select(F.expr(f"percentile_approx(v, array({', '.join(f'{k / RANGES}' for k in range(1, RANGES))}), 10000)")).first()[0] or []
    edges = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]).cast("array<double>")
    place = F.size(F.filter(edges, lambda e: e <= F.col("v")))
    # of equal ones, values come first where the test lets equal ones through
    after = F.lit(2 if op.endswith("equal") else 0)
    none = F.lit(None).cast("string")
    points = asked.groupBy("v").agg(F.count("*").alias("__k")).select("v", F.lit(0).cast("long").alias("n"), none.alias("first"), after.alias("o"), F.lit(True).alias("asks"))
    rows = values.select("v", "n", "first", F.lit(1).alias("o"), F.lit(False).alias("asks")).union(points).withColumn("r", place)
    inside = Window.partitionBy("r").orderBy("v", "o").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("r", "v", "asks", F.sum("n").over(inside).alias("n"), F.min("first").over(inside).alias("first")).where("asks")
    before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # of one row a range
    totals = rows.groupBy("r").agg(F.sum("n").alias("n"), F.min("first").alias("first")).select("r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.min("first").over(before).alias("first0"))
    found = found.join(F.broadcast(totals), "r").select("v", (F.col("n") + F.col("n0")).alias("n"), F.least("first", "first0").alias("first")).where("n > 0")
    return meet(asked, found, "v").select("holder", "n", "first")


def reverse(edges: DataFrame) -> DataFrame:
    """(id, src): the facet back from results to holders."""
    return edges.select(F.col("result").alias("id"), F.col("holder").alias("src")).distinct()


def refused(reads: dict[str, set[tuple[str, bool]]]) -> set[str]:
    """Names whose loop passes through a negation or an aggregation, and all that read them. reads: name -> (name it reads, monotone)."""
    reach = {n: {m for m, _ in r} for n, r in reads.items()}
    while True:
        more = {n: r | {x for m in r for x in reach.get(m, ())} for n, r in reach.items()}
        if more == reach:
            break
        reach = more
    bad = {n for n, r in reads.items() for m, monotone in r if not monotone and n in reach.get(m, set()) | {m} and (m == n or n in reach.get(m, ()))}
    bad |= {n for n in reads if n in reach[n] and reach[n] & bad}
    return bad | {n for n in reads if reach[n] & bad}


def derive(base: dict[str, DataFrame], steps: dict[str, tuple[set[str], Callable[[dict[str, DataFrame]], DataFrame]]], recursive: dict[str, Callable[[dict[str, DataFrame], DataFrame], DataFrame]] | None = None, loops: set[str] = frozenset()) -> tuple[dict[str, DataFrame], set[str]]:
    """Derived tables in order of dependency, and the names refused.

    steps: name -> (what it reads, builder from the tables so far). ``recursive`` steps read themselves monotonely and run to a
    fixpoint of distinct rows: such a builder gets the tables and the rows that its own last round added, and gives the rows that follow with at least one of those, so
    a round's work follows what is new (a step that reads itself once puts the new rows in its own place). Rounds are appended; what is known isn't written again. ``loops``: names whose loop has no answer (see ``refused``); what reads them is refused too.
    """
    out, no = dict(base), set(loops)
    grown = True
    while grown:
        more = {n for n, (reads, _) in steps.items() if reads & no} - no
        no |= more
        grown = bool(more)
    for name in order_of({n: reads - {n} for n, (reads, _) in steps.items() if n not in no}):
        if not recursive or name not in recursive:
            out[name] = steps[name][1](out)
            continue
        new = saved(steps[name][1](out).distinct())
        parts = [new]
        while True:
            out[name] = reduce(lambda a, b: a.union(b), parts)
            new = unseen(recursive[name](out, new), out[name])
            if new.isEmpty():
                break
            parts.append(new)
    return out, no


def unseen(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct rows that ``known`` lacks. Few ones are sent to where the known are, which then aren't shuffled."""
    rows = saved(rows.select(known.columns).distinct())
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in known.columns])
    if rows.limit(SENT_ROWS + 1).count() > SENT_ROWS:
        return saved(meet(rows, known, same(rows, known), "left_anti"))
    few = F.broadcast(rows)
    seen = saved(known.join(few, same(known, few), "left_semi").distinct())
    return saved(meet(rows, seen, same(rows, seen), "left_anti"))
