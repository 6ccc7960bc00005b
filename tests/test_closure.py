import random

import pytest

from linkframe.operators import closure as c
from linkframe.operators import history


def plain(edges):
    out = set(edges)
    while True:
        more = out | {(a, d) for a, b in out for x, d in edges if x == b}
        if more == out:
            return out
        out = more


@pytest.mark.parametrize("seed", range(3))
def test_closure(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(14)}
    df = spark.createDataFrame(sorted(edges), "src int, dst int")
    want = plain(edges)
    got = c.closure(df)
    assert {tuple(x) for x in got.collect()} == want
    assert {tuple(x) for x in c.closure(got).collect()} == want  # closing again changes nothing
    assert {x[0] for x in c.on_cycle(df).collect()} == {a for a, b in want if a == b}


def test_empty(spark):
    df = spark.createDataFrame([], "src int, dst int")
    assert c.closure(df).isEmpty() and c.on_cycle(df).isEmpty()


def test_first_parent(spark):
    commits = spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None) for i in range(50)] + [("x", "c3")], "commit string, parent string")
    got = [(r["commit"], r["hops"]) for r in c.first_parent(commits, "c40").collect()]
    assert got == [(f"c{40 - i}", i) for i in range(41)]


def test_first_parent_meets_few_rows(spark, monkeypatch):
    """A long chain among others, with branches, a parent that isn't there and a head in the middle: what is written is a few times the table, whatever its logarithm."""
    n, rows, real = 4000, [], c.saved
    monkeypatch.setattr(c, "CHAIN_ROWS", 1000, raising=False)
    monkeypatch.setattr(c, "saved", lambda df: (out := real(df), rows.append(out.count()))[0])
    commits = spark.range(2 * n).selectExpr("concat('c', id) AS commit", "CASE WHEN id % 7 = 6 AND id % 2 = 1 THEN concat('c', id - 1) WHEN id = 0 THEN 'gone' WHEN id = 1 THEN NULL ELSE concat('c', id - 2) END AS parent")
    got = [(r["commit"], r["hops"]) for r in c.first_parent(commits, f"c{2 * n - 4}").collect()]
    assert got == [(f"c{k}", i) for i, k in enumerate(range(2 * n - 4, -1, -2))] + [("gone", n - 1)]
    assert sum(rows) < 5 * 2 * n


def test_merge_base_and_history(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("f", "d"), ("f", "c")], "src string, dst string")
    base = lambda x, y: [r[0] for r in c.merge_base(parents, x, y).collect()]
    assert base("c", "d") == ["b"] and base("e", "f") == ["c"] and base("a", "a") == ["a"]
    commits = spark.createDataFrame([(x,) for x in "bcdef"], "commit string")
    assert [tuple(r) for r in c.check_history(commits, parents).collect()] == [("b", "a")]


def strong(edges):
    """Nodes that reach themselves, by the set of nodes on their cycles."""
    paths = plain(edges)
    return {frozenset(b for b in {x for e in edges for x in e} if (a, b) in paths and (b, a) in paths) for a, _ in paths if (a, a) in paths}


@pytest.mark.parametrize("seed", range(4))
def test_cycles_and_searches(spark, seed):
    """Components, searches backwards and forwards on random graphs with chains, rings and loops."""
    r = random.Random(seed)
    nodes = 9 + 5 * seed
    edges = {(r.randrange(nodes), r.randrange(nodes)) for _ in range(nodes + seed)} | {(i, i + 1) for i in range(50, 58)} | {(70, 71), (71, 72), (72, 70), (3, 50), (58, r.choice([3, 90]))}
    df = spark.createDataFrame([*sorted(edges), (None, 1), (1, None), (2, 2)][: None if seed % 2 else -1], "src int, dst int")
    edges |= {(2, 2)} if seed % 2 else set()
    got = {}
    for x in c.cycles(df).collect():
        got.setdefault(x["cycle"], set()).add(x["id"])
    assert set(map(frozenset, got.values())) == strong(edges) and all(k in v for k, v in got.items())
    paths = plain(edges)
    targets = r.sample(range(nodes), 3) + [72]
    found = [x[0] for x in c.reaching(df, spark.createDataFrame([(t,) for t in targets], "id int")).collect()]
    assert sorted(found) == sorted({a for a, b in paths if b in targets})
    roots = r.sample(range(nodes), 2) + [50, 51, 99]
    seen = [tuple(x) for x in c.reachable(df, spark.createDataFrame([(t,) for t in roots], "id int")).collect()]
    assert sorted(seen) == sorted({(a, b) for a, b in paths if a in roots} | {(t, t) for t in roots})


@pytest.mark.parametrize("seed", range(2))
def test_ways_that_never_part(spark, monkeypatch, capsys, seed):
    """One way on for each node, with tails, rings, loops and ways to nowhere: each pair once, and without rings none is compared with those known."""
    monkeypatch.setattr(c, "FOLLOWED", 1, raising=False)
    r, real = random.Random(seed), c.saved
    ways = {i: r.choice([i // 2, i // 2, 200 + i]) for i in range(1, 60)} | {60: 60, 90: 60} | {i: i - 1 for i in range(100, 120)}
    rings = {70: 71, 71: 72, 72: 70, 73: 70, 80: 81, 81: 80} | {i: 80 for i in range(82, 86)}

    def found(ways, roots):
        got = [tuple(x) for x in c.reachable(spark.createDataFrame([*ways.items(), *ways.items()], "src int, dst int"), spark.createDataFrame([(x,) for x in roots], "id int")).collect()]
        want = set()
        for x in roots:
            y = x
            while y is not None and (x, y) not in want:
                want.add((x, y))
                y = ways.get(y)
        assert sorted(got) == sorted(want)

    monkeypatch.setattr(c, "saved", lambda df: (df.explain(), real(df))[1])
    found(ways, [*ways, 999])
    assert "LeftAnti" not in capsys.readouterr().out
    found(ways | rings, [*range(1, 60, 7), 119, *rings, 90, 999])


def test_dependencies_meet_those_whole_only_if_they_can_be_there(spark, capsys):
    full = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "b")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("d",)], "id string")
    whole = {(x, y, "full") for x, y in ("aa", "ab", "ac", "dd", "db", "dc")}
    shown = lambda shallow: history.dependencies(roots, full, spark.createDataFrame(shallow, "src string, dst string"))
    got = shown([("a", "x"), ("b", "x"), ("c", None)])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*whole, ("a", "x", "read"), ("d", "x", "read"), ("a", None, "read"), ("d", None, "read")], key=str)
    got.explain()
    assert "LeftAnti" not in capsys.readouterr().out
    assert sorted(map(tuple, shown([("a", "b"), ("b", "d"), ("c", "x")]).collect())) == sorted([*whole, ("a", "d", "read"), ("a", "x", "read"), ("d", "x", "read")])


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    """A chain of 10,000 and a ring of 100,000: a few dozen checkpoints, not thousands, and no table of pairs."""
    n, made, real = 10_000, [], c.saved
    monkeypatch.setattr(c, "saved", lambda df: made.append(1) or real(df))
    chain = spark.range(n).selectExpr("id AS src", "id + 1 AS dst")
    assert c.reaching(chain, spark.createDataFrame([(n // 2,)], "id long")).count() == n // 2
    assert len(made) < 40
    made.clear()
    assert c.reachable(chain, spark.createDataFrame([(5,)], "id long")).count() == n - 4 and len(made) < 60
    made.clear()
    assert c.on_cycle(chain).isEmpty() and len(made) < 60
    made.clear()
    ring = spark.range(10 * n).selectExpr("id AS src", f"(id * 1 + 1) % {10 * n} AS dst")
    found = c.cycles(ring)
    assert found.count() == 10 * n and [r[0] for r in found.select("cycle").distinct().collect()] == [0] and len(made) < 60


def test_saved_tables_have_their_own_size(spark, capsys):
    """Joins in rounds don't multiply what Spark takes a table's size for."""
    now = spark.range(10).selectExpr("id", "id AS to")
    for _ in range(8):
        now = c.saved(now.join(now.selectExpr("id AS to", "to AS further"), "to").selectExpr("id", "further AS to"))
    now.explain("cost")
    assert "E+" not in capsys.readouterr().out


def test_short_rings_and_trees_take_few_rounds(spark, monkeypatch, capsys):
    """Rings of two and a tree of halves: rounds follow neither the number of rings nor the levels of the tree, and no table goes by way of the driver."""
    made, real = [], c.saved
    monkeypatch.setattr(c, "saved", lambda df: made.append(df.explain()) or real(df))
    rings = spark.range(4000).selectExpr("id", "id + 1 - 2 * (id % 2) AS to")
    got = c.jumped(rings).collect()
    assert all(r["to"] is None and r["low"] == r["id"] // 2 * 2 for r in got) and len(got) == 4000 and len(made) < 5
    made.clear()
    tree = spark.range(1, 4000).selectExpr("id AS src", "id DIV 2 AS dst")
    assert sorted(r["node"] for r in c.reachable(tree, spark.createDataFrame([(3999,)], "id long")).collect()) == sorted(3999 >> k for k in range(13)) and len(made) < 12
    made.clear()
    assert c.on_cycle(tree).isEmpty() and len(made) < 40
    assert "BroadcastHashJoin" not in capsys.readouterr().out
