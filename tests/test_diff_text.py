import random

from pyspark.sql import functions as F

from linkframe.operators import alignment as al
from linkframe.operators import diff as d
from linkframe.operators import text as t

MD = """# One {#one}

A paragraph
on two lines.
```python
# no heading
~~~
[[X]]
```
- item
  goes on
- other

| a | b |
| c | d |
## Two
~~~
bare
~~~
"""


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "id string, text string")


def test_blocks(spark):
    got = [(r["kind"], r["key"]) for r in t.blocks(docs(spark, MD)).orderBy("n").collect()]
    assert got == [
        ("heading", "# One {#one}"), ("text", "A paragraph on two lines."), ("code", "```python\n# no heading\n~~~\n[[X]]\n```"), ("item", "- item goes on"), ("item", "- other"),
        ("row", "| a | b |"), ("row", "| c | d |"), ("heading", "## Two"), ("code", "~~~\nbare\n~~~"),
    ]
    assert t.blocks(docs(spark, "", None)).isEmpty()


def test_code_blocks_and_tags(spark):
    assert [(r["language"], r["line"]) for r in t.code_blocks(docs(spark, MD)).orderBy("line").collect()] == [("python", 5), ("none", 17)]
    got = t.tags(docs(spark, "# A {#ok}\n1. b {#fine-1}\ntext {#odd}\n## C {#Bad}\n"))
    assert sorted((r["tag"], r["problem"] is None) for r in got.collect()) == [("Bad", False), ("fine-1", True), ("odd", False), ("ok", True)]


def test_wikilinks(spark):
    got = t.wikilinks(docs(spark, "[[A]] [[B\\|label]] ![[C]]\n[[D#name:long]] [[#tag:number]] ![[#x]] [[]]\n![[E]]\n```\n[[F]]\n```\n"))
    rows = [(r["line"], r["embed"], r["target"], r["name"], r["local"], r["label"], r["mode"], r["alone"]) for r in got.orderBy("line", "at").collect()]
    assert rows == [
        (1, False, "A", "", "", "", "", False), (1, False, "B", "", "", "label", "", False), (1, True, "C", "", "", "", "", False),
        (2, False, "D", "name", "", "", "long", False), (2, False, "", "", "tag", "", "number", False), (3, True, "E", "", "", "", "", True),
    ]


def test_heading_numbers(spark):
    r = random.Random(5)
    levels = [r.randrange(1, 7) for _ in range(300)]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(levels)], "id string, line int, level int")
    counters, want = [0] * 7, []
    for x in levels:
        if x >= 2:
            counters[x] += 1
            counters[x + 1 :] = [0] * (6 - x)
        want.append(".".join(str(counters[i]) for i in range(2, x + 1)) if x >= 2 else "")
    assert [r["number"] for r in t.number_headings(df).orderBy("line").collect()] == want


def test_item_labels(spark):
    rows = [("p", "1", None, "L", 1, 4, 1), ("p", "2", None, "L", 2, 4, 1), ("p", "a", "2", "M", 3, 1, 2), ("p", "b", "2", "M", 4, 1, 2), ("p", "i", "b", "N", 5, 1, 3), ("p", "ii", "b", "N", 6, 1, 3)]
    df = spark.createDataFrame(rows, "page string, item string, parent string, list string, pos int, start int, depth int")
    assert {r["item"]: r["label"] for r in t.number_items(df).collect()} == {"1": "4", "2": "5", "a": "5(a)", "b": "5(b)", "i": "5(b)(i)", "ii": "5(b)(ii)"}
    def plain(n):
        return "" if n == 0 else plain((n - 1) // 26) + chr(97 + (n - 1) % 26)

    big = [1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 10**12, 2**62]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in big], "n long").select(t.letters(F.col("n"))).collect()] == list(map(plain, big))
    n = spark.range(1, 800).select("id", t.letters(F.col("id")).alias("a"), t.roman(F.col("id")).alias("r"))
    got = {r["id"]: (r["a"], r["r"]) for r in n.collect()}
    assert got[1] == ("a", "i") and got[26][0] == "z" and got[27][0] == "aa" and got[702][0] == "zz" and got[703][0] == "aaa" and got[494][1] == "cdxciv" and got[799][1] == "dccxcix"


def test_deep_items(spark):
    """Lists eight levels deep, several items a level; one item's parent isn't there."""
    r = random.Random(5)
    rows, want = [], {}

    def style(depth, n):
        return {2: chr(96 + n), 3: ["", "i", "ii", "iii", "iv", "v", "vi"][n]}.get(depth, str(n))

    def grow(parent, label, depth):
        start, name = r.randrange(1, 4), f"L{len(rows)}"
        for k in range(r.randrange(1, 3)):
            item = f"I{len(rows)}"
            want[item] = label + (style(depth, start + k) if depth == 1 else f"({style(depth, start + k)})")
            rows.append(("p", item, parent, name, len(rows), start, depth))
            if depth < 8:
                grow(item, want[item], depth + 1)

    grow(None, "", 1)
    rows.append(("p", "lost", "nobody", "L", 10**6, 1, 2))
    got = {x["item"]: x["label"] for x in t.number_items(spark.createDataFrame(rows, "page string, item string, parent string, list string, pos int, start int, depth int")).collect()}
    assert got == {**want, "lost": None} and any(x.count("(") == 7 for x in want.values())


def test_captions_citations_shift(spark):
    cap = spark.createDataFrame([("p", 1, "Figure", "x"), ("p", 2, "Table", ""), ("p", 3, "Figure", "x")], "page string, pos int, kind string, cid string")
    assert [(r["number"], r["first"]) for r in t.number_captions(cap).orderBy("pos").collect()] == [(1, True), (1, True), (2, False)]
    df = spark.createDataFrame([("p", 1, 2, False), ("p", 2, 1, True), ("p", 3, 5, True), ("p", 4, None, True)], "page string, pos int, level int, embedded boolean")
    assert [r["shown_level"] for r in t.shift_headings(df).orderBy("pos").collect()] == [2, 3, 6, None]


def test_text_diff(spark):
    old = docs(spark, "Same here.\n\nOne two three four.\n\nGone for good.\n\n```\na\nb\n```\n", "x")
    new = docs(spark, "Same   here.\n\nOne two three five.\n\nBrand new words now.\n\n```\na\nc\n```\n", "x")
    got = sorted((r["op"], r["old"] or "", r["new"] or "") for r in d.diff_text(old, new).where("id = '0'").collect())
    assert got == [("added", "", "Brand new words now."), ("changed", "One two three four.", "One two three five."), ("changed", "```\na\nb\n```", "```\na\nc\n```"), ("kept", "Same here.", "Same here."), ("removed", "Gone for good.", "")]
    words = d.diff_words(d.diff_text(old, new).where("op = 'changed'")).orderBy("old").collect()
    assert [(r["kept"], r["removed"], r["added"]) for r in words] == [(["One", "three", "two"], ["four."], ["five."]), (["```", "```", "a"], ["b"], ["c"])]


def test_blocks_with_one_best_partner(spark):
    """Two edited fences behind two new paragraphs, and two paragraphs alike: both of each are changed."""
    fence = lambda x: f"```\n{x}\n```"
    old = docs(spark, "\n\n".join([fence("a"), fence("b")]), "one two three four five six\n\none two three four five nine")
    new = docs(spark, "\n\n".join(["P q.", "R s.", "T u.", "V w.", fence("c"), fence("d")]), "one two three four five seven\n\none two three ten eleven twelve")
    got = [(r["id"], r["op"]) for r in d.diff_text(old, new).collect()]
    assert sorted(got) == [("0", "added")] * 4 + [("0", "changed")] * 2 + [("1", "changed")] * 2


def test_rising():
    """A longest chain, against all ways."""
    import itertools

    r = random.Random(2)
    for _ in range(80):
        n, m = r.randrange(5), r.randrange(5)
        fit = [(i, j) for i in range(n) for j in range(m) if r.random() < 0.4]
        got = al.rising(fit)
        best = max((len(x) for z in range(min(n, m) + 1) for x in itertools.combinations(sorted(fit), z) if all(a < c and b < e for (a, b), (c, e) in zip(x, x[1:]))), default=0)
        assert len(got) == best and set(got) <= set(fit) and all(a < c and b < e for (a, b), (c, e) in zip(got, got[1:]))


def test_aligned():
    """What is kept is equal and in order; whoever is once on both sides and in order is kept; runs pair as well as all pairs would."""
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.choice("abcdefghij") for _ in range(r.randrange(12))] for _ in range(2))
        got = al.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:]))
        assert bool(got) == bool(set(a) & set(b))
        words = [[" ".join(r.choice("pqrst") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(6))] for _ in range(2)]
        every = [(i, j) for i, x in enumerate(words[0]) for j, y in enumerate(words[1]) if al.alike(x, y)]
        assert len(al.paired(*words)) == len(al.rising(every))
        ops = al.compared(a, b)
        assert [x[1] for x in ops if x[1] is not None] == a and [x[2] for x in ops if x[2] is not None] == b
    numbers = list(range(3000))
    moved = [*numbers[:10], *numbers[20:], *numbers[10:20]]
    assert len(al.aligned(numbers, moved)) == 2990
    assert al.alike("a b c d", "a b x y") and not al.alike("a b c d", "b a x y") and not al.alike("```\nx\n```", "x") and al.alike("", "")


def test_long_runs(spark):
    """A run of 300 by 300 changed blocks, with one new one in front of 201 by 200, and a moved block."""
    para = lambda i, w: f"paragraph {i} says {w}"
    old = docs(spark, "\n\n".join(para(i, "this") for i in range(300)), "\n\n".join(para(i, "this") for i in range(200)), "x y\n\nfirst one here\n\nsecond two there")
    new = docs(spark, "\n\n".join(para(i, "that") for i in range(300)), "\n\n".join(["entirely new", *(para(i, "that") for i in range(200))]), "first one here\n\nsecond two there\n\nx y")
    got = {(r["id"], r["op"]): r["count"] for r in d.diff_text(old, new).groupBy("id", "op").count().collect()}
    assert got == {("0", "changed"): 300, ("1", "changed"): 200, ("1", "added"): 1, ("2", "kept"): 2, ("2", "removed"): 1, ("2", "added"): 1}


def test_runs_of_words(spark):
    df = spark.createDataFrame([(1, "The ceiling is 8 mA under any fault.", "The ceiling is 6 mA under a fault."), (2, "```\na\nb\nc\n```", "```\na\nx\ny\nc\n```"), (3, None, "new"), (4, "same", "same")], "id long, old string, new string")
    got = {r["id"]: [tuple(x) for x in r["runs"]] for r in d.diff_runs(df).collect()}
    assert got["1"] == [("kept", "The ceiling is"), ("removed", "8"), ("added", "6"), ("kept", "mA under"), ("removed", "any"), ("added", "a"), ("kept", "fault.")]
    assert got["2"] == [("kept", "```\na"), ("removed", "b"), ("added", "x\ny"), ("kept", "c\n```")] and got["3"] == [("added", "new")] and got["4"] == [("kept", "same")]


def test_pairs_stay_in_their_run(spark):
    """An edited paragraph before a kept one doesn't pair with one after it."""
    old = docs(spark, "one two three four\n\nkept words here\n\nfive six seven eight")
    new = docs(spark, "kept words here\n\none two three five\n\nfive six seven nine")
    got = sorted((r["op"], r["old"], r["new"]) for r in d.diff_text(old, new).where("op <> 'kept'").collect())
    assert got == [("added", None, "one two three five"), ("changed", "five six seven eight", "five six seven nine"), ("removed", "one two three four", None)]


SCHEMA = "id string, type string, title string, weight double, uses array<string>, steps array<struct<action:string,check:string>>"


def sides(spark):
    old = [("A", "Part", "t", 1.0, ["x", "y"], [("do", "see")]), ("B", "Part", " ", None, [], []), ("C", "Part", "c", 1.0, None, None), ("D", "Part", "d", 2.0, ["p", "q"], None)]
    new = [("A", "Part", "t", 2.0, ["y", "y"], [("do", "look"), ("more", None)]), ("B", "Part", None, None, None, None), ("C", "Report", "c", 1.0, None, None), ("E", "Part", "e", 1.0, None, None), ("D", "Part", "d", 2.0, ["q", "p"], None)]
    return spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)


def test_entity_diff(spark):
    old, new = sides(spark)
    ops = lambda a, b: {r["id"]: r["op"] for r in d.diff(a, b).collect()}
    assert ops(old, new) == {"A": "changed", "C": "retyped", "D": "changed", "E": "added"}
    assert ops(new, old) == {"A": "changed", "C": "retyped", "D": "changed", "E": "removed"}
    assert ops(old, old) == {}
    assert {r["id"]: r["derived"] for r in d.diff(old, new, derived=("uses",)).collect()}["D"] is True
    lists = {r["id"]: (r["lost"], r["gained"], r["reordered"]) for r in d.diff_list(old, new, "uses").collect()}
    assert lists == {"A": (["x"], ["y"], False), "D": ([], [], True)}
    rows = sorted((r["pos"], r["cell"], r["old"], r["new"]) for r in d.diff_rows(old, new, "steps").collect())
    assert rows == [(0, "check", "see", "look"), (1, "action", None, "more")]


def test_same_buckets_never_meet(spark):
    """Of 100,000 entities with few changes some dozens meet; what differs is found all the same."""
    old = spark.range(100_000).selectExpr("concat('E', id) AS id", "'T' AS type", "id * 2 AS n", "array(id, id) AS l")
    new = old.where("id <> 'E7'").selectExpr("id", "type", "CASE WHEN id = 'E99' THEN NULL ELSE n END AS n", "l").union(spark.createDataFrame([("new", "T", 1, [2])], "id string, type string, n long, l array<bigint>"))
    a, b = d.differing(old, new)
    assert 2 <= a.count() < 30 and 2 <= b.count() < 30
    assert {(r["id"], r["op"]) for r in d.diff(old, new).collect()} == {("E7", "removed"), ("E99", "changed"), ("new", "added")}
    assert d.diff(old, old).isEmpty() and d.differing(old, old)[0].isEmpty()


def test_files(spark):
    side = lambda *x: spark.createDataFrame([(p, c) for p, c in x], "path string, content binary")
    got = d.diff_files(side(("a", b"x\r\ny"), ("b", b"\xff\r\n"), ("c", b"1")), side(("a", b"x\ny"), ("b", b"\xff\n"), ("d", b"1")))
    assert {r["path"]: r["op"] for r in got.collect()} == {"b": "changed", "c": "removed", "d": "added"}
