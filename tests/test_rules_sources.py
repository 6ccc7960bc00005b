import hashlib
import json
import random

import graphs
import pytest
from pyspark.sql import functions as F

from linkframe import sinks
from linkframe.operators import history, selections
from linkframe.operators.cond import all_of, any_of, field, some_linked, some_of, some_row
from linkframe.operators.model import Model, collect_facet
from linkframe.plans import rules
from linkframe.registry import EntityType, Field, Registry
from linkframe.sources import delimited as s
from linkframe.sources import records


def messages(df):
    return sorted((r["rule"], r["entity"], r["message"]) for r in df.collect())


#: check -> (a table with one violation, a clean one)
WIDGET = Registry(EntityType("Base", (Field("title", title=True, required=True),), abstract=True), EntityType("Widget", (Field("status", "enum", values=("draft", "done")), Field("tags", "list", of="string"), Field("steps", "list", fields=(Field("n", "number", required=True),)), Field("parent", "link", ("Widget",), reverse="children"), Field("score", "number", calculated=True)), extends="Base", prefix="WID"))
SCHEMA = "id string, title string, status string, tags array<string>, steps array<struct<n:double>>, parent string"


def widget(spark, **kw):
    row = {"id": "WID-0001", "title": "t", "status": "draft", "tags": ["a"], "steps": [(1.0,)], "parent": None} | kw
    return spark.createDataFrame([tuple(row.values())], SCHEMA)


def model(df):
    return Model(WIDGET, {"Widget": df})


CHECKS = {
    "schema/required": (lambda sp, bad: rules.required(widget(sp, title=" " if bad else "t"), WIDGET.fields("Widget"))),
    "schema/enum-value": (lambda sp, bad: rules.enum_values(widget(sp, status="odd" if bad else None), WIDGET.fields("Widget"))),
    "schema/id-format": (lambda sp, bad: rules.id_format(widget(sp, id="WID-1" if bad else "WID-0001"), "WID")),
    "links/unresolved": (lambda sp, bad: rules.unresolved(model(w := widget(sp, parent="WID-9" if bad else "WID-0001")).all_edges(), w)),
    "links/target-type": (lambda sp, bad: rules.wrong_target(model(widget(sp, parent="X")).all_edges(), sp.createDataFrame([("X", "Other" if bad else "Widget")], "id string, type string"), WIDGET)),
    "schema/unknown-type": (lambda sp, bad: rules.unknown_type(sp.createDataFrame([("a", "Nope" if bad else "Widget")], "id string, type string"), WIDGET)),
    "schema/abstract-type": (lambda sp, bad: rules.abstract_type(sp.createDataFrame([("a", "Base" if bad else "Widget")], "id string, type string"), WIDGET)),
    "schema/unknown-field": (lambda sp, bad: rules.unknown_keys(sp.createDataFrame([("a", ["title", "odd" if bad else "tags"])], "id string, keys array<string>"), WIDGET.fields("Widget"))),
    "schema/calculated-set": (lambda sp, bad: rules.unknown_keys(sp.createDataFrame([("a", ["score"] if bad else [])], "id string, keys array<string>"), WIDGET.fields("Widget"))),
    "schema/list-row": (lambda sp, bad: rules.unknown_row_keys(sp.createDataFrame([("a", 0, ["n", "m"] if bad else ["n"])], "id string, pos int, keys array<string>"), "steps", (Field("n", "number"),))),
    "schema/unused-type": (lambda sp, bad: rules.unused(Registry(EntityType("A"), EntityType("B")), sp.createDataFrame([("a", "A"), ("b", "A" if bad else "B")], "id string, type string"))),
    "schema/unused-enum": (lambda sp, bad: rules.unused_enum_values(sp.createDataFrame([("draft",), ("draft" if bad else "done",)], "status string"), WIDGET.field("Widget", "status"))),
    "schema/invalid-value": (lambda sp, bad: rules.invalid_values(sp.createDataFrame([("a", None if bad else 1.0, "x")], "id string, n double, n__raw string"), ["n"])),
    "content/duplicate-id": (lambda sp, bad: rules.duplicate_ids(sp.createDataFrame([("a", "p"), ("a" if bad else "b", "q")], "id string, path string"))),
    "content/embed": (lambda sp, bad: rules.misplaced_embeds(sp.createDataFrame([("a", "see ![[b]]" if bad else "![[b]]")], "id string, text string"))),
    "content/embed-cycle": (lambda sp, bad: rules.embed_cycles(sp.createDataFrame([("a", "b"), ("b", "a" if bad else "c")], "src string, dst string"))),
    "content/unrendered-block": (lambda sp, bad: rules.block_languages(sp.createDataFrame([("a", "```query\n```" if bad else "```python\n```")], "id string, text string"), ("query",))),
    "content/image": (lambda sp, bad: rules.assets(sp.createDataFrame([("a", "![x](i.png) ![y](data:1)")], "id string, text string"), sp.createDataFrame([("j.png" if bad else "i.png",)], "path string"))),
    "content/tag": (lambda sp, bad: rules.duplicate_tags(sp.createDataFrame([("a", "T", "x", 1), ("a", "T", "x" if bad else "y", 2)], "id string, type string, tag string, line int"), sp.createDataFrame([("T", "z")], "type string, name string"))),
    "content/caption": (lambda sp, bad: rules.misplaced_markers(sp.createDataFrame([("a", ("words\n\n" if bad else "| a |\n\n") + "```caption\nkind: Table\n```")], "id string, text string"))),
    "links/reference": (lambda sp, bad: rules.text_references(sp.createDataFrame([("a", "[[b]]" if bad else "[[a#t]]")], "id string, text string"), sp.createDataFrame([("a",)], "id string"), sp.createDataFrame([("a", "t")], "owner string, name string"))),
}


@pytest.mark.parametrize("check", sorted(CHECKS))
def test_check(spark, check):
    """One violation and one clean example per check."""
    bad = CHECKS[check](spark, True).collect()
    assert {r["rule"] for r in bad} == {check} and len(bad) == (2 if check == "content/duplicate-id" or check == "content/embed-cycle" else 1)
    assert CHECKS[check](spark, False).isEmpty()


def test_rules(spark):
    rows = graphs.music(4)
    m, plain = graphs.music_model(spark, rows), graphs.Plain(rows)
    loud = some_linked("guests", field("genre").equals("noise"))
    r = rules.Rule("no-noise", "error", "has a noisy guest", ("Album",), loud)
    want = plain.select("Album", loud)
    assert want and {x[1] for x in messages(rules.run_rule(r, m))} == want
    places = {(x["id"], f"guests {y['id']}") for x in plain.of("Album") for y in plain.targets(x, "guests") if y["genre"] == "noise"}
    assert {(x["entity"], x["at"]) for x in rules.place(r, m).collect()} == places
    row = rules.Rule("r", "warning", "m", ("Album",), some_row("tracks", field("tone").equals("Z")))
    places = {(x["id"], f"tracks/{i}") for x in plain.of("Album") for i, t in enumerate(x["tracks"] or []) if t["tone"] == "Z"}
    assert places and {(x["entity"], x["at"]) for x in rules.place(row, m).collect()} == places
    either = rules.Rule("e", "warning", "m", ("Album",), any_of(field("price").equals(3.0), all_of(field("live").equals(True))))
    got = {x["entity"]: x["at"] for x in rules.place(either, m).collect()}
    assert got == {x["id"]: "price" if x["price"] == 3 else "live" for x in plain.of("Album") if x["price"] == 3 or x["live"]}
    same = rules.Rule("s", "error", "dear ones", ("Solo",), some_of(["Album"], field("price").equals(4.0)))
    dear = ", ".join(sorted(x["id"] for x in plain.of("Album") if x["price"] == 4))
    assert dear and {x[2] for x in messages(rules.run_rule(same, m))} == {f"dear ones: {dear}"}
    with pytest.raises(ValueError):
        rules.Rule("x", "fatal", "m", ("A",), field("a").exists())


def test_reports(spark, tmp_path):
    v = rules.union(CHECKS["schema/required"](spark, True), CHECKS["schema/unused-type"](spark, True))
    assert not rules.gate(v) and rules.gate(CHECKS["schema/unused-type"](spark, True))
    assert tuple(rules.totals(v).first()) == (1, 1)
    sinks.write_json(v, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j/violations")).count() == 2 and spark.read.json(str(tmp_path / "j/summary")).first()["version"] == 1
    sinks.write_text(v, str(tmp_path / "t"))
    assert ": error [schema/required] title is required (WID-0001)" in {r[0] for r in spark.read.text(str(tmp_path / "t")).collect()}
    catalogue = spark.createDataFrame([("schema/required", False), ("a", False), ("b", True)], "rule string, skipped boolean")
    assert {r["rule"]: r["result"] for r in rules.rule_results(v, catalogue).collect()} == {"schema/required": "failed", "a": "passed", "b": "skipped"}


def test_delimited(spark, tmp_path):
    reg = Registry(EntityType("Item", (Field("title", column="Name"), Field("n", "number"), Field("on", "boolean"), Field("day", "date"), Field("tags", "list", of="string"), Field("to", "link", ("Item",), many=True), Field("gone"))))
    (tmp_path / "a.csv").write_text('id,Name,n,on,day,tags,to,extra\nA,"x, ""y""\nz",1e3,TRUE,2026-02-28,a; ;b,B;C,1\n B ,b,0x10,yes,2026-02-30,,,2\n,none,,,,,,3\nC,too,few\nD,1,2,3,4,5,6,7,8\nE,,,,,,,\n')
    rows, problems = s.read_entities(spark, str(tmp_path / "a.csv"), reg, "Item")
    got = {r["id"]: r for r in rows.collect()}
    assert sorted(got) == ["A", "B", "E"]
    a, b, e = got["A"], got["B"], got["E"]
    assert a["title"] == 'x, "y"\nz' and a["n"] == 1000.0 and a["on"] is True and str(a["day"]) == "2026-02-28" and a["tags"] == ["a", "b"] and a["to"] == ["B", "C"] and a["n__raw"] is None
    assert (b["n"], b["n__raw"], b["on"], b["on__raw"], b["day"], b["day__raw"]) == (None, "0x10", None, "yes", None, "2026-02-30")
    assert e["title"] is None and e["tags"] is None and e["n__raw"] is None
    found = sorted(r["message"] for r in problems.collect())
    assert found == ["column extra is not read", "field gone has no column", "the row has no id", "the row has the wrong number of cells", "the row has the wrong number of cells"]


def test_header_per_file(spark, tmp_path):
    """Columns by each file's own header; headers in error give no rows; a quoted line end belongs to its name."""
    reg = Registry(EntityType("Item", (Field("title"), Field("size", "number"), Field("two\nlines", column="two\nlines"))))
    files = {
        "a.csv": "id,title,size\nP-1,one,3\n", "b.csv": "\ufeffid,size,title\r\nP-2,4,two\r\n", "c.csv": "title,title,id\nx,y,P-3\n", "d.csv": "title,size\nx,1\n",
        "e.csv": 'id,"two\nlines","a ""b"""\nP-4,z,1\n', "f.csv": "", "g.csv": "id,title,size\nP-5,five,x\n",
    }
    for name, x in files.items():
        (tmp_path / name).write_bytes(x.encode())
    rows, problems = s.read_entities(spark, str(tmp_path), reg, "Item")
    got = {r["id"]: (r["title"], r["size"], r["size__raw"], r["two\nlines"]) for r in rows.collect()}
    assert got == {"P-1": ("one", 3.0, None, None), "P-2": ("two", 4.0, None, None), "P-4": (None, None, None, "z"), "P-5": ("five", None, "x", None)}
    found = {(r["path"].rpartition("/")[2], r["message"]) for r in problems.where("severity = 'error'").collect()}
    assert found == {("c.csv", "column title is there twice"), ("d.csv", "there is no column id for the id"), ("f.csv", "the file has no header")}
    assert ("e.csv", 'column a "b" is not read') in {(r["path"].rpartition("/")[2], r["message"]) for r in problems.collect()}


def plain_records(text):
    """(line, record) of a delimited text, quote by quote; what begins with a quote that never ends is left out."""
    out, begin, line, inside, now = [], 1, 1, False, ""
    for ch in text:
        if ch == "\n" and not inside:
            out.append((begin, now.removesuffix("\r")))
            begin, now = line + 1, ""
        else:
            now += ch
        inside ^= ch == '"'
        line += ch == "\n"
    out += [(begin, now.removesuffix("\r"))] if not inside else []
    return [(a, b) for a, b in out if b]


def test_records_across_blocks(spark, tmp_path):
    """Files cut into blocks of 64 bytes: quoted line ends across blocks, doubled quotes, a cell that never ends, all with the right lines, in many tasks."""
    r = random.Random(4)
    cell = lambda: r.choice(["a", "", "bcd", '"x,y"', '"l1\nl2"', '"say ""hi"""', '"' + "long\n" * r.randrange(1, 40) + '"', '""'])
    for k in range(4):
        body = "".join(",".join(cell() for _ in range(3)) + r.choice(["\n", "\r\n", "\n\n"]) for _ in range(120))
        (tmp_path / f"f{k}.csv").write_bytes((("\ufeff" if k == 1 else "") + "\n" * (k == 2) + "id,title,size\n" + body + ('z,"open\nto the end,1\n2,3,4\n' if k == 3 else "")).encode())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    try:
        found, files = records.records(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 8
        names = {x["file"]: (x["path"].rpartition("/")[2], x["header"], x["broken"]) for x in files.collect()}
        got = sorted((names[x["file"]][0], x["line"], x["text"]) for x in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = []
    for k in range(4):
        every = plain_records((tmp_path / f"f{k}.csv").read_bytes().decode())
        want += [(f"f{k}.csv", a, b) for a, b in every[1:]]
    assert got == sorted(want) and all(h == ["id", "title", "size"] for _, h, _ in names.values())
    assert [n for n, _, broken in names.values() if broken] == ["f3.csv"]


def test_lines_of_problems(spark, tmp_path):
    reg = Registry(EntityType("Item", (Field("title"),)))
    (tmp_path / "a.csv").write_text('id,title\nA,"x\ny"\nB\n,none\nC,"a"b\nD,"' + "long, " * 50_000 + '"\nE,"never\nends\n')
    rows, problems = s.read_entities(spark, str(tmp_path), reg, "Item")
    assert sorted((r["id"], r["title"], r["line"]) for r in rows.collect()) == [("A", "x\ny", 2), ("D", "long, " * 50_000, 7)]
    assert sorted((r["line"], r["message"]) for r in problems.collect()) == [(4, "the row has the wrong number of cells"), (5, "the row has no id"), (6, "a quote is out of place"), (8, "a quoted cell doesn't end")]


def test_many_headers(spark, tmp_path):
    """A thousand files, each with columns in an order of its own: one scan, and a plan that doesn't grow with them."""
    reg = Registry(EntityType("Item", (Field("title"), Field("size", "number"))))
    for i in range(1000):
        names = [f"extra{i}", "id", "size", "title"] if i % 2 else ["title", f"extra{i}", "size", "id"]
        cells = {"id": f"P{i}", "title": f"t{i}", "size": str(i), f"extra{i}": "e"}
        (tmp_path / f"f{i}.csv").write_text(",".join(names) + "\n" + ",".join(cells[n] for n in names) + "\n")
    rows, problems = s.read_entities(spark, str(tmp_path), reg, "Item")
    assert sorted((r["id"], r["title"], r["size"]) for r in rows.collect()) == sorted((f"P{i}", f"t{i}", float(i)) for i in range(1000))
    assert problems.where("message LIKE 'column extra% is not read'").count() == 1000


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("a", "p"), ("a", "p"), ("b", "p"), ("b", "q"), ("b", None), ("c", "r")], "id string, path string")
    assert messages(rules.duplicate_ids(df)) == [("content/duplicate-id", "a", "id a is also in p")] * 2 + [("content/duplicate-id", "b", "id b is also in p"), ("content/duplicate-id", "b", "id b is also in p, q"), ("content/duplicate-id", "b", "id b is also in q")]


def test_duplicate_of_a_hot_id(spark):
    """A message of bounded length, however many copies there are."""
    rows = spark.range(3000).selectExpr("'hot' AS id", "concat('p', lpad(id % 1500, 4, '0')) AS path").union(spark.createDataFrame([("one", "p")], "id string, path string"))
    got = rules.duplicate_ids(rows)
    assert got.count() == 3000 and got.selectExpr("max(length(message))").first()[0] < 120
    texts = {r["message"] for r in got.collect()}
    ten = lambda skip: ", ".join([f"p{i // 2:04d}" for i in range(20) if i != skip][:10])
    assert texts == {f"id hot is also in {ten(k)} and 2989 more" for k in (0, 2, 4, 6, 8, 10)} | {f"id hot is also in {ten(None)} and 2989 more"}
    assert rules.duplicate_paths(rows).where("n = 2 AND copies = 3000").count() == 1500


def test_unused(spark):
    """Types that link out, or are linked to, or have subtypes with entities, are used; named enums and records are if some field has them."""
    row = (Field("n", "number"),)
    reg = Registry(
        EntityType("Top", abstract=True), EntityType("Has", extends="Top"), EntityType("Out", (Field("to", "link", ("Aim",)),)), EntityType("Aim"), EntityType("Idle", (Field("s", "enum", values=("x", "y")), Field("l", "list", fields=row))),
        EntityType("RowOut", (Field("l", "list", fields=(Field("to", "link", ("Aim",)),)),)), enums={"Known": ("x", "y"), "Spare": ("z",)}, records={"Row": row, "Other": (Field("m"),)},
    )
    got = rules.unused(reg, spark.createDataFrame([("h", "Has")], "id string, type string"))
    assert messages(got) == [("schema/unused-enum", None, "enum Spare is not used"), ("schema/unused-record", None, "record Other is not used"), ("schema/unused-type", None, "type Idle is not used")]


def test_header_and_encoding(spark, tmp_path):
    got = s.audit_header(spark, ["x", "x", "title"], (Field("title"),), "id")
    assert sorted((r["severity"], r["name"]) for r in got.collect()) == [("error", "id"), ("error", "x"), ("warning", "x")]
    (tmp_path / "ok.csv").write_bytes("é\n".encode())
    (tmp_path / "bad.csv").write_bytes(b"a\nb\n\xff\n")
    got = s.check_encoding(spark, str(tmp_path)).collect()
    assert [(r["path"].rpartition("/")[2], r["line"]) for r in got] == [("bad.csv", 3)]


def test_corpus(spark, tmp_path):
    texts = {"a.md": '---\nid: A\ntype: "T"\nx: 1\n---\nbody\n', "b.md": "---\nid: B\n---\n", "c.md": "no header", "d.md": "---\r\nid: D\r\ntype: T\r\n---\r\nhi", "e.md": "---\nid: \ntype: T\n---\n"}
    for name, x in texts.items():
        (tmp_path / name).write_bytes(x.encode())
    entities, problems = s.read_corpus(spark, str(tmp_path))
    assert sorted((r["id"], r["type"], r["body"]) for r in entities.collect()) == [("A", "T", "body\n"), ("D", "T", "hi")]
    assert sorted(r["message"] for r in problems.collect()) == ["id must be a non-empty string", "the header has an id but no type"]


def test_history(spark):
    v = spark.createDataFrame([(1, "A", "p", "x"), (2, "A", "p", "x"), (3, "A", "p", "y"), (4, "A", "p", None), (4, "A", "q", "y")], "seq int, id string, path string, text string")
    got = history.changes(v)
    assert sorted(map(tuple, got.collect())) == [(1, "A", "p", "added"), (3, "A", "p", "changed"), (4, "A", "p", "removed"), (4, "A", "q", "added")]
    found = got.withColumn("type", F.lit("T")).withColumn("commit", F.col("seq").cast("string"))
    inputs = spark.createDataFrame([("path", "q"), ("entity", "Z")], "kind string, value string")
    assert [r["seq"] for r in history.revisions(found, inputs).collect()] == [4]
    dirty = spark.createDataFrame([("A",), ("N",)], "id string")
    assert sorted(map(tuple, history.last_changed(found, "id", dirty).collect())) == [("A", "4-dirty"), ("N", "uncommitted")]
    files = spark.createDataFrame([("s", "blob", "b", b"2"), ("s", "blob", "a", b"1"), ("s", "blob", ".signatures/x", b"0")], "snapshot string, kind string, path string, content binary")
    want = hashlib.sha256(b"v1\nblob\0a\x001\x001blob\0b\x001\x002").hexdigest()
    assert history.content_hash_framed(files, "v1\n").first()["hash"] == "sha256:" + want
    assert history.content_hash(files).first()["hash"] == history.content_hash(files.where("path <> '.signatures/x'")).first()["hash"]


def test_selections(spark):
    reqs = spark.createDataFrame([("REQ-0001", "approved", 3.0, None), ("REQ-0002", "approved", 1.0, None), ("REQ-0003", "draft", 2.0, "REQ-0002")], "id string, status string, order double, parent string")
    holders = spark.createDataFrame([("DOC-1", "approved", None), ("DOC-2", "covers", "REQ-0002")], "holder string, spec string, covers string")
    specs = {
        "approved": lambda h: h.crossJoin(reqs.where("status = 'approved'")).select("holder", "id", "order"),
        "covers": lambda h: h.join(reqs, (F.col("id") == F.col("covers")) | (F.col("parent") == F.col("covers"))).select("holder", "id", "order"),
    }
    got = selections.materialise(holders, specs, {"approved": ["order"]})
    assert sorted((r["holder"], r["pos"], r["result"]) for r in got.collect()) == [("DOC-1", 0, "REQ-0002"), ("DOC-1", 1, "REQ-0001"), ("DOC-2", 0, "REQ-0002"), ("DOC-2", 1, "REQ-0003")]
    assert selections.reverse(got).count() == 3 + 1
    with pytest.raises(ValueError, match="unknown selection"):
        selections.materialise(holders, {"approved": specs["approved"]})
    assert selections.refused({"a": {("b", False)}, "b": {("a", True)}, "c": {("a", True)}, "d": {("d", True)}}) == {"a", "b", "c"}


def test_ten_thousand_selections(spark):
    """Each holder has its own selection; a null parameter and an unknown spec select nothing; the plan is one join."""
    n = 10_000
    holders = spark.range(n).selectExpr("concat('H', id) AS holder", "concat('S', id) AS spec", "id % 50 AS k").union(spark.createDataFrame([("H-", "none", 1)], "holder string, spec string, k long"))
    specs = spark.range(n).selectExpr("concat('S', id) AS spec", "CASE WHEN id % 10 = 3 THEN NULL ELSE CAST(id AS DOUBLE) / 100 END AS p0")
    targets = spark.range(200).selectExpr("concat('T', id) AS id", "id % 50 AS k", "CAST(id AS DOUBLE) AS v").union(spark.createDataFrame([("T-", 1, None)], "id string, k long, v double"))
    got = selections.materialise_shape(holders, specs, targets, selections.Shape(links=(("k", "k"),), tests=(("v", "greater_or_equal"),), order=("v",)))
    want = {(f"H{i}", j, f"T{t}") for i in range(n) if i % 10 != 3 for j, t in enumerate(t for t in range(200) if t % 50 == i % 50 and t >= i / 100)}
    assert {(r["holder"], r["pos"], r["result"]) for r in got.collect()} == want
    some = specs.where("p0 > 98")
    got = selections.materialise_shape(holders, some, targets, selections.Shape(tests=(("v", "greater_than"),)))
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert {(r["holder"], r["result"]) for r in got.collect()} == {(f"H{i}", f"T{t}") for i in range(9801, n) if i % 10 != 3 for t in range(200) if t > i / 100}
    with pytest.raises(ValueError, match="a shape needs"):
        selections.materialise_shape(holders, specs, targets, selections.Shape(tests=(("v", "not_equals"),)))


def test_rounds_take_what_is_new(spark, monkeypatch):
    """Each round of a derivation gets the rows of the last one alone; large rounds go the way by a shuffle; nulls are equal."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(6, 3), (None, 0), (None, 0)], "src int, dst int")
    for limit in (selections.SENT_ROWS, 0):
        monkeypatch.setattr(selections, "SENT_ROWS", limit)
        sizes = []

        def again(t, new):
            sizes.append(new.count())
            return new.select("src", F.col("dst").alias("via")).join(t["edges"].select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")

        out, _ = selections.derive({"edges": edges}, {"path": ({"edges", "path"}, lambda t: t["edges"])}, {"path": again})
        got = [tuple(r) for r in out["path"].collect()]
        far = {(a, b) for a in range(7) for b in range(7) if b > a or (a >= 3 and b >= 3)} | {(None, b) for b in range(7)}
        assert sorted(got, key=str) == sorted(far, key=str) and sum(sizes) == len(far)


def test_registry():
    with pytest.raises(ValueError, match="declares again"):
        Registry(EntityType("A", (Field("x"),)), EntityType("B", (Field("x"),), extends="A"))
    with pytest.raises(ValueError, match="unknown kind"):
        Field("x", "money")
    assert WIDGET.concrete("Base") == ["Widget"] and WIDGET.prefix("Widget") == "WID"
    assert json.loads(WIDGET.struct("Widget").json())["fields"][0]["name"] == "id"


def test_facet_of_a_hot_entity(spark):
    facet = spark.range(5000).selectExpr("'hot' AS id", "concat('S', lpad(id % 4000, 4, '0')) AS src").union(spark.createDataFrame([("cold", "S1"), ("cold", "S1")], "id string, src string"))
    got = {r["id"]: (r["sources"], r["n"]) for r in collect_facet(facet, 3).collect()}
    assert got == {"hot": (["S0000", "S0001", "S0002"], 4000), "cold": (["S1"], 1)}
    assert {r["id"]: (len(r["sources"]), r["n"]) for r in collect_facet(facet).collect()} == {"hot": (4000, 4000), "cold": (1, 1)}
