"""Queries over whole tables that SQL doesn't follow, against plain Python."""

import os
import re

import duckdb
import pytest

from linkframe import queries
from linkframe.operators import diff
from linkframe.plans.retail import Retail

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


def plain_kinds(text):
    """Kinds of the blocks of a text, in order."""
    out, before, mark = [], "blank", ""
    for s in text.replace("\r\n", "\n").split("\n"):
        m = re.match(r"[ \t\x0b\f\r]{0,3}(```|~~~)", s)
        if mark:
            kind = "code"
            mark = "" if m and m[1] == mark else mark
        elif m:
            mark, kind = m[1], "code"
            out.append(kind)
        elif not re.sub(r"\s", " ", s, flags=re.A).strip(" "):
            kind = "blank"
        else:
            kind = "heading" if re.match(r"\s{0,3}#{1,6}(\s|$)", s, re.A) else "row" if re.match(r"\s*\|", s, re.A) else "item" if re.match(r"\s*([-*+]|\d+[.)])\s", s, re.A) else "text"
            if kind != "text" or before in ("blank", "heading", "row", "code"):
                out.append(kind)
        before = kind
    return out


def test_d09_all(spark):
    want = {}
    for r in spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id % 7 <> 0").collect():
        for k in plain_kinds(r["text"] + ("\n\nAn added paragraph." if r["doc_id"] % 5 == 0 else "")):
            want[f"DOC-{r['doc_id']}", k] = want.get((f"DOC-{r['doc_id']}", k), 0) + 1
    assert {(r["id"], r["kind"]): r["n"] for r in queries.QUERIES["d09_all_blocks"](spark, DIR).collect()} == want


def test_d11_meets_every_document(spark, monkeypatch):
    seen, real = [], diff.diff_words
    monkeypatch.setattr(diff, "diff_words", lambda pair: seen.append(pair) or real(pair))
    got = queries.QUERIES["d11_words"](spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    assert {(r["id"], r["old"]) for r in seen[0].collect()} == {(f"DOC-{r['doc_id']}", r["text"]) for r in docs}
    assert {tuple(r) for r in got.collect()} == {(f"DOC-{r['doc_id']}", 2, 0) for r in docs if r["doc_id"] % 5 == 0 and r["text"]}


def test_h08_all(spark):
    parts = {r["id"]: r for r in Retail(spark, DIR).table("Part").collect()}
    want = {}
    for root in parts:
        seen, now = [], root
        while now is not None and now not in seen:
            seen.append(now)
            now = parts[now]["parent"] if now in parts else None
        want[root, "full"] = len(seen)
        want[root, "read"] = len({parts[x]["brand"] for x in seen if x in parts})
    assert {(r["root"], r["how"]): r["n"] for r in queries.QUERIES["h08_all_dependencies"](spark, DIR).collect()} == want


def test_h09_all(spark):
    nation = {r["c_custkey"]: r["c_nationkey"] for r in spark.read.parquet(f"{DIR}/customer.parquet").collect()}
    want = {f"ORD-{r['o_orderkey']}": 1 + (nation.get(r["o_custkey"]) is not None) for r in spark.read.parquet(f"{DIR}/orders.parquet").collect()}
    assert {r["root"]: r["n"] for r in queries.QUERIES["h09_all_inputs"](spark, DIR).collect()} == want


def test_d09_odd_texts(spark, tmp_path):
    """Texts without words, vertical tabs and rows that share an id, against the query's SQL."""
    texts = ["", "", " ", "\n", "\t\r\n ", None, "\x0b", "a\n\x0b\nb", "\x0b# a", "\x0b```\na", "a\n\x0b- b", "a\n\n b", "- a", "a\n 1) b", "a\nb", "\na\n", "a\rb", "\xa0"] * 4
    rows = [(i, t) for i, t in enumerate(texts)] + [(11, "a"), (11, "b"), (11, "b"), (15, ""), (15, ""), (22, "x ```")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(map(tuple, queries.QUERIES["d09_blocks"](spark, str(tmp_path)).collect())) == sorted(con.execute(queries.SQL["d09_blocks"]).fetchall())
