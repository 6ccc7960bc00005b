"""Phrases and the cascade against plain Python, and the queries with SQL against it."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from linkframe.llm import cascade, oracles, phrases, queries

DIR = "/root/testdata/sf0.001"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def plain_phrases(rows, least, top, inside=80):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        gone = {p[i:j] for p, n in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * n >= inside * f[p[i:j]]}
        kept = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, total[lang], -score))
    return out


def babble(seed, n):
    r = random.Random(seed)
    words = ["a", "B", "b", "cc", "d d", "é", "#", "eighteen-letters-x", "of", "the"]
    fixed = ["new York City", "in the end of it", "x y"]
    text = lambda: r.choice([" ", "  ", "\t"]).join(r.choice(fixed) if r.random() < 0.3 else r.choice(words) + r.choice(["", "", "", ".", ",\n", "!"]) for _ in range(r.randrange(60)))
    return [(r.choice(["en", "de", None, "und", ""]), r.choice([None, "", text(), text(), text()])) for _ in range(n)]


@pytest.mark.parametrize(("shards", "least"), [(1, 3), (2, 4), (3, 8)])
def test_phrases(spark, shards, least, monkeypatch):
    """Full and tiny filters, several steps and sums, many copies of one row."""
    monkeypatch.setattr(phrases, "FILTER_BITS", 128 if shards == 3 else 1 << 27)
    monkeypatch.setattr(phrases, "STEP", 7)
    monkeypatch.setattr(phrases, "HELD", 50)
    rows = babble(shards, 60)
    rows += [rows[-1]] * 20
    docs = spark.createDataFrame([(i % 9, lang, t, 5, "x") for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n int, word string").repartition(3)
    top = 6 if shards == 3 else 10_000
    got = phrases.collocations(docs, shards, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(plain_phrases(rows, least, top))


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([(None, None, None), (1, None, " .\n"), (2, "en", "one two")], "doc_id long, lang string, text string")
    assert phrases.collocations(docs).isEmpty() and phrases.collocations(docs.limit(0)).isEmpty()


def test_long_text(spark):
    text = "over and over. " * 60_000
    docs = spark.createDataFrame([(1, "en", text), (2, "en", "x")], "doc_id long, lang string, text string")
    assert [tuple(r) for r in phrases.collocations(docs).collect()] == plain_phrases([("en", text), ("en", "x")], 30, 2000)


def plain_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(lines)


def odd_texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 9)))
    prose = lambda n: " ".join(word() + r.choice(["", "", "", ".", "\n"]) for _ in range(n))
    base = [prose(n) for n in (10, 60, 90, 300, 2000)]
    more = ["x " * 80, " | ".join(word() for _ in range(90)), prose(80).upper(), "- " + prose(90).replace("\n", "\n- "), "...\n".join(prose(20) for _ in range(6)), "12345. " * 60, prose(70).replace(" ", "!! "), (prose(12).replace("\n", "") + ".\n") * 9, "", None, " \n\t", "a\n\na\n a\na", "one two three one two three", "\x0b\x0c.", "z" * 5000]
    return base + more + base[:2]


def test_cascade(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, 7, True) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept boolean").repartition(3)
    got = {r["doc_id"]: r for r in cascade.judged(docs).collect()}
    counts = cascade.Counts(pa.array(texts))
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat, lines = plain_counts(t)
        assert [got[i][c] for c in cascade.BASE] == [n, chars, symbols, dup, repeat] and counts.n_lines[i] == lines
        failed = n < 50 or 100 * repeat > 50 * n
        assert got[i]["base_failed"] == failed
        assert got[i]["kept"] == (not failed and not any(rule(cascade.Text(t, n, chars, symbols, lines, dup)) for rule in cascade.RULES))
    assert {r["kept"] for r in got.values()} == {True, False}
    assert cascade.judged(docs.limit(0)).isEmpty()
    found = cascade.planned(docs)
    assert sorted(n for n, _, _ in found) == sorted(r.__name__ for r in cascade.RULES) and all(c > 0 for _, c, _ in found)


def test_order_of_rules(spark):
    """Most rejected of what is left per cost comes first; a text meets no rule after the one that rejects it."""
    rules = tuple(lambda t: None for _ in range(4))
    found = [{"rejected": "xx--", "n": 6, "cost": [600, 60, 6, 60]}, {"rejected": "x-x-", "n": 3, "cost": [300, 30, 3, 30]}, {"rejected": "----", "n": 1, "cost": [100, 10, 1, 10]}]
    assert [(i, n) for i, _, n in cascade.ordered(found, rules)] == [(2, 3), (1, 6), (3, 0), (0, 0)]
    assert [i for i, _, _ in cascade.ordered([], rules)] == [0, 1, 2, 3]
    calls = Counter()

    def first(t):
        calls["first"] += 1
        return True

    def second(t):
        calls["second"] += 1
        return False

    t = cascade.Text("x", 1, 1, 0, 1, 0)
    assert any(rule(t) for rule in (first, second)) and calls == {"first": 1}


def test_verdict_without_order(spark):
    docs = spark.createDataFrame(list(enumerate(odd_texts())), "doc_id long, text string")
    kept = lambda rules: sorted((r["doc_id"], r["kept"]) for r in cascade.judged(docs, rules).collect())
    assert kept(cascade.RULES) == kept(cascade.RULES[::-1])


def test_labelled_documents(spark):
    """Rules that were set without labels reject nearly all bad documents and hardly a good one that passes the base test."""
    big = DIR.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    n = {(r["quality"], r["base_failed"], r["kept"]): r["count"] for r in cascade.judged(docs).join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()}
    assert n.get((0, False, True), 0) <= 2 and n.get((1, False, False), 0) <= 3


@pytest.mark.parametrize("name", ["op11_merkle", "op12_phrases", "op13_cascade"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(result.fetchall(), key=str)
    assert np.isin(["MERKLE", "PHRASES", "CASCADE"], dir(oracles)).all()
