"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from linkframe.llm import merkle

DIR = "/root/testdata/sf0.001"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS])


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def climb(nodes):
    """Root, and each node's siblings (left, right) by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            paths[i].append((run[: at % 8], run[at % 8 + 1 :]))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        places = [at // 8 for at in places]
    return nodes[0], paths


def plain(rows):
    langs = {}
    for r in sorted(rows, key=lambda r: (r["lang"] is not None, (r["lang"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        langs.setdefault(r["lang"], []).append(r)
    trees = {lang: climb([leaf(r) for r in rs]) for lang, rs in langs.items()}
    root, over = climb([trees[x][0] for x in langs]) if langs else (None, [])
    out = []
    for lang, upper in zip(langs, over):
        for r, path in zip(langs[lang], trees[lang][1], strict=True):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            at = leaf({**r, "text": lower(r["text"])}) if changed else leaf(r)
            for left, right in path + upper:
                at = H(*left, at, *right)
            proof = H(*[x for a, b in path + upper for x in a + b])
            out.append((r["doc_id"], leaf(r), trees[lang][0], root, proof, at, at == root))
    return out


def got(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert set(names) <= set(df.columns)
    return [tuple(r) for r in df.select(names).collect()]


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, root int"


@pytest.mark.parametrize(("n", "levels"), [(1, 0), (8, 0), (9, 1), (150, 0), (150, 1), (700, 1)])
def test_manifest(spark, n, levels):
    """Trees of one partition and of many, full and partial runs, up to four rounds."""
    r = random.Random(n)
    langs = ["en", "é", "", None] if n > 8 else ["en"]
    rows = [dict(doc_id=i, source=r.choice(["a", None]), lang=langs[min(3, int(r.expovariate(1)))] if n > 8 else "en", n_chars=r.choice([i, None]), text=r.choice([None, "", "Aé b", "x" * 50, f"T{i}"])) for i in range(n)]
    docs = spark.createDataFrame([(*[x[c] for c in FIELDS], "z", 1, 2) for x in rows], SCHEMA).repartition(3)
    same(got(merkle.manifest(docs, levels)), plain(rows))


def test_odd_rows(spark):
    """Repeated rows, rows of one doc_id, no doc_id at all, an empty table, a long text."""
    rows = [dict(doc_id=i, source="s", lang=None, n_chars=1, text=t) for i, t in [(None, "A"), (None, "A"), (None, None), (3, "B"), (3, "B"), (3, "C"), (-4, "É")]]
    rows += [dict(doc_id=9, source=None, lang="en", n_chars=0, text="Long " * 500_000)]
    docs = spark.createDataFrame([(*[x[c] for c in FIELDS], None, None, None) for x in rows], SCHEMA)
    for levels in (0, 2):
        same(got(merkle.manifest(docs, levels)), plain(rows))
    assert got(merkle.manifest(docs.limit(0))) == []


def test_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    found = got(merkle.manifest(docs, 1))
    same(found, plain(rows))
    assert {x[-1] for x in found} == {True, False}
