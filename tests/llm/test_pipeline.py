import corpus_pipeline as p
import pytest
from pyspark.sql import functions as F

from linkframe.llm import mixing, quality, spans

DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    """Each stage against a plain version on what the stage before it kept."""
    from test_text_operators import plain_components, plain_spans

    docs = spark.read.parquet(f"{DIR}/documents.parquet").cache()
    columns = docs.columns
    kept = p.keep_quality(spark, docs, DIR).cache()
    assert kept.columns == columns
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.5}
    near = p.drop_near_duplicates(spark, kept, DIR).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect())
    labels, _ = plain_components([t for _, t in rows])
    assert sorted(r["doc_id"] for r in near.collect()) == [rows[i][0] for i, x in enumerate(labels) if x == i]
    assert near.columns == columns
    cut = p.drop_repeated_sentences(spark, near, DIR).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in near.collect())
    want = plain_spans(rows)
    got = {r["doc_id"]: r for r in cut.collect()}
    assert [got[i]["text"] for i, _ in rows] == want and all(r["n_chars"] == len(r["text"]) for r in got.values())
    mix = p.mix_sources(spark, cut, DIR).cache()
    assert mix.columns == columns
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(cut).collect()}
    sizes = {r["doc_id"]: len(r["text"].split()) for r in cut.collect()}
    times = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert times == {i: n // sizes[i] for i, n in taken.items() if n}
    tokens = p.encode(spark, mix, DIR)
    assert tokens.count() == mix.count() and tokens.where("n_tokens * 4 <> length(ids)").isEmpty()
    lost = tokens.join(mix.select("doc_id", F.sha2("text", 256).alias("s")).distinct(), "doc_id").where("s <> decoded_sha256")
    assert lost.isEmpty()


def test_stages():
    assert len(p.STAGES) in (4, 5) and p.ORACLE_SQL is None and spans.RUN >= 2
    assert all(callable(f) for _, f in p.STAGES)


def test_entry():
    entry = pytest.importorskip("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_rows_of_one_id(spark):
    """Texts that share a doc_id, or have none, are documents of their own; the mix takes no row more than twice."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (5, text("d") + " more"), (9, text("c")), (7, text("c")), (None, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    near = p.drop_near_duplicates(spark, docs, DIR)
    assert near.columns == docs.columns
    want = [(None, text("a")), (None, text("b")), (7, text("c")), (5, text("d") + " more"), (None, ""), (3, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in near.collect()), key=str) == sorted(want, key=str)
    mix = p.mix_sources(spark, docs, DIR).groupBy("doc_id", "text").count().collect()
    times = {x: rows.count(x) for x in rows}
    assert mix and all(r["count"] <= 2 * times[r["doc_id"], r["text"]] for r in mix)
    assert sum(r["count"] * len(r["text"].split()) for r in mix) <= 1.5 * sum(len((t or "").split()) for _, t in rows) + 31


ODD = [(1, None), (1, None), (2, ""), (None, " \n"), (3, "short"), (4, " ".join(f"word{i}" for i in range(80)) + "."), (4, " ".join(f"word{i}" for i in range(80)) + "."), (None, " ".join(f"word{i}" for i in range(80)) + "."), (6, "é" * 40_000), (7, " ".join(f"long{i}" for i in range(30_000)))]
NAMES = ["__at", "__votes", "__size", "row", "rid", "marked", "votes", "score", "size", "pattern", "copies", "text_", "c0"]


def odd(spark, rows):
    """Documents with columns named as the stages' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *NAMES) for i, t in rows], schema).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_odd_rows(spark, name):
    """Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns go through each stage."""
    stage = dict(p.STAGES)[name]
    docs = odd(spark, ODD)
    found = stage(spark, docs, DIR)
    rows = found.collect()
    assert stage(spark, odd(spark, []), DIR).isEmpty()
    if name == "tokens":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in ODD) and all(len(r["ids"]) == 4 * r["n_tokens"] >= 8 for r in rows)
        return
    assert found.columns == docs.columns and all(r[n] == n for r in rows for n in NAMES)
    texts = sorted((str(r["doc_id"]), r["text"]) for r in rows if r["text"])
    if name == "quality":
        assert all(sum(x == (str(i), t) for x in texts) in (0, sum(y == (i, t) for y in ODD)) for i, t in ODD if t)
    if name == "near_duplicates":
        assert sorted(texts) == sorted([("3", "short"), ("4", ODD[5][1]), ("6", ODD[8][1]), ("7", ODD[9][1]), ("None", " \n")]) and len(rows) == 8
    if name == "repeated_sentences":
        assert len(rows) == len(ODD) and [t for i, t in texts if i == "4"] == [ODD[5][1]] * 2 and ("None", ODD[5][1]) not in texts
    if name == "mix":
        assert all((r["text"] or "").split() for r in rows) and len(rows) <= 2 * 7
