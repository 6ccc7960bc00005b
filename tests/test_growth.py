"""Tables that grow don't go by way of the driver, and files keep one header each."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from linkframe import cases, queries  # noqa: F401
from linkframe.operators import alignment, diff, selections, text
from linkframe.plans.retail import Retail

DIR = "/root/testdata/sf0.001"


def test_items_meet_without_broadcast(spark, capsys):
    queries.QUERIES["x08_deep_items"](spark, DIR).explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_files_have_one_header(spark, tmp_path):
    parts = Retail(spark, DIR).read("part")
    parts.withColumn("p_partkey", F.col("p_partkey") * 1000).write.parquet(f"{tmp_path}/part.parquet")
    got = [r["id"] for r in queries.QUERIES["s01_s07_delimited"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(f"PART-{k}" for k in (r["p_partkey"] * 1000 for r in parts.collect()) if k % 37 == 0 and k % 41)


def test_derivations_meet_without_broadcast(spark, monkeypatch, capsys):
    monkeypatch.setattr(selections, "saved", lambda df, real=selections.saved: (df.explain(), real(df))[1])
    monkeypatch.setattr(selections, "SENT_ROWS", 50)
    queries.QUERIES["q03_derive"](spark, DIR)
    plans = [p for p in capsys.readouterr().out.split("== Physical Plan ==") if "parent" in p or "p_partkey" in p]
    assert plans and not [p for p in plans if "Inner BuildRight" in p or "Inner, BuildRight" in p or "Inner, BuildLeft" in p]


def test_counts_of_selections_need_no_pairs(spark, monkeypatch):
    """What the selections give, counted, for each order test; with equal values, null ones, targets and specs that are there twice."""
    monkeypatch.setattr(selections, "RANGES", 4)
    holders = spark.createDataFrame([(f"h{i}", f"s{i}") for i in range(9)] + [("h9", "none")], "holder string, spec string")
    specs = spark.createDataFrame([(f"s{i}", float(i * 3 % 10)) for i in range(8)] + [("s1", 8.0), ("s8", None)], "spec string, p0 double")
    targets = spark.createDataFrame([(f"t{i % 17}", float(i % 10)) for i in range(20)] + [("t99", None)], "id string, v double")
    for op in selections.ORDERED:
        want = selections.materialise_shape(holders, specs, targets, selections.Shape(tests=(("v", op),))).groupBy("holder").agg(F.count("*").alias("n"), F.min("result").alias("first"))
        assert sorted(map(tuple, selections.summarise_shape(holders, specs, targets, ("v", op)).collect())) == sorted(map(tuple, want.collect()))


def test_long_runs_that_are_all_alike(monkeypatch):
    """Every block is like every other: the chain is found without looking at all pairs, and in any case is a longest one."""
    r, real, calls = random.Random(1), alignment.alike, []
    for rare in (0, 2, 5, 100):
        monkeypatch.setattr(alignment, "RARE", rare)
        for _ in range(40):
            block = lambda: " ".join(r.choices("abcdefgh", k=r.randrange(6))) if r.random() < 0.9 else "```x" + r.choice("ab")
            old, new = [[block() for _ in range(r.randrange(1, 12))] for _ in range(2)]
            pairs = [(i, j) for i, x in enumerate(old) for j, y in enumerate(new) if real(x, y)]
            masks = alignment._masks(old, new)
            assert [(i, j) for i in range(len(old)) for j in range(len(new)) if masks[i] >> j & 1] == pairs
            chain = alignment.longest(masks, len(new))
            assert set(chain) <= set(pairs) and len(chain) == len(alignment.rising(pairs)) and all(a < b and x < y for (a, x), (b, y) in zip(chain, chain[1:], strict=False))
    monkeypatch.setattr(alignment, "RARE", 16)
    monkeypatch.setattr(alignment, "alike", lambda a, b: calls.append(1) or real(a, b))
    old = [f"Customer CUS-{i} called Customer#{i:09d} lived here" for i in range(1500)]
    got = alignment.compared(old, ["Nothing like what was there", *[x.replace("lived", "lives") for x in old]])
    assert [x[0] for x in got].count("changed") == 1500 and len(calls) < 20_000


def test_words_are_counted_in_small_pieces(spark):
    """A task that gets many texts at once never has them all as Python objects."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["x"])
    got = list(diff.sliced([batch]))
    assert max(b.num_rows for b in got) <= 128 and pa.Table.from_batches(got)["x"].to_pylist() == list(range(1000))
    pair = spark.range(1000).selectExpr("CAST(id AS string) AS id", "'a b c' AS old", "'c b d d' AS new").coalesce(1)
    assert {(tuple(r["kept"]), tuple(r["removed"]), tuple(r["added"])) for r in diff.diff_words(pair).collect()} == {(("b", "c"), ("a",), ("d", "d"))}


def test_texts_are_split_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(text, "PIECE", 3)
    docs = spark.range(20).selectExpr("id", "CASE WHEN id % 4 > 0 THEN concat('a\n```x', id, '\nb\n```') END AS text").coalesce(1)
    got = sorted((r["id"], r["line"], r["s"], r["edge"], r["lang"], r["fenced"]) for r in text.lines(docs).where("s <> ''").collect())
    assert got == sorted(x for i in range(20) if i % 4 for x in ((i, 1, "a", None, None, False), (i, 2, f"```x{i}", "open", f"x{i}", True), (i, 3, "b", None, None, True), (i, 4, "```", "close", "", True)))


def test_pairs_of_runs_are_as_many_as_can_be(monkeypatch):
    """Runs compared in rows of bits, with alike blocks at their ends, and with no rows of bits kept: the pairs are alike, rise, and are as many as those of all pairs."""
    r = random.Random(2)
    monkeypatch.setattr(alignment, "MOST_PAIRS", 0)
    for rare, kept in ((0, 0), (2, 1 << 20), (5, 0), (100, 0)):
        monkeypatch.setattr(alignment, "RARE", rare)
        monkeypatch.setattr(alignment, "KEPT_BYTES", kept, raising=False)
        for _ in range(60):
            block = lambda: " ".join(r.choices("abcdefgh", k=r.randrange(6))) if r.random() < 0.9 else "```x" + r.choice("ab")
            old, new = [[block() for _ in range(r.randrange(1, 12))] for _ in range(2)]
            got = alignment.paired(old, new)
            assert all(alignment.alike(old[i], new[j]) for i, j in got) and all(a < b and x < y for (a, x), (b, y) in zip(got, got[1:], strict=False))
            assert len(got) == len(alignment.rising([(i, j) for i, x in enumerate(old) for j, y in enumerate(new) if alignment.alike(x, y)]))


def test_long_runs_need_memory_for_their_words_alone():
    """Four times the blocks take about four times the memory, whether frequent words make blocks alike or rare ones."""

    def peak(n: int, words: str) -> int:
        old, new = (["first thing", *[words.format(i, w) for i in range(n)], last] for w, last in (("lived", "a b c d"), ("lives", "e f g h i")))
        new[0] = "Nothing like what was there"
        tracemalloc.start()
        try:
            assert Counter(x[0] for x in alignment.compared(old, new))["changed"] == n
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    for words in ("Customer CUS-{0} called Customer#{0} {1} here", "k{0} m{0} {1}"):
        assert peak(16_000, words) < 5 * peak(4000, words)
