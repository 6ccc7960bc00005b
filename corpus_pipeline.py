"""A training corpus from raw documents: quality, near duplicates, repeated sentences, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkframe.llm import mixing, ngram_join, quality, sentencepiece_bpe, spans
from linkframe.llm.common import removed, table, words, written

#: No SQL: training, components of near duplicates and tokens aren't expressible; tests hold run() against plain Python.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. A null text counts as an empty one; equal rows are accepted or rejected alike."""
    names = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}  # the classifier adds columns of its own
    kept = quality.accepted(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (null last), then one by its text; blank texts are in no group and stay."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", ngram_join.row_hash().alias("rid"), (F.size(words(F.col("text"))) == 0).alias("blank"))
    first = ngram_join.first_rows(docs).alias("first")
    kept = rows.where("not blank").alias("rows").join(first, (F.col("rows.rid") == F.col("first.rid")) & F.col("rows.doc_id").cast("long").eqNullSafe(F.col("first.doc_id")), "left_semi").dropDuplicates(["doc_id", "rid"])
    return kept.select("row.*").union(rows.where("blank").select("row.*"))


def drop_repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated runs; every document stays, n_chars follows its text."""
    return spans.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all (all those without words), once or twice. A null source is one of its own."""
    whole = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("n"), F.struct(*docs.columns).alias("row"))
    taken = mixing.mix(whole, F.array("source"), F.col("n"), mixing.by_turns(3, 1, 2), tie=F.xxhash64("row.text")).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (little-endian 32-bit integers) and a digest of what they decode to; null text counts as empty, every row stays."""
    found = sentencepiece_bpe.tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_sentences", drop_repeated_sentences),
    ("mix", mix_sources),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
