"""The registered queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers as TOKENIZERS
from pyspark.sql import DataFrame, SparkSession

from . import cascade, fingerprint, flac, merkle, mixing, ngram_join, oracles, phrases, quality, sentencepiece_bpe, spans, suffix_dedup, token_counts, warc
from .common import table, written


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op1_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(written(flac.with_media(table(spark, sf_dir, "documents")), "media"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = written(warc.archives(warc.deduplicated(table(spark, sf_dir, "pages"))), "warc")
    return warc.page_records(warc.records(archives, blocks=False))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), TOKENIZERS.path("piece_bpe_32k.model"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def mix_of_sources_and_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping sources: a document belongs to its source and to its language. What each of them was to give, and what it gives."""
    return mixing.quotas(mixing.overlapping(table(spark, sf_dir, "documents")))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.without_repeats(docs)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, with their votes and score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.accepted(docs).select("doc_id", "votes", "posterior", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), TOKENIZERS.path("byte_bpe_50k.tiktoken"), TOKENIZERS.PATTERN)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.cut_out(table(spark, sf_dir, "documents")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade.judged(docs).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith(("op", "mix_of_")) or name == "pipeline"}


def oracle_sql() -> dict[str, str]:
    """The others rest on tokens, hashes, training or components; tests hold them against plain Python."""
    return {"op3_warc": oracles.WARC, "op11_merkle": oracles.MERKLE, "op12_phrases": oracles.PHRASES, "op13_cascade": oracles.CASCADE}
