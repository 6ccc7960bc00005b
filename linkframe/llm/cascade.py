"""Quality rules as a short-circuit cascade.

Each rule looks for one fault in a whole text. On a bounded sample every rule judges every text, which gives its cost (time a text) and what it
rejects; then rules are put in order, each time the one that rejects most of what is left per cost. In that order they judge the whole
table, and a text that one rule rejects is judged by no other. The order changes what is spent, never the verdict: a text is kept if no rule
rejects it.

What all rules share (words, lines, repeats) is counted for whole batches of texts; a text's other traits are worked out when a rule asks.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import BLANK, bytes_of, mix64, sequence_hashes, word_hashes, words_of
from .common import longer, pieces

#: Texts on which costs and rejections are measured: about so many, drawn by a hash of doc_id and text. Verdicts don't depend on it.
SAMPLE_ROWS = 2000
LEAST_WORDS = 50
WINDOW = 3
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(flags: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """How many flags each text has; ``edge`` says where texts begin and end among them."""
    return np.diff(np.r_[0, np.cumsum(flags)][edge])


def _unlike(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the number of its first equal in the same text, and how many equals there are."""
    keys = mix64(keys ^ mix64(text.astype(np.uint64)))
    _, at, inverse, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return at[inverse], n[inverse]


class Counts:
    """Of each text of a batch: words, code points in words, symbols, lines with a word, those equal to an earlier one, words in repeated windows."""

    def __init__(self, texts: pa.Array):
        raw, edge = bytes_of(texts)
        start, end, first = words_of(raw, edge)
        self.n_words = np.diff(first)
        self.word_chars = _per_text(~BLANK[raw] & (raw & 0xC0 != 0x80), edge)
        self.n_symbols = _per_text(SYMBOLS[raw], edge)
        # lines: what lies between line feeds, never across texts
        cut = np.unique(np.r_[edge, np.flatnonzero(raw == 10) + 1])
        a, b = cut[:-1], cut[1:].copy()
        b -= (raw[b - 1] == 10) if len(b) else 0
        worded = np.searchsorted(start, b) > np.searchsorted(start, a)
        a, b = a[worded], b[worded]
        text = np.searchsorted(edge, a, side="right") - 1
        self.n_lines = np.bincount(text, minlength=len(texts))
        leader, _ = _unlike(word_hashes(raw, a, b), text)
        self.n_dup_lines = np.bincount(text[leader != np.arange(len(a))], minlength=len(texts))
        # windows of words
        text = np.repeat(np.arange(len(texts)), self.n_words)
        at = np.arange(max(0, len(start) - WINDOW + 1))
        at = at[text[at] == text[at + WINDOW - 1]] if len(at) else at
        _, n = _unlike(sequence_hashes(word_hashes(raw, start, end), at, at + WINDOW), text[at])
        covered = np.zeros(len(start), bool)
        for i in range(WINDOW):
            covered[at[n > 1] + i] = True
        self.n_repeat_words = _per_text(covered, first)
        self.base_failed = (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > 50 * self.n_words)


class Text:
    """One text: its counts, and traits that are worked out once, when a rule first asks."""

    def __init__(self, text: str, n_words: int, word_chars: int, n_symbols: int, n_lines: int, n_dup_lines: int):
        self.text, self.n_words, self.word_chars, self.n_symbols, self.n_lines, self.n_dup_lines = text, n_words, word_chars, n_symbols, n_lines, n_dup_lines

    @cached_property
    def bytes(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.text.encode("utf-8", "replace"), np.uint8), minlength=256)

    @cached_property
    def words(self) -> list[str]:
        return re.findall(r"[^\x20\x09-\x0D]+", self.text)

    @cached_property
    def lines(self) -> list[str]:
        return [x for line in self.text.split("\n") if (x := line.strip(" \t\x0b\x0c\r"))]


def word_length(t: Text) -> bool:
    """Words of under 2.5 or over 12 code points on average."""
    return not 2.5 * t.n_words <= t.word_chars <= 12 * t.n_words


def symbols(t: Text) -> bool:
    """Over one of ``#*$%&|<>`` in ten words."""
    return 10 * t.n_symbols > t.n_words


def same_lines(t: Text) -> bool:
    """Over three in ten lines that an earlier line equals."""
    return 10 * t.n_dup_lines > 3 * t.n_lines


def capitals(t: Text) -> bool:
    """More A-Z than a-z."""
    return int(t.bytes[65:91].sum()) > int(t.bytes[97:123].sum())


def digits(t: Text) -> bool:
    """Over three in ten of the code points of words are 0-9."""
    return 10 * int(t.bytes[48:58].sum()) > 3 * t.word_chars


def shouting(t: Text) -> bool:
    """Over one exclamation mark in four words."""
    return 4 * int(t.bytes[33]) > t.n_words


def letterless(t: Text) -> bool:
    """Over one word in five without A-Z, a-z or a code point past ASCII."""
    return 5 * sum(1 for w in t.words if not re.search(r"[A-Za-z\x80-\U0010FFFF]", w)) > t.n_words


def prose(t: Text) -> bool:
    """Under one word in a hundred ends in ``.``, ``!`` or ``?``."""
    return 100 * sum(1 for w in t.words if w[-1] in ".!?") < t.n_words


def bullets(t: Text) -> bool:
    """Over nine in ten lines begin with ``-``, ``*`` or a bullet."""
    return 10 * sum(1 for x in t.lines if x[0] in "-*•") > 9 * t.n_lines


def ellipses(t: Text) -> bool:
    """Over three in ten lines end with three dots or an ellipsis."""
    return 10 * sum(1 for x in t.lines if x.endswith(("...", "…"))) > 3 * t.n_lines


def one_word(t: Text) -> bool:
    """One word makes up over three in ten of all."""
    return 10 * max(Counter(t.words).values()) > 3 * t.n_words


def one_pair(t: Text) -> bool:
    """One pair of neighbouring words is there so often that it makes up over two in ten of all words."""
    pairs = Counter(zip(t.words, t.words[1:], strict=False))
    return 10 * 2 * max(pairs.values()) > 2 * t.n_words


#: A rule is true where it rejects. Texts that fail the base test (no words among them) are never shown to a rule.
RULES: tuple[Callable[[Text], bool], ...] = (word_length, symbols, same_lines, capitals, digits, shouting, letterless, prose, bullets, ellipses, one_word, one_pair)


def _texts(column: pa.Array, counts: Counts) -> Iterable[tuple[int, Text]]:
    """The texts that passed the base test, each with its row."""
    for i in np.flatnonzero(~counts.base_failed):
        yield int(i), Text(column[int(i)].as_py(), *(int(x[i]) for x in (counts.n_words, counts.word_chars, counts.n_symbols, counts.n_lines, counts.n_dup_lines)))


def measured(docs: DataFrame, rules: tuple = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(rejected, n, cost): for each set of rules (one letter each, x where it rejects) how many sampled texts fall to just these, and what each
    rule took for them in nanoseconds. At most 2 to the number of rules, and ``sample_rows``, rows."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    lot = (F.xxhash64("doc_id", "text").cast("double") + 2.0**63) <= share * 2.0**64

    def run(batches):
        for part in pieces(batches):
            column = part.column("text")
            for _, t in _texts(column, Counts(column)):
                marks, took = [], []
                for rule in rules:
                    for trait in ("bytes", "words", "lines"):  # each rule pays for all it needs
                        t.__dict__.pop(trait, None)
                    begin = time.perf_counter_ns()
                    marks.append("x" if rule(t) else "-")
                    took.append(time.perf_counter_ns() - begin)
                yield pa.RecordBatch.from_arrays([pa.array(["".join(marks)]), pa.array([took], pa.list_(pa.int64()))], ["rejected", "cost"])

    found = docs.where(lot).select("text").mapInArrow(run, "rejected string, cost array<bigint>")
    return found.groupBy("rejected").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("cost")[i]) for i in range(len(rules))]).alias("cost"))


def ordered(found: list, rules: tuple = RULES) -> list[tuple[int, float, int]]:
    """(rule, nanoseconds a text, texts it rejects first) in the order to run: next is always the rule that rejects most of what is left per cost; rules that
    reject nothing more come last, cheapest first, and of equal ones the earlier of ``rules``."""
    total = sum(r["n"] for r in found)
    cost = [sum(r["cost"][i] for r in found) / max(1, total) for i in range(len(rules))]
    left, todo, out = list(found), list(range(len(rules))), []
    while todo:
        falls = {i: sum(r["n"] for r in left if r["rejected"][i] == "x") for i in todo}
        best = max(todo, key=lambda i: (falls[i] / max(cost[i], 1), -cost[i], -i))
        out.append((best, cost[best], falls[best]))
        left = [r for r in left if r["rejected"][best] != "x"]
        todo.remove(best)
    return out


def planned(docs: DataFrame, rules: tuple = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, int]]:
    """The cascade's order, with what the sample says of each rule: name, nanoseconds a text, texts it is the first to reject."""
    return [(rules[i].__name__, cost, n) for i, cost, n in ordered(measured(docs, rules, sample_rows).collect(), rules)]


def judged(docs: DataFrame, rules: tuple = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add ``BASE`` counts, base_failed and kept to every document.

    A null text has no words, and fails the base test as all texts of under 50 words do. Every row stays, repeated ones are
    judged alike, and columns that already have these names give way. An empty table stays empty. What reaches the driver is ``measured``.
    """
    docs = docs.drop(*BASE, "base_failed", "kept")
    order = [rules[i] for i, _, _ in ordered(measured(docs, rules, sample_rows).collect(), rules)]
    schema = longer(docs.schema, ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean")
    where = schema.fieldNames().index("text")

    def run(batches):
        for part in pieces(batches):
            column = part.column(where)
            counts = Counts(column)
            kept = np.zeros(part.num_rows, bool)
            for i, t in _texts(column, counts):
                kept[i] = not any(rule(t) for rule in order)
            new = [pa.array(getattr(counts, c), pa.int64()) for c in BASE] + [pa.array(counts.base_failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *BASE, "base_failed", "kept"])

    return docs.mapInArrow(run, schema)
