"""Phrase collocations by dynamic itemset counting.

A phrase is two to four words in a row inside a piece of a text. The table is dealt into ``SHARDS`` parts which are scanned in turn, over and
over. A word is counted from the first scan on; a longer phrase from the scan after the one in which the later of its two subphrases (all words
but the last, all but the first) reached the threshold, whatever the lengths that are being counted at that time. Each is counted for exactly one cycle,
so its count is that of the whole table; it ends when nothing is left to count. A subphrase is there at least as often as its
phrase, so no phrase that reaches the threshold is missed.

What has reached the threshold travels to a scan's tasks as a bit array of one size, with that of a cycle before: a phrase is counted if the first lets all its
subphrases through and the second doesn't. Bits are only ever set, so a phrase that chance lets through early is counted early, and for one cycle as
well: the fuller the array, the more is counted in vain, but never is a count wrong. So counts are all that is shuffled; the words of what is frequent are found in the
end. Languages have their own words: a word's hash covers its language.

Defined cases: a null text is empty, a null language is ``und``; rows are counted as often as they are there; ids don't matter and other columns neither;
an empty table gives no phrases.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import bytes_of, mix64, word_hashes
from .common import deleted, give_back, pieces, written

SHARDS = 2
LEAST, LONGEST = 30, 4
INSIDE = 80  # per cent: a phrase goes if a longer one around it is there so often
TOP = 2000
SCALE = 2_000_000
#: An array has a bit for so many words of the table, but never more than ``FILTER_BITS``; a phrase has ``PLACES`` places in it.
WORDS_A_BIT, FILTER_BITS, PLACES = 8, 1 << 28, 2
#: Words that a task looks at at once, and finds that it holds before it adds them up.
STEP, HELD = 1 << 17, 1 << 20
#: What is frequent is first looked for in one document in so many; only what isn't there in all others.
FIRST_LOOK = 8
BREAK = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
GAP = np.isin(np.arange(256), list(b" \t")) | BREAK
SALTS = 64


def _joined(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """The hash of a phrase of ``size`` words from those of its two subphrases."""
    return mix64(mix64(a + np.uint64(size)) * np.uint64(3) + b)


def words_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start and end of each word, whether a piece begins with it, and its text."""
    raw, edge = bytes_of(texts)
    word = ~GAP[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[edge] = True
    start = np.flatnonzero(word & (first[:-1] | ~np.r_[False, word[:-1]]))
    end = np.flatnonzero(word & (first[1:] | ~np.r_[word[1:], False])) + 1
    text = np.searchsorted(edge, start, side="right") - 1
    breaks = np.r_[0, np.cumsum(BREAK[raw])]
    new = np.ones(len(start), bool)
    if len(start) > 1:
        new[1:] = (text[1:] != text[:-1]) | (breaks[start[1:]] > breaks[end[:-1]])
    return raw, start, end, new, text


def word_ids(part: pa.RecordBatch) -> tuple:
    """Of columns text and lang: bytes, start and end of each word, whether a piece begins with it, its text, its id, and the languages' names by text."""
    raw, start, end, new, text = words_in(part.column("text"))
    langs = part.column("lang").dictionary_encode()
    names = langs.dictionary.to_pylist()
    lang = langs.indices.to_numpy()
    ids = word_hashes(raw, start, end, fold=True)
    ids = mix64(ids + word_hashes(*_bytes_of_names(names))[lang[text]]) | np.uint64(1)  # never zero
    return raw, start, end, new, text, ids, [names[i] for i in lang]


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", "text").alias("lot"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def sequences(batches):
    """Of each slice of a task's batches what ``word_ids`` gives, its words with a zero before each piece, and the place of each word in that."""
    for part in pieces(batches):
        found = word_ids(part)
        new, ids = found[3], found[5]
        place = np.arange(len(ids)) + np.cumsum(new)
        seq = np.zeros(len(ids) + int(new.sum()), np.uint64)
        seq[place] = ids
        yield found, seq, place


def totals(docs: DataFrame) -> DataFrame:
    """(lang, total): how many words each language has."""

    def run(batches):
        for part in pieces(batches):
            *_, text = words_in(part.column("text"))
            total: dict[str, int] = {}
            for lang, n in zip(part.column("lang").to_pylist(), np.bincount(text, minlength=part.num_rows).tolist(), strict=True):
                total[lang] = total.get(lang, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["lang", "n"])

    return written(_slim(docs).select("lang", "text").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("total")), "totals")


def spelled(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, size, n, head, tail, lang, word) of ``found(id, size, n)``: the two subphrases of each phrase, language and spelling of each word.

    A task gives each thing once. First one document in ``FIRST_LOOK`` is read, then the others for what wasn't there.
    """
    parts, left = [], found
    for look in (F.pmod("lot", F.lit(FIRST_LOOK)) == 0, F.pmod("lot", F.lit(FIRST_LOOK)) != 0):
        bits = array_size(left.count())
        sent = docs.sparkSession.sparkContext.broadcast((Bits(bits).fill(found), Bits(bits).fill(left)))
        rows = _slim(docs).where(look).mapInArrow(_speller(sent), "id long, head long, tail long, lang string, word string")
        there = rows.groupBy("id").agg(*[F.min(c).alias(c) for c in ("head", "tail", "lang", "word")])
        parts.append(written(left.join(there, "id"), "spelled"))
        sent.destroy()
        left = written(found.join(parts[0].select("id"), "id", "left_anti"), "unspelled")
        if left.isEmpty():
            break
    return reduce(DataFrame.union, parts)


def _speller(sent: Broadcast):
    def run(batches):
        frequent, wanted = sent.value
        seen = np.zeros(0, np.uint64)
        for (raw, start, end, _, text, ids, langs), seq, place in sequences(batches):
            some, at = np.unique(ids, return_index=True)
            for found, head, tail, size in [(some, None, None, 1), *_phrases(seq, frequent, None, len(seq))]:
                first = at
                if size > 1:
                    found, first = np.unique(found, return_index=True)
                new = wanted.has(found) & ~np.isin(found, seen)
                found, first = found[new], first[new]
                seen = np.r_[seen, found]
                sides = [pa.array(x[first].view(np.int64)) if size > 1 else pa.nulls(len(found), pa.int64()) for x in (head, tail)]
                words = [raw[a:b].tobytes().decode("utf-8", "replace").translate(LOWER) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)] if size == 1 else [None] * len(found)
                names = [langs[i] for i in text[first].tolist()] if size == 1 else words
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *sides, pa.array(names, pa.string()), pa.array(words, pa.string())], ["id", "head", "tail", "lang", "word"])
        give_back()

    return run


LOWER = {c: c + 32 for c in range(65, 91)}


def _bytes_of_names(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names as words, each with a byte before it, so that none is empty."""
    raw, edge = bytes_of(pa.array([f"\x01{x}" for x in names], pa.string()))
    return raw, edge[:-1], edge[1:]


class Bits:
    """A set of hashes as a bit array: it may hold others too, but lacks none."""

    def __init__(self, bits: int, like: Bits | None = None):
        self.words, self.bits = like.words.copy() if like else np.zeros(bits // 64, np.uint64), bits

    @staticmethod
    def places(ids: Column, bits: int) -> Column:
        """Where an id's bits are, in Spark."""
        return F.array(*[F.pmod(F.shiftrightunsigned(ids, 7 + 29 * i), F.lit(bits)) for i in range(PLACES)])

    def fill(self, ids: DataFrame) -> Bits:
        """Add column ``id``. Places are set as 64-bit words, so what comes to the driver is bounded by the size of the array."""
        at = ids.select(F.explode(self.places(F.col("id"), self.bits)).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set")).toArrow()
        self.words[words.column("word").to_numpy()] |= words.column("set").to_numpy().view(np.uint64)
        return self

    def has(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for i in range(PLACES):
            at = (ids >> np.uint64(7 + 29 * i)) % np.uint64(self.bits)
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def array_size(n: int, each: int = 16) -> int:
    return min(FILTER_BITS, max(1 << 12, 1 << (each * n).bit_length()))


def _phrases(seq: np.ndarray, now: Bits, then: Bits | None, own: int):
    """(id, head, tail, size) arrays of the phrases to count that begin in the first ``own`` places of word hashes: those that ``now`` lets through, with all
    their subphrases, but for those that ``then`` did too."""
    ids, at = seq, np.flatnonzero(seq)
    before = np.full(len(at), then is not None)  # whether what begins here was let through then
    for size in range(2, LONGEST + 1):
        good = np.zeros(len(seq) + 1, np.int8)
        good[at] = now.has(ids[at])
        if then is not None:
            old = at[before]
            good[old] |= 2 * then.has(ids[old]).astype(np.int8)
        pair = at[(good[at] & good[at + 1] & 1) > 0]
        if not len(pair):
            return
        before = (good[pair] & good[pair + 1] & 2) > 0
        joined = np.zeros(len(seq), np.uint64)
        joined[pair] = _joined(ids[pair], ids[pair + 1], size)
        count = pair[~before & (pair < own)]
        if len(count):
            yield joined[count], ids[count], ids[count + 1], size
        ids, at = joined, pair


def scanned(docs: DataFrame, sent: Broadcast, words: bool) -> DataFrame:
    """What to count in these documents as (id, size, n), a thing may have several rows: the words, if they still are, and phrases by the arrays in ``sent``."""

    def run(batches):
        now, then = sent.value
        held, size = [], 0

        def summed():
            for k in range(1, LONGEST + 1):
                if parts := [ids for ids, n in held if n == k]:
                    found, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), k, np.int32)), pa.array(n)], ["id", "size", "n"])

        for _, seq, _ in sequences(batches):
            for at in range(0, len(seq), STEP):  # a step sees the few words behind it, but counts nothing that begins there
                step = seq[at : at + STEP + LONGEST - 1]
                if words:
                    held.append((step[:STEP][step[:STEP] > 0], 1))
                    size += len(held[-1][0])
                if now is not None:
                    for ids, _, _, k in _phrases(step, now, then, STEP):
                        held.append((ids, k))
                        size += len(ids)
                if size >= HELD:
                    yield from summed()
                    held, size = [], 0
        yield from summed()
        give_back()

    return docs.mapInArrow(run, "id long, size int, n long")


def counted(docs: DataFrame, words: int, shards: int = SHARDS, least: int = LEAST) -> DataFrame:
    """(id, size, n): all words and phrases that are there ``least`` times or more. ``words``: how many words the table has.

    After each scan one table is written, of what its cycle isn't surely over for and of what ends with it. What isn't frequent yet goes with the next one.
    """
    context, slim = docs.sparkSession.sparkContext, _slim(docs)
    bits = array_size(words // WORDS_A_BIT, 1)
    arrays = [None]  # what had reached the threshold before each scan
    tables, news = [], []
    step = 0
    while step < shards or any(news[-shards:]):
        sent = context.broadcast((arrays[step], arrays[step - shards] if step >= shards else None))
        found = scanned(slim.where(F.pmod("lot", F.lit(shards)) == step % shards), sent, step < shards)
        rows = found.groupBy("id", "size").agg(F.sum("n").alias("n")).select("id", "size", "n", F.lit(step).alias("first"), F.lit(False).alias("over"))
        if tables:
            rows = rows.union(tables[-1].where(F.col("first") + (shards - 1) >= step).select("id", "size", "n", "first", F.col("often").alias("over")))
        summed = rows.groupBy("id", "size").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.bool_or("over").alias("over")) if tables else rows
        tables.append(written(summed.withColumn("often", F.col("n") >= least), "counts", "often"))
        sent.destroy()
        if step:
            deleted(docs.sparkSession, f"{tables[-2].written_at}/often=false")
        fresh = tables[-1].where(F.col("often") & ~F.col("over") & (F.col("size") < LONGEST))
        news.append(fresh.limit(1).count())
        after = Bits(bits, arrays[-1])
        arrays.append(after.fill(fresh) if news[-1] else after if arrays[-1] is not None else None)
        if step >= shards:
            arrays[step - shards] = None
        step += 1
    last = len(tables) - 1
    ended = [F.col("first") + (shards - 1) == at if at < last else F.col("first") + (shards - 1) >= at for at in range(len(tables))]
    return reduce(DataFrame.union, [df.where(F.col("often") & test).select("id", "size", "n") for df, test in zip(tables, ended, strict=True)])


def _scores(size: int) -> Column:
    """(score, cut, l, r) of the cut with the lowest score; of equal ones the first."""
    cuts = []
    for k in range(1, size):
        l, r = f"pre[{k - 1}]", f"suf[{size - k - 1}]"
        exact = f"CAST(CAST({SCALE} AS DECIMAL(10,0)) * CAST(n AS DECIMAL(20,0)) div (CAST({l} AS DECIMAL(20,0)) + CAST({r} AS DECIMAL(20,0))) AS BIGINT)"
        cuts.append(F.expr(f"struct({exact} AS score, {k} AS cut, {l} AS l, {r} AS r)"))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, shards: int = SHARDS, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases that no longer one takes up."""
    total = totals(docs)
    found = written(counted(docs, total.agg(F.sum("total")).first()[0] or 0, shards, least), "frequent")
    found = spelled(docs, found)
    one = found.where("size = 1").select("id", "n", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("n").alias("pre"), F.array("n").alias("suf"))
    below, levels = written(one, "words"), []
    for size in range(2, LONGEST + 1):
        head = below.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("x"), F.col("pre").alias("p"))
        tail = below.select(F.col("id").alias("tail"), F.col("last"), F.col("suf").alias("s"))
        here = found.where(F.col("size") == size).drop("lang", "word").join(head, "head").join(tail, "tail")
        here = here.select("id", "head", "tail", "n", "lang", F.concat_ws(" ", "x", "last").alias("phrase"), "last", F.concat("p", F.array("n")).alias("pre"), F.concat("s", F.array("n")).alias("suf"))
        below = written(here, "phrases")
        levels.append(below.withColumn("best", _scores(size)).select("id", "lang", "phrase", "n", "best"))
    longer = found.where("size > 2")
    around = longer.select(F.col("head").alias("id"), "n").union(longer.select(F.col("tail").alias("id"), "n")).groupBy("id").agg(F.max("n").alias("around"))
    left = reduce(DataFrame.union, levels).join(around, "id", "left").where(f"around IS NULL OR CAST(around AS DECIMAL(20,0)) * 100 < CAST(n AS DECIMAL(20,0)) * {INSIDE}")
    left = left.select("id", "lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("salt", F.pmod(F.shiftright("id", 8), F.lit(SALTS)))  # so that no language is sorted whole in one task
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return left.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
