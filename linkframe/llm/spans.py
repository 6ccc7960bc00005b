"""Substring dedup by sliding sentence spans.

Every run of consecutive units is hashed: from each unit on ``RUN`` of them, or as many as it takes for ``LEAST_WORDS``
words. Of runs that are equal anywhere in the table, all but the first (by doc_id, then a hash of doc_id and text, then place) are
marked, and the units that a marked run covers go. Units are sentences, which end at ``.``, ``!`` or ``?`` before white space
and at line ends; a sentence of over ``LONG`` words is also cut after the word with the least hash of each ``WINDOW``. Words are
what ASCII white space parts; it doesn't matter how much of it there is, but for line ends.

Where a passage lies in its sentence doesn't matter: whole windows inside it choose the same words in every copy, so
only its first and last eight words can be cut differently. From the 17th word on, at the latest, copies are cut alike, and a run
is over 24 words later, at the latest: each passage of 50 words has a run that all its copies share. Passages of under
``LEAST_WORDS`` words are left alone, as texts share so many by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import bytes_of, sequence_hashes, word_hashes, words_of
from .common import free, longer, pieces, removed, written

RUN = 2
#: Fewer words than this are too few to tell a copy from chance.
LEAST_WORDS = 16
#: Sentences of more words are cut by content; no unit has more words than this.
LONG, WINDOW = 10, 9
#: Stands for a null doc_id.
NO_ID = 2**63 - 1
STOP = np.isin(np.arange(256), list(b".!?"))
#: A run that more than this, and more than one in a thousand, of all runs equal is hot; so there are under a thousand hot ones.
HOT = 5000


class Units:
    """The units of a batch of texts. ``end``: where each ends in the bytes (white space behind it is the next one's, or the text's
    last one's); ``first``: the number of each text's first unit; ``words``: the number of each unit's first word."""

    def __init__(self, texts: pa.Array):
        self.raw, self.edge = bytes_of(texts)
        start, stop, first_word = words_of(self.raw, self.edge)
        n = len(start)
        self.hashes = word_hashes(self.raw, start, stop)
        lines = np.concatenate([[0], np.cumsum(self.raw == 10)])
        last = np.zeros(n, bool)  # the last word of its text
        last[first_word[1:][np.diff(first_word) > 0] - 1] = True
        ends = last | STOP[self.raw[stop - 1]] if n else last
        if n > 1:
            ends[:-1] |= lines[start[1:]] > lines[stop[:-1]]
        close = np.flatnonzero(ends)
        size = np.diff(np.r_[-1, close])
        if n >= WINDOW:
            windows = np.lib.stride_tricks.sliding_window_view(self.hashes, WINDOW)
            text = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word))
            whole = np.flatnonzero(text[WINDOW - 1 :] == text[: n - WINDOW + 1])
            for a in range(0, len(whole), 1 << 16):
                at = whole[a : a + (1 << 16)]
                picked = at + windows[at].argmin(axis=1)
                ends[picked[np.repeat(size, size)[picked] > LONG]] = True
        close = np.flatnonzero(ends)
        self.words = np.r_[0, close + 1]
        self.first = np.searchsorted(close, first_word)
        self.end = stop[close].copy()
        self.end[self.first[1:][np.diff(self.first) > 0] - 1] = self.edge[1:][np.diff(self.first) > 0]

    def runs(self, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First unit, the unit behind the last one, and place in its text of each run, by first unit. Where too few words follow a unit
        it begins none; for that, a text's last run ends with it, and if it is not one of the others its place is counted from -1 down."""
        k = np.arange(len(self.end))
        to = np.maximum(k + run, np.searchsorted(self.words, self.words[:-1] + least))
        begin, limit = (np.repeat(x, np.diff(self.first)) for x in (self.first[:-1], self.first[1:]))
        fits = to <= limit
        first, to, at = k[fits], to[fits], (k - begin)[fits]
        lo, hi = self.first[:-1], self.first[1:]
        tail = np.minimum(hi - run, np.searchsorted(self.words, self.words[hi] - least, side="right") - 1)
        lo, hi, tail = lo[tail >= lo], hi[tail >= lo], tail[tail >= lo]
        new = to[np.searchsorted(first, tail)] < hi if len(tail) else np.zeros(0, bool)
        first, to, at = np.r_[first, tail[new]], np.r_[to, hi[new]], np.r_[at, -1 - (tail - lo)[new]]
        order = np.lexsort((to, first))
        return first[order], to[order], at[order]

    def run_hashes(self, first: np.ndarray, to: np.ndarray) -> np.ndarray:
        return sequence_hashes(self.hashes, self.words[first], self.words[to]).view(np.int64)

    def text_of(self, units: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, units, side="right") - 1


def sentences(text: str) -> list[str]:
    """A text's units; joined they are the text, if it has words."""
    u = Units(pa.array([text]))
    return [bytes(u.raw[a:b]).decode() for a, b in zip([0, *u.end[:-1]], u.end, strict=False)]


def doc_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def with_rid(docs: DataFrame, name: str) -> DataFrame:
    """Add a column that tells documents apart: rows with equal doc_id and text are one document."""
    return docs.withColumn(name, F.xxhash64("doc_id", "text"))


def repeated(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """(doc, rid, at): places of runs that are not the first of their kind; ``doc`` is the doc_id, or ``NO_ID``. Input: doc_id, text, rid."""

    def keys(batches):
        for part in pieces(batches):
            u = Units(part.column("text"))
            first, to, at = u.runs(run, least)
            text = u.text_of(first)
            doc, rid = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc", "rid"))
            yield pa.RecordBatch.from_arrays([pa.array(u.run_hashes(first, to)), pa.array(doc), pa.array(rid), pa.array(at.astype(np.int32))], ["run", "doc", "rid", "at"])

    slim = docs.select(doc_of("doc_id").alias("doc"), "rid", "text")
    every = written(slim.mapInArrow(keys, "run long, doc long, rid long, at int"), "every")
    tag = F.xxhash64("doc", "rid", "at")  # a number for a place, as the places themselves would shuffle far more
    twice = every.groupBy("run").agg(F.min(tag).alias("x"), F.max(tag).alias("y"), F.count("*").alias("n")).where("x <> y").select("run", "n")
    twice = written(twice, "twice")
    most = max(HOT, every.count() // 1000)
    hot = twice.where(F.col("n") > most).select("run")
    place = F.struct("doc", "rid", "at")
    if hot.isEmpty():
        some = every.join(twice, "run", "left_semi")
    else:  # hot runs never meet: their first places combine before they shuffle, and come back by broadcast (under a thousand rows)
        first = every.join(F.broadcast(hot), "run", "left_semi").groupBy("run").agg(F.min(place).alias("first"))
        marks = written(every.join(F.broadcast(first), "run").where(place != F.col("first")).select("doc", "rid", "at"), "hot")
        some = every.join(F.broadcast(hot), "run", "left_anti").join(twice, "run", "left_semi")
    some = written(some, "runs")
    first = some.groupBy("run").agg(F.min(place).alias("first"))
    rest = some.join(first, "run").where(place != F.col("first")).select("doc", "rid", "at")
    out = written(rest if hot.isEmpty() else rest.union(marks), "marks")
    removed(every, twice, some, *([] if hot.isEmpty() else [marks]))
    return out


def without_repeats(docs: DataFrame, run: int = RUN, least: int = LEAST_WORDS) -> DataFrame:
    """The documents with ``text`` shortened, and n_sentences and n_removed added.

    Every row stays, with its other columns; a null text stays null, one without words as it is; rows with equal doc_id
    and text count as one document and stay as they are to each other. A document of which all is
    repeated keeps an empty text. Columns named n_sentences or n_removed give way, others keep their names, whatever these are.
    """
    docs = docs.drop("n_sentences", "n_removed")
    rid, doc, marked = free(docs, "rid", "doc", "marked")
    keyed = with_rid(docs, rid)
    marks = repeated(keyed.select("doc_id", "text", F.col(rid).alias("rid")), run, least)
    marks = marks.groupBy(F.col("doc").alias(doc), F.col("rid").alias(rid)).agg(F.collect_set("at").alias(marked))
    both = keyed.withColumn(doc, doc_of("doc_id")).join(marks, [doc, rid], "left").select(*[F.col(f"`{c}`") for c in docs.columns], marked)
    schema = longer(docs.schema, "n_sentences int, n_removed int")
    where = schema.fieldNames().index("text")

    def cut(batches):
        for part in pieces(batches):
            column = part.column(where)
            u = Units(column)
            marks = part.column(part.num_columns - 1).to_pylist()
            gone, texts = np.zeros(part.num_rows, np.int32), None
            first, to, at = u.runs(run, least)
            cut = np.searchsorted(first, u.first)
            for i in (i for i, m in enumerate(marks) if m):
                base, out, here = int(u.first[i]), set(), set(marks[i])
                for j in range(cut[i], cut[i + 1]):
                    if int(at[j]) in here:
                        out |= set(range(int(first[j]), int(to[j])))
                gone[i] = len(out)
                begin = np.r_[u.edge[i], u.end[base : u.first[i + 1] - 1]]
                texts = column.to_pylist() if texts is None else texts
                texts[i] = b"".join(u.raw[a:b].tobytes() for j, (a, b) in enumerate(zip(begin, u.end[base : u.first[i + 1]], strict=True), base) if j not in out).decode()
            cols = [part.column(c) for c in range(part.num_columns - 1)]
            if texts is not None:
                cols[where] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(u.first), pa.int32()), pa.array(gone)], [*part.schema.names[:-1], "n_sentences", "n_removed"])

    return both.mapInArrow(cut, schema)
