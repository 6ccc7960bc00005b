"""Repeated byte strings by a run-compressed Burrows-Wheeler transform.

Every window of ``WIDTH`` bytes has one anchor, the gram of ``GRAM`` bytes with the least hash in it, so equal
windows have equal anchors. An anchor's occurrence owns the run of windows that chose it; its segment is the text
of these windows. Anchors that occur once hold nothing repeated; where all segments of an anchor are equal,
all of them are repeated. The segments of the other anchors meet by anchor, in parts of bounded size, and each part
is indexed: suffix array, Burrows-Wheeler transform, its runs, suffix-array samples at both ends of every run and
the matches with the neighbour beyond each end. All other matches follow from these while the text streams by: a match
shrinks by one with each step until a run's end gives a longer one. Windows whose longest match reaches
``WIDTH`` are repeated. A window belongs to one segment only, so it never matches itself.

Equal segments of an anchor combine before their bytes are fetched. An anchor with more than ``HOT`` different segments isn't brought together:
longer anchors take its place. A window has half of the bytes that it is longer than its anchor on one side
of it or the other, so it goes to the anchor made longer by these, to the left or to the right; such anchors serve as the first ones do, and are made longer in
their turn, up to the whole window.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import bytes_of, mix64, range_hashes
from .common import pieces, removed, written

WIDTH = 200
GRAM = 32
HOT = 20_000
PART_SEGMENTS = 5000
BLOCK = 1 << 20
#: Of keys that more than this, and more than one in a thousand, of all rows have there are under a thousand; they join by broadcast.
HEAVY = 5000
PACK = 7  # symbols of 9 bits in 63


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` (a power of two) bytes from each place on."""
    h, step = raw.astype(np.uint64) + np.uint64(1), 1
    while step < gram:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ h[step:] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        step *= 2
    return h ^ h >> np.uint64(32)


def anchors(raw: np.ndarray, edge: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts (bytes from ``edge`` to ``edge``) in order: hash, place, text, start of the first window that chose it, end of the last.

    Of equal hashes a window takes the leftmost. Blocks of bounded size, whose windows overlap nowhere.
    """
    hashes, places, firsts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(raw) - width + 1, BLOCK):
        h = gram_hashes(raw[a : a + BLOCK + width - 1], gram)
        least, span, have = (h & np.uint64(0xFFFFFFFF)) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), width - gram + 1, 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        start = np.arange(a, a + len(least))
        text = np.searchsorted(edge, start, side="right") - 1
        start = start[start + width <= edge[text + 1]]  # windows inside one text
        place = (least[start - a] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
        hashes.append(h[place[new]])
        places.append(place[new] + a)
        firsts.append(start[new])
    key, place, first = np.concatenate(hashes), np.concatenate(places), np.concatenate(firsts)
    new = np.r_[True, place[1:] != place[:-1]][: len(place)]  # an anchor of two blocks is one
    key, place, first = key[new], place[new], first[new]
    text = np.searchsorted(edge, first, side="right") - 1
    to = np.r_[first[1:] - 1, 0][: len(first)]
    last = np.r_[text[1:] != text[:-1], True][: len(first)]
    to[last] = edge[text[last] + 1] - width
    return key.view(np.int64), place, text, first, to + width


def packed_symbols(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next PACK symbols of each place as one number, zeros from the end of its segment on."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(PACK, text.dtype)])
    key = np.zeros(n, np.int64)
    for i in range(PACK):
        key = key << 9 | np.where(left >= i, padded[i : n + i], 0)
    return key


def suffix_array(key: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling from packed symbols. Zeros end segments and are all different, in order of place.

    ``left``: symbols before the next zero. A suffix that meets a zero within its pack equals no other one.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_ = key[order]
    rank[order] = np.maximum.accumulate(np.where(np.r_[True, (sorted_[1:] != sorted_[:-1]) | (left[order[1:]] < PACK)], np.arange(n), 0))
    size = PACK
    while True:
        ranks = rank[order]
        same = np.r_[False, ranks[1:] == ranks[:-1]]
        todo = np.flatnonzero(same | np.r_[same[1:], False])  # places in the order that aren't settled
        if not len(todo):
            return order
        items = order[todo]
        group, after = rank[items], rank[np.minimum(items + size, n - 1)]
        sub = np.argsort(group * n + after, kind="stable")
        items, after = items[sub], after[sub]
        order[todo] = items
        new = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank[items] = np.maximum.accumulate(np.where(new, todo, 0))
        size *= 2


def common_prefix(text: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, no longer than ``room``: pack by pack, then symbol by symbol."""
    n = len(text)
    out, live, at = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(live):
        x, y = a[live] + at, b[live] + at
        same = (at + PACK <= room[live]) & (np.maximum(x, y) < n)
        same[same] = key[x[same]] == key[y[same]]
        out[live[~same]] = at
        live = live[same]
        at += PACK
    live = np.flatnonzero(out < room)
    for _ in range(PACK):
        x, y = a[live] + out[live], b[live] + out[live]
        same = (out[live] < room[live]) & (np.maximum(x, y) < n)
        same[same] = text[x[same]] == text[y[same]]
        live = live[same]
        out[live] += 1
    return out


class RunIndex:
    """Run-compressed transform of a text of segments: run heads, their symbols, and the samples at both ends of each run."""

    def __init__(self, segments: list[bytes]):
        size = np.array([len(s) for s in segments], np.int64)
        raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
        self.ends = np.cumsum(size + 1) - 1
        self.starts = self.ends - size
        raw[self.ends] = 0
        self.text = raw
        left = np.repeat(self.ends, size + 1) - np.arange(len(raw))
        key = packed_symbols(raw, left)
        order = suffix_array(key, left)
        bwt = raw[order - 1]
        new = np.r_[True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)]
        self.heads = np.flatnonzero(new)
        self.symbols = bwt[self.heads]
        tails = np.r_[self.heads[1:], len(order)] - 1
        self.first, self.last = order[self.heads], order[tails]  # suffix-array samples
        before, after = order[self.heads[1:] - 1], order[tails[:-1] + 1]
        self.left = left
        self.above = np.r_[0, common_prefix(raw, key, before, self.first[1:], left[self.first[1:]])]
        self.below = np.r_[common_prefix(raw, key, self.last[:-1], after, left[self.last[:-1]]), 0]

    def matches(self) -> np.ndarray:
        """Of every place the length of the longest match with any other place, within its segment."""
        out = np.zeros(len(self.text), np.int64)
        for at, size in ((self.first, self.above), (self.last, self.below)):
            reach = np.zeros(len(self.text), np.int64)
            np.maximum.at(reach, at, at + size)
            out = np.maximum(out, np.maximum.accumulate(reach) - np.arange(len(self.text)))
        return np.minimum(out, self.left)


def spans_of(marked: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs covered by windows of ``width`` at the sorted places ``marked``."""
    if not len(marked):
        return []
    cut = np.flatnonzero(np.diff(marked) > width)
    return list(zip(marked[np.r_[0, cut + 1]].tolist(), (marked[np.r_[cut, len(marked) - 1]] + width).tolist(), strict=True))


def repeated_in(anchor: list[int], segments: list[bytes], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """Repeated spans of each segment. Equal segments of an anchor are repeated whole, and stand in the index once."""
    groups: dict[tuple[int, bytes], list[int]] = {}
    for i, key in enumerate(zip(anchor, segments, strict=True)):
        groups.setdefault(key, []).append(i)
    keys = list(groups)
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    index = RunIndex([k[1] for k in keys])
    hit = np.flatnonzero(index.matches() >= width)
    which = np.searchsorted(index.ends, hit)
    edge = np.searchsorted(which, np.arange(len(keys) + 1))
    for j, key in enumerate(keys):
        own = groups[key]
        found = [(0, len(key[1]))] if len(own) > 1 else spans_of(hit[edge[j] : edge[j + 1]] - index.starts[j], width)
        for i in own:
            out[i] = found
    return out


ANCHOR = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("to", pa.int64())])


def anchor_rows(docs: DataFrame, width: int) -> DataFrame:
    """(anchor, segment (a hash of its bytes), doc, rid, at, to): one row per anchor, ``at`` and ``to`` bound its segment."""

    def run(batches):
        for part in pieces(batches, 512, 4 << 20):
            raw, edge = bytes_of(part.column(2))
            key, _, text, first, to = anchors(raw, edge, width)
            if len(key):
                doc, rid = (part.column(i).to_numpy(zero_copy_only=False)[text] for i in range(2))
                segment = range_hashes(lambda a, b: mix64(raw[a:b].astype(np.uint64) + np.uint64(1)), len(raw), first, to).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, segment, doc, rid, first - edge[text], to - edge[text])], schema=ANCHOR)

    return docs.select("doc", "rid", "text").mapInArrow(run, "anchor long, segment long, doc long, rid long, at long, to long")


#: A segment and its anchor's place and length within; level says how often the anchor was made longer.
SEGMENT = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("core", pa.int32()), ("size", pa.int32()), ("bytes", pa.binary())])
SEGMENTS = "anchor long, doc long, rid long, at long, core int, size int, bytes binary"


def segments(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The segments at ``places`` (doc, rid, anchor, at, to)."""
    lists = places.groupBy("doc", "rid").agg(F.collect_set(F.struct("anchor", "at", "to")).alias("places")).hint("merge")  # as many as there are documents
    both = docs.join(lists, ["doc", "rid"])

    def run(batches):
        for part in pieces(batches):
            cols: list[list] = [[] for _ in SEGMENT]
            for doc, rid, text, places in zip(*(part.column(c).to_pylist() for c in ("doc", "rid", "text", "places")), strict=True):
                data = text.encode("utf-8")
                for p in places:
                    a, b = p["at"], p["to"]
                    for col, x in zip(cols, (p["anchor"], doc, rid, a, 0, 0, data[a:b]), strict=True):
                        col.append(x)
                if len(cols[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SEGMENT, strict=True)], schema=SEGMENT)
                    cols = [[] for _ in SEGMENT]
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SEGMENT, strict=True)], schema=SEGMENT)

    return both.select("doc", "rid", "text", "places").mapInArrow(run, SEGMENTS)


def longer_anchors(found: DataFrame, width: int) -> DataFrame:
    """Each segment dealt to two longer anchors: windows that hold half of what is missing to the left of the anchor, and the others, which hold
    the rest to its right. A segment without a known anchor place (size 0) has it found first."""

    def run(batches):
        for part in pieces(batches, 4096):
            rows = []
            for r in part.to_pylist():
                data, core, size = r["bytes"], r["core"], r["size"]
                if not size:
                    raw = np.frombuffer(data, np.uint8)
                    core, size = int(anchors(raw, np.array([0, len(raw)]), width)[1][0]), GRAM
                last, more = len(data) - width, width - size  # windows start at 0 to last
                left = (more + 1) // 2
                right = more - left + 1
                for side, a, b, c, n in ((0, 0, min(last, core - left), core - left, size + left), (1, max(0, core - left + 1), last, core, size + right)):
                    if a <= b:
                        key = data[c : c + n]
                        rows.append((hashed(key, r["anchor"], side), r["doc"], r["rid"], r["at"] + a, c - a, n, data[a : b + width]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SEGMENT, strict=True)], schema=SEGMENT)

    return found.mapInArrow(run, SEGMENTS)


def hashed(data: bytes, *names: int) -> int:
    """A signed 64-bit number for bytes under names."""
    return int.from_bytes(hashlib.blake2b(data + b"".join((n & (1 << 64) - 1).to_bytes(8, "little") for n in names), digest_size=8).digest(), "little", signed=True)


MARK = pa.schema([("doc", pa.int64()), ("rid", pa.int64()), ("at", pa.int64()), ("to", pa.int64())])


def indexed(found: DataFrame, width: int, parts: int) -> DataFrame:
    """Repeated spans (doc, rid, at, to) of segments, a run-compressed index per part; an anchor is in one part."""

    def run(table: pa.Table) -> pa.Table:
        at = table.column("at").to_pylist()
        spans = repeated_in(table.column("anchor").to_pylist(), table.column("bytes").to_pylist(), width)
        rows = [(d, r, a + x, a + y) for d, r, a, s in zip(table.column("doc").to_pylist(), table.column("rid").to_pylist(), at, spans, strict=True) for x, y in s]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=MARK)

    slim = found.select(F.pmod(F.shiftright("anchor", 20), F.lit(parts)).alias("part"), "anchor", "doc", "rid", "at", "bytes")
    return slim.groupBy("part").applyInArrow(run, "doc long, rid long, at long, to long")


def kinds_of(rows: DataFrame, hot: int) -> DataFrame:
    """(anchor, n, kind) of anchors that occur again: 0 where all segments are equal, 1 for the index, 2 if perhaps too many for one part of it."""
    found = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("segment").alias("a"), F.max("segment").alias("b")).where("n > 1")
    return found.select("anchor", "n", F.when(F.col("a") == F.col("b"), F.lit(0)).when(F.col("n") <= hot, F.lit(1)).otherwise(F.lit(2)).alias("kind"))


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Rows with what ``groups`` (n: rows of a group) says of theirs; others go. Groups of a large share of all rows meet no shuffle: they are few."""
    large = F.col("n") > max(HEAVY, total // 1000)
    heavy, light = groups.where(large), groups.where(~large).hint("merge")  # light grows with the corpus: never broadcast
    if heavy.isEmpty():
        return rows.join(light, keys)
    return rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys).unionByName(rows.join(F.broadcast(heavy), keys))


def split(found: DataFrame, hot: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Of hot anchors' segments: spans (doc, rid, at, to) that are repeated for sure, and segments under longer anchors for the index."""
    marks, ready = [], []
    while True:
        # equal segments are repeated whole, and one of each kind stands for them
        found = written(found.withColumn("segment", F.xxhash64("bytes")), "segments")
        times = found.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("doc", "rid", "at")).alias("one"))
        again = times.where("n > 1").select("anchor", "segment", "one", "n")
        total = found.count()
        heavy = again.where(F.col("n") > max(HEAVY, total // 1000)).select("anchor", "segment")
        light = again.select("anchor", "segment")
        whole = found.join(light, ["anchor", "segment"], "left_semi") if heavy.isEmpty() else found.join(F.broadcast(heavy), ["anchor", "segment"], "left_anti").join(light, ["anchor", "segment"], "left_semi").unionByName(found.join(F.broadcast(heavy), ["anchor", "segment"], "left_semi"))
        marks.append(written(whole.select("doc", "rid", "at", (F.col("at") + F.length("bytes")).alias("to")), "marks"))
        ones = times.select("anchor", "one.*").distinct()
        left = written(found.drop("segment").join(ones, ["anchor", "doc", "rid", "at"], "left_semi").dropDuplicates(["anchor", "doc", "rid", "at"]).withColumn("segment", F.xxhash64("bytes")), "different")
        kinds = written(kinds_of(left, hot), "kinds")
        ready.append(left.join(kinds.where("kind = 1"), "anchor", "left_semi").drop("segment"))
        more = left.join(kinds.where("kind = 2"), "anchor", "left_semi").drop("segment")
        removed(found)
        if kinds.where("kind = 2").isEmpty():
            break
        found = longer_anchors(more, width)
    union = lambda x: reduce(lambda a, b: a.unionByName(b), x)
    return union(marks), union(ready)


def cut_out(docs: DataFrame, width: int = WIDTH, hot: int = HOT, part_segments: int = PART_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, spans (array of removed [start, end) byte offsets) and kept (the bytes left) of every document.

    Null text counts as empty. Equal rows are documents of their own, so each removes what the other has. Texts
    under ``width`` bytes lose nothing. Extra columns are left out.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    docs = docs.select(doc.alias("doc"), F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(anchor_rows(docs, width), "anchors")
    kinds = written(kinds_of(rows, hot), "kinds")
    total = rows.count()
    places = written(with_group(rows, kinds, ["anchor"], total).drop("n"), "places")
    removed(rows, kinds)
    marks = places.where("kind = 0").select("doc", "rid", "at", "to")
    # of equal segments all are repeated whole, and the one of the least lot stands for them in the index
    mixed = places.where("kind > 0").withColumn("lot", F.xxhash64("doc", "rid", "at"))
    times = written(mixed.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min("lot").alias("least"), F.max("kind").alias("kind")), "times")
    different = times.count()
    if different:
        mixed = written(with_group(mixed.drop("kind"), times, ["anchor", "segment"], total).withColumn("stands", F.col("lot") == F.col("least")).drop("segment", "lot", "least", "kind"), "mixed")
        marks = marks.union(mixed.where("n > 1").select("doc", "rid", "at", "to"))
        ones = mixed.where("stands")
        often = times.where("kind = 2").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor")
        if often.isEmpty():
            found = segments(docs, ones)
        else:
            more, ready = split(segments(docs, ones.join(often, "anchor", "left_semi")), hot, width)
            marks = marks.union(more)
            found = segments(docs, ones.join(often, "anchor", "left_anti")).unionByName(ready)
        marks = marks.union(indexed(found, width, math.ceil(different / part_segments)))
    marks = marks.groupBy("doc", "rid").agg(F.collect_set(F.struct("at", "to")).alias("__marks")).hint("merge")
    both = docs.join(marks, ["doc", "rid"], "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("at", pa.int64()), ("to", pa.int64())]))), ("kept", pa.binary())])

    def run(batches):
        for part in pieces(batches):
            out = []
            for d, text, marks in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("__marks").to_pylist(), strict=True):
                data, spans = text.encode("utf-8"), []
                for m in sorted(marks or (), key=lambda m: (m["at"], m["to"])):
                    if spans and m["at"] <= spans[-1]["to"]:
                        spans[-1]["to"] = max(spans[-1]["to"], m["to"])
                    else:
                        spans.append(dict(m))
                kept, at = [], 0
                for s in spans:
                    kept.append(data[at : s["at"]])
                    at = s["to"]
                out.append({"doc_id": d, "n_bytes": len(data), "spans": spans, "kept": b"".join([*kept, data[at:]])})
            yield pa.RecordBatch.from_pylist(out, schema)

    return both.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<at: long, to: long>>, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    """Numbers and a digest of what ``cut_out`` returns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["to"] - s["at"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
