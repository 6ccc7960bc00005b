"""Mixing sources to target weights as a minimum-cost flow.

Documents that belong to the same sources are one node, whose words can be taken up to ``cap`` times at
convex cost (each further copy costs more); a source's quota is the sink of its words. The flow says how
many words of each membership pattern every source takes. Documents are then chosen in an order drawn
from their id: a pattern's copies lie on a line, first copies before second ones, and the flow's
words are a prefix of that line, dealt to the sources one after the other.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words

#: The flow runs on the driver over patterns, never over documents; more patterns than this are an error.
MAX_PATTERNS = 20_000
BUCKETS = 4096


def shares(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """``total`` shared by weight; what a source has over ``cap`` times its size is shared again among the rest."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = cap * float(sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def flow(supplies: list[tuple[tuple[int, ...], int]], quotas: list[int], cap: int) -> list[dict[int, int]]:
    """Words that each pattern (its sources, its size) gives to each source, at least cost, as near to the quotas as can be.

    Copy c of a pattern's words costs c - 1 a word. Successive shortest paths with potentials; each
    path carries all it can, so their number follows patterns, copies and sources, not words.
    """
    n, m = len(supplies), len(quotas)
    begin, end = n + m, n + m + 1
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, r, c in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)
        return len(to) - 2

    ways: list[dict[int, int]] = []
    for p, (members, size) in enumerate(supplies):
        for copy in range(cap):
            edge(begin, p, size, copy)
        ways.append({s: edge(p, n + s, cap * size, 0) for s in members})
    for s, quota in enumerate(quotas):
        edge(n + s, end, quota, 0)
    height = [0] * (n + m + 2)
    while True:
        far, via, queue = {begin: 0}, {}, [(0, begin)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in out[a]:
                if room[e] and (to[e] not in far or d + cost[e] + height[a] - height[to[e]] < far[to[e]]):
                    far[to[e]] = d + cost[e] + height[a] - height[to[e]]
                    via[to[e]] = e
                    heapq.heappush(queue, (far[to[e]], to[e]))
        if end not in far:
            return [{s: room[e ^ 1] for s, e in w.items() if room[e ^ 1]} for w in ways]
        most = max(far.values())
        height = [h + far.get(i, most) for i, h in enumerate(height)]
        path, a = [], end
        while a != begin:
            path.append(via[a])
            a = to[via[a] ^ 1]
        words_ = min(room[e] for e in path)
        for e in path:
            room[e] -= words_
            room[e ^ 1] += words_


def mix(docs: DataFrame, members: Column, size: Column, weights, share: float = 1.5, cap: int = 2, seed: int = 0, key: str = "doc_id", tie: Column | None = None) -> DataFrame:
    """Add size, source_size, target, copies, taken and dealt to every document.

    ``members``: array of a document's sources (null is a source of its own; an empty or null array belongs to none
    and is not taken). ``weights``: from the number of sources, in code point order, null last, to their weights.
    ``share``: words to take, as a part of all words. No document is taken more than ``cap`` times. source_size and
    target are those of the document's first source; dealt has of each copy the source whose quota it fills, and that source's target. Rows with equal
    id and ``tie`` (a hash of the text, say, so that rows without an id don't draw one lot) draw equal lots and follow by size; identical rows are told apart by none of their results but copies. Columns that already have the
    added names give way, all others keep theirs. A table without words takes nothing.
    """
    added = ("size", "source_size", "target", "copies", "taken", "dealt")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    members = F.array_sort(F.array_distinct(F.coalesce(members.cast("array<string>"), F.array().cast("array<string>"))))
    docs = docs.select(row.alias("row"), F.col(key).alias("id"), (F.lit(0) if tie is None else tie).alias("tie"), members.alias("members"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    docs = docs.withColumn("pattern", F.to_json("members", {"ignoreNullFields": "false"})).drop("members")
    found = docs.groupBy("pattern").agg(F.sum("size").alias("z")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge rare sources first")
    supplies = sorted(((tuple(json.loads(r["pattern"])), r["z"]) for r in found), key=lambda x: [(s is None, s or "") for s in x[0]])
    sources = sorted({s for m, _ in supplies for s in m}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(sources)}
    sizes = [sum(z for m, z in supplies if s in m) for s in sources]
    targets = shares(sizes, weights(len(sources)), share * sum(z for _, z in supplies), cap)
    routed = flow([(tuple(at[s] for s in m), z) for m, z in supplies], [math.floor(t + 0.5) for t in targets], cap)
    rows = []
    for (m, z), got in zip(supplies, routed, strict=True):
        first = at[m[0]] if m else None
        ends = [sum(list(got.values())[: i + 1]) for i in range(len(got))]
        names = [(sources[i], targets[i]) for i in got]
        rows.append((json.dumps(m, ensure_ascii=False), z, sum(got.values()), ends, names, sizes[first] if m else 0, targets[first] if m else 0.0))
    plan = docs.sparkSession.createDataFrame(rows, "p string, z long, w long, ends array<long>, names array<struct<source: string, target: double>>, source_size long, target double")
    # to_json writes no blanks between items, json.dumps does: patterns meet as arrays
    plan = plan.withColumn("pattern", F.to_json(F.from_json("p", "array<string>"), {"ignoreNullFields": "false"})).drop("p")
    docs = docs.join(F.broadcast(plan), "pattern")  # MAX_PATTERNS rows at most
    docs = docs.withColumn("lot", F.xxhash64(F.lit(seed), "id", "tie")).withColumn("bucket", F.shiftrightunsigned("lot", 64 - BUCKETS.bit_length() + 1).cast("int"))
    sums = docs.groupBy("pattern", "bucket").agg(F.sum("size").alias("s"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pattern", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("lot", "id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.join(sums, ["pattern", "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    middle = F.col("at") + F.col("size") / 2
    copies = sum(((middle + F.col("z") * c < F.col("w")).cast("int") for c in range(cap)), F.lit(0))
    docs = docs.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    source_at = lambda place: F.get("names", F.size(F.filter("ends", lambda e: e <= place)))
    dealt = F.array(*[source_at(middle + F.col("z") * c) for c in range(cap)])
    return docs.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), F.slice(dealt, 1, F.col("copies")).alias("dealt"))


def overlapping(docs: DataFrame) -> DataFrame:
    """The mix of documents by source and by language, each document a member of both: weights 3, 1, 2 in turn, 150 % of all words, twice at most."""
    slim = docs.select("doc_id", "source", "lang", F.size(words(F.col("text"))).cast("long").alias("n"))
    members = [F.concat(F.lit(f"{c}="), c) for c in ("source", "lang")]
    return mix(slim, F.filter(F.array(*members), lambda m: m.isNotNull()), F.col("n"), by_turns(3, 1, 2))


def quotas(mixed: DataFrame) -> DataFrame:
    """(source, target, given): of each source that gives something the words it was to give and the words of the copies dealt to it."""
    each = mixed.select("size", F.explode("dealt").alias("d"))
    return each.groupBy(F.col("d.source").alias("source")).agg(F.max("d.target").alias("target"), F.sum("size").alias("given"))


def by_turns(*weights: float):
    """Weights given to the sources in turn."""
    return lambda n: [float(weights[i % len(weights)]) for i in range(n)]


def mixed(docs: DataFrame) -> DataFrame:
    """The mix of documents by ``source``: weights 3, 1, 2 in turn, 150 % of all words, twice at most. Only ids and sizes shuffle."""
    slim = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("n"), F.xxhash64("text").alias("text"))
    return mix(slim, F.array("source"), F.col("n"), by_turns(3, 1, 2), tie=F.col("text")).select("doc_id", "size", "source_size", "target", "taken")
