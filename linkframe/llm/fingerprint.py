"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's shingles.
Two sketches merge by keeping the k smallest of their union, so parts of a document, or documents of
a group, can be sketched apart. A text with fewer words than a shingle has one shingle, the whole
sequence; a text without words (or null) has an empty sketch, whose likeness is 1 to another empty
sketch and 0 to any other.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE, removed, words, written

K = 256
#: Bytes of text in a range of documents.
RANGE_BYTES = 8 << 20
#: Ranges at most; beyond 8 TB of text they grow instead (to some 100 MB at 100 TB).
MOST_RANGES = 1 << 20


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, width: int = SHINGLE) -> DataFrame:
    """Add column ``out``, the sketch of column ``text``."""
    h, s = f"__{out}_words", f"__{out}_shingles"
    df = df.withColumn(h, F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    shingle = lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(width)])
    several = F.transform(F.sequence(F.lit(0), F.size(h) - width), shingle)
    df = df.withColumn(s, F.when(F.size(h) >= width, several).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(s)), 1, k)).drop(h, s)


def union(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts together."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard likeness: the share of the union's sketch that both have."""
    both = union(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a fraction."""
    part = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + F.lit(1.0)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of ``a``'s shingles that ``b`` has."""
    shared = resemblance(a, b, k) * distinct_count(union(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merged(df: DataFrame, key: str, sketch: str, k: int = K, fan: int = 32) -> DataFrame:
    """One sketch per key. Equal sketches of a key are one; the others merge in rounds of about ``fan``, so a hot key never meets in one group.

    Null keys form one group; null sketches count as empty.
    """
    step = written(df.select(F.col(key).alias("key"), F.coalesce(F.col(sketch), F.array().cast("array<bigint>")).alias("sketch")).distinct(), "sketches")
    rows, keys = step.count(), step.select("key").distinct().count()
    salts = 1
    while rows > keys * salts * fan:
        salts *= fan
    while True:
        group = F.pmod(F.xxhash64("sketch"), F.lit(salts)) if salts > 1 else F.lit(0)
        ordered = Window.partitionBy("key", "salt").orderBy(F.size("sketch").desc())
        dealt = step.withColumn("salt", group).withColumn("block", F.floor((F.row_number().over(ordered) - 1) / fan))
        flat = F.flatten(F.collect_list("sketch"))
        before, step = step, written(dealt.groupBy("key", "salt", "block").agg(F.slice(F.sort_array(F.array_distinct(flat)), 1, k).alias("sketch")).drop("salt", "block"), "sketches")
        removed(before)
        if step.count() == keys:
            return step.select(F.col("key").alias(key), F.col("sketch").alias(sketch))
        salts = max(1, salts // fan)


def below(cuts: list[int], at: Column) -> Column:
    """How many of the sorted cuts are below a value: first among blocks of cuts, then in one block, so a row meets some 2 sqrt(n) of n cuts."""
    if not cuts:
        return F.lit(0)
    wide = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    array = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    block = F.greatest(F.lit(0), F.size(F.filter(array([b[0] for b in blocks], "array<bigint>"), lambda c: c < at)) - 1)
    return block * wide + F.size(F.filter(F.get(array(blocks, "array<array<bigint>>"), block), lambda c: c < at))


def in_ranges(df: DataFrame, order: str, carry: str, parts: int) -> DataFrame:
    """The rows dealt into ranges by descending ``order``, for ``following``. Adds __part, __at, __h, __copies and __guest.

    Each range also gets a guest: the first row of the range after it (of the last one, the first of all). Equal values
    of ``order`` follow by a hash of ``carry``; null comes last. A value that many rows have is dealt on by that hash, and of its equal
    rows, which follow each other, one stands for all: __copies says how many more there are.

    At most MOST_RANGES ranges, cut in two steps: the root of their number in the plan, then as many in each of these, in a table. So what
    is broadcast, by way of the driver (cuts, frequent values, first rows), is bounded by a few times MOST_RANGES numbers; Python holds the first cuts alone.
    """
    parts = max(1, min(parts, MOST_RANGES))
    columns = df.columns
    df = df.withColumn("__at", F.coalesce(F.col(order).cast("long"), F.lit(-(2**63)))).withColumn("__copies", F.lit(0).cast("long"))
    most = max(1000, df.count() // parts)
    hot = written(df.groupBy("__at").agg(F.count("*").alias("__n")).where(F.col("__n") > most), "hot")  # fewer than ``parts`` rows
    if hot.isEmpty():
        df = df.withColumn("__n", F.lit(None).cast("long"))
    else:
        df = df.join(F.broadcast(hot), "__at", "left")
        one = df.where("__n is not null").groupBy(*columns, "__at", "__n").agg((F.count("*") - 1).alias("__copies"))
        df = df.where("__n is null").unionByName(one)
    wide = math.isqrt(parts - 1) + 1
    evenly = [i / wide for i in range(1, wide)]
    coarse = df.agg(F.percentile_approx("__at", evenly, 10_000)).first()[0] if evenly else None
    df = df.withColumn("__coarse", below(sorted({*(coarse or [])}), F.col("__at")).cast("long"))
    inner = F.percentile_approx("__at", evenly, 10_000) if evenly else F.array().cast("array<bigint>")
    fine = df.groupBy("__coarse").agg(inner.alias("cuts"), F.collect_set(F.when(F.col("__n").isNotNull(), F.col("__at"))).alias("alone"))
    lower = F.transform(F.filter("alone", lambda v: v > -(2**63)), lambda v: v - 1)
    fine = written(fine.select("__coarse", F.sort_array(F.array_distinct(F.concat("cuts", "alone", lower))).alias("__cuts")), "cuts")
    df = df.join(F.broadcast(fine), "__coarse").withColumn("__h", F.xxhash64(carry))
    # as many equal ranges of the hash as a frequent value needs; lower ones come first, so they have higher numbers
    m = F.least(F.lit(1 << 20), 1 + F.floor(F.col("__n") / most))
    dealt = F.when(F.col("__n").isNull(), 0).otherwise(m - 1 - F.least(m - 1, F.floor((F.col("__h").cast("double") + 2.0**63) * m / 2.0**64)))
    place = F.size(F.filter("__cuts", lambda c: c < F.col("__at"))).cast("long")
    df = df.withColumn("__part", (F.col("__coarse") * (1 << 22) + place) * (1 << 20) + dealt).withColumn("__x", F.bitwise_not("__h"))
    tops = df.groupBy("__part").agg(F.max(F.struct("__at", "__x")).alias("top")).agg(F.sort_array(F.collect_list(F.struct("__part", "top"))).alias("t"))
    after = F.concat(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 1, 1))
    hosts = tops.select(F.inline(F.arrays_zip(F.col("t").alias("this"), after.alias("host")))).select("this.top.*", F.col("host.__part").alias("__host"))
    df = df.join(F.broadcast(hosts), ["__at", "__x"], "left")  # one row per range
    home = F.struct(F.col("__part").alias("part"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("__host").alias("part"), F.lit(1).alias("guest"))
    df = df.withColumn("__home", F.explode(F.when(F.col("__host").isNull(), F.array(home)).otherwise(F.array(home, guest))))
    return df.select(*columns, "__at", "__h", "__copies", F.col("__home.part").alias("__part"), F.col("__home.guest").alias("__guest"))


def following(carry: str) -> Column:
    """Of the next row column ``carry``; null for guests."""
    return F.lead(carry).over(Window.partitionBy("__part").orderBy("__guest", F.col("__at").desc(), "__h"))


def fingerprints(docs: DataFrame, k: int = K, parts: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited text (the last third replaced by the start of the next document).

    Null text counts as empty. Repeated doc_ids are rows of their own, in the order of a hash of their texts.
    Extra columns are ignored. An empty table gives an empty result. ``parts``: ranges that the documents are dealt into, by default as many as
    their bytes need.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    rows = in_ranges(rows, "doc_id", "text", parts).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edit = lambda by: F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(by, F.lit(1), cut))
    rows = rows.withColumn("next_text", following("text")).withColumn("edited", edit("next_text"))
    rows = with_sketch(rows.drop("next_text"), "text", "sketch", k)
    rows = rows.withColumn("next_sketch", following("sketch")).where("__guest = 0")
    itself = F.struct(edit("text").alias("edited"), F.col("sketch").alias("next_sketch"), F.col("__copies").alias("n"))
    other = F.struct("edited", "next_sketch", F.lit(1).cast("long").alias("n"))
    ways = F.when(F.col("__copies") > 0, F.array(other, itself)).otherwise(F.array(other))
    rows = rows.withColumn("v", F.explode(ways)).select("doc_id", "n_chars", "sketch", "v.edited", "v.next_sketch", "v.n")
    rows = with_sketch(rows, "edited", "edited_sketch", k).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    a, b, c = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        resemblance(a, b, k).alias("near_edited"), resemblance(a, c, k).alias("near_next"),
        distinct_count(a, k).alias("distinct_shingles"), containment(a, b, k).alias("contained_in_edited"),
    )
