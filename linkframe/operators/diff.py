"""Comparison of two snapshots: entities, fields, lists, rows, text blocks, words, files."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import alignment
from .closure import saved
from .model import as_text
from .text import blocks


def blank(c: Column, kind: T.DataType) -> Column:
    """Absent, white space alone, or an empty list."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) <= 0
    if isinstance(kind, T.StringType):
        return F.trim(F.coalesce(F.regexp_replace(c, r"\s", " "), F.lit(""))) == ""
    return c.isNull()


def _filled(c: Column) -> Column:
    """A text, or null where it is white space alone."""
    return F.when(F.trim(F.regexp_replace(c, r"\s", " ")) != "", c)


def _differing(cells: list[Column]) -> Column:
    """Of structs with old and new those that differ."""
    return F.filter(F.array(*cells), lambda x: ~x["old"].eqNullSafe(x["new"]))


def diff_fields(old: DataFrame, new: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(id, field, old, new) of scalar fields that differ, in entities on both sides; blank equals absent.

    The sides meet once, by id; only fields that differ become rows.
    """
    flat = lambda t: {f.name: f.dataType for f in t.schema.fields if f.name not in ("id", "type") and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and (fields is None or f.name in fields)}
    a, b = flat(old), flat(new)
    names = list(dict.fromkeys([*a, *b]))
    if not names:
        return old.sparkSession.createDataFrame([], "id string, field string, old string, new string")
    side = lambda t, kinds, name: t.select("id", F.struct(*[(_filled(as_text(F.col(n), kinds[n])) if n in kinds else F.lit(None).cast("string")).alias(n) for n in names]).alias(name))
    both = side(old, a, "a").join(side(new, b, "b"), "id").where(~F.col("a").eqNullSafe(F.col("b")))
    cells = [F.struct(F.lit(n).alias("field"), F.col(f"a.{n}").alias("old"), F.col(f"b.{n}").alias("new")) for n in names]
    return both.select("id", F.explode(_differing(cells)).alias("x")).select("id", "x.*")


def sliced(batches, rows: int = 128):
    """Batches in pieces of a few rows, so that what Python holds of them doesn't follow a batch's 10,000 texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _multisets(pairs: DataFrame) -> DataFrame:
    """Of each row's arrays of texts a and b: what both have, a alone and b alone, as multisets in order (null last), in place of a and b."""
    keep = [f for f in pairs.schema.fields if f.name not in ("a", "b")]
    kind = pa.list_(pa.string())

    def run(batches):
        for batch in sliced(batches):
            parts = ([], [], [])
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = Counter(a), Counter(b)
                for out, found in zip(parts, (x & y, x - y, y - x), strict=True):
                    out.append(sorted(found.elements(), key=lambda v: (v is None, v or "")))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], *[pa.array(p, kind) for p in parts]], [*[f.name for f in keep], "both", "lost", "gained"])

    schema = T.StructType([*keep, *T.StructType.fromDDL("both array<string>, lost array<string>, gained array<string>").fields])
    return pairs.mapInArrow(run, schema)


def diff_list(old: DataFrame, new: DataFrame, field: str) -> DataFrame:
    """(id, field, lost, gained, reordered): items as a multiset; a pure reorder is told apart. Entities on both sides."""
    pair = old.select("id", F.col(field).alias("a")).join(new.select("id", F.col(field).alias("b")), "id")
    text = lambda c: F.coalesce(F.transform(c, lambda x: x.cast("string")), F.array().cast("array<string>"))
    pair = pair.select("id", text(F.col("a")).alias("a"), text(F.col("b")).alias("b")).where("a <> b")
    got = _multisets(pair).select("id", F.lit(field).alias("field"), "lost", "gained")
    return got.withColumn("reordered", (F.size("lost") == 0) & (F.size("gained") == 0))


def diff_rows(old: DataFrame, new: DataFrame, field: str) -> DataFrame:
    """(id, list, pos, cell, old, new): list rows by position, cell by cell. Entities on both sides.

    The sides meet once, by id; equal lists go at once, and of the others only cells that differ become rows.
    """
    kind = old.schema[field].dataType.elementType
    cells = [f for f in kind.fields if not isinstance(f.dataType, T.ArrayType)]
    both = old.select("id", F.col(field).alias("a")).join(new.select("id", F.col(field).alias("b")), "id").where(~F.col("a").eqNullSafe(F.col("b")))
    text = lambda c, i, f: _filled(as_text(F.get(F.col(c), i)[f.name], f.dataType))
    row = lambda i: _differing([F.struct(i.cast("int").alias("pos"), F.lit(f.name).alias("cell"), text("a", i, f).alias("old"), text("b", i, f).alias("new")) for f in cells])
    size = F.greatest(F.coalesce(F.size("a"), F.lit(0)), F.coalesce(F.size("b"), F.lit(0)))
    found = F.flatten(F.transform(F.when(size > 0, F.sequence(F.lit(0), size - 1)), row))
    return both.select("id", F.explode(found).alias("x")).select("id", F.lit(field).alias("list"), "x.*")


def changed_fields(old: DataFrame, new: DataFrame, derived: tuple[str, ...] = ()) -> DataFrame:
    """(id, field, derived): every field, scalar or list, that differs in entities on both sides."""
    lists = [f.name for f in old.schema.fields if isinstance(f.dataType, T.ArrayType) and f.name in new.columns]
    parts = [diff_fields(old, new).select("id", "field")]
    for name in lists:
        if isinstance(old.schema[name].dataType.elementType, T.StructType):
            parts.append(diff_rows(old, new, name).select("id", F.col("list").alias("field")).distinct())
        else:
            parts.append(diff_list(old, new, name).select("id", "field"))
    got = reduce(lambda a, b: a.union(b), parts)
    return got.withColumn("derived", F.col("field").isin(*derived) if derived else F.lit(False))


#: Ids are dealt into so many buckets to tell what hardly differs; those that differ are sent to every task, half a megabyte at most.
BUCKETS = 1 << 16


def differing(old: DataFrame, new: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Both sides without the buckets of ids in which all rows are the same: only what is left needs to meet.

    A bucket's digest is made of its rows' (a count, and two 64-bit hashes of the rows, whatever their order), which combine before they shuffle. So what is shuffled is a row for each
    bucket and task, and then what follows the changes. Columns that only one side has are null on the other.
    """
    names = sorted({*old.columns, *new.columns} - {key})

    def digests(t: DataFrame, name: str) -> DataFrame:
        cells = [F.col(n) if n in t.columns else F.lit(None) for n in (key, *names)]
        row = [F.bit_xor(F.xxhash64(F.lit(seed), *cells)) for seed in (1, 2)]
        return t.groupBy(_bucket(key).alias("__bucket")).agg(F.struct(F.count("*").alias("n"), *[h.alias(f"h{i}") for i, h in enumerate(row)]).alias(name))

    wrong = digests(old, "a").join(digests(new, "b"), "__bucket", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("__bucket")
    wrong = F.broadcast(saved(wrong))
    return tuple(t.withColumn("__bucket", _bucket(key)).join(wrong, "__bucket", "left_semi").drop("__bucket") for t in (old, new))


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def diff(old: DataFrame, new: DataFrame, derived: tuple[str, ...] = (), scope: DataFrame | None = None) -> DataFrame:
    """(id, op, derived): added, removed, retyped or changed entities. derived: only calculated or selected values changed.

    Both sides have ``id`` and ``type``. Where an entity's text is found doesn't matter. ``scope``: ids to look at. Buckets of ids that are the same on
    both sides never meet (``differing``).
    """
    old, new = differing(old, new)
    ids = old.select("id", F.col("type").alias("a")).join(new.select("id", F.col("type").alias("b")), "id", "full")
    moved = ids.where(~F.col("a").eqNullSafe(F.col("b"))).select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("retyped").alias("op"), F.lit(False).alias("derived"))
    same = ids.where("a = b").select("id")
    fields = changed_fields(old, new, derived).groupBy("id").agg(F.bool_and("derived").alias("derived"))
    out = moved.union(fields.join(same, "id").select("id", F.lit("changed"), "derived"))
    return out.join(scope.select("id"), "id", "left_semi") if scope is not None else out


def diff_raw(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, op): sides without types, compared by their raw text (column text), line ends and outer blanks aside."""
    key = lambda t, n: t.select("id", F.sha2(F.trim(F.regexp_replace("text", "\r\n", "\n")), 256).alias(n))
    got = key(old, "a").join(key(new, "b"), "id", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return got.select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("op"))


def diff_counts(found: DataFrame) -> DataFrame:
    """(op, derived, n)."""
    return found.groupBy("op", "derived").agg(F.count("*").alias("n"))


def diff_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, op): other files by path. Text compares with CRLF as LF, other content by its hash. Input: path, content (binary)."""
    text = F.decode("content", "UTF-8")
    key = F.when(F.expr("is_valid_utf8(content)"), F.sha2(F.regexp_replace(text, "\r\n", "\n"), 256)).otherwise(F.sha2("content", 256))
    old, new = differing(*[t.select("path", key.alias("key")) for t in (old, new)], key="path")
    side = lambda t, n: t.select("path", F.col("key").alias(n))
    got = side(old, "a").join(side(new, "b"), "path", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return got.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("op"))


#: Rows of a text's comparison that leave Python at one time.
OUT_ROWS = 10_000


def _words(c: str) -> Column:
    return F.array_remove(F.split(c, r"\s+"), "")


def diff_text(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, pos, op, old, new): text blocks kept, removed, added or changed, in reading order. Only texts on both sides.

    The order of blocks counts: a block that has moved is removed at one place and added at the other. What lies between two kept blocks is a
    run, and inside it removed and added blocks pair in order, as many as can (``alignment.alike``). Texts whose
    blocks are all equal never leave the JVM; a null text has no blocks.
    """
    side = lambda t, n: blocks(t).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias(n)).select("id", F.transform(n, lambda x: x["key"]).alias(n))
    both = old.select("id").join(new.select("id"), "id").distinct()
    none = F.array().cast("array<string>")
    got = both.join(side(old, "a"), "id", "left").join(side(new, "b"), "id", "left").select(F.col("id").cast("string").alias("id"), F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    same = got.where("a = b").select("id", F.posexplode("a").alias("pos", "old")).select("id", "pos", F.lit("kept").alias("op"), "old", F.col("old").alias("new"))
    schema = pa.schema([("id", pa.string()), ("pos", pa.int32()), ("op", pa.string()), ("old", pa.string()), ("new", pa.string())])

    def compare(batches):
        for batch in sliced(batches, 1):  # the blocks of one text at a time are Python objects
            i, a, b = (batch.column(k)[0].as_py() for k in range(3))
            found = alignment.compared(a, b)
            for at in range(0, len(found), OUT_ROWS):
                part = found[at : at + OUT_ROWS]
                columns = [[i] * len(part), list(range(at, at + len(part))), *(list(x) for x in zip(*part, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return same.union(got.where("a <> b").mapInArrow(compare, "id string, pos int, op string, old string, new string"))


def diff_runs(changed: DataFrame) -> DataFrame:
    """(id, old, new, runs): of changed blocks the runs of words (of fences: lines) kept, removed and added, in reading order. Null counts as empty."""
    kind = pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())]))
    schema = pa.schema([("id", pa.string()), ("old", pa.string()), ("new", pa.string()), ("runs", kind)])

    def run(batches):
        for batch in batches:
            rows = [[{"op": op, "text": t} for op, t in alignment.word_runs(a or "", b or "")] for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, kind)], schema=schema)

    return changed.select(F.col("id").cast("string").alias("id"), "old", "new").mapInArrow(run, "id string, old string, new string, runs array<struct<op:string,text:string>>")


def diff_words(changed: DataFrame) -> DataFrame:
    """Of changed blocks (columns old, new): words kept, removed and added, as multisets in order of word; fences by line. ``diff_runs`` keeps their order."""
    part = lambda c: F.when(F.col(c).rlike(r"^\s{0,3}(```|~~~)"), F.split(c, "\n")).otherwise(_words(c))
    items = lambda c: F.coalesce(part(c), F.array().cast("array<string>"))
    got = _multisets(changed.select("id", "old", "new", items("old").alias("a"), items("new").alias("b")))
    return got.select("id", "old", "new", F.col("both").alias("kept"), F.col("lost").alias("removed"), F.col("gained").alias("added"))
