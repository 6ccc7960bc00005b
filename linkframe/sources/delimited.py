"""Entities from delimited files and text corpora, strictly typed; what is wrong is reported, not guessed at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkframe.operators.closure import saved
from linkframe.registry import Field, Registry

from .records import cells, records, sent

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PROBLEMS = "path string, id string, severity string, message string"


def split_items(c: Column, separator: str = ";") -> Column:
    """Items of a cell: split, trimmed, empty ones dropped."""
    parts = F.transform(F.split(c, F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E"))), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def type_cell(c: Column, kind: str) -> tuple[Column, Column]:
    """(value, whether the text isn't of its kind). Empty cells are absent."""
    raw = F.when(F.trim(c) != "", F.trim(c))
    if kind == "number":
        value = F.when(raw.rlike(NUMBER), F.expr("1.0D") * raw.try_cast("double"))
        value = F.when(F.abs(value) != F.lit(float("inf")), value)
    elif kind == "boolean":
        value = F.when(raw.isin("true", "True", "TRUE"), F.lit(True)).when(raw.isin("false", "False", "FALSE"), F.lit(False))
    elif kind == "date":
        value = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    else:
        value = F.when(c != "", c)
        raw = value
    return value, raw.isNotNull() & value.isNull()


def typed(c: Column, f: Field, separator: str) -> tuple[Column, Column]:
    if f.kind == "link":
        ids = split_items(c, separator)
        return (F.when(F.size(ids) > 0, ids), F.lit(False)) if f.many else (F.when(F.trim(c) != "", F.trim(c)), F.lit(False))
    if f.kind == "list":
        if f.fields:
            raise ValueError(f"{f.name}: list rows can't be read from a cell")
        items = split_items(c, separator)
        values = F.transform(items, lambda x: type_cell(x, f.of)[0])
        return F.when(F.size(items) > 0, values), F.exists(items, lambda x: type_cell(x, f.of)[1])
    return type_cell(c, f.kind)


def audit_header(spark: SparkSession, header: list[str], fields: tuple[Field, ...], id_col: str) -> DataFrame:
    """Problems of a header: duplicates and a missing id column (errors), unread columns and fields without one (warnings)."""
    names = {f.column or f.name for f in fields if not f.calculated}
    rows = [(h, "error", f"column {h} is there twice") for h in sorted({h for h in header if header.count(h) > 1})]
    if id_col not in header:
        rows.append((id_col, "error", f"there is no column {id_col} for the id"))
    rows += [(h, "warning", f"column {h} is not read") for h in dict.fromkeys(header) if h not in names and h != id_col]
    rows += [(n, "warning", f"field {n} has no column") for n in sorted(names) if n not in header]
    return spark.createDataFrame(rows, "name string, severity string, message string")


def check_encoding(spark: SparkSession, path: str) -> DataFrame:
    """Files that aren't UTF-8, with the first line that isn't."""
    bad = spark.read.format("binaryFile").load(path).where("not is_valid_utf8(content)")
    # lines of the bytes as Latin-1, which every byte is; then each line alone as UTF-8
    lines = bad.select("path", F.posexplode(F.split(F.decode("content", "ISO-8859-1"), "\n")).alias("pos", "s"))
    wrong = lines.where(~F.expr("is_valid_utf8(encode(s, 'ISO-8859-1'))"))
    return wrong.groupBy("path").agg((F.min("pos") + 1).alias("line")).select("path", "line", F.lit("not UTF-8").alias("message"))


def _header_problems(files: DataFrame, fields: list[Field], id_col: str) -> DataFrame:
    """``audit_header`` for a table of files (path, header), a row per problem."""
    names = sorted({f.column or f.name for f in fields if not f.calculated})
    known = F.array(*[F.lit(x) for x in dict.fromkeys([id_col, *names])])
    header = F.col("header")
    say = lambda severity, names, before, after: F.transform(names, lambda h: F.struct(F.lit(severity).alias("severity"), F.concat(F.lit(before), h, F.lit(after)).alias("message")))
    twice = F.array_distinct(F.filter(header, lambda h, i: F.array_position(header, h) != i + 1))
    none = F.when(~F.array_contains(header, id_col), F.array(F.struct(F.lit("error").alias("severity"), F.lit(f"there is no column {id_col} for the id").alias("message")))).otherwise(F.array().cast("array<struct<severity:string,message:string>>"))
    found = F.concat(say("error", twice, "column ", " is there twice"), none, say("warning", F.array_except(header, known), "column ", " is not read"))
    if names:
        found = F.concat(found, say("warning", F.array_except(F.array(*[F.lit(x) for x in names]), header), "field ", " has no column"))
    return files.select("path", F.explode(found).alias("x")).select("path", F.lit(None).cast("string").alias("id"), "x.*", F.lit(1).cast("long").alias("line"))


def read_entities(spark: SparkSession, path: str, registry: Registry, etype: str, id_col: str = "id", delimiter: str = ",", separator: str = ";") -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of RFC 4180 files, each with a header of its own.

    rows: id, the type's fields, ``f__raw`` of invalid cells, path, and line. A row with the wrong number of cells, or without an id, is
    dropped and reported with its line, as is one with a quote out of place. Quoted cells may hold delimiters, doubled quotes and line ends; one that never ends is reported
    and what follows it isn't read. A file's columns are found by the names in its own
    header, in whatever order; a file whose header has a name twice, lacks the id column or isn't there gives problems and no rows.
    Files are cut in parallel (``records``), and headers are a table that is joined, so nothing that grows with files reaches the driver.
    """
    fields = [f for f in registry.fields(etype) if not f.calculated]
    found, files = records(spark, path, delimiter)
    files = saved(files)
    note = lambda df, message, line="line", ident=None: df.select("path", (F.lit(None).cast("string") if ident is None else ident).alias("id"), F.lit("error").alias("severity"), F.lit(message).alias("message"), F.col(line).cast("long").alias("line"))
    # no row comes from empty files; their names are in the listing that Spark's driver holds of any path
    plain = F.regexp_replace("path", "^([A-Za-z0-9+.-]+):/+", "$1:/").alias("plain")
    listed = spark.createDataFrame([(p,) for p in spark.read.text(path).inputFiles()], "path string")
    empty = listed.select("path", plain).join(files.select(plain), "plain", "left_anti").select("path", F.lit(1).alias("line"))
    headed = files.where(F.col("header").isNotNull())
    problems = [note(empty, "the file has no header"), note(files.where(F.col("header").isNull()).withColumn("line", F.lit(1)), "the file has no header"), note(files.where(F.col("broken").isNotNull()), "a quoted cell doesn't end", "broken")]
    problems.append(_header_problems(headed, fields, id_col))
    right_head = F.array_contains("header", id_col) & (F.size(F.array_distinct("header")) == F.size("header"))
    place = lambda name: (F.array_position("header", name) - 1).cast("int")
    names = {f.column or f.name: f"__p{i}" for i, f in enumerate(fields)}
    good = headed.where(right_head).select("file", "path", F.size("header").alias("__n"), place(id_col).alias("__id"), *[place(n).alias(p) for n, p in names.items()])
    raw = found.join(sent(saved(good)), "file").withColumn("__cells", cells(F.col("text"), delimiter))
    cell = lambda p: F.get("__cells", F.col(p))
    key = F.trim(cell("__id"))
    problems.append(note(raw.where(F.col("__cells").isNull()), "a quote is out of place"))
    problems.append(note(raw.where(F.size("__cells") != F.col("__n")), "the row has the wrong number of cells", ident=key))
    right = raw.where(F.size("__cells") == F.col("__n")).withColumn("id", key)
    nameless = F.coalesce(F.col("id"), F.lit("")) == ""
    problems.append(note(right.where(nameless), "the row has no id"))
    columns = [F.col("id")]
    for f in fields:
        value, bad = typed(cell(names[f.column or f.name]), f, separator)
        columns += [value.cast(f.spark()).alias(f.name), F.when(bad, cell(names[f.column or f.name])).alias(f"{f.name}__raw")]
    return right.where(~nameless).select(*columns, "path", "line"), reduce(lambda a, b: a.union(b), problems)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, problems) of whole text files: id, type, keys (a map of the header), body, path.

    A file is an entity when its header block (between lines of ``---`` at its start) has both ``id`` and ``type``; one of them alone
    is a problem. Headers are flat ``key: value`` lines.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    return corpus(files)


HEADER = r"(?s)^\x{FEFF}?---[ \t]*\r?\n(.*?)(?:(?<=\n)---[ \t]*(?:\r?\n(.*)|$))"


def corpus(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``read_corpus`` on a table of (path, text)."""
    got = files.where(F.col("text").rlike(HEADER)).withColumn("head", F.regexp_extract("text", HEADER, 1)).withColumn("body", F.regexp_extract("text", HEADER, 2))
    lines = F.filter(F.split("head", r"\r?\n"), lambda s: s.rlike(r"^[A-Za-z_][\w-]*:(\s|$)"))
    pairs = F.transform(lines, lambda s: F.struct(F.substring_index(s, ":", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(s, r"^[^:]*:", "")), "^([\"'])(.*)\\1$", "$2").alias("v")))
    first = F.filter(pairs, lambda p: p["v"] != "\u0000")
    keys = F.map_from_entries(F.filter(F.transform(first, lambda p, i: F.struct(p["k"], F.when(F.array_position(F.transform(first, lambda q: q["k"]), p["k"]) == i + 1, p["v"]).alias("v"))), lambda p: p["v"].isNotNull()))
    got = got.withColumn("keys", keys).withColumn("id", F.try_element_at("keys", F.lit("id"))).withColumn("type", F.try_element_at("keys", F.lit("type")))
    full = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    problem = (
        F.when(F.col("id").isNull() & F.col("type").isNull(), F.lit(None))
        .when(F.col("type").isNull(), "the header has an id but no type")
        .when(F.col("id").isNull(), "the header has a type but no id")
        .when(~full("id"), "id must be a non-empty string")
        .when(~full("type"), "type must be a non-empty string")
    )
    entities = got.where(full("id") & full("type")).select("id", "type", "keys", "body", "path")
    problems = got.withColumn("message", problem).where("message is not null").select("path", F.col("id"), F.lit("error").alias("severity"), "message")
    return entities, problems


def union_sources(*sources: tuple[str, DataFrame], owners: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, problems): sources in order, the first entity of an id is kept; an entity found outside the source that owns its type is rejected.

    Each source is (name, rows with id, type, path). Ties follow by source, path, then text of the row.
    """
    parts = [df.withColumn("source", F.lit(name)).withColumn("__order", F.lit(i)) for i, (name, df) in enumerate(sources)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if owners:
        pairs = [F.lit(x) for p in owners.items() for x in p]
        owner = F.try_element_at(F.create_map(*pairs), F.col("type"))
        foreign = owner.isNotNull() & (owner != F.col("source"))
        problems = every.where(foreign).select("path", "id", F.lit("error").alias("severity"), F.concat("type", F.lit(" comes from "), owner, F.lit(" alone")).alias("message"))
        every = every.where(~foreign)
    else:
        problems = every.sparkSession.createDataFrame([], PROBLEMS)
    n = F.row_number().over(Window.partitionBy("id").orderBy("__order", "path", F.xxhash64(*[c for c in every.columns if not c.startswith("__")])))
    return every.withColumn("__n", n).where("__n = 1").drop("__n", "__order"), problems


def at(df: DataFrame, snapshot: str | int) -> DataFrame:
    """The state at a snapshot: a filter on the partition column ``snapshot``."""
    return df.where(F.col("snapshot") == snapshot).drop("snapshot")


