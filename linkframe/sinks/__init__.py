"""Reports as files: everything is written by Spark, in parallel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkframe.operators.model import Model, collect_facet
from linkframe.plans.rules import summarise, totals


def write_json(violations: DataFrame, path: str) -> None:
    """Violations under path/violations, and one summary row with the report's version under path/summary."""
    violations.write.mode("overwrite").json(f"{path}/violations")
    totals(violations).withColumn("version", F.lit(1)).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def text_lines(violations: DataFrame) -> DataFrame:
    """``path:line: severity [rule] message (entity)``."""
    place = F.when(F.col("line") > 0, F.concat_ws(":", F.coalesce("path", F.lit("")), "line")).otherwise(F.coalesce("path", F.lit("")))
    tail = F.when(F.coalesce("entity", F.lit("")) != "", F.concat(F.lit(" ("), "entity", F.lit(")"))).otherwise("")
    return violations.select(F.concat(place, F.lit(": "), "severity", F.lit(" ["), "rule", F.lit("] "), "message", tail).alias("value"))


def write_text(violations: DataFrame, path: str) -> None:
    text_lines(violations).write.mode("overwrite").text(path)


def write_summary(violations: DataFrame, path: str) -> None:
    summarise(violations).write.mode("overwrite").parquet(path)


def type_listing(model: Model, etype: str, facets: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """All entities of a type: one column per field, and one per facet with the linking entities in order of id: all of them, or the first ``most``."""
    out = model.table(etype)
    for f in facets:
        got = collect_facet(model.facet(f), most).select("id", F.col("sources").alias(f))
        out = out.join(got, "id", "left").withColumn(f, F.coalesce(f, F.array().cast("array<string>")))
    return out


def by_type(entities: DataFrame) -> DataFrame:
    """(type, n): how many entities each type has. Members are a query of their own, since one array of all would not hold them."""
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def members(entities: DataFrame) -> DataFrame:
    """(type, pos, id): a listing's members in order; range-sorted by Spark, so that no type is one group."""
    return entities.select("type", "id").orderBy("type", "id")


def diff_report(entities: DataFrame, fields: DataFrame | None = None, rows: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """(what, id, place, op, old, new): one row per changed entity, field, row and file."""
    none = F.lit(None).cast("string")
    parts = [entities.select(F.lit("entity").alias("what"), "id", none.alias("place"), "op", none.alias("old"), none.alias("new"))]
    if fields is not None:
        parts.append(fields.select(F.lit("field"), "id", "field", F.lit("changed"), "old", "new"))
    if rows is not None:
        parts.append(rows.select(F.lit("row"), "id", F.format_string("%s[%d].%s", "list", "pos", "cell"), F.lit("changed"), "old", "new"))
    if files is not None:
        parts.append(files.select(F.lit("file"), "path", none, "op", none, none))
    return reduce(lambda a, b: a.union(b), parts)


def write_diff(report: DataFrame, path: str, how: str = "parquet") -> None:
    report.write.mode("overwrite").format(how).save(path)
