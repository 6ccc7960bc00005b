"""Typed tables and what follows from their links: edges, facets, rows, items, facts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkframe.registry import Field, Registry


class Model:
    """A DataFrame per entity type, with column ``id`` and one per field."""

    def __init__(self, registry: Registry, tables: dict[str, DataFrame]):
        for name in tables:
            if registry.get(name).abstract:
                raise ValueError(f"{name} is abstract; it can't have entities")
        self.registry, self.tables = registry, tables

    def table(self, *names: str) -> DataFrame:
        """Union of the concrete types that the names stand for, with column ``type``; a field that a type lacks is null.

        Fields of one name must have one kind.
        """
        parts = [self.tables[t].withColumn("type", F.lit(t)) for t in self.registry.concrete(*names) if t in self.tables]
        if not parts:
            raise ValueError(f"no table for {', '.join(names)}")
        kinds: dict[str, T.DataType] = {}
        for p in parts:
            for f in p.schema.fields:
                if kinds.setdefault(f.name, f.dataType) != f.dataType:
                    raise ValueError(f"{f.name} has kinds {kinds[f.name].simpleString()} and {f.dataType.simpleString()} on the types selected")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def entities(self) -> DataFrame:
        """(id, type) of everything."""
        return self.table_ids(*[t for t in self.tables])

    def table_ids(self, *names: str) -> DataFrame:
        parts = [self.tables[t].select("id", F.lit(t).alias("type")) for t in self.registry.concrete(*names) if t in self.tables]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def edges(self, name: str, link: str, within: str | None = None) -> DataFrame:
        """(src, dst, pos) of one link field of a type and its subtypes; ``within`` names the list whose rows hold it.

        pos is the place of the row, null for a field of the entity itself. Duplicates are one edge.
        """
        parts = []
        for t in self.registry.concrete(name):
            if t not in self.tables:
                continue
            table = self.tables[t]
            if within:
                table = table.select(F.col("id").alias("src"), F.posexplode(within).alias("pos", "row"))
                value = F.col(f"row.{link}")
            else:
                table = table.withColumnRenamed("id", "src").withColumn("pos", F.lit(None).cast("int"))
                value = F.col(link)
            many = isinstance(table.select(value).schema[0].dataType, T.ArrayType)
            parts.append(table.select("src", (F.explode(value) if many else value).alias("dst"), "pos").where("dst is not null"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        many_field = (self.registry.field(name, within) or Field(name="-")).fields if within else (self.registry.field(name, link),)
        single = all(f is None or not f.many for f in many_field if f is None or f.name == link)
        return out if single else out.distinct()

    def all_edges(self) -> DataFrame:
        """(src, type, field, dst, list, pos) of every link of every type."""
        parts = []
        for t in self.tables:
            for within, f in self.registry.links(t):
                if f.calculated:
                    continue
                e = self.edges(t, f.name, within)
                parts.append(e.select("src", F.lit(t).alias("type"), F.lit(f.name).alias("field"), "dst", F.lit(within).cast("string").alias("list"), "pos"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def facet(self, reverse: str) -> DataFrame:
        """(id, src): entities linking to ``id`` by any of the fields that ``reverse`` stands for, each once, allowed targets only."""
        found = self.registry.facet(reverse)
        if not found:
            raise ValueError(f"no link field has the reverse name {reverse}")
        out = None
        for t, within, f in found:
            e = self.edges(t, f.name, within).select(F.col("dst").alias("id"), "src")
            e = e.join(self.table_ids(*f.target).select("id"), "id", "left_semi")
            out = e if out is None else out.union(e)
        return out.distinct()


def resolve(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with ``target_type``: null where the target doesn't exist."""
    return edges.join(entities.select(F.col("id").alias("dst"), F.col("type").alias("target_type")), "dst", "left")


def collect_facet(facet: DataFrame, most: int | None = None) -> DataFrame:
    """(id, sources, n): a facet as one sorted array per entity, for display, and how many sources there are. With ``most`` no more than so many are
    gathered, the first by id, however many link to a hot entity; the facet itself has all as rows."""
    if most is None:
        return facet.groupBy("id").agg(F.array_sort(F.collect_set("src")).alias("sources"), F.count_distinct("src").alias("n"))
    facet = facet.distinct()
    nth = F.row_number().over(Window.partitionBy("id").orderBy("src"))  # Spark keeps the first few of each task before they meet
    few = facet.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("id").agg(F.array_sort(F.collect_list("src")).alias("sources"))
    return few.join(facet.groupBy("id").agg(F.count("*").alias("n")), "id")


def rows(table: DataFrame, within: str) -> DataFrame:
    """List rows: id, pos, and a column per field of the row."""
    return table.select("id", F.posexplode(within).alias("pos", "row")).select("id", "pos", "row.*")


def items(table: DataFrame, within: str) -> DataFrame:
    """List items by place; equal items are all there."""
    return table.select("id", F.posexplode(within).alias("pos", "value"))


def item_set(column: str | Column) -> Column:
    """The items of a list as a set of values."""
    return F.array_distinct(column)


def title(registry: Registry, name: str) -> Column:
    """The declared title field, else an empty text."""
    f = next((f for f in registry.fields(name) if f.title), None)
    return F.coalesce(F.col(f.name).cast("string"), F.lit("")) if f else F.lit("")


def as_text(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # shortest decimal: whole numbers without a fraction
        return F.when(column == F.floor(column), F.format_string("%d", column.cast("long"))).otherwise(column.cast("string"))
    return column.cast("string")


def to_facts(table: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """(id, field, value): the scalar fields of a table as rows, absent ones left out."""
    names = [f.name for f in table.schema.fields if f.name != "id" and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) and (columns is None or f.name in set(columns))]
    texts = table.select("id", *[as_text(F.col(n), table.schema[n].dataType).alias(n) for n in names])
    return texts.unpivot(["id"], names, "field", "value").where("value is not null")
