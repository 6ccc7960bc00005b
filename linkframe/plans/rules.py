"""Rules and built-in checks. All return violations: rule, severity, message, entity, path, line."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkframe.operators import cond, text
from linkframe.operators.closure import on_cycle
from linkframe.operators.diff import blank
from linkframe.operators.model import Model
from linkframe.registry import Field, Registry

COLUMNS = ("rule", "severity", "message", "entity", "path", "line")


def violations(df: DataFrame, rule: str, message: Column | str, severity: str = "error", entity: Column | str | None = "id", path: Column | None = None, line: Column | None = None) -> DataFrame:
    """Rows of ``df`` as violations."""
    none = lambda kind: F.lit(None).cast(kind)
    own = lambda c: F.col(c) if isinstance(c, str) else c
    where = path if path is not None else F.col("path") if "path" in df.columns else none("string")
    at = line if line is not None else F.col("line") if "line" in df.columns else none("int")
    what = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), what.alias("message"), (own(entity) if entity is not None else none("string")).cast("string").alias("entity"), where.cast("string").alias("path"), at.cast("int").alias("line"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    message: str
    types: tuple[str, ...]
    where: cond.Cond

    def __post_init__(self):
        if self.severity not in ("error", "warning"):
            raise ValueError(f"{self.id}: severity is error or warning")
        if not self.message or not self.types:
            raise ValueError(f"{self.id}: a rule has a message and types")


def parts_of(where: cond.Cond) -> list[cond.Cond]:
    return list(where.parts) if isinstance(where, cond.Group) and where.every else [where]


def run_rule(rule: Rule, model: Model) -> DataFrame:
    """A violation per match. Where a sub-query is over unrelated entities, the message lists those found, sorted."""
    found = cond.select(model, list(rule.types), rule.where)
    subs = [c for c in parts_of(rule.where) if isinstance(c, cond.Sub) and c.how == "of" and not c.negate and not c.agg]
    message = F.lit(rule.message)
    if subs and not cond._reads_outside(subs[0].where):  # the same for all: one list
        message = F.concat(message, F.lit(": "), cond.unrelated_items(model, subs[0]).agg(F.array_join(F.array_sort(F.collect_set("item")), ", ")).scalar())
    elif subs:
        items = cond.match_items(model, list(rule.types), subs[0]).groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("__found"))
        found = found.join(items, "id", "left")
        message = F.concat(message, F.lit(": "), F.array_join("__found", ", "))
    return violations(found, rule.id, message, rule.severity)


def place(rule: Rule, model: Model) -> DataFrame:
    """Violations with the place they point to (column at), one per place.

    The last sub-query of a rule decides: each row or linked entity that it matched; for one over unrelated entities, and where nothing else
    is said, the entity itself. Without a sub-query the last test does: its field, or the entity where the field is missing; of alternatives the first
    that holds, by the same rules, so one place per row or link inside it.
    """
    found = cond.select(model, list(rule.types), rule.where).select("id")
    rest = (F.lit(rule.id).alias("rule"), F.lit(rule.severity).alias("severity"), F.lit(rule.message).alias("message"))
    return found.join(_places(rule.where, rule.types, model), "id").dropDuplicates(["id", "at"]).select(*rest, F.col("id").alias("entity"), "at")


def _places(where: cond.Cond, types: tuple[str, ...], model: Model) -> DataFrame:
    """(id, at) for the entities on which the condition holds; others may be there too."""
    parts = parts_of(where)
    subs = [c for c in parts if isinstance(c, cond.Sub) and not c.negate and not c.agg]
    last = parts[-1]
    if subs and subs[-1].how != "of":
        items = cond.match_items(model, list(types), subs[-1])
        return items.select("id", (F.col("item") if subs[-1].how == "row" else F.concat(F.lit(f"{subs[-1].name} "), "item")).alias("at"))
    if not subs and isinstance(last, cond.Group) and not last.every:
        holds = [cond.select(model, list(types), c).select("id", F.lit(i).alias("i")) for i, c in enumerate(last.parts)]
        first = reduce(lambda a, b: a.union(b), holds).groupBy("id").agg(F.min("i").alias("i"))
        there = [_places(c, types, model).select("id", "at", F.lit(i).alias("i")) for i, c in enumerate(last.parts)]
        return first.join(reduce(lambda a, b: a.union(b), there), ["id", "i"]).select("id", "at")
    name = "" if subs or isinstance(last, cond.Test) and last.op == "missing" else str(getattr(last, "name", ""))
    return cond.select(model, list(types), where).select("id", (F.lit(name) if name else F.col("id")).alias("at"))


#: The names and severities of the built-in checks are fixed values: reports are compared by them.

# -- built-in checks ------------------------------------------------------------------------------------------------


#: A message names so many paths, and how many more there are.
NAMED = 10


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """Every copy of an id, naming the paths of the others, its own too where it is there twice: the first ``NAMED`` of them, and how many more. Input: id, path.

    Of a hot id no more than that is ever gathered; ``duplicate_paths`` has all of them as rows.
    """
    places = duplicate_paths(rows)
    few = places.where(F.col("nth") <= NAMED + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", "n"))).alias("few"), F.max("copies").alias("copies"))
    again = rows.join(few, "id")
    # without this copy's own path, once
    spread = F.flatten(F.transform("few", lambda x: F.array_repeat(x["path"], F.least(x["n"], F.lit(NAMED + 1)).cast("int"))))
    again = again.withColumn("paths", spread).withColumn("at", F.coalesce(F.array_position("paths", F.col("path")), F.lit(0)).cast("int"))
    others = F.when(F.col("at") > 0, F.concat(F.slice("paths", F.lit(1), F.col("at") - 1), F.slice("paths", F.col("at") + 1, F.size("paths")))).otherwise(F.slice("paths", 1, NAMED + 1))
    again = again.withColumn("others", F.slice(others, 1, NAMED)).withColumn("more", F.col("copies") - F.when(F.col("path").isNotNull(), 1).otherwise(0) - F.size("others"))
    listed = F.concat(F.array_join("others", ", "), F.when(F.col("more") > 0, F.concat(F.lit(" and "), F.col("more").cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    return violations(again, "content/duplicate-id", F.concat(F.lit("id "), "id", F.lit(" is also in "), listed))


def duplicate_paths(rows: DataFrame) -> DataFrame:
    """(id, path, n, nth, copies) of ids that are there more than once: how many copies each path has, its place by path, and the copies of the id that have a path."""
    per = rows.groupBy("id", "path").agg(F.count("*").alias("n"))
    twice = per.groupBy("id").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("path").isNotNull(), F.col("n"))).alias("copies")).where("all > 1").select("id", F.coalesce("copies", F.lit(0)).alias("copies"))
    found = per.where("path is not null").join(twice, "id")
    # Spark keeps the first few of each task before they meet, where only these are asked for
    return found.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("path"))).select("id", "path", "n", "nth", "copies")


def unresolved(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Links to no entity. Input: src, field, dst."""
    got = edges.join(entities.select(F.col("id").alias("dst")), "dst", "left_anti")
    return violations(got, "links/unresolved", F.concat("field", F.lit(" links to "), "dst", F.lit(", which doesn't exist")), entity="src")


def wrong_target(edges: DataFrame, entities: DataFrame, registry: Registry) -> DataFrame:
    """Links to an entity whose type isn't allowed; subtypes of allowed types are. Input: src, type, field, list, dst."""
    rows = []
    for t in registry.types:
        for within, f in registry.links(t):
            rows += [(t, f.name, within or "", x) for x in registry.concrete(*f.target)]
    allowed = edges.sparkSession.createDataFrame(rows, "type string, field string, __list string, target_type string")  # from the registry: bounded
    got = edges.withColumn("__list", F.coalesce("list", F.lit(""))).join(entities.select(F.col("id").alias("dst"), F.col("type").alias("target_type")), "dst")
    got = got.join(F.broadcast(allowed), ["type", "field", "__list", "target_type"], "left_anti")
    return violations(got, "links/target-type", F.concat("field", F.lit(" links to "), "dst", F.lit(", a "), "target_type"), entity="src")


def required(table: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Blank required fields, of list rows too."""
    parts = []
    for f in fields:
        if f.required:
            parts.append(violations(table.where(blank(F.col(f.name), table.schema[f.name].dataType)), "schema/required", f"{f.name} is required"))
        for g in f.fields:
            if g.required:
                rows = table.select("id", F.posexplode(f.name).alias("pos", "row"))
                kind = table.schema[f.name].dataType.elementType[g.name].dataType
                parts.append(violations(rows.where(blank(F.col(f"row.{g.name}"), kind)), "schema/required", F.format_string(f"{f.name}[%d].{g.name} is required", "pos")))
    return union(*parts)


def invalid_values(table: DataFrame, fields: list[str]) -> DataFrame:
    """Raw text that isn't of its type: columns ``f__raw`` beside ``f``."""
    bad = [F.when(F.col(f"{f}__raw").isNotNull() & F.col(f).isNull(), F.struct(F.lit(f).alias("field"), F.col(f"{f}__raw").alias("raw"))) for f in fields]
    got = table.select("id", F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("b"))
    return violations(got, "schema/invalid-value", F.concat("b.field", F.lit(": "), "b.raw", F.lit(" is not valid")))


def enum_values(table: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """Values that an enum doesn't have."""
    parts = []
    for f in (f for f in fields if f.kind == "enum"):
        many = isinstance(table.schema[f.name].dataType, T.ArrayType)
        if many:
            got = table.select("id", F.explode(F.array_except(f.name, F.array(*map(F.lit, f.values)))).alias("v"))
        else:
            got = table.where(F.col(f.name).isNotNull() & ~F.col(f.name).isin(*f.values)).select("id", F.col(f.name).alias("v"))
        parts.append(violations(got, "schema/enum-value", F.concat(F.lit(f"{f.name}: "), "v", F.lit(" is not one of " + ", ".join(f.values)))))
    return union(*parts)


def id_format(table: DataFrame, prefix: str, from_table: bool = False) -> DataFrame:
    """``PREFIX-`` and four digits at least; entities of delimited tables need the prefix only."""
    ok = F.col("id").rlike(f"^{prefix}-.+$" if from_table else f"^{prefix}-[0-9]{{4,}}$")
    return violations(table.where(~ok), "schema/id-format", F.concat(F.lit("id "), "id", F.lit(f" doesn't start with {prefix}- as it should")))


def unknown_type(rows: DataFrame, registry: Registry) -> DataFrame:
    known = list(registry.types)
    return violations(rows.where(~F.col("type").isin(known)), "schema/unknown-type", F.concat(F.lit("unknown type "), "type"))


def abstract_type(rows: DataFrame, registry: Registry) -> DataFrame:
    names = [t for t, d in registry.types.items() if d.abstract]
    return violations(rows.where(F.col("type").isin(names)), "schema/abstract-type", F.concat("type", F.lit(" is abstract")))


def unknown_keys(rows: DataFrame, fields: tuple[Field, ...], keys: str = "keys") -> DataFrame:
    """Supplied keys that the type doesn't declare, or that are calculated. Input: id and an array of key names."""
    own, calculated = [f.name for f in fields if not f.calculated], [f.name for f in fields if f.calculated]
    got = rows.select("id", F.explode(F.array_except(keys, F.array(*[F.lit(x) for x in ("id", "type", *own)]))).alias("k"))
    is_calc = F.col("k").isin(calculated) if calculated else F.lit(False)
    return union(
        violations(got.where(~is_calc), "schema/unknown-field", F.concat(F.lit("unknown field "), "k")),
        violations(got.where(is_calc), "schema/calculated-set", F.concat("k", F.lit(" is calculated, so it can't be set"))),
    )


def unknown_row_keys(rows: DataFrame, within: str, fields: tuple[Field, ...]) -> DataFrame:
    """The same inside list rows. Input: id, pos, keys."""
    got = rows.select("id", "pos", F.explode(F.array_except("keys", F.array(*[F.lit(f.name) for f in fields]))).alias("k"))
    return violations(got, "schema/list-row", F.format_string(f"{within}[%d]: unknown field %s", "pos", "k"))


def unused(registry: Registry, entities: DataFrame) -> DataFrame:
    """Types that no entity has (ancestors of used ones count as used), that no link targets and that link to nothing; declared
    enums that no field has, and declared records that no list has."""
    spark = entities.sparkSession
    up = spark.createDataFrame([(t, a) for t in registry.types for a in registry.ancestors(t)], "type string, up string")
    linked = {x for t in registry.types for _, f in registry.links(t) for x in (t, *f.target)}
    used = entities.select("type").distinct().join(F.broadcast(up), "type").select(F.col("up").alias("name")).distinct()
    declared = spark.createDataFrame([(t,) for t in registry.types if t not in linked] or [], "name string")
    types = violations(declared.join(used, "name", "left_anti"), "schema/unused-type", F.concat(F.lit("type "), "name", F.lit(" is not used")), "warning", entity=None)
    fields = [f for t in registry.types for f in registry.fields(t)]
    enums = {g.values for f in fields for g in (f, *f.fields) if g.kind == "enum"}
    lists = {f.fields for f in fields if f.kind == "list"}
    rest = [("schema/unused-enum", f"enum {n} is not used") for n, v in sorted(registry.enums.items()) if tuple(v) not in enums]
    rest += [("schema/unused-record", f"record {n} is not used") for n, v in sorted(registry.records.items()) if tuple(v) not in lists]
    rest_ = spark.createDataFrame(rest, "rule string, message string")
    none = lambda kind: F.lit(None).cast(kind)
    return union(types, rest_.select("rule", F.lit("warning").alias("severity"), "message", none("string").alias("entity"), none("string").alias("path"), none("int").alias("line"))) if rest else types


def unused_enum_values(table: DataFrame, f: Field) -> DataFrame:
    """Values of an enum that no entity has."""
    declared = table.sparkSession.createDataFrame([(v,) for v in f.values], "v string")
    used = table.select(F.col(f.name).alias("v")).distinct()
    return violations(declared.join(used, "v", "left_anti"), "schema/unused-enum", F.concat(F.lit(f"{f.name}: "), "v", F.lit(" is not used")), "warning", entity=None)


def formula_conflicts(values: DataFrame, name: str) -> DataFrame:
    """Calculated values that came out several ways. Input: id, conflict."""
    return violations(values.where("conflict"), "schema/invalid-value", f"{name} has several values")


def text_references(docs: DataFrame, entities: DataFrame, names: DataFrame) -> DataFrame:
    """``[[ID]]`` to no entity, ``[[ID#name]]`` to no field, tag or caption. names: owner, name."""
    links = text.wikilinks(docs).withColumn("owner", F.when(F.col("target") == "", F.col("id")).otherwise(F.col("target")))
    what = F.when(F.col("target") == "", F.col("local")).otherwise(F.col("name"))
    links = links.withColumn("what", what)
    lost = links.where("target <> ''").join(entities.select(F.col("id").alias("target")), "target", "left_anti")
    named = links.where("what <> ''").join(entities.select(F.col("id").alias("owner")), "owner", "left_semi")
    no_name = named.join(names.select("owner", F.col("name").alias("what")).distinct(), ["owner", "what"], "left_anti")
    return union(
        violations(lost, "links/reference", F.concat(F.lit("[["), "target", F.lit("]] refers to no entity"))),
        violations(no_name, "links/reference", F.concat(F.lit("[["), "owner", F.lit("#"), "what", F.lit("]]: no such field, tag or caption"))),
    )


def duplicate_tags(tags: DataFrame, fields: DataFrame) -> DataFrame:
    """Tags used twice in an entity, and tags named like a field. tags: id, type, tag, line; fields: type, name."""
    w = Window.partitionBy("id", "tag").orderBy("line")
    again = tags.withColumn("nth", F.row_number().over(w)).where("nth > 1")
    like = tags.join(fields.select("type", F.col("name").alias("tag")).distinct(), ["type", "tag"], "left_semi")
    return union(
        violations(again, "content/tag", F.concat(F.lit("#"), "tag", F.lit(" is used twice"))),
        violations(like, "content/tag", F.concat(F.lit("{#"), "tag", F.lit("} has the name of a field"))),
    )


def duplicate_captions(captions: DataFrame) -> DataFrame:
    """Caption ids used twice on a page. Input: page, pos, kind, cid."""
    again = text.number_captions(captions).where("not first")
    return violations(again, "content/caption", F.concat(F.lit("caption id "), "cid", F.lit(" is used twice")), entity="page", line=F.col("pos"))


def embed_cycles(embeds: DataFrame) -> DataFrame:
    """Entities that embed each other. Input: src, dst."""
    return violations(on_cycle(embeds), "content/embed-cycle", F.concat("id", F.lit(" embeds itself")))


def block_languages(docs: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Fenced blocks in a language that would be shown raw: those listed are handled."""
    got = text.code_blocks(docs).where(F.col("language").isin(*allowed))
    return violations(got, "content/unrendered-block", F.concat(F.lit("a "), "language", F.lit(" block isn't rendered")), "warning")


#: Image formats that are published. Fixed values.
FORMATS = ("png", "jpg", "jpeg", "gif", "svg", "webp")


def assets(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Image references to no file, or of a format that isn't published. files: path."""
    got = text.images(docs)
    odd = ~F.lower(F.regexp_extract("asset", r"\.([^./]+)$", 1)).isin(*FORMATS)
    return union(
        violations(got.join(files.select(F.col("path").alias("asset")), "asset", "left_anti"), "content/image", F.concat("asset", F.lit(" doesn't exist"))),
        violations(got.where(odd), "content/image", F.concat("asset", F.lit(" is of a format that isn't published"))),
    )


def misplaced_embeds(docs: DataFrame) -> DataFrame:
    """Embeds inside running text."""
    return violations(text.wikilinks(docs).where("embed and not alone"), "content/embed", F.concat(F.lit("![["), "target", F.lit("]] must be a paragraph of its own")))


def misplaced_markers(docs: DataFrame) -> DataFrame:
    """Captions that don't come right after what they can caption, and tags not on a heading or an ordered item, or ill-formed."""
    w = Window.partitionBy("id").orderBy("n")
    found = text.blocks(docs).withColumn("caption", (F.col("kind") == "code") & F.col("key").rlike(r"^\s{0,3}(```+|~~~+)\s*caption\b"))
    before, key = F.lag("kind").over(w), F.lag("key").over(w)
    image = key.rlike(r"^\[?!\[[^\]]*\]\([^()]*\)(\]\([^()]*\))?$") | key.rlike(r"^!\[\[[^\[\]]*\]\]$") | key.startswith("<")
    ok = F.coalesce((before == "row") | ((before == "code") & ~F.lag("caption").over(w)) | ((before == "text") & image), F.lit(False))
    bad = found.withColumn("ok", ok).where("caption and not ok")
    return union(
        violations(bad, "content/caption", "a caption must come right after the figure, table, equation or embed it captions"),
        violations(text.tags(docs).where("problem is not null"), "content/tag", F.concat(F.lit("{#"), "tag", F.lit("}: "), "problem")),
    )


# -- reports --------------------------------------------------------------------------------------------------------


def sort_violations(found: DataFrame) -> DataFrame:
    """By path, line, rule, message."""
    return found.orderBy("path", "line", "rule", "message", "entity")


def summarise(found: DataFrame) -> DataFrame:
    """(rule, severity, n)."""
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def totals(found: DataFrame) -> DataFrame:
    """(errors, warnings) in one row."""
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def gate(found: DataFrame) -> bool:
    """Whether nothing is an error."""
    return found.where("severity = 'error'").isEmpty()


def rule_results(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(rule, result, n): every check and rule of the catalogue (rule, skipped): passed, failed or skipped."""
    n = found.groupBy("rule").agg(F.count("*").alias("n"))
    got = catalogue.join(n, "rule", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return got.select("rule", F.when(F.col("skipped"), "skipped").when(F.col("n") > 0, "failed").otherwise("passed").alias("result"), "n")
