"""Blank-aware calculated columns.

A blank is null. Arithmetic is on numbers; a result that isn't finite is blank. Values of different kinds are never
equal and never ordered. Aggregates count every row or item, equal values too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkframe.operators.cond import finite
from linkframe.operators.model import Model


def lit(v: float | str | bool) -> Column:
    return F.lit(float(v) if isinstance(v, int) and not isinstance(v, bool) else v)


def add(a: Column, b: Column) -> Column:
    return finite(a + b)


def sub(a: Column, b: Column) -> Column:
    return finite(a - b)


def mul(a: Column, b: Column) -> Column:
    return finite(a * b)


def div(a: Column, b: Column) -> Column:
    """Blank on a zero divisor."""
    return finite(F.try_divide(a, b))


def neg(a: Column) -> Column:
    return F.lit(0.0) - a


def eq(a: Column, b: Column, same_kind: bool = True) -> Column:
    """TRUE or FALSE, blank if a side is blank; different kinds are FALSE."""
    return a == b if same_kind else F.when(a.isNotNull() & b.isNotNull(), F.lit(False))


def ne(a: Column, b: Column, same_kind: bool = True) -> Column:
    return ~eq(a, b, same_kind)


def lt(a: Column, b: Column, same_kind: bool = True) -> Column:
    """Blank across kinds."""
    return a < b if same_kind else F.lit(None).cast("boolean")


def gt(a: Column, b: Column, same_kind: bool = True) -> Column:
    return a > b if same_kind else F.lit(None).cast("boolean")


def le(a: Column, b: Column, same_kind: bool = True) -> Column:
    return a <= b if same_kind else F.lit(None).cast("boolean")


def ge(a: Column, b: Column, same_kind: bool = True) -> Column:
    return a >= b if same_kind else F.lit(None).cast("boolean")


def if_(c: Column, a: Column, b: Column | None = None) -> Column:
    """Without ``b``, a false condition gives FALSE as text where ``a`` is no boolean; a blank one gives blank."""
    if b is None:
        return F.when(c, a.cast("string")).when(~c, F.lit("false"))
    return F.when(c, a).when(~c, b)


def and_(*cs: Column) -> Column:
    return reduce(lambda a, b: a & b, cs)


def or_(*cs: Column) -> Column:
    return reduce(lambda a, b: a | b, cs)


def not_(c: Column) -> Column:
    return ~c


def isblank(c: Column, many: bool = False) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0 if many else c.isNull()


def values(*args: Column, many: tuple[bool, ...] = ()) -> Column:
    """All arguments' values as one array, blanks left out. ``many`` says which arguments are arrays."""
    flags = many or (False,) * len(args)
    arrays = [F.coalesce(a, F.array().cast("array<double>")) if m else F.array(a) for a, m in zip(args, flags, strict=True)]
    return F.filter(F.concat(*arrays), lambda v: v.isNotNull())


def sum_(v: Column) -> Column:
    """0 of nothing; added in order of value, so that reruns agree to the last bit."""
    return finite(F.aggregate(F.array_sort(v), F.lit(0.0), lambda a, b: a + b))


def count_(v: Column) -> Column:
    return F.coalesce(F.size(F.filter(v, lambda x: x.isNotNull())), F.lit(0)).cast("double")


def avg_(v: Column) -> Column:
    return finite(F.try_divide(sum_(v), F.size(v)))


def min_(v: Column) -> Column:
    return F.array_min(v)


def max_(v: Column) -> Column:
    return F.array_max(v)


def row_values(within: Column, read: Callable[[Column], Column] | str) -> Column:
    """``list[].field`` as an array: one value per row; a function reads what the row gives."""
    fn = (lambda r: r[read]) if isinstance(read, str) else read
    return F.coalesce(F.transform(within, fn), F.array().cast("array<double>"))


def row_calc(within: Column, name: str, fn: Callable[[Column], Column]) -> Column:
    """The list with a calculated field on each row."""
    return F.transform(within, lambda r: r.withField(name, fn(r)))


def through_link(df: DataFrame, link: str, target: DataFrame, read: str, out: str) -> DataFrame:
    """``link.field`` of a single link as column ``out``."""
    far = target.select(F.col("id").alias("__id"), F.col(read).alias(out))
    return df.join(far, df[link] == far["__id"], "left").drop("__id")


def through_many(df: DataFrame, pairs: DataFrame, target: DataFrame, read: str, out: str, agg: str = "collect") -> DataFrame:
    """``many.field``: one value per linked entity. ``pairs``: src, dst. ``agg``: collect, or sum, count, avg, min, max."""
    far = pairs.select("src", "dst").join(target.select(F.col("id").alias("dst"), F.col(read).alias("__v")), "dst").where("__v is not null")
    how = {"collect": lambda c: F.collect_list(c), "sum": F.sum, "count": lambda c: F.count(c).cast("double"), "avg": F.avg, "min": F.min, "max": F.max}[agg]
    got = far.groupBy("src").agg(how("__v").alias(out))
    wide = df.join(got, df["id"] == got["src"], "left").drop("src")
    if agg in ("sum", "count"):
        return wide.withColumn(out, F.coalesce(out, F.lit(0.0)))
    return wide.withColumn(out, finite(F.col(out))) if agg == "avg" else wide


def through_rows(df: DataFrame, within: str, link: str, target: DataFrame, read: str, out: str) -> DataFrame:
    """``list[].link.field`` as an array in the order of the rows; rows without a value are left out."""
    rows = df.select("id", F.posexplode(within).alias("pos", "row")).select("id", "pos", F.col(f"row.{link}").alias("dst"))
    far = rows.join(target.select(F.col("id").alias("dst"), F.col(read).alias("v")), "dst").where("v is not null")
    got = far.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias(out))
    return df.join(got, "id", "left")


def order_of(inputs: dict[str, set[str]]) -> list[str]:
    """Names in order of dependency. A loop is an error that names its path."""
    done: list[str] = []

    def visit(n: str, path: list[str]) -> None:
        if n in path:
            raise ValueError("depends on itself: " + " -> ".join([*path[path.index(n) :], n]))
        if n not in done and n in inputs:
            for m in sorted(inputs[n]):
                visit(m, [*path, n])
            done.append(n)

    for n in inputs:
        visit(n, [])
    return done


def calculate(df: DataFrame, formulas: dict[str, tuple[set[str], Callable[[], Column]]]) -> DataFrame:
    """Calculated columns that read each other, in order of dependency. name: (names it reads, builder)."""
    for name in order_of({n: reads & set(formulas) for n, (reads, _) in formulas.items()}):
        df = df.withColumn(name, formulas[name][1]())
    return df


def over_types(model: Model, names: list[str], formulas: dict[str, Callable[[DataFrame], DataFrame]], out: str) -> DataFrame:
    """(id, type, out): one calculated name on several types."""
    parts = [formulas[t](model.tables[t]).select("id", F.lit(t).alias("type"), out) for t in model.registry.concrete(*names)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def single_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, conflict): several distinct values on one key make it invalid. Only the two extremes are kept, so no group grows."""
    got = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return got.select(key, F.when(F.col("a") == F.col("b"), F.col("a")).alias(value), (F.col("a") != F.col("b")).alias("conflict"))


#: Words that stay small inside a title. Fixed values.
MINOR = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "nor", "of", "on", "or", "the", "to")


def title_case(c: Column) -> Column:
    """Words cut at ``_``, ``-``, blanks and humps (an acronym stays whole), with capitals, but for minor words inside the title."""
    spaced = F.regexp_replace(c, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    found = F.filter(F.split(spaced, r"[_\-\s]+"), lambda w: w != "")
    last = F.size(found) - 1
    inside = lambda w, i: (i > 0) & (i < last) & F.lower(w).isin(*MINOR)
    up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
    return F.array_join(F.transform(found, lambda w, i: F.when(inside(w, i), F.lower(w)).otherwise(up(w))), " ")


def shown(c: Column, kind: T.DataType) -> Column:
    """A value as text: the shortest decimal, true or false, items joined by commas; blank is empty."""
    from linkframe.operators.model import as_text

    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.array_join(F.transform(c, lambda x: shown(x, kind.elementType)), ", "), F.lit(""))
    return F.coalesce(as_text(c, kind), F.lit(""))


def short(c: Column) -> Column:
    """The first 7 of a hash of 40 hexadecimal digits; a suffix after ``-`` stays."""
    return F.regexp_replace(c, "^([0-9a-f]{7})[0-9a-f]{33}(?=$|-)", "$1")
