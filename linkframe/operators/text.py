"""References, blocks, markers and numbers in Markdown texts, line by line with windows.

All functions take a DataFrame with ``id`` and ``text``. Windows are partitioned by id, so a group is one text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import meet, saved

#: White space of the format, without the vertical tab that Java's and Python's classes have too.
BLANKS = " \t\n\f\r"
FENCE = rf"^[{BLANKS}]{{0,3}}(```|~~~)"
HEADING = rf"^[{BLANKS}]{{0,3}}(#{{1,6}})([{BLANKS}]|$)"
ITEM = rf"^[{BLANKS}]*([-*+]|\d+[.)])[{BLANKS}]"
ORDERED = rf"^[{BLANKS}]*(\d+)[.)][{BLANKS}]"
ROW = rf"^[{BLANKS}]*\|"
LINK = r"(!?)\[\[([^\[\]\n]*)\]\]"
#: A tag at the end of a line, and what its name may be. They define the format.
TAG = r"[ \t]*\{#([^{}\s]*)\}[ \t]*$"
TAG_NAME = "^[a-z0-9][a-z0-9-]*$"
IMAGE = r"!\[[^\]]*\]\(([^()\s]+)[^()]*\)"
MODES = ("full", "number", "title", "long")


LINE = "array<struct<s:string,edge:string,lang:string,fenced:boolean>>"
#: Texts whose lines are Python objects at one time.
PIECE = 128
MARK = re.compile(rf"[{BLANKS}]{{0,3}}(?:(```)`*|(~~~)~*)[{BLANKS}]*([^{BLANKS}`]*)")


def _with_fences(text: str) -> list[tuple[str, str | None, str | None, bool]]:
    """(s, edge, lang, fenced) of each line, in one pass."""
    out, inside = [], ""
    for s in text.split("\n"):
        found = MARK.match(s)
        mark = (found[1] or found[2]) if found else ""
        if mark and not inside:
            inside = mark
            out.append((s, "open", found[3], True))
        elif mark and mark == inside:
            inside = ""
            out.append((s, "close", "", True))
        else:
            out.append((s, None, None, bool(inside)))
    return out


def lines(docs: DataFrame) -> DataFrame:
    """id, line (from 1), s, and whether the line is inside a fence (its markers too).

    A fence closes at a line that starts with the marker that opened it; the other marker inside it is text. A text is split where it is
    read: nothing is shuffled, and only texts with a marker leave the JVM.
    """

    @F.arrow_udf(LINE)
    def fenced(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("s", pa.string()), ("edge", pa.string()), ("lang", pa.string()), ("fenced", pa.bool_())]))
        marked = lambda t: None if t is None else [dict(zip(("s", "edge", "lang", "fenced"), x, strict=True)) for x in _with_fences(t)]
        # the lines of a few texts at a time are Python objects, all others are Arrow's
        pieces = [pa.array([marked(t) for t in texts.slice(at, PIECE).to_pylist()], kind) for at in range(0, len(texts), PIECE)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], kind)

    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n", "\n")
    marked = text.contains("```") | text.contains("~~~")
    none = F.lit(None).cast("string")
    plain = F.transform(F.split(text, "\n"), lambda s: F.struct(s.alias("s"), none.alias("edge"), none.alias("lang"), F.lit(False).alias("fenced")))
    every = F.when(marked, fenced(F.when(marked, text))).otherwise(plain)
    return docs.select("id", F.posexplode(every).alias("pos", "x")).select("id", (F.col("pos") + 1).alias("line"), "x.*")


def code_blocks(docs: DataFrame) -> DataFrame:
    """(id, language or ``none``, line of the opening fence)."""
    return lines(docs).where("edge = 'open'").select("id", F.when(F.col("lang") == "", "none").otherwise(F.col("lang")).alias("language"), "line")


def wikilinks(docs: DataFrame) -> DataFrame:
    """(id, line, at, embed, target, name, local, label, mode, alone): ``[[ID]]``, ``[[ID|label]]``, ``[[ID#name:mode]]``, ``[[#tag]]``, ``![[ID]]``.

    Links in code fences don't count. ``alone``: nothing else is on the line. An embed needs an ID.
    """
    found = lines(docs).where("not fenced").select("id", "line", "s", F.posexplode(F.regexp_extract_all("s", F.lit(LINK), 0)).alias("at", "m"))
    inner = F.regexp_extract("m", LINK, 2)
    target = F.regexp_replace(F.substring_index(inner, "|", 1), r"\\$", "")
    label = F.when(F.instr(inner, "|") > 0, F.trim(F.expr("substring(inner, instr(inner, '|') + 1)")))
    found = found.withColumn("inner", inner).withColumn("target", target).withColumn("label", label)
    after = F.when(F.instr("target", "#") > 0, F.expr("substring(target, instr(target, '#') + 1)")).otherwise("")
    found = found.withColumn("after", after)
    name = F.trim(F.substring_index("after", ":", 1))
    mode = F.when(F.instr("after", ":") > 0, F.trim(F.expr("substring(after, instr(after, ':') + 1)"))).otherwise("")
    to = F.trim(F.substring_index("target", "#", 1))
    embed = F.col("m").startswith("!")
    out = found.select("id", "line", "at", embed.alias("embed"), to.alias("to"), name.alias("name"), F.coalesce("label", F.lit("")).alias("label"), mode.alias("mode"), (F.trim("s") == F.col("m")).alias("alone"))
    out = out.where((F.col("to") != "") | (F.col("name") != "") & ~F.col("embed"))
    local = F.when(F.col("to") == "", F.col("name")).otherwise("")
    return out.withColumn("local", local).withColumn("name", F.when(F.col("to") == "", "").otherwise(F.col("name"))).withColumnRenamed("to", "target")


def images(docs: DataFrame) -> DataFrame:
    """(id, line, asset): image references to files of the repository; ``data:`` and web addresses aren't."""
    found = lines(docs).where("not fenced").select("id", "line", F.explode(F.regexp_extract_all("s", F.lit(IMAGE), 1)).alias("asset"))
    return found.where(~F.col("asset").rlike("^(data:|[a-z][a-z0-9+.-]*://)"))


def refs(docs: DataFrame) -> DataFrame:
    """(id, kind, value, line): everything that a text refers to. Kinds: embed, cited, shown, query, asset, code."""
    w = wikilinks(docs).where("target <> ''")
    kind = F.when(F.col("embed"), "embed").when(F.col("name") != "", "shown").otherwise("cited")
    code = code_blocks(docs)
    return (
        w.select("id", kind.alias("kind"), F.when(F.col("name") != "", F.concat_ws("#", "target", "name")).otherwise(F.col("target")).alias("value"), "line")
        .union(images(docs).select("id", F.lit("asset"), "asset", "line"))
        .union(code.select("id", F.when(F.col("language") == "query", "query").otherwise("code"), "language", "line"))
    )


def tags(docs: DataFrame) -> DataFrame:
    """(id, tag, line, problem): ``{#tag}`` ending a heading or an ordered item; elsewhere, or ill-formed, it is a problem."""
    found = lines(docs).where(~F.col("fenced") & F.col("s").rlike(TAG))
    tag = F.regexp_extract("s", TAG, 1)
    ok = F.col("s").rlike(HEADING) | F.col("s").rlike(ORDERED)
    problem = F.when(~ok, "a tag must end a heading or an ordered list item").when(~tag.rlike(TAG_NAME), "use lower-case letters, digits and '-'")
    return found.select("id", tag.alias("tag"), "line", problem.alias("problem"))


def blocks(docs: DataFrame) -> DataFrame:
    """(id, n, kind, key, line): a text's blocks in order.

    A fence is whole, a heading or a table row alone, a list item has its continuation lines, else paragraphs.
    The key has white-space runs as one blank, but for fences, which stay as written.
    """
    blank = ~F.col("s").rlike(f"[^{BLANKS}]")
    kind = (
        F.when(F.col("fenced"), "code").when(blank, "blank").when(F.col("s").rlike(HEADING), "heading").when(F.col("s").rlike(ROW), "row").when(F.col("s").rlike(ITEM), "item").otherwise("text")
    )
    w = Window.partitionBy("id").orderBy("line")
    found = lines(docs).withColumn("kind", kind)
    before, edge = F.lag("kind").over(w), F.coalesce("edge", F.lit(""))
    new = F.when(F.col("kind") == "code", edge == "open").when(F.col("kind") == "text", F.coalesce(before.isin("blank", "heading", "row", "code"), F.lit(True))).otherwise(True)
    found = found.withColumn("n", F.sum(new.cast("int")).over(w)).where("kind <> 'blank'")
    parts = F.array_sort(F.collect_list(F.struct("line", "kind", "s")))
    got = found.groupBy("id", "n").agg(parts.alias("p"))
    body = F.when(F.col("p")[0]["kind"] == "code", F.array_join(F.transform("p", lambda x: x["s"]), "\n")).otherwise(F.trim(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["s"]), " "), r"\s+", " ")))
    got = got.select("id", "n", F.col("p")[0]["kind"].alias("kind"), body.alias("key"), F.col("p")[0]["line"].alias("line"))
    return got.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("line")))


def citations(cited: DataFrame) -> DataFrame:
    """(page, target, type, n, n_of_type): order of first citation. Input: page, pos, target, type."""
    first = cited.groupBy("page", "target", "type").agg(F.min("pos").alias("pos"))
    by = lambda *k: F.row_number().over(Window.partitionBy(*k).orderBy("pos", "target"))
    return first.select("page", "target", "type", by("page").alias("n"), by("page", "type").alias("n_of_type"))


def number_captions(captions: DataFrame) -> DataFrame:
    """Add number: one sequence per kind and page. ``first``: whether this is the first use of its id. Input: page, pos, kind, cid."""
    by = lambda *k: Window.partitionBy(*k).orderBy("pos")
    return captions.withColumn("number", F.row_number().over(by("page", "kind"))).withColumn("first", (F.col("cid") == "") | (F.row_number().over(by("page", "cid")) == 1))


def headings(docs: DataFrame) -> DataFrame:
    """(id, line, level, title) of Markdown headings."""
    mark = F.regexp_extract("s", HEADING, 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("s", r"^\s{0,3}#{1,6}\s*", ""), TAG, ""), r"\s+#+\s*$", ""))
    return lines(docs).where(~F.col("fenced") & F.col("s").rlike(HEADING)).select("id", "line", F.length(mark).alias("level"), title.alias("title"))


def number_headings(found: DataFrame, key: str = "id", pos: str = "line") -> DataFrame:
    """Add number: 1, 1.2, 1.2.3 for levels 2 to 6; level 1 has none; skipped levels print 0.

    The count of a level starts again after each heading of a lower level; level 1 doesn't start anything again.
    """
    out = found
    upto: list[str] = []
    for level in range(2, 7):
        w = Window.partitionBy(key, *upto).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"__n{level}", F.sum(F.when(F.col("level") == level, 1).otherwise(0)).over(w))
        upto.append(f"__n{level}")
    number = F.when(F.col("level") >= 2, F.array_join(F.slice(F.array(*upto), 1, F.greatest(F.col("level") - 1, F.lit(1))), "."))
    return out.withColumn("number", F.coalesce(number, F.lit(""))).drop(*upto)


def letters(n: Column) -> Column:
    """a, b, ..., z, aa, ..., for as many letters as it takes (14 at most for 64 bits): 26 values a place, without a zero."""
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("s"))
    digit = lambda a: F.pmod(a["left"] - 1, F.lit(26).cast("long"))
    more = lambda a: F.struct(F.call_function("div", a["left"] - 1 - digit(a), F.lit(26).cast("long")).alias("left"), F.concat(F.char(F.lit(97) + digit(a)), a["s"]).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, lambda a, _: F.when(a["left"] > 0, more(a)).otherwise(a), lambda a: a["s"])


#: Roman digits by place. Fixed values.
ONES = ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")
TENS = ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc")
HUNDREDS = ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm")
THOUSANDS = ("", "m", "mm", "mmm")


def roman(n: Column) -> Column:
    """Lower-case roman numerals of 1 to 3999."""
    digit = lambda names, x: F.get(F.array(*map(F.lit, names)), x.cast("int"))
    return F.concat(digit(THOUSANDS, F.floor(n / 1000)), digit(HUNDREDS, F.pmod(F.floor(n / 100), F.lit(10))), digit(TENS, F.pmod(F.floor(n / 10), F.lit(10))), digit(ONES, F.pmod(n, F.lit(10))))


def number_items(items: DataFrame) -> DataFrame:
    """Add label: decimal, then (a), then (i) under their parents, from each list's start value. Deeper lists are decimal again, to any depth.

    Input: page, item, parent (an item, or null), list, pos, start, depth (of ordered lists). Labels grow by twice as many levels each round, so rounds
    follow the logarithm of the depth. An item whose parent isn't there has no label.
    """
    n = F.row_number().over(Window.partitionBy("page", "list").orderBy("pos")) + F.col("start") - 1
    out = items.withColumn("n", n)
    own = F.when((F.col("depth") == 2) & (F.col("n") > 0), letters(F.col("n"))).when((F.col("depth") == 3) & (F.col("n") > 0) & (F.col("n") < 4000), roman(F.col("n"))).otherwise(F.col("n").cast("string"))
    label = F.when(F.col("depth") == 1, own).otherwise(F.concat(F.lit("("), own, F.lit(")")))
    out = out.withColumn("label", label).withColumn("__up", F.when(F.col("depth") > 1, F.col("parent")))
    deepest = items.agg(F.max("depth")).first()[0] or 1
    for _ in range((deepest - 1).bit_length()):
        out = saved(out)
        above = out.select(F.col("page").alias("__page"), F.col("item").alias("__item"), F.col("label").alias("__label"), F.col("__up").alias("__next"))
        open_ = (F.col("depth") > 1) & (F.col("__up").isNotNull() | F.col("parent").isNull())
        out = meet(out, above, (F.col("page") == F.col("__page")) & (F.col("__up") == F.col("__item")), "left")
        out = out.withColumn("label", F.when(open_, F.concat("__label", "label")).otherwise(F.col("label"))).withColumn("__up", F.col("__next")).drop("__page", "__item", "__label", "__next")
    return out.drop("__up")


def ref_text(kind: Column, number: Column, title: Column, mode: Column) -> Column:
    """What a reference shows: full (Section 3.2), number (3.2), title, or long (Section 3.2 Setup)."""
    return (
        F.when(number == "", title).when(mode == "number", number).when(mode == "title", title).when(mode == "long", F.concat_ws(" ", kind, number, F.when(title != "", title))).otherwise(F.concat_ws(" ", kind, number))
    )


def references(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links with the text they show. links: page, owner, tag, mode; anchors: owner, tag, kind, number, title."""
    got = links.join(anchors, ["owner", "tag"], "left")
    return got.withColumn("shown", ref_text(F.col("kind"), F.col("number"), F.col("title"), F.col("mode")))


def shift_headings(parts: DataFrame) -> DataFrame:
    """Levels of embedded headings moved down by that of the last heading of the host before them, 6 at most.

    Input: page, pos, level (null for no heading), embedded (whether the row comes from an embedded text).
    """
    w = Window.partitionBy("page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    host = F.last(F.when(~F.col("embedded"), F.col("level")), ignorenulls=True).over(w)
    return parts.withColumn("shown_level", F.when(F.col("embedded") & F.col("level").isNotNull(), F.least(F.col("level") + F.coalesce(host, F.lit(0)), F.lit(6))).otherwise(F.col("level")))
