"""More registered queries: inputs that vary, so that each finds some and not all, and operators that no other query reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkframe import sinks
from linkframe.functions import calc
from linkframe.operators import closure, diff, history, selections, text
from linkframe.operators.cond import aggregate, all_of, any_of, field, none_linking, none_of, outer, select, some_linking, some_of, some_row
from linkframe.operators.model import Model
from linkframe.plans import rules
from linkframe.plans.retail import Retail
from linkframe.queries import _flat, _folder, ids, query, simple
from linkframe.registry import EntityType, Field, Registry
from linkframe.sources import delimited

def number() -> Column:
    """The number in a part's id."""
    return F.substring("id", 6, 20).cast("long")


# -- conditions -------------------------------------------------------------------------------------------------------

#: Orders of every seventh customer belong to the next one, so that some customers have none.
MOVED = "SELECT id, 'CUS-'||(substr(customer,5)::BIGINT + CAST(substr(customer,5)::BIGINT%7=0 AS INT)) AS customer FROM ord"


def _moved(spark, sf_dir) -> Model:
    r = Retail(spark, sf_dir)
    k = F.substring("customer", 5, 20).cast("long")
    return Model(r.slim.registry, r.slim.tables | {"Order": r.slim_orders.withColumn("customer", F.concat(F.lit("CUS-"), F.when(k % 7 == 0, k + 1).otherwise(k)))})


@query("p05_missing_some", "cus ord", f"SELECT id FROM cus WHERE id NOT IN (SELECT customer FROM ({MOVED}))")
def p05(spark, sf_dir):
    return ids(select(_moved(spark, sf_dir), "Customer", field("orders").missing()))


@query("g01_count_zero_some", "cus ord", f"SELECT id FROM cus WHERE id NOT IN (SELECT customer FROM ({MOVED}))")
def g01(spark, sf_dir):
    return ids(select(_moved(spark, sf_dir), "Customer", aggregate("facet", "orders", "count", "equals", 0)))


simple("j05_elsewhere", "Customer", some_of(["Supplier"], field("balance").less_than(-900)), "SELECT id FROM cus WHERE EXISTS (SELECT 1 FROM sup WHERE balance<-900)", "cus sup")
simple("j06_anywhere", "Supplier", some_of(["Customer"], field("segment").equals("MACHINERY"), field("balance").less_than(value_of=outer("balance"))), "SELECT id FROM sup s WHERE EXISTS (SELECT 1 FROM cus c WHERE c.segment='MACHINERY' AND c.balance<s.balance)", "cus sup")
simple("j06_two_orders", "Part", some_of(["Part"], field("size").greater_than(value_of=outer("size")), field("price").less_than(value_of=outer("price"))), "SELECT id FROM prt p WHERE EXISTS (SELECT 1 FROM prt q WHERE q.size>p.size AND q.price<p.price)", "prt")
simple("j06_two_orders_by_key", "Order", none_of(["Order"], field("customer").equals(value_of=outer("customer")), field("day").less_or_equal(value_of=outer("day")), field("total").greater_than(value_of=outer("total"))), "SELECT id FROM ord o WHERE NOT EXISTS (SELECT 1 FROM ord p WHERE p.customer=o.customer AND p.day<=o.day AND p.total>o.total)", "ord")
simple("j13_some_of", "Part", some_of(["Part"], *[field(f).equals(value_of=outer(f)) for f in ("name", "brand", "size")], field("id").not_equals(value_of=outer("id"))), "SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY name, brand, size) AS k FROM prt) WHERE k>1", "prt")
simple("j07_none_with_rows", "Customer", all_of(field("segment").equals("BUILDING"), some_linking("orders", field("status").equals("O"), field("total").greater_than(100000)), none_linking("orders", some_row("lines", field("flag").equals("R"), field("quantity").greater_than(45)))),
       "SELECT c.id FROM cus c WHERE c.segment='BUILDING' AND EXISTS (SELECT 1 FROM ord o WHERE o.customer=c.id AND o.status='O' AND o.total>100000) AND NOT EXISTS (SELECT 1 FROM ord o JOIN lin l ON l.id=o.id WHERE o.customer=c.id AND l.flag='R' AND l.quantity>45)", "cus ord lin", slim=False)


@query("c04_c05_compare", "prt", "SELECT id, size<>10 AS other, size<=25 AS small, price>=1000 AS dear, NOT (size<=25) AS big FROM prt")
def c04(spark, sf_dir):
    ten, quarter, thousand = (F.lit(x) for x in (10.0, 25.0, 1000.0))
    small = calc.le(F.col("size"), quarter)
    return Retail(spark, sf_dir).table("Part").select("id", calc.ne(F.col("size"), ten).alias("other"), small.alias("small"), calc.ge(F.col("price"), thousand).alias("dear"), calc.not_(small).alias("big"))


@query("g09_members", "cus sup nat reg prt", "SELECT type, id FROM (SELECT 'Customer' AS type, id FROM cus UNION ALL SELECT 'Supplier', id FROM sup UNION ALL SELECT 'Nation', id FROM nat UNION ALL SELECT 'Region', id FROM reg UNION ALL SELECT 'Part', id FROM prt)")
def g09(spark, sf_dir):
    r = Retail(spark, sf_dir)
    return sinks.members(Model(r.slim.registry, {k: v for k, v in r.slim.tables.items() if k != "Order"}).entities())


# -- checks -----------------------------------------------------------------------------------------------------------


@query("v15_unused_some", "prt", "SELECT 'schema/unused-type' AS rule, 'warning' AS severity, 'type '||brand||' is not used' AS message FROM prt GROUP BY brand HAVING max(price)<2040 UNION ALL SELECT 'schema/unused-enum', 'warning', 'enum Spare is not used' UNION ALL SELECT 'schema/unused-record', 'warning', 'record Spare is not used'")
def v15(spark, sf_dir):
    """Brands as types: those without a dear part have no entity. One more type only links out, an enum and a record are used, others not."""
    parts = Retail(spark, sf_dir).table("Part")
    brands = [r["brand"] for r in parts.select("brand").distinct().orderBy("brand").collect()]
    row = (Field("n", "number"),)
    other = EntityType("Other", (Field("to", "link", ("Aim",)), Field("size", "enum", values=("s", "m")), Field("rows", "list", fields=row)))
    reg = Registry(*[EntityType(b) for b in brands], EntityType("Aim"), other, enums={"Size": ("s", "m"), "Spare": ("x",)}, records={"Row": row, "Spare": (Field("m"),)})
    return rules.unused(reg, parts.where("price >= 2040").select("id", F.col("brand").alias("type"))).select("rule", "severity", "message")


@query("v20_repeated_tags", "", "SELECT 'USR-'||user_id AS entity, '#'||event_type||' is used twice' AS message, CAST(event_id AS INT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k>1")
def v20(spark, sf_dir):
    r = Retail(spark, sf_dir)
    tags = r.read("events").select(r.key("USR", "user_id").alias("id"), F.lit("User").alias("type"), F.col("event_type").alias("tag"), F.col("event_id").cast("int").alias("line"))
    return rules.duplicate_tags(tags, spark.createDataFrame([("Other", "view")], "type string, name string")).select("entity", "message", "line")


@query("v20_repeated_captions", "", "SELECT CAST(user_id AS VARCHAR) AS entity, 'caption id '||event_type||' is used twice' AS message, CAST(event_id AS INT) AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k>1")
def v20b(spark, sf_dir):
    e = Retail(spark, sf_dir).read("events").select(F.col("user_id").alias("page"), F.col("event_id").alias("pos"), F.lit("Figure").alias("kind"), F.col("event_type").alias("cid"))
    return rules.duplicate_captions(e).select("entity", "message", "line")


@query("v21_embed_cycles_some", "prt", "SELECT id AS entity, id||' embeds itself' AS message FROM prt WHERE (n%4=0 AND n+1 IN (SELECT n FROM prt)) OR (n%4=1 AND n-1 IN (SELECT n FROM prt))")
def v21(spark, sf_dir):
    """Of four parts in a row the first two embed each other, the others embed the half of their number."""
    to = F.when(number() % 4 == 0, number() + 1).when(number() % 4 == 1, number() - 1).otherwise(F.floor(number() / 2))
    e = Retail(spark, sf_dir).table("Part").select(F.col("id").alias("src"), F.concat(F.lit("PART-"), to).alias("dst"))
    return rules.embed_cycles(e).select("entity", "message")


def _event_texts(spark, sf_dir) -> DataFrame:
    """A text per event: a fence in the language of its type, then an embed of its user, inside a sentence for views."""
    r = Retail(spark, sf_dir)
    user = F.concat(F.lit("![[USR-"), "user_id", F.lit("]]"))
    embed = F.when(F.col("event_type") == "view", F.concat(F.lit("see "), user, F.lit(" there"))).otherwise(user)
    return r.read("events").select(r.key("EVT", "event_id").alias("id"), F.concat(F.lit("```"), "event_type", F.lit("\nx\n```\n\n"), embed).alias("text"))


@query("v24_languages_some", "", "SELECT 'EVT-'||event_id AS entity, 'a '||event_type||' block isn''t rendered' AS message, 1 AS line FROM events WHERE event_type IN ('view', 'click')")
def v24(spark, sf_dir):
    return rules.block_languages(_event_texts(spark, sf_dir), ("view", "click", "other")).select("entity", "message", "line")


@query("v26_embeds_some", "", "SELECT 'EVT-'||event_id AS entity, '![[USR-'||user_id||']] must be a paragraph of its own' AS message FROM events WHERE event_type='view'")
def v26(spark, sf_dir):
    return rules.misplaced_embeds(_event_texts(spark, sf_dir)).select("entity", "message")


@query("v01_elsewhere", "cus sup", "SELECT 'r' AS rule, 'error' AS severity, 'poor: '||(SELECT string_agg(id, ', ' ORDER BY id) FROM sup WHERE balance<-900) AS message, id AS entity FROM cus WHERE balance>9900 AND EXISTS (SELECT 1 FROM sup WHERE balance<-900)")
def v01(spark, sf_dir):
    """The message lists what a sub-query over unrelated entities finds, the same for all."""
    rule = rules.Rule("r", "error", "poor", ("Customer",), all_of(field("balance").greater_than(9900), some_of(["Supplier"], field("balance").less_than(-900))))
    return _flat(rules.run_rule(rule, Retail(spark, sf_dir).slim))


@query("v02_alternatives", "cus ord", """SELECT 'r' AS rule, id AS entity, "at" FROM (SELECT c.id, 'orders '||o.id AS "at" FROM cus c JOIN ord o ON o.customer=c.id WHERE o.total>400000 AND o.status='O'
UNION ALL SELECT c.id, 'balance' FROM cus c WHERE c.balance<0 AND c.id NOT IN (SELECT customer FROM ord WHERE total>400000 AND status='O'))""")
def v02_alternatives(spark, sf_dir):
    """Alternatives: the first that holds says where, so each large open order of a customer, or else its balance."""
    either = any_of(some_linking("orders", field("total").greater_than(400000), field("status").equals("O")), all_of(field("name").exists(), field("balance").less_than(0)))
    return rules.place(rules.Rule("r", "error", "m", ("Customer",), either), Retail(spark, sf_dir).slim).select("rule", "entity", "at")


@query("v02_elsewhere", "cus sup ord", 'SELECT \'r\' AS rule, id AS entity, id AS "at" FROM cus WHERE balance>9000 AND id IN (SELECT customer FROM ord WHERE total>200000) AND EXISTS (SELECT 1 FROM sup WHERE sup.nation=cus.nation)')
def v02_elsewhere(spark, sf_dir):
    """The last sub-query is over unrelated entities: the place is the entity itself, once, whatever the sub-query before it matched."""
    where = all_of(field("balance").greater_than(9000), some_linking("orders", field("total").greater_than(200000)), some_of(["Supplier"], field("nation").equals(value_of=outer("nation"))))
    return rules.place(rules.Rule("r", "error", "m", ("Customer",), where), Retail(spark, sf_dir).slim).select("rule", "entity", "at")


@query("x08_deep_items", "", "SELECT user_id, event_id, depth, label FROM (SELECT p_partkey AS user_id, d AS event_id, d AS depth, '1'||CASE WHEN d>1 THEN '(a)' ELSE '' END||CASE WHEN d>2 THEN '(i)' ELSE '' END||repeat('('||(p_partkey%5+1)||')', greatest(d-3, 0)) AS label FROM part, range(1, 9) AS s(d))")
def x08_deep(spark, sf_dir):
    """An item in an item, eight levels deep, for every part; below the third level lists begin with a number of their own."""
    p = Retail(spark, sf_dir).read("part").select(F.col("p_partkey").alias("page"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("depth"))
    start = F.when(F.col("depth") > 3, (F.col("page") % 5 + 1).cast("int")).otherwise(1)
    rows = p.select("page", F.col("depth").cast("string").alias("item"), F.when(F.col("depth") > 1, (F.col("depth") - 1).cast("string")).alias("parent"), F.concat(F.lit("L"), "depth").alias("list"), F.col("depth").alias("pos"), start.alias("start"), "depth")
    return text.number_items(rows).select(F.col("page").alias("user_id"), F.col("pos").cast("long").alias("event_id"), F.col("depth").cast("long").alias("depth"), "label")


# -- comparison, history, text ------------------------------------------------------------------------------------------


@query("d10_planted", "prt", """SELECT id, op, sum(k)::BIGINT AS n FROM (SELECT id, unnest(['kept', 'changed', 'removed', 'added']) AS op, unnest([1 + CAST(n%2=0 AS INT) + CAST(n%3<>0 AS INT), CAST(n%2<>0 AS INT), CAST(n%3=0 AS INT), CAST(n%5=0 AS INT)]) AS k FROM prt) WHERE k>0 GROUP BY id, op""")
def d10(spark, sf_dir):
    """Three paragraphs per part: the first has a word changed in odd parts, the last is gone in every third one, and every fifth gets a new one."""
    p = Retail(spark, sf_dir).table("Part")
    first = lambda w: F.concat_ws(" ", F.lit("a part"), "id", F.lit(w), F.lit("make"), "brand")
    kept, last = F.concat_ws(" ", F.lit("always"), "id", F.lit("here")), F.concat_ws(" ", F.lit("gone"), "id")
    old = p.select("id", F.concat_ws("\n\n", first("of"), kept, last).alias("text"))
    new = p.select("id", F.concat_ws("\n\n", F.when(number() % 2 == 0, first("of")).otherwise(first("by")), kept, F.when(number() % 3 != 0, last), F.when(number() % 5 == 0, F.concat_ws(" ", F.lit("brand new words"), "id"))).alias("text"))
    return diff.diff_text(old, new).groupBy("id", "op").agg(F.count("*").alias("n"))


@query("q01_many", "cus ord", "SELECT c.id AS holder, o.id AS result, row_number() OVER (PARTITION BY c.id ORDER BY o.total, o.id)-1 AS pos FROM cus c JOIN ord o ON o.customer=c.id AND o.priority=CASE WHEN c.segment='BUILDING' THEN '1-URGENT' ELSE '2-HIGH' END AND o.total>100000+c.balance*10")
def q01_many(spark, sf_dir):
    """A selection of its own for every customer: its orders of a priority, over a total. They are one plan."""
    r = Retail(spark, sf_dir)
    c, o = r.table("Customer"), r.table("Order")
    specs = c.select(F.col("id").alias("spec"), F.when(F.col("segment") == "BUILDING", "1-URGENT").otherwise("2-HIGH").alias("p0"), (100000 + F.col("balance") * 10).alias("p1"))
    shape = selections.Shape(links=(("customer", "customer"),), tests=(("priority", "equals"), ("total", "greater_than")), order=("total",))
    got = selections.materialise_shape(c.select(F.col("id").alias("holder"), F.col("id").alias("spec"), F.col("id").alias("customer")), specs, o, shape)
    return got.select("holder", "result", F.col("pos").cast("long").alias("pos"))


@query("q01_thresholds", "sup prt", "SELECT s.id AS holder, count(*) AS n, min(p.id) AS first FROM sup s JOIN prt p ON p.price<900+s.balance/100 GROUP BY s.id")
def q01_thresholds(spark, sf_dir):
    """A selection per supplier with an order test and no key: the parts below a price of its own."""
    r = Retail(spark, sf_dir)
    s, p = r.table("Supplier"), r.table("Part")
    return selections.summarise_shape(s.select(F.col("id").alias("holder"), F.col("id").alias("spec")), s.select(F.col("id").alias("spec"), (900 + F.col("balance") / 100).alias("p0")), p, ("price", "less_than"))


@query("d10_moved", "prt", "SELECT id, op, sum(k)::BIGINT AS n FROM (SELECT id, unnest(['kept', 'removed', 'added', 'changed']) AS op, unnest([2 + CAST(n%2<>0 AS INT), CAST(n%2=0 AS INT), CAST(n%2=0 AS INT), 1]) AS k FROM prt) WHERE k>0 GROUP BY id, op")
def d10_moved(spark, sf_dir):
    """Four paragraphs per part; the last one has a word changed. In even parts the first has moved behind the third: it is removed and added, and its words don't make it a changed one."""
    p = Retail(spark, sf_dir).table("Part")
    first, second, third = (F.concat_ws(" ", F.lit(w), "id") for w in ("first words of", "then what follows", "last of all"))
    edited = lambda w: F.concat_ws(" ", F.lit("part"), "id", F.lit("has"), F.lit(w), F.lit("words"))
    old = p.select("id", F.concat_ws("\n\n", first, second, third, edited("old")).alias("text"))
    new = p.select("id", F.concat_ws("\n\n", F.when(number() % 2 != 0, first), second, third, F.when(number() % 2 == 0, first), edited("new")).alias("text"))
    return diff.diff_text(old, new).groupBy("id", "op").agg(F.count("*").alias("n"))


@query("d10_long_runs", "cus", "SELECT nation AS id, 'changed' AS op, count(*) AS n FROM cus GROUP BY nation UNION ALL SELECT DISTINCT nation, 'added', 1 FROM cus WHERE CAST(substr(nation, 5) AS INT)%2=0")
def d10_long_runs(spark, sf_dir):
    """A text per nation with a paragraph per customer, all changed, so runs of hundreds by hundreds; in every second nation a new paragraph comes first."""
    c = Retail(spark, sf_dir).table("Customer")
    para = lambda w: F.concat_ws(" ", F.lit("Customer"), "id", F.lit("called"), "name", F.lit(w), F.lit("here"))
    texts = lambda w: c.groupBy("nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", para(w).alias("s")))), lambda x: x["s"]), "\n\n").alias("text"))
    head = F.when(F.substring("nation", 5, 10).cast("int") % 2 == 0, F.lit("Nothing like what was there")).alias("head")
    new = texts("lives").select(F.col("nation").alias("id"), F.concat_ws("\n\n", head, "text").alias("text"))
    return diff.diff_text(texts("lived").select(F.col("nation").alias("id"), "text"), new).groupBy("id", "op").agg(F.count("*").alias("n"))


@query("d11_runs", "prt", "SELECT id, 'kept:'||name||'|removed:old stock|added:fresh|kept:'||brand||'|added:now' AS runs FROM prt")
def d11_runs(spark, sf_dir):
    """The runs of words of a line per part, in reading order."""
    p = Retail(spark, sf_dir).table("Part")
    pair = p.select("id", F.concat_ws(" ", "name", F.lit("old stock"), "brand").alias("old"), F.concat_ws("  ", "name", F.lit("fresh"), "brand", F.lit("now")).alias("new"))
    return diff.diff_runs(pair).select("id", F.array_join(F.transform("runs", lambda x: F.concat_ws(":", x["op"], x["text"])), "|").alias("runs"))


@query("h07_tree", "", "SELECT snapshot, 'sha256:'||sha256(string_agg(part||chr(0)||sha, chr(10) ORDER BY part)) AS hash FROM (SELECT source AS snapshot, substr(sha256('DOC-'||doc_id),1,3) AS part, sha256(string_agg(('DOC-'||doc_id)||chr(0)||sha256(text), chr(10) ORDER BY 'DOC-'||doc_id)) AS sha FROM documents GROUP BY ALL) GROUP BY snapshot")
def h07(spark, sf_dir):
    r = Retail(spark, sf_dir)
    return history.content_hash_tree(r.read("documents").select(F.col("source").alias("snapshot"), r.key("DOC", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")))


@query("h13_merge_base_some", "", "WITH RECURSIVE w AS (SELECT max(p_partkey) AS n, 'a' AS side FROM part UNION ALL SELECT max(p_partkey)*2//3, 'b' FROM part UNION ALL SELECT n//2, side FROM w WHERE n>1) SELECT 'PART-'||max(x.n) AS commit FROM w x JOIN w y ON x.n=y.n WHERE x.side='a' AND y.side='b'")
def h13(spark, sf_dir):
    """The lowest common ancestor of the last part and the one at two thirds of its number, in the tree of halves."""
    p = Retail(spark, sf_dir).read("part").select("p_partkey")
    last = p.agg(F.max("p_partkey")).first()[0]
    parents = p.where("p_partkey > 1").select(F.concat(F.lit("PART-"), "p_partkey").alias("src"), F.concat(F.lit("PART-"), F.floor(F.col("p_partkey") / 2)).alias("dst"))
    return closure.merge_base(parents, f"PART-{last}", f"PART-{last * 2 // 3}")


@query("x08_nested_items", "", """SELECT user_id, event_id, depth, CASE depth WHEN 1 THEN top WHEN 2 THEN top||'('||letter||')' ELSE top||'('||letter||')('||roman||')' END AS label FROM (
    SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS VARCHAR) AS top,
    CASE WHEN event_id%40<26 THEN chr(CAST(97+event_id%40 AS INT)) ELSE 'a'||chr(CAST(71+event_id%40 AS INT)) END AS letter,
    (['','x','xx','xxx','xl','l'])[(1+event_id%50)//10+1]||(['','i','ii','iii','iv','v','vi','vii','viii','ix'])[(1+event_id%50)%10+1] AS roman FROM events), (VALUES (1), (2), (3)) d(depth)""")
def x08(spark, sf_dir):
    """An item per event, with a nested one in it, and one in that; the nested lists start at different values."""
    e = Retail(spark, sf_dir).read("events").select("user_id", "event_id")
    item = lambda d: F.col("event_id") * 3 + d
    level = lambda d, up, where, start: F.struct(item(d).alias("item"), up.cast("long").alias("parent"), where.cast("long").alias("list"), start.cast("int").alias("start"), F.lit(d).alias("depth"))
    every = F.array(level(1, F.lit(None), F.lit(0), F.lit(1)), level(2, item(1), item(1), 1 + F.col("event_id") % 40), level(3, item(2), item(2), 1 + F.col("event_id") % 50))
    rows = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("pos"), F.explode(every).alias("x")).select("page", "pos", "x.*")
    return text.number_items(rows).select(F.col("page").alias("user_id"), F.col("pos").alias("event_id"), "depth", "label")


# -- sources ----------------------------------------------------------------------------------------------------------


@query("s04_headers", "prt", "SELECT id, name AS title, CASE WHEN n%29=0 THEN NULL ELSE CAST(size AS BIGINT) END AS size, CASE WHEN n%29=0 THEN 'x'||CAST(size AS BIGINT) END AS raw FROM prt WHERE n%37<>0")
def s04(spark, sf_dir):
    """Files whose headers have other orders: each is read by its own. One row in 37 has a cell too many and is dropped."""
    rows, _ = _shuffled(spark, sf_dir)
    return rows.select("id", "title", F.col("size").cast("long").alias("size"), F.col("size__raw").alias("raw"))


@query("s04_header_problems", "prt", "SELECT message, count(*) AS n FROM (SELECT 'the row has the wrong number of cells' AS message FROM prt WHERE n%37=0 UNION ALL SELECT 'column extra is not read' FROM (SELECT DISTINCT n%8 AS f FROM prt) WHERE f%2=1) GROUP BY message")
def s04b(spark, sf_dir):
    _, problems = _shuffled(spark, sf_dir)
    return problems.groupBy("message").agg(F.count("*").alias("n"))


def _shuffled(spark, sf_dir):
    p = Retail(spark, sf_dir).read("part")
    n = F.col("p_partkey")
    size = F.concat(F.when(n % 29 == 0, "x").otherwise(""), F.col("p_size").cast("string"))
    more = F.when(n % 37 == 0, "more")
    line = F.when(n % 2 == 0, F.concat_ws(",", F.concat(F.lit("PART-"), n), "p_name", size, more)).otherwise(F.concat_ws(",", F.lit("-"), size, F.concat(F.lit("PART-"), n), "p_name", more))
    path = _folder(spark, "headers")
    files = p.select((n % 8).alias("f"), n, line.alias("line")).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))).alias("rows"))
    head = F.when(F.col("f") % 2 == 0, "id,title,size\n").otherwise("extra,size,id,title\n")
    files.select("f", F.concat(head, F.array_join(F.transform("rows", lambda x: x["line"]), "\n")).alias("value")).repartition(8, "f").write.partitionBy("f").option("lineSep", "\n").text(path)
    return delimited.read_entities(spark, f"{path}/*", Registry(EntityType("Item", (Field("title", title=True), Field("size", "number")))), "Item")


@query("s02_lines", "prt", """SELECT CAST(line AS BIGINT) AS line, CASE WHEN n%37=0 THEN 'the row has the wrong number of cells' WHEN n%41=0 THEN 'the row has no id' ELSE 'a quote is out of place' END AS message
FROM (SELECT n, 2 + coalesce(sum(1 + 2 * CAST(n%5=0 AS INT)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM prt) WHERE n%37=0 OR n%41=0 OR n%43=0""")
def s02_lines(spark, sf_dir):
    """One file of all parts, in order; every fifth has a title of three lines. Each row in error with the line it begins with."""
    p = Retail(spark, sf_dir).read("part")
    n = F.col("p_partkey")
    title = F.when(n % 5 == 0, F.concat(F.lit('"on\n""three""\nlines"'), F.when((n % 43 == 0) & (n % 37 != 0) & (n % 41 != 0), "x").otherwise(""))).otherwise(F.when((n % 43 == 0) & (n % 37 != 0) & (n % 41 != 0), '"quoted"x').otherwise(F.col("p_name")))
    line = F.concat_ws(",", F.when(n % 41 == 0, " ").otherwise(F.concat(F.lit("PART-"), n)), title, F.when(n % 37 == 0, "more"))
    path = _folder(spark, "onefile")
    rows = p.select(n.alias("n"), line.alias("value")).union(spark.createDataFrame([(-1, "id,title")], "n long, value string"))
    rows.repartitionByRange(1, "n").sortWithinPartitions("n").select("value").write.option("lineSep", "\n").text(path)
    _, problems = delimited.read_entities(spark, path, Registry(EntityType("Item", (Field("title", title=True),))), "Item")
    return problems.select("line", "message")


@query("s05_encoding", "", "SELECT lang, min(k) AS line, 'not UTF-8' AS message FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents) WHERE doc_id%50=7 GROUP BY lang")
def s05(spark, sf_dir):
    """A file of document ids per language, written as Latin-1; every fiftieth line has a letter that isn't UTF-8 then."""
    d = Retail(spark, sf_dir).read("documents").select("lang", "doc_id", F.concat(F.lit("DOC-"), "doc_id", F.when(F.col("doc_id") % 50 == 7, "é").otherwise("")).alias("value"))
    path = _folder(spark, "latin")
    d.repartition("lang").sortWithinPartitions("lang", "doc_id").select("lang", "value").write.partitionBy("lang").option("encoding", "ISO-8859-1").csv(path)
    bad = delimited.check_encoding(spark, f"{path}/*/*.csv")
    return bad.select(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang"), F.col("line").cast("long").alias("line"), "message")
