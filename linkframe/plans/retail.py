"""The driver's star schema as entity types: ids are texts, lines are nested in their orders, snapshots are derived."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkframe.operators.model import Model
from linkframe.registry import EntityType, Field, Registry

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
STATUS = ("F", "O", "P")


def registry() -> Registry:
    line = (Field("number", "number"), Field("part", "link", ("Part",), reverse="ordered_in"), Field("supplier", "link", ("Supplier",), reverse="supplied_in"), Field("quantity", "number"), Field("price", "number"), Field("discount", "number"), Field("flag", "enum", values=("A", "N", "R")))
    return Registry(
        EntityType("Region", (Field("name", title=True),), prefix="REG"),
        EntityType("Nation", (Field("name", title=True), Field("region", "link", ("Region",), reverse="nations")), prefix="NAT"),
        EntityType("Party", (Field("name", title=True), Field("balance", "number"), Field("nation", "link", ("Nation",), reverse="parties")), abstract=True),
        EntityType("Customer", (Field("segment", "enum", values=SEGMENTS),), extends="Party", prefix="CUS"),
        EntityType("Supplier", (), extends="Party", prefix="SUP"),
        EntityType("Part", (Field("name", title=True), Field("brand"), Field("kind"), Field("size", "number"), Field("price", "number"), Field("parent", "link", ("Part",), reverse="children")), prefix="PART"),
        EntityType("Order", (Field("customer", "link", ("Customer",), reverse="orders"), Field("status", "enum", values=STATUS), Field("total", "number"), Field("day", "date"), Field("priority"), Field("lines", "list", fields=line)), prefix="ORD"),
        EntityType("Archive", (Field("name"),), prefix="ARC"),
    )


class Retail:
    """Tables of one folder as a model. Columns that a query doesn't read are pruned at the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def key(prefix: str, column: str):
        return F.concat(F.lit(f"{prefix}-"), F.col(column).cast("string"))

    @cached_property
    def lines(self) -> DataFrame:
        """(order, line): lines as structs."""
        k = self.key
        line = F.struct(F.col("l_linenumber").cast("double").alias("number"), k("PART", "l_partkey").alias("part"), k("SUP", "l_suppkey").alias("supplier"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"))
        return self.read("lineitem").select(F.col("l_orderkey").alias("okey"), line.alias("line"))

    @cached_property
    def model(self) -> Model:
        k = self.key
        party = lambda p, t: (k(t, f"{p}key").alias("id"), F.col(f"{p[0]}_name").alias("name"), F.col(f"{p[0]}_acctbal").alias("balance"), k("NAT", f"{p[0]}_nationkey").alias("nation"))
        lines = self.lines.groupBy("okey").agg(F.array_sort(F.collect_list("line")).alias("lines"))
        orders = self.read("orders").join(lines, F.col("o_orderkey") == F.col("okey"), "left")
        parent = F.when((F.col("p_partkey") > 0) & (F.col("p_partkey") % 97 == 0), F.col("p_partkey") + 1_000_000).otherwise(F.floor(F.col("p_partkey") / 2))
        return Model(
            registry(),
            {
                "Region": self.read("region").select(k("REG", "r_regionkey").alias("id"), F.col("r_name").alias("name")),
                "Nation": self.read("nation").select(k("NAT", "n_nationkey").alias("id"), F.col("n_name").alias("name"), k("REG", "n_regionkey").alias("region")),
                "Customer": self.read("customer").select(*party("c_cust", "CUS"), F.col("c_mktsegment").alias("segment")),
                "Supplier": self.read("supplier").select(*party("s_supp", "SUP")),
                "Part": self.read("part").select(k("PART", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.concat(F.lit("PART-"), parent.cast("string")).alias("parent")),
                "Order": orders.select(k("ORD", "o_orderkey").alias("id"), k("CUS", "o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("priority"), "lines"),
            },
        )

    def table(self, name: str) -> DataFrame:
        return self.model.tables[name]

    @cached_property
    def slim_orders(self) -> DataFrame:
        """Orders without their lines: no shuffle."""
        k = self.key
        return self.read("orders").select(k("ORD", "o_orderkey").alias("id"), k("CUS", "o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("priority"))

    @cached_property
    def slim(self) -> Model:
        return Model(self.model.registry, self.model.tables | {"Order": self.slim_orders})

    def new_parts(self) -> DataFrame:
        """A later snapshot of parts: every tenth is gone, every seventh has another price, every thirteenth another name; some are new."""
        n = F.substring("id", 6, 20).cast("long")
        old = self.table("Part")
        top = F.lit(5_000_000)
        kept = old.where(n % 10 != 0).withColumn("price", F.when(n % 7 == 0, F.col("price") + 1).otherwise(F.col("price"))).withColumn("name", F.when(n % 13 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name")))
        return kept.union(old.where(n % 11 == 0).withColumn("id", F.concat(F.lit("PART-"), (n + top).cast("string"))))
