"""What the operators share: the folder for intermediate tables, word patterns, text cleaning."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SHINGLE = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or on a local master one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="linkframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder, in folders by the columns ``by``, and read again: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these tables. Only for tables that nothing reads any more, not even a plan to be run again; others are left alone."""
    for df in tables:
        if path := getattr(df, "written_at", None):
            deleted(df.sparkSession, path)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def pieces(batches, rows: int = 512, size: int = 8 << 20):
    """Arrow batches cut into slices of at most so many rows and, but for single rows, bytes: a task's working set stays small beside long texts."""
    for batch in batches:
        todo = [batch.slice(at, rows) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part
    give_back()


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, and they would keep what the largest task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU C library
        pass


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has: the given ones, with as many underscores behind them as it takes."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def longer(schema: T.StructType, added: str) -> T.StructType:
    """A schema with the columns of a DDL string added."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(added).fields])
