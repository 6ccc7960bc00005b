"""Records of delimited files, cut in parallel: a file of any size is read by as many tasks as it has blocks.

Whether a line end is inside quotes depends on all quotes before it. So two passes: the first counts each block's lines and the parity of its quotes, and for either
parity that it may begin with the last line that opens a quoted cell; a prefix over a file's blocks (a row each) then says how each block begins and with
which line number. The second joins that to the lines. Most lines are records of their own; only those of a record that spans several meet by a
shuffle, on the line it begins with.
"""

from __future__ import annotations

import csv

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkframe.operators.closure import saved

FAR = -1
#: Tables of blocks or files of at most so many rows are sent to every task; larger ones are joined by a shuffle.
SENT_ROWS = 100_000
LINES = "file long, block long, nth long, odd boolean, own boolean, open0 long, open1 long, value string"
BLOCKS = "path string, block long, n long, odd boolean, open0 long, open1 long, head string, head_end long"
LINE_NAMES, BLOCK_NAMES = ([c.split()[0] for c in ddl.split(", ")] for ddl in (LINES, BLOCKS))


def sent(df: DataFrame) -> DataFrame:
    """A checkpointed table, for broadcast if it is small enough."""
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _lines(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), (quotes % 2 == 1).alias("own"), "value")


class _Block:
    """What is known of a block while its lines go by: how many, the parity of quotes, and the last line that opens a quoted cell if the block begins
    outside of quotes (0) or inside (1)."""

    def __init__(self):
        self.n, self.odd, self.open = 0, False, [FAR, FAR]

    def take(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Number in the block, parity before, and the last opening line before each of these lines, for either beginning."""
        nth = self.n + np.arange(len(own))
        odd = (np.cumsum(own) - own + self.odd) % 2 == 1
        before = []
        for k, opens in enumerate((~odd & own, odd & own)):
            last = np.maximum.accumulate(np.r_[self.open[k], np.where(opens, nth, FAR)])
            before.append(last[:-1])
            self.open[k] = int(last[-1])
        self.n += len(own)
        self.odd = bool((self.odd + own.sum()) % 2)
        return nth, odd, before


def _runs(batches, *names: str):
    """(start of a new block?, its key, rows) of each run of lines of one block, in order. Batches keep the order of files."""
    key = None
    for batch in batches:
        columns = [batch.column(n) for n in names]
        codes = [c.dictionary_encode().indices.to_numpy() if pa.types.is_string(c.type) else c.to_numpy() for c in columns]
        new = np.zeros(batch.num_rows, bool)
        for c in codes:
            new[1:] |= c[1:] != c[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cut, cut[1:], strict=False):
            here = tuple(c[a].as_py() for c in columns)
            yield here != key, here, batch.slice(a, b - a)
            key = here


def _blocks(lines: DataFrame) -> DataFrame:
    """A row per block, with the file's header (its first record that isn't empty) in that of the first block."""

    def run(batches):
        block, key, head, end = _Block(), None, [], FAR

        def summary():
            row = [*key, block.n, block.odd, *block.open, "\n".join(head) if head else None, end]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], BLOCK_NAMES)

        for new, here, rows in _runs(batches, "path", "block"):
            if new:
                if key is not None:
                    yield summary()
                block, key, head, end = _Block(), here, [], FAR
            own = rows.column("own").to_numpy(zero_copy_only=False)
            nth, odd, _ = block.take(own)
            if here[1] == 0 and end == FAR:
                for i, s in enumerate(rows.column("head").to_pylist()):
                    text = (s or "").removeprefix("﻿") if nth[i] == 0 else s or ""
                    if not head and not text.rstrip("\r"):
                        continue
                    head.append(text)
                    if bool(odd[i]) == bool(own[i]):  # even behind it: the record ends here
                        end = int(nth[i])
                        break
        if key is not None:
            yield summary()

    return lines.select("path", "block", "own", F.when(F.col("block") == 0, F.col("value")).alias("head")).mapInArrow(run, BLOCKS)


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their number in the block, the parity of quotes before them in it, and the last opening lines."""

    def run(batches):
        block = _Block()
        for new, _, rows in _runs(batches, "file", "block"):
            block = _Block() if new else block
            nth, odd, (open0, open1) = block.take(rows.column("own").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([rows.column("file"), rows.column("block"), pa.array(nth), pa.array(odd), rows.column("own"), pa.array(open0), pa.array(open1), rows.column("value")], LINE_NAMES)

    return lines.select(F.xxhash64("path").alias("file"), "block", "own", "value").mapInArrow(run, LINES)


def cells(text: Column, delimiter: str) -> Column:
    """The cells of a record; null where a quote is out of place. Only records with quotes leave the JVM."""

    @F.pandas_udf("array<string>")
    def parsed(texts: pd.Series) -> pd.Series:
        csv.field_size_limit(1 << 31)  # a cell may be as long as its record

        def one(t):
            if t is None:
                return None
            try:
                return next(csv.reader([t], delimiter=delimiter, strict=True), [""])
            except csv.Error:
                return None

        return texts.map(one)

    quoted = text.contains('"')
    plain = F.split(text, "\\Q" + delimiter + "\\E", -1)
    return F.when(~quoted, plain).otherwise(parsed(F.when(quoted, text)))


def records(spark: SparkSession, path: str, delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """(records, files). records: file, line (of the record's first line, from 1), text; without headers and empty lines.
    files: file, path, header (names; null where there is none), broken (the line of a quoted cell that never ends, or null); its record is left out.

    A line ends at a line feed; a carriage return before it goes, at a record's end. A byte order mark goes.
    """
    lines = _lines(spark, path)
    blocks = saved(_blocks(lines))
    upto = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(upto), F.lit(0)) % 2 == 1).withColumn("line0", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    opened = F.when(F.col("inside"), F.col("open1")).otherwise(F.col("open0"))
    starts = starts.withColumn("opened", F.when(opened >= 0, F.col("line0") + opened + 1)).withColumn("carry", F.last("opened", ignorenulls=True).over(upto))
    starts = saved(starts.withColumn("file", F.xxhash64("path")))
    whole = starts.groupBy("file", "path").agg((F.sum(F.col("odd").cast("int")) % 2 == 1).alias("odd"), F.max("opened").alias("last"), F.max("head").alias("head"), F.max("head_end").alias("head_end"))
    broken = F.when(F.col("odd"), F.col("last"))
    files = saved(whole.select("file", "path", F.regexp_replace("head", "\r$", "").alias("head"), (F.col("head_end") + 1).alias("head_end"), broken.alias("broken")))
    heads = files.select("file", "path", F.when(F.col("head_end") > 0, cells(F.col("head"), delimiter)).alias("header"), "broken", "head_end")
    at = starts.select("file", "block", "inside", "line0", "carry")
    found = _numbered(lines).join(sent(at), ["file", "block"])
    inside = F.col("odd") != F.col("inside")
    line = F.col("line0") + F.col("nth") + 1
    opening = F.when(F.col("inside"), F.col("open1")).otherwise(F.col("open0"))
    begin = F.when(inside, F.when(opening >= 0, F.col("line0") + opening + 1).otherwise(F.col("carry"))).otherwise(line)
    found = found.select("file", line.alias("at"), begin.alias("line"), (~inside & ~F.col("own")).alias("whole"), "value")
    found = found.join(sent(files.select("file", "head_end", "broken")), "file").where("line > head_end AND (broken IS NULL OR line <> broken)")
    several = found.where(~F.col("whole")).groupBy("file", "line").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["value"]), "\n")
    out = found.where("whole").select("file", "line", "value").union(several.select("file", "line", text.alias("value")))
    out = out.select("file", "line", F.regexp_replace("value", "\r$", "").alias("text")).where("text <> ''")
    return out, heads.drop("head_end")
