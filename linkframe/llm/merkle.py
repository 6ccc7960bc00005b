"""Merkle manifest of a table, with a proof per row, by a butterfly exchange.

The rows of one tree (for documents: one language) are leaves in order of their key. Partitions hold aligned runs of
``FANOUT ** LEVELS`` leaves and hash their own subtree. Then partitions swap roots round by round: in round r each meets those at its own
place in the other nodes of its run of ``FANOUT``, and all of them hash the parent for themselves, so each partition climbs with its own upper proof
and nothing is handed down. A partial last node has fewer partitions than its neighbours; each of them answers at several places. The roots of all
trees are the leaves of one more tree, built alike.

A node is the SHA-256, in lower-case hex, of its children's hex digests one after the other. While a level of a tree has several nodes, every run
of ``FANOUT`` consecutive ones, the last perhaps shorter, even of one, becomes one; what remains is the tree's root.

Defined cases: a null field of a row is ``-`` in its leaf; rows without a key come first, and nothing tampers with them; rows with equal tree and
key are in order of their leaf, so equal rows are leaves of their own; a null tree comes first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, written

FANOUT = 8
#: A partition hashes this many levels on its own: 4096 leaves.
LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """The digest of a row: of each field ``-`` if null, else its length in UTF-8 bytes, a colon and its text."""
    cells = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in cells]), 256)


def _parent(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _div(n: Column, size: int) -> Column:
    """Whole quotient of a non-negative whole number, exact at any size."""
    return F.call_function("div", n, F.lit(size))


def _nodes(n: Column, size: int) -> Column:
    """How many nodes of ``size`` leaves cover n leaves."""
    return _div(n + (size - 1), size)


def placed(leaves: DataFrame) -> DataFrame:
    """Add ``pos``, a leaf's place in its tree, and ``n``, the tree's leaves. Input: tree, key, digest, changed.

    Leaves are sorted by ranges; the places follow from counts per range and tree. No tree has a task of its own.
    """
    order = ["tree", "key", "digest", "tie"]  # the last one only lets equal rows be dealt out
    leaves = leaves.withColumn("tie", F.monotonically_increasing_id())
    ranges = leaves.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    ranges = written(ranges.withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", 33).alias("part")
    first = ranges.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    tree = Window.partitionBy("tree")
    first = first.select("tree", "part", "first", (F.sum("here").over(tree.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(tree).alias("n"))
    a, b = ranges.withColumn("part", part).alias("a"), first.alias("b")
    both = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.part") == F.col("b.part")))
    out = both.select("a.tree", "a.key", "a.digest", "a.changed", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n")
    out.written_at = ranges.written_at
    return out


def partitions(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, n, block, rows): one row for each aligned run of ``FANOUT ** levels`` leaves; ``rows`` are its leaves in order."""
    at = placed(leaves)
    row = F.struct("pos", "key", "digest", "changed")
    out = written(at.groupBy("tree", "n", _div(F.col("pos"), FANOUT**levels).alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows")), "partitions")
    removed(at)
    return out


def _run_parent(nodes: Column, run: Column) -> Column:
    return _parent(F.slice(nodes, run * FANOUT + 1, F.lit(FANOUT)))


def _climbed(blocks: DataFrame, levels: int) -> tuple[DataFrame, list[str]]:
    """Add the nodes of each level of a partition's own subtree as arrays. A tree of one partition ends at its first single node."""
    out = blocks.withColumn("l0", F.transform("rows", lambda x: x["digest"]))
    names = ["l0"]
    for i in range(levels):
        here, name = F.col(names[-1]), f"l{i + 1}"
        last = (_nodes(F.size(here), FANOUT) - 1).cast("int")
        up = F.transform(F.sequence(F.lit(0), last), partial(_run_parent, here))
        out = out.withColumn(name, F.when((F.size(here) > 1) | (F.col("n") > FANOUT**levels), up).otherwise(here))
        names.append(name)
    return out, names


def exchanged(roots: DataFrame, levels: int, most: int) -> DataFrame:
    """(tree, block, node, path): the root of its tree for every partition, and the siblings on the way up from the partition's own root.

    Input: tree, n, block, node (the partition's root). ``most``: the leaves of the largest tree. Every round is one shuffle of a row per partition.
    """
    empty = F.array().cast("array<struct<left:string,right:string>>")
    state = roots.withColumn("path", empty)
    span = 1  # partitions below a node
    while FANOUT**levels * span < most:
        leaves = FANOUT**levels * span
        g = _div(F.col("block"), span)
        rows = state.withColumn("g", g).withColumn("place", F.pmod("block", F.lit(span))).withColumn("blocks", _nodes(F.col("n"), FANOUT**levels))
        held = F.least(F.lit(span).cast("long"), F.col("blocks") - F.col("g") * span)
        rows = rows.withColumn("to", F.explode(F.sequence(F.col("place"), F.lit(span - 1).cast("long"), held)))
        own = F.when(F.col("to") == F.col("place"), F.struct("block", "path", "g"))
        met = rows.groupBy("tree", "n", _div(F.col("g"), FANOUT).alias("run"), "to").agg(F.array_sort(F.collect_list(F.struct("g", "node"))).alias("nodes"), F.collect_list(own).alias("own"))
        met = met.withColumn("parent", _parent(F.transform("nodes", lambda x: x["node"]))).withColumn("own", F.explode("own"))
        side = lambda test: F.array_join(F.transform(F.filter("nodes", test), lambda x: x["node"]), "")
        step = F.struct(side(lambda x: x["g"] < F.col("own.g")).alias("left"), side(lambda x: x["g"] > F.col("own.g")).alias("right"))
        several = _nodes(F.col("n"), leaves) > 1
        state = met.select("tree", "n", "own.block", F.when(several, F.col("parent")).otherwise(F.col("nodes")[0]["node"]).alias("node"), F.when(several, F.concat("own.path", F.array(step))).otherwise(F.col("own.path")).alias("path"))
        span *= FANOUT
    return state.drop("n")


def _own_path(names: list[str], levels: int, i: Column) -> Column:
    """The siblings of leaf ``i`` of a partition on the way to the partition's root."""
    steps = []
    for name in names[:-1]:
        here = F.col(name)
        run = i - F.pmod(i, F.lit(FANOUT))
        left, right = F.slice(here, run + 1, i - run), F.slice(here, i + 2, FANOUT - 1 - (i - run))
        steps.append(F.when((F.size(here) > 1) | (F.col("n") > FANOUT**levels), F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))))
        i = _div(i, FANOUT).cast("int")
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, node, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def tree_paths(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, list[str]]:
    """The partitions with the nodes of their levels, their upper paths (tree, block, node, path), and the names of the level columns."""
    blocks = partitions(leaves, levels)
    climbed, names = _climbed(blocks, levels)
    climbed.written_at = blocks.written_at
    most = blocks.agg(F.max("n")).first()[0] or 0
    roots = climbed.select("tree", "n", "block", F.col(names[-1])[0].alias("node"))
    return climbed, exchanged(roots, levels, most), names


def proven(leaves: DataFrame, result: Callable[[Column, Column, Column, Column], Column], levels: int = LEVELS) -> DataFrame:
    """For each leaf ``result(row, path, subroot, root)`` in column ``x``. Input: tree (string), key, digest, changed (a digest or null)."""
    climbed, upper, names = tree_paths(leaves, levels)
    upper = written(upper, "upper")
    tops = upper.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("node").alias("digest"), F.lit(None).cast("string").alias("changed"))
    last, above, last_names = tree_paths(tops, levels)
    above = above.select("block", F.col("node").alias("root"), F.col("path").alias("over"))
    trees = last.join(above, "block").select(F.explode(F.transform("rows", lambda x, i: F.struct(x["key"].alias("tree"), F.concat(_own_path(last_names, levels, i), F.col("over")).alias("over"), F.col("root").alias("root")))).alias("t")).select("t.*")
    trees = written(trees, "trees")
    a, b, c = climbed.alias("a"), upper.alias("b"), trees.alias("c")
    both = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.block") == F.col("b.block"))).join(c, F.col("a.tree").eqNullSafe(F.col("c.tree")))
    both = both.select("a.n", "a.rows", *[f"a.{x}" for x in names], F.concat("b.path", "c.over").alias("upper"), F.col("b.node").alias("subroot"), "c.root")
    per_row = F.transform("rows", lambda x, i: result(x, F.concat(_own_path(names, levels, i), F.col("upper")), F.col("subroot"), F.col("root")))
    out = both.select(F.explode(per_row).alias("x"))
    removed(last)
    return out


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of each row of ``docs`` as it is, and, after the trial tampering, folded_root and verified.

    The trial lower-cases A-Z in the text of rows where 3 divides the CRC-32 of the decimal doc_id. Columns other than ``FIELDS`` don't count.
    """
    text = F.translate("text", UPPER, LOWER)
    fields = [F.col(c) for c in FIELDS]
    touched = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0) & (text != F.col("text"))
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), leaf(*fields).alias("digest"), F.when(touched, leaf(*fields[:-1], text)).alias("changed"))

    def result(x: Column, path: Column, subroot: Column, root: Column) -> Column:
        seen = F.coalesce(x["changed"], x["digest"])
        return F.struct(x["key"].alias("doc_id"), x["digest"].alias("leaf"), subroot.alias("subroot"), root.alias("root"), proof_digest(path).alias("proof_sha256"), folded(seen, path).alias("folded_root"))

    return proven(leaves, result, levels).select("x.*").withColumn("verified", F.col("folded_root") == F.col("root"))
