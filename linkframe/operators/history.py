"""Change history and input lineage over tables of versions, commits and changes."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import meet, reachable
from .diff import differing


def row_text(fields: list[str]) -> Column:
    """A hash of the id and the declared fields in the schema's order, so that column order and other columns change nothing."""
    return F.sha2(F.to_json(F.struct("id", *fields), {"ignoreNullFields": "false"}), 256)


def changes(versions: DataFrame) -> DataFrame:
    """(seq, id, path, op) per version: added, removed or changed. A move is a removal and an addition.

    Input: seq, id, path, text (null where the entity isn't there any more). Versions follow by seq.
    """
    w = Window.partitionBy("id", "path").orderBy("seq")
    got = versions.withColumn("before", F.lag("text").over(w)).where(~F.col("text").eqNullSafe(F.col("before")))
    return got.select("seq", "id", "path", F.when(F.col("before").isNull(), "added").when(F.col("text").isNull(), "removed").otherwise("changed").alias("op"))


def revisions(found: DataFrame, inputs: DataFrame) -> DataFrame:
    """(seq) of commits that touch any input, newest first. found: seq, id, type, path; inputs: kind (entity, type, path), value."""
    parts = []
    for kind, column in (("entity", "id"), ("type", "type"), ("path", "path")):
        want = inputs.where(F.col("kind") == kind).select(F.col("value").alias(column)).distinct()
        parts.append(found.join(want, column, "left_semi").select("seq"))
    return reduce(lambda a, b: a.union(b), parts).distinct().orderBy(F.desc("seq"))


def last_changed(found: DataFrame, key: str = "id", dirty: DataFrame | None = None) -> DataFrame:
    """(key, commit): the newest commit of each; ``uncommitted`` where there is none, ``-dirty`` behind it where the working state differs.

    found: key, seq, commit. dirty: key.
    """
    got = found.groupBy(key).agg(F.max_by("commit", "seq").alias("commit"))
    if dirty is None:
        return got
    marked = got.join(dirty.select(key).distinct().withColumn("__d", F.lit(True)), key, "full")
    return marked.select(key, F.when(F.col("commit").isNull(), "uncommitted").when(F.col("__d"), F.concat("commit", F.lit("-dirty"))).otherwise(F.col("commit")).alias("commit"))


def latest(found: DataFrame, key: str, value: str = "commit", by: str = "seq") -> DataFrame:
    """The newest of each key's rows."""
    return found.groupBy(key).agg(F.max_by(value, by).alias(value))


def dirty(snapshot: DataFrame, working: DataFrame) -> DataFrame:
    """(path, id, type, op): files that differ from the snapshot (line ends aside), with the entities in them. Input: path, id, type, text."""
    key = F.sha2(F.regexp_replace("text", "\r\n", "\n"), 256)
    snapshot, working = differing(*[t.select("path", "id", "type", key.alias("key")) for t in (snapshot, working)], key="path")
    side = lambda t, n: t.select("path", "id", F.col("type").alias(f"{n}_type"), F.col("key").alias(n))
    got = side(snapshot, "a").join(side(working, "b"), ["path", "id"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    op = F.when(F.col("a").isNull(), "untracked").when(F.col("b").isNull(), "deleted").otherwise("changed")
    return got.select("path", "id", F.coalesce("b_type", "a_type").alias("type"), op.alias("op"))


def commit_tags(tags: DataFrame) -> DataFrame:
    """(commit, tags): each commit's tag names, sorted."""
    return tags.groupBy("commit").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def content_hash(files: DataFrame, excluded: str = ".signatures") -> DataFrame:
    """(snapshot, hash): digest over the digests of a snapshot's files in order of path; one folder is left out.

    Files are hashed where they lie; only a digest per file meets its snapshot.
    """
    kept = files.where((F.col("path") != excluded) & ~F.col("path").startswith(excluded + "/"))
    each = kept.select("snapshot", F.struct("path", F.sha2("content", 256).alias("sha")).alias("f"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat_ws("\u0000", f["path"], f["sha"])), "\n")
    return each.groupBy("snapshot").agg(F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("hash"))


def content_hash_tree(files: DataFrame, excluded: str = ".signatures", digits: int = 3) -> DataFrame:
    """(snapshot, hash) where no task or array holds a snapshot: files are digested by the first digits of their path's hash, and
    these digests (16 ** ``digits`` at most) make the snapshot's."""
    kept = files.where((F.col("path") != excluded) & ~F.col("path").startswith(excluded + "/"))
    one = F.struct("path", F.sha2("content", 256).alias("sha")).alias("f")
    lines = lambda c, a: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda f: F.concat_ws("\u0000", f[a], f["sha"])), "\n"), 256)
    each = kept.select("snapshot", F.substring(F.sha2("path", 256), 1, digits).alias("part"), one).groupBy("snapshot", "part").agg(lines("f", "path").alias("sha"))
    return each.groupBy("snapshot").agg(F.concat(F.lit("sha256:"), lines(F.struct("part", "sha"), "part")).alias("hash"))


def content_hash_framed(files: DataFrame, first_line: str, excluded: str = ".signatures") -> DataFrame:
    """(snapshot, hash) in the byte-exact form: a first line, then kind, path, length and bytes of each file, framed by zero bytes.

    One task reads a snapshot, file after file in order of path. Input: snapshot, kind, path, content.
    """
    schema = pa.schema([("snapshot", pa.string()), ("hash", pa.string())])
    kept = files.where((F.col("path") != excluded) & ~F.col("path").startswith(excluded + "/"))
    ordered = kept.select(F.col("snapshot").cast("string"), "kind", "path", "content").repartition("snapshot").sortWithinPartitions("snapshot", F.encode("path", "UTF-8"))

    def run(batches):
        now, digest = None, None
        for b in batches:
            for snapshot, kind, path, content in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if snapshot != now or digest is None:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"snapshot": now, "hash": "sha256:" + digest.hexdigest()}], schema)
                    now, digest = snapshot, hashlib.sha256(first_line.encode())
                digest.update(f"{kind}\0{path}\0{len(content)}\0".encode() + content)
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"snapshot": now, "hash": "sha256:" + digest.hexdigest()}], schema)

    return ordered.mapInArrow(run, "snapshot string, hash string")


def dependencies(roots: DataFrame, full: DataFrame, shallow: DataFrame) -> DataFrame:
    """(root, node, how): what a rendered root depends on: by ``full`` edges (embeds, results shown whole) at any depth,
    then one step of ``shallow`` edges (entities that are only cited or read)."""
    whole = reachable(full, roots)
    near = meet(whole.select("root", F.col("node").alias("src")), shallow.select("src", "dst"), "src").select("root", F.col("dst").alias("node")).distinct()
    named = full.select(F.col("dst").alias("node")).union(roots.select("id")).distinct()
    if not meet(shallow.select(F.col("dst").alias("node")).distinct(), named, "node", "left_semi").isEmpty():  # else none is there whole, and pairs needn't meet
        near = meet(near, whole, ["root", "node"], "left_anti")
    return whole.withColumn("how", F.lit("full")).union(near.withColumn("how", F.lit("read")))


def formula_inputs(roots: DataFrame, path_edges: list[DataFrame]) -> DataFrame:
    """(root, node): entities that a calculated value reads, by the edges of its declared paths, at any depth; not the root itself."""
    edges = reduce(lambda a, b: a.union(b), [e.select("src", "dst") for e in path_edges])
    return reachable(edges, roots).where("root <> node")


def in_scope(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a scope: a query's results, or a root and what it depends on."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def output_inputs(content: DataFrame, formulas: DataFrame, types: DataFrame, paths: DataFrame) -> DataFrame:
    """(page, kind, value): the input set of each output. content and formulas: page, node; types: page, type; paths: page, path."""
    e = content.select("page", F.lit("entity").alias("kind"), F.col("node").alias("value")).union(formulas.select("page", F.lit("entity"), "node"))
    return e.union(types.select("page", F.lit("type"), "type")).union(paths.select("page", F.lit("path"), "path")).distinct()
