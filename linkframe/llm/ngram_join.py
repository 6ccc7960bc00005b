"""N-gram Jaccard join by prefix filters under several global token orders.

A document's tokens are the hashes of its distinct word shingles; documents with equal sets are one class. If two
sets have a likeness of at least t, they share a token among the first n - ceil(t n) + 1 of each under any
order common to all. All orders here put rarer tokens first (document frequency, or its magnitude, then a hash of
their own), so tokens that only one class has fill prefixes first and most classes drop out
unpaired. A pair must share a prefix token under every order before its sets are compared.

Frequencies need every token of every class once: they are shuffled packed, some seven bytes a token. Tokens that
are very frequent (found by a pass before, at most ``MAX_HOT``) are left out of that count and come last in all orders,
so that no part of it holds a token of a large share of the rows: they travel as one list per class.

Only components are wanted by ``joined``, so pairs within one component aren't tested there: classes are first held against one
leader per token, that with the fewest rarer tokens, and then all pairs that are left between different components are compared;
``links`` compares them all. A pair is dropped early where the places of a common token leave too little behind it for the overlap that
both sizes need. Where over ``SPLIT`` classes would meet by one token, they meet by that token and one of the second order's prefix.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import bytes_of, mix64, word_hashes, words_of
from .common import SHINGLE, pieces, removed, written
from .components import components

LEAST = 75  # per cent
#: A token that one in HOT_IN of the CHUNK classes in a task has (four at least) is reported; the MAX_HOT most frequent of those are hot.
CHUNK, HOT_IN, MAX_HOT = 4096, 256, 100_000
CHUNK_TOKENS = 1_200_000
PART_TOKENS = 1_000_000
#: Parts that a chunk is dealt into at once; more are dealt in two steps, so that rows don't grow as chunks times parts.
DEAL = 4096
LEADER_ROUNDS = 4
SPLIT = 2000
HOT_DF = 1 << 30
BITS = 56  # of a token


TURN = mix64(np.arange(1, 1 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def token_sets(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and where each text's begin.

    A-Z are lower-cased, words cut at ASCII white space. Fewer words than a shingle are one shingle; null, empty and blank texts have none.
    """
    raw, edge = bytes_of(texts)
    start, end, words = words_of(raw, edge)
    h = word_hashes(raw, start, end, fold=True)
    count = np.diff(words)
    held = np.maximum(count - width + 1, 0)
    whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for i in range(width):
        whole += h[i : len(h) - width + 1 + i] * TURN[i] if len(whole) else whole
    whole = mix64(whole) >> np.uint64(64 - BITS)
    held[(count > 0) & (count < width)] = 1
    at = np.r_[0, np.cumsum(held)]
    out = np.empty(at[-1], np.uint64)
    for i in np.flatnonzero(held):
        a, n = words[i], count[i]
        if n < width:
            out[at[i]] = xxhash.xxh3_64_intdigest(h[a : a + n].tobytes(), seed=1) >> (64 - BITS)
        else:
            out[at[i] : at[i + 1]] = np.sort(whole[a : a + n - width + 1])
    new = np.r_[True, out[1:] != out[:-1]]
    new[at[:-1][held > 0]] = True
    new = new[: len(out)]
    return out[new], np.r_[0, np.cumsum(new)][at]


def classes_of(tokens: np.ndarray, at: np.ndarray) -> list[int | None]:
    """One number for each set: documents with equal sets have equal numbers, those with empty ones none."""
    return [xxhash.xxh3_64_intdigest(tokens[a:b]) - (1 << 63) if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def row_hash() -> Column:
    """Tells rows apart: those with equal doc_id and text are one document."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def chunks(batches):
    """Batches as (batch, classes, None), and after every ``CHUNK`` classes or ``CHUNK_TOKENS`` tokens (None, the new classes, their sets)."""
    sets: dict[int, np.ndarray] = {}
    total = 0
    for part in pieces(batches):
        tokens, at = token_sets(part.column("text"))
        found = classes_of(tokens, at)
        yield part, found, np.diff(at)
        for i, c in enumerate(found):
            if c is not None and c not in sets:
                sets[c] = tokens[at[i] : at[i + 1]]
                total += len(sets[c])
        if len(sets) >= CHUNK or total >= CHUNK_TOKENS:
            yield None, np.fromiter(sets, np.int64, len(sets)), list(sets.values())
            sets, total = {}, 0
    if sets:
        yield None, np.fromiter(sets, np.int64, len(sets)), list(sets.values())


def surveyed(docs: DataFrame) -> DataFrame:
    """Rows kind 'd': doc_id, n (size of the set), class, rid. Rows kind 't': a token frequent in one chunk, and how many classes there have it."""
    schema = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("rid", pa.int64())])

    def run(batches):
        for part, classes, sets in chunks(batches):
            if part is not None:
                yield pa.RecordBatch.from_arrays([pa.array(["d"] * len(classes), pa.string()), part.column("doc_id"), pa.array(sets, pa.int64()), pa.array(classes, pa.int64()), part.column("rid")], schema=schema)
                continue
            tokens = np.sort(np.concatenate(sets))
            start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            count = np.diff(np.r_[start, len(tokens)])
            take = count >= max(4, len(classes) // HOT_IN)
            n = int(take.sum())
            yield pa.RecordBatch.from_arrays([pa.array(["t"] * n, pa.string()), pa.array(tokens[start[take]].view(np.int64)), pa.array(count[take]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text", row_hash().alias("rid")).mapInArrow(run, "kind string, id long, n long, class long, rid long")


def part_of(token: np.ndarray, parts: int) -> np.ndarray:
    """Parts are equal ranges of the first 32 bits of tokens."""
    return ((token >> np.uint64(BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


BLOB = pa.schema([("part", pa.int64()), ("blob", pa.binary())])


def blobs(token: np.ndarray, owner: np.ndarray, part: np.ndarray):
    """Batches of (part, blob) of sorted parts, tokens sorted within."""
    edge = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)] if len(part) else np.zeros(1, np.int64)
    for at in range(0, len(edge) - 1, 64):
        some = list(zip(edge[at : at + 64], edge[at + 1 : at + 65], strict=False))
        yield pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in some], pa.int64()), pa.array([blob(token[a:b], owner[a:b]) for a, b in some], pa.binary())], schema=BLOB)


def packed(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """(part, blob): the classes and tokens of a chunk of documents that fall into a part of the hash range.

    Parts below zero hold the hot tokens of classes, by number in ``hot``: a class has one such part.
    """
    wide = -(-parts // DEAL)  # fine parts in a coarse one

    def run(batches):
        for part, classes, sets in chunks(batches):
            if part is not None:
                continue
            token, owner = np.concatenate(sets), np.repeat(classes, [len(s) for s in sets])
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            if len(hot):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                is_hot = hot[at] == token
                home = -1 - owner[is_hot] % parts
                order = np.lexsort((at[is_hot], home))
                yield from blobs(at[is_hot][order].astype(np.uint64), owner[is_hot][order], home[order])
                token, owner = token[~is_hot], owner[~is_hot]
            yield from blobs(token, owner, part_of(token, parts) // wide)

    def deal(batches):
        held: dict[int, list[bytes]] = {}
        size = 0
        for batch in batches:
            for c, b in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                held.setdefault(c, []).append(b.as_py())
                size += len(held[c][-1])
            if size >= 64 << 20:
                yield from dealt(held)
                held, size = {}, 0
        yield from dealt(held)

    def dealt(held: dict[int, list[bytes]]):
        for c, found in held.items():
            if c < 0:
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(found), pa.int64()), pa.array(found, pa.binary())], schema=BLOB)
                continue
            both = [unblob(b) for b in found]
            token, owner = np.concatenate([t for t, _ in both]), np.concatenate([o for _, o in both])
            order = np.argsort(token)
            yield from blobs(token[order], owner[order], part_of(token[order], parts))

    found = docs.select("text").mapInArrow(run, "part long, blob binary")
    if wide > 1:
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        found = found.repartition(tasks, F.col("part"), F.pmod(F.xxhash64("blob"), F.lit(max(1, tasks // 16)))).mapInArrow(deal, "part long, blob binary")
    return found


def blob(token: np.ndarray, owner: np.ndarray) -> bytes:
    """Distinct classes, then sorted tokens as differences, then each one's class as an index."""
    used, index = np.unique(owner, return_inverse=True)
    step = np.diff(token, prepend=token[:1])
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    data = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    short = "<u2" if len(used) <= 1 << 16 else "<u4"
    return np.array([len(used), len(token), width, int(token[0])], "<u8").tobytes() + used.astype("<i8").tobytes() + data.tobytes() + index.astype(short).tobytes()


def unblob(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    m, n, width, base = (int(x) for x in np.frombuffer(raw, "<u8", 4))
    used = np.frombuffer(raw, "<i8", m, 32)
    data = np.zeros((n, 8), np.uint8)
    data[:, :width] = np.frombuffer(raw, np.uint8, n * width, 32 + 8 * m).reshape(n, width)
    index = np.frombuffer(raw, "<u2" if m <= 1 << 16 else "<u4", n, 32 + 8 * m + n * width)
    return np.cumsum(data.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base), used[index]


FOUND = pa.struct([("df", pa.int32()), ("token", pa.int64())])


def shared(found: DataFrame) -> DataFrame:
    """(class, found): of each part the tokens (df, token) of a class that other classes have too, a row each; a class's hot ones, with names
    below zero, are one row."""
    schema = pa.schema([("class", pa.int64()), ("found", pa.list_(FOUND))])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        both = [unblob(b.as_py()) for b in table.column("blob")]
        token, owner = np.concatenate([t for t, _ in both]), np.concatenate([c for _, c in both])
        del both
        if key[0].as_py() < 0:
            name, df = -1 - token.astype(np.int64), np.full(len(token), HOT_DF, np.int32)
        else:
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            same = token[1:] == token[:-1]
            some = np.r_[same, False] | np.r_[False, same]  # tokens that are there once are most
            name, owner = token[some].view(np.int64), owner[some]
        order = np.lexsort((owner, name))
        name, owner = name[order], owner[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])][: len(name)]
        name, owner = name[new], owner[new]
        if key[0].as_py() < 0:
            df = df[: len(name)]
        else:
            start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]][: len(name)])
            df = np.diff(np.r_[start, len(name)])
            df = np.repeat(df, df).astype(np.int32)
            name, owner, df = name[df > 1], owner[df > 1], df[df > 1]
        order = np.argsort(owner, kind="stable")
        name, owner, df = name[order], owner[order], df[order]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)]) if key[0].as_py() < 0 else np.arange(len(owner))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(owner)], pa.int32()), pa.StructArray.from_arrays([pa.array(df), pa.array(name)], fields=list(FOUND)))
        return pa.Table.from_arrays([pa.array(owner[start]), lists], schema=schema)

    return found.groupBy("part").applyInArrow(run, "class long, found array<struct<df: int, token: long>>")


def needed(n: Column) -> Column:
    """ceil(t n): the least overlap of a set of n with any set as like as t, by size alone."""
    return F.floor((n * LEAST + 99) / 100)


def candidates(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes whose prefixes hold shared tokens: n, tokens (all shared ones), and a prefix under each order."""
    per = tokens.groupBy("class").agg(F.flatten(F.collect_list("found")).alias("all")).join(classes.select("class", "n"), "class")
    left = F.col("n") - needed(F.col("n")) + 1 - (F.col("n") - F.size("all"))  # of a prefix, once tokens of one class fill it first
    per = per.withColumn("left", left.cast("int")).where("left > 0").withColumn("all", F.array_sort("all"))

    def prefix(seed: int) -> Column:
        magnitude = lambda x: F.floor(F.log2(x["df"])).cast("int")
        named = F.transform("all", lambda x: F.struct(magnitude(x).alias("m"), F.xxhash64(x["token"], F.lit(seed)).alias("h"), x["token"].alias("token")))
        return F.transform(F.slice(F.array_sort(named), 1, F.col("left")), lambda x: x["token"])

    alone = (F.col("n") - F.size("all")).alias("alone")
    return per.select("class", "n", alone, F.transform("all", lambda x: x["token"]).alias("tokens"), F.transform(F.slice("all", 1, F.col("left")), lambda x: x["token"]).alias("first"), prefix(1).alias("second"), prefix(2).alias("third"))


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) that share prefix tokens under the other orders too, and whose sets are alike enough."""
    side = lambda c, *cols: found.select(F.col("class").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in cols])
    alike = (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * LEAST) & F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third")
    few = pairs.join(side("a", "n", "second", "third"), "a").join(side("b", "n", "second", "third"), "b").where(alike).select("a", "b")
    both = few.join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")))
    return both.where(F.col("common") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("common")) * LEAST).select("a", "b")


def enough(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of n and m elements whose first common token is at these places can be alike enough.

    What follows the token in the smaller rest bounds the overlap, which must be t / (1 + t) of both sizes.
    """
    rest = F.least(n - at, m - to)
    return (rest * (100 + LEAST) >= (n + m) * LEAST) & (F.least(n, m) * 100 >= F.greatest(n, m) * LEAST)


def prefixes(found: DataFrame) -> DataFrame:
    """(class, n, at, token): a class's prefix under the first order; ``at`` counts its rarer tokens."""
    rows = found.select("class", "n", "alone", F.posexplode("first").alias("i", "token"))
    return written(rows.select("class", "n", (F.col("alone") + F.col("i")).alias("at"), "token"), "prefixes")


def meeting(known: DataFrame, found: DataFrame, split: int = SPLIT) -> DataFrame:
    """Pairs (a, b), a < b, of different ``comp`` with a prefix token of the first order in common that leaves enough behind it.

    known: class, comp, n, at, token. Of a token that over ``split`` classes have, pairs must share one of the second order too.
    """
    spread = known.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("k")).where("x <> y").select("token", "k")
    known = known.join(spread, "token")
    few = known.where(F.col("k") <= split).withColumn("key", F.col("token"))
    many = known.where(F.col("k") > split).join(found.select("class", F.explode("second").alias("also")), "class").withColumn("key", F.xxhash64("token", "also")).drop("also")
    known = few.unionByName(many)
    side = lambda p: known.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("class", "comp", "n", "at", "token")])
    fit = (F.col("a_class") < F.col("b_class")) & (F.col("a_token") == F.col("b_token")) & (F.col("a_comp") != F.col("b_comp")) & enough(F.col("a_n"), F.col("a_at"), F.col("b_n"), F.col("b_at"))
    a, b = side("a"), side("b").withColumnRenamed("key", "__key")
    return a.join(b, (F.col("key") == F.col("__key")) & fit).select(F.col("a_class").alias("a"), F.col("b_class").alias("b")).distinct()


def linked(found: DataFrame) -> DataFrame:
    """(class, comp): the component of each class, by the least class in it."""
    rows = prefixes(found)
    labels = written(found.select("class", F.col("class").alias("comp")), "components")
    tested, spent = None, [rows]

    def fold(labels: DataFrame, links: DataFrame) -> DataFrame:
        joined = links.join(labels.select(F.col("class").alias("a"), F.col("comp").alias("x")), "a").join(labels.select(F.col("class").alias("b"), F.col("comp").alias("y")), "b")
        merged = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")))
        new = labels.join(merged.withColumnRenamed("node", "comp"), "comp", "left")
        new = written(new.select("class", F.coalesce("label", "comp").alias("comp")), "components")
        removed(links, merged, labels)
        return new

    for _ in range(LEADER_ROUNDS):
        known = rows.join(labels, "class")
        middle = F.min(F.struct((F.col("at") / F.col("n")).alias("share"), "class", "comp", "n", "at"))  # the one with the fewest rarer tokens
        lead = known.groupBy("token").agg(middle.alias("lead"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token", "lead")
        pairs = known.join(lead, "token").where((F.col("comp") != F.col("lead.comp")) & enough(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
        pairs = pairs.groupBy(F.col("lead.class").alias("a"), F.col("class").alias("b")).agg(F.count("*").alias("times"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        best = written(pairs.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b"), "pairs")
        spent.append(best)
        links = written(verified(best, found), "links")
        tested = best if tested is None else tested.union(best)
        if links.isEmpty():
            break
        labels = fold(labels, links)
    pairs = meeting(rows.join(labels, "class"), found)
    if tested is not None:
        pairs = pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = written(verified(pairs, found), "links")
    out = labels if links.isEmpty() else fold(labels, links)
    removed(*spent)
    return out


def gathered(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row (doc_id, n_shingles, class, rid), each class of rows with shingles (class, least, n, rows), and those that may have links (``candidates``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = written(surveyed(docs), "survey")
    top = survey.where("kind = 't'").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(MAX_HOT).select("id").collect()
    hot = np.sort(np.array([r["id"] for r in top], np.int64).view(np.uint64))
    total = survey.where("kind = 'd'").agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_TOKENS))
    one = survey.where("kind = 'd'").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class", "rid")
    classes = one.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    return one, classes, written(candidates(shared(packed(docs, parts, hot)), classes), "candidates")


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row (doc_id, n_shingles, class, rid), and each class of rows with shingles (class, least, comp)."""
    one, classes, found = gathered(docs)
    labels = linked(found)
    removed(found)
    return one, classes.join(labels, "class", "left").select("class", "least", F.coalesce("comp", "class").alias("comp"))


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, as (a, b) of class numbers, a < b; and every row (doc_id, class, n_links).

    n_links counts the other rows that a row links with, those of its own class included. Rows without shingles have no class and no link.
    """
    one, classes, found = gathered(docs)
    rows = prefixes(found).withColumn("comp", F.col("class"))
    pairs = written(verified(meeting(rows, found), found), "links")
    size = classes.select(F.col("class").alias("b"), "rows")
    both = pairs.union(pairs.select("b", "a")).join(size, "b").groupBy(F.col("a").alias("class")).agg(F.sum("rows").alias("far"))
    per = classes.join(both, "class", "left").select("class", (F.col("rows") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))
    return pairs, one.join(per, "class", "left").select("doc_id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def first_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, rid): with its row_hash(), the first row of each component, by doc_id (null last), then a hash of the text. Rows without shingles are in none."""
    one, comp = labelled(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    first = one.where("n_shingles > 0").groupBy("class").agg(F.min(place).alias("first"))
    return first.join(comp, "class").groupBy("comp").agg(F.min("first").alias("first")).select("first.doc_id", "first.rid")


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Null, empty and blank texts have no shingles and are linked with nothing, not even each other. Rows that repeat are all
    returned. A null doc_id counts in no minimum; a component of nothing else has null. Extra columns are ignored.
    """
    one, comp = labelled(docs)
    least = comp.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = comp.join(least, "comp").select("class", "component_id")
    out = one.join(ids, "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
