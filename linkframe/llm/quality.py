"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of
vote patterns (at most 3 to the number of labellers, whatever the corpus) estimates how often each
labeller is right; the patterns' posteriors label a bounded sample of documents, on which a linear scorer over
hashed byte trigrams and votes is trained. The scorer then judges every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longer, pieces

#: Documents that the scorer is trained on: about so many, drawn by a hash of doc_id and text, equal rows once. Everything else covers all rows.
TRAIN_ROWS = 6000
#: Features that these texts may have together, counted as a text's bytes or DIMS, whichever is less; beyond it the last drawn are left out of the training.
TRAIN_FEATURES = 32 << 20
DIMS = 1 << 15
SCALE = 30.0
GOOD, BAD, NONE = "1", "0", "-"
UPPER, LOWER, DIGIT, SYMBOL = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*~^=<>{}[]\\_@+"))


def vote(good: bool, bad: bool) -> str:
    return BAD if bad else GOOD if good else NONE


def distinctness(tokens: list[str], block: int = 500) -> float:
    """The share of distinct words, as the mean over blocks of one size (the last one ends with the text), so that it doesn't fall with length."""
    cuts = [*range(0, len(tokens) - block, block), max(0, len(tokens) - block)]
    return sum(len(set(tokens[a : a + block])) / max(1, len(tokens[a : a + block])) for a in cuts) / len(cuts)


def votes(text: str) -> str:
    """One letter per labeller. A text without words gets bad votes from length and prose alone."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    upper, lower = int(seen[UPPER].sum()), int(seen[LOWER].sum())
    tokens = text.split()
    n, size = max(1, len(tokens)), max(1, len(raw))
    letters = max(1, upper + lower)
    lines = [x for x in text.split("\n") if x.strip()]
    copies = 1 - len(set(lines)) / max(1, len(lines))
    distinct = distinctness(tokens)
    ends = int(seen[[33, 46, 63]].sum()) / n
    symbols = int(seen[SYMBOL].sum()) / size
    bars = int(seen[124]) / n
    shout = int(seen[33]) / n
    digits = int(seen[DIGIT].sum()) / size
    return "".join((
        vote(False, upper / letters > 0.5 and letters > 20),  # capitals
        vote(False, symbols > 0.04),  # symbols
        vote(False, bars > 0.15),  # table bars
        vote(False, shout > 0.25 and len(tokens) > 3),  # shouting
        vote(len(lines) > 3 and copies < 0.1, len(lines) > 3 and copies > 0.4),  # repeated lines
        vote(n > 30 and distinct > 0.5, n > 50 and distinct < 0.25),  # repeated words
        vote(0.03 < ends < 0.25, ends < 0.01 or ends > 0.6),  # prose: sentences end now and then
        vote(len(tokens) >= 20, len(tokens) < 4),  # length
        vote(False, digits > 0.3),  # digits
    ))


LABELLERS = 9
#: Labellers that look for one fault and never vote good; the others are silent where a text is too short to tell.
ONE_SIDED = [True, True, True, True, False, False, False, False, True]
#: What is believed of a labeller before any data, as vote shares (bad, good, silent) on bad and on good texts, and the weight
#: of that belief as a part of all rows. Without it, labellers of faults that never occur together can't be told from noise.
BELIEF = {True: ((0.3, 0, 0.7), (0.001, 0, 0.999)), False: ((0.2, 0.8, 0), (0.02, 0.98, 0))}
BELIEF_WEIGHT = 0.2


def expectation(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each vote pattern, each labeller's votes given bad and good, and the share of good.

    Votes are taken as independent given the class; silence counts for a labeller's rates, but not for a text. It starts from the faults
    found: a text with one is taken for bad. Equal counts give equal results.
    """
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    hot = np.array([[[c == v for v in (BAD, GOOD, NONE)] for c in k] for k in keys], float)  # patterns, labellers, votes
    if not keys:
        return {}, np.full((2, LABELLERS, 3), 1 / 3), 0.5
    hot[:, ~np.array(ONE_SIDED), 2] = 0
    post = np.array([0.02 if any(c == BAD and x for c, x in zip(k, ONE_SIDED, strict=True)) else 0.3 if BAD in k else 0.97 for k in keys])
    table, prior = np.zeros((2, *hot.shape[1:])), 0.5
    for _ in range(rounds):
        for c, p in ((0, 1 - post), (1, post)):
            w = np.einsum("p,plv->lv", p * count, hot) + BELIEF_WEIGHT * count.sum() * np.array([BELIEF[x][c] for x in ONE_SIDED]) + 1e-6
            table[c] = w / w.sum(1, keepdims=True)
        prior = (float((post * count).sum()) + 1) / (count.sum() + 2)
        odds = np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", hot[:, :, :2], np.log((table[1] + 1e-9) / (table[0] + 1e-9))[:, :2])
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(keys, post.tolist(), strict=True)), table, prior


def accuracies(table: np.ndarray, prior: float) -> list[float]:
    """How often each labeller's votes (where it votes) are right."""
    right = table[0, :, 0] * (1 - prior) + table[1, :, 1] * prior
    return (right / (right + table[0, :, 1] * (1 - prior) + table[1, :, 0] * prior)).tolist()


def trigrams(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.uint32)
    return ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)


def vote_features(v: str) -> list[int]:
    return [DIMS + 3 * i + (BAD, GOOD, NONE).index(c) for i, c in enumerate(v)]


def voted(docs: DataFrame) -> DataFrame:
    """(votes) of each text; null counts as empty."""

    def run(batches):
        for part in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([votes(t or "") for t in part.column("text").to_pylist()], pa.string())], ["votes"])

    return docs.select("text").mapInArrow(run, "votes string")


def sample_features(docs: DataFrame) -> DataFrame:
    """votes (v), places and values of each text's features."""

    def run(batches):
        for part in pieces(batches):
            rows = []
            for t in part.column("text").to_pylist():
                raw = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)
                at, n = np.unique(trigrams(raw), return_counts=True) if len(raw) > 2 else (np.zeros(0), np.zeros(0))
                rows.append({"v": votes(t or ""), "at": at.astype(np.int32).tobytes(), "n": (n * SCALE / max(1, len(raw) - 2)).astype(np.float32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("v", pa.string()), ("at", pa.binary()), ("n", pa.binary())]))

    return docs.select("text").mapInArrow(run, "v string, at binary, n binary")


def train(rows: list, posterior: dict[str, float], rounds: int = 80, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer whose targets are posteriors, by AdaGrad over whole passes."""
    w, squares = np.zeros(DIMS + 3 * LABELLERS + 1), np.full(DIMS + 3 * LABELLERS + 1, 1e-6)
    if not rows:
        return w
    places = [np.concatenate([np.frombuffer(r["at"], np.int32), vote_features(r["v"]), [len(w) - 1]]) for r in rows]
    values = np.concatenate([np.concatenate([np.frombuffer(r["n"], np.float32), np.full(LABELLERS, 0.5, np.float32), np.ones(1, np.float32)]) for r in rows])
    size = np.array([len(p) for p in places])
    at, row = np.concatenate(places).astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), size)
    goal = np.array([posterior[r["v"]] for r in rows])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, values * w[at], len(rows)), -30, 30)))
        grad = np.bincount(at, values * (p - goal)[row], len(w)) / len(rows) + decay * w
        squares += grad * grad
        w -= rate * grad / np.sqrt(squares)
    return w


def drawn(docs: DataFrame, share: float, most: int) -> DataFrame:
    """(text) of a share of the documents, drawn by a hash of doc_id and text, equal rows once; in the order of that hash as many as have ``most`` features together, one at least.

    The driver sees a hash and a size of each drawn row.
    """
    lots = docs.select("text", F.xxhash64("doc_id", "text").alias("lot")).where((F.col("lot").cast("double") + 2.0**63) <= share * 2.0**64)
    size = F.least(F.lit(DIMS), F.octet_length(F.coalesce("text", F.lit(""))))
    last, left = None, most
    for lot, n in sorted((r["lot"], r["n"]) for r in lots.groupBy("lot").agg(F.max(size).alias("n")).collect()):
        left -= n
        if left < 0 and last is not None:
            lots = lots.where(F.col("lot") <= last)
            break
        last = lot
    return lots.groupBy("lot").agg(F.first("text").alias("text")).select("text")  # rows of one lot are equal


def scored(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_features: int = TRAIN_FEATURES) -> DataFrame:
    """Add votes, posterior and score (0 to 1) to every document.

    Null text counts as empty; repeated rows get equal results; columns that already have these names
    give way. An empty table stays empty. What reaches the driver is bounded: vote patterns and about ``train_rows`` feature lists, at most ``train_features`` long together.
    """
    docs = docs.drop("votes", "posterior", "score")
    patterns = {r["votes"]: r["n"] for r in voted(docs).groupBy("votes").agg(F.count("*").alias("n")).collect()}
    posterior, _, _ = expectation(patterns)
    share = min(1.0, train_rows / max(1, sum(patterns.values())))
    w = train(sample_features(drawn(docs, share, train_features)).collect(), posterior)
    trained, extra = w[:DIMS].astype(np.float32), w[DIMS:]
    schema = longer(docs.schema, "votes string, posterior double, score double")

    def run(batches):
        for part in pieces(batches):
            got, score = [], []
            for t in part.column("text").to_pylist():
                t = t or ""
                raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
                v = votes(t)
                z = float(trained[trigrams(raw)].mean(dtype=np.float64)) * SCALE if len(raw) > 2 else 0.0
                z += sum(0.5 * float(extra[i - DIMS]) for i in vote_features(v)) + float(extra[-1])
                got.append(v)
                score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string()), pa.array([posterior[v] for v in got], pa.float64()), pa.array(score, pa.float64())], [*part.schema.names, "votes", "posterior", "score"])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents whose score reaches ``least``, as ``scored`` returns them."""
    return scored(docs, train_rows).where(F.col("score") >= least)
