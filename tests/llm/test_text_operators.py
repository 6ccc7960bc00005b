"""Joins, spans, mixing, quality, fingerprints, counts and suffix dedup against plain Python."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkframe.llm import bytewords, components, fingerprint, mixing, ngram_join, quality, spans, suffix_dedup, token_counts

DIR = "/root/testdata/sf0.001"


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    bases = [[word() for _ in range(r.randrange(3, 60))] for _ in range(12)]
    common = [word() for _ in range(30)]
    out = []
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w[len(w) // 2 : len(w) // 2] = common
        out.append(r.choice([" ", "  ", "\n"]).join(w) if r.random() < 0.9 else " ".join(w).upper())
    return [*out, None, "", " \n", "one two", "One  TWO", "a b c d e", "ü Ü"]


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed, monkeypatch):
    texts = corpus(seed)
    if seed == 2:  # tiny chunks, so that many tokens are hot
        monkeypatch.setattr(ngram_join, "CHUNK", 16)
        monkeypatch.setattr(ngram_join, "HOT_IN", 4)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, component_id int").repartition(4)
    want, sizes = plain_components(texts)
    got = {r["doc_id"]: r for r in ngram_join.joined(docs).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert ngram_join.joined(docs.limit(0)).isEmpty()


def test_ngram_join_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.joined(docs).collect()), key=str) == [(7, 2, 7), (7, 2, 7), (9, 0, 9), (None, 2, 7)]


def test_blobs():
    r = np.random.default_rng(1)
    for n, m in ((500, 40), (1, 1), (70_000, 66_000)):
        token = np.sort(r.integers(0, 1 << 56, n, dtype=np.uint64))
        owner = r.permutation(np.resize(r.integers(-(1 << 62), 1 << 62, m), n))
        a, b = ngram_join.unblob(ngram_join.blob(token, owner))
        assert (a == token).all() and (b == owner).all()


def test_token_sets():
    """Equal shingles have equal hashes and others don't, whatever lies around them; long texts go span by span."""
    r = random.Random(3)
    texts = corpus(3) + [" ".join(r.choice("abc") * r.randrange(1, 5) for _ in range(3000)), "x" * 3_000_000 + " a b c d e f", "\u00a0A \u2003b", "a\x0bb\x0cc d e f"]
    array = pa.array(["skipped", *texts])[1:]
    tokens, at = ngram_join.token_sets(array)
    names: dict = {}
    for i, t in enumerate(texts):
        s, alone = tokens[at[i] : at[i + 1]], ngram_join.token_sets(pa.array([t], pa.string()))[0]
        assert len(s) == len(shingles(t)) and (np.diff(s.astype(np.int64)) > 0).all() and (s == alone).all()
        names.setdefault(frozenset(shingles(t)), set()).add(tuple(s.tolist()))
    assert all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == len(names)
    assert len({h for x in names.values() for s in x for h in s}) == len(set.union(*(shingles(t) for t in texts)))


def test_dealing_in_two_steps(spark, monkeypatch):
    """Many parts are dealt coarse, then fine, and hold the same; a token that one in a hundred documents has is in none of them."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(30)) + (" the very same five words here" if i % 100 == 0 else "") for i in range(6000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    hot = [x["id"] for x in ngram_join.surveyed(docs).where("kind = 't'").select("id").distinct().collect()]
    assert len(hot) == 2  # its two shingles
    none, all_ = np.zeros(0, np.uint64), np.sort(np.array(hot, np.uint64))

    def content(rows):
        out = {}
        for x in rows:
            t, c = ngram_join.unblob(bytes(x["blob"]))
            out.setdefault(x["part"], set()).update(zip(t.tolist(), c.tolist(), strict=True))
        return out

    whole = content(ngram_join.packed(docs, 40, none).collect())
    few = content(ngram_join.packed(docs, 40, all_).collect())
    monkeypatch.setattr(ngram_join, "DEAL", 7)
    assert content(ngram_join.packed(docs, 40, none).collect()) == whole
    assert max(len(v) for v in few.values()) < 1.3 * sum(map(len, whole.values())) / 40
    assert not {t for k, v in few.items() if k >= 0 for t, _ in v} & set(hot)
    # a class's hot tokens leave as one row
    got = ngram_join.shared(ngram_join.packed(docs, 40, all_)).where(F.col("found")[0]["df"] == ngram_join.HOT_DF)
    assert got.count() == got.select("class").distinct().count() == 60


def test_meeting_by_two_tokens(spark):
    """Splitting a frequent token by those of the second order loses no pair that shares both, and links() counts what joined() joins."""
    texts = corpus(5, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pairs, per = ngram_join.links(docs)
    sets = [shingles(t) for t in texts]
    want = [sum(i != j and bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert [r["n_links"] for r in per.orderBy("doc_id").collect()] == want
    _, _, found = ngram_join.gathered(docs)
    rows = ngram_join.prefixes(found).withColumn("comp", F.col("class"))
    split = ngram_join.verified(ngram_join.meeting(rows, found, split=1), found)
    assert {tuple(x) for x in split.collect()} == {tuple(x) for x in pairs.collect()}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3)]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    label = {x: x for e in edges if None not in e for x in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(k in e and e[0] != e[1] and None not in e for e in edges)}


def plain_mix(x):
    whole = 1 << 64
    x = (x ^ x >> 31) * 0x7FB5D329728EA185 % whole
    x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D % whole
    return x ^ x >> 33


def plain_sum(values, size):
    whole = 1 << 64
    return plain_mix((sum(plain_mix((v + (i + 1) * int(bytewords.PLACE)) % whole) for i, v in enumerate(values)) + int(size) * int(bytewords.LENGTH)) % whole)


def plain_hash(word):
    return plain_sum([int.from_bytes(word[i : i + 8], "little") for i in range(0, len(word), 8)], len(word))


def test_word_hashes(monkeypatch):
    """Words of all lengths, in one part or several, against the definition; runs of words too."""
    r = random.Random(6)
    words = [bytes(r.choice(b"abAB\xc3\xa9.") for _ in range(n)) for n in [*range(1, 40), 1, 1, 8, 16, 17, 3000]]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    for lanes in (bytewords.LANES, 5):
        monkeypatch.setattr(bytewords, "LANES", lanes)
        h = bytewords.word_hashes(raw, start, end)
        assert h.tolist() == [plain_hash(w) for w in words]
        assert bytewords.word_hashes(raw, start, end, fold=True).tolist() == [plain_hash(bytes(c + 32 if 65 <= c < 91 else c for c in w)) for w in words]
        a, b = np.array([0, 1, 1, 5, 44]), np.array([3, 1, 30, 6, 45])
        assert bytewords.sequence_hashes(h, a, b).tolist() == [plain_sum(h[x:y].tolist(), y - x) for x, y in zip(a, b)]
        assert bytewords.sequence_hashes(h, a, a + 1).tolist() == [plain_sum([int(h[x])], 1) for x in a]
    assert len(bytewords.word_hashes(raw[:0], start[:0], end[:0])) == 0


def thue_morse(a, b, n=10):
    """Words of 2 ** n letters that sums of powers modulo 2 ** 64 can't tell apart, whatever the base."""
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_hashes_without_structure(spark):
    """Words, and runs of words, of such a form stay apart."""
    a, b = thue_morse("a", "b")
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b} x y z"), (4, f"{b} {a} x y z")], "doc_id long, text string")
    assert [r["component_id"] for r in ngram_join.joined(docs).orderBy("doc_id").collect()] == [1, 2, 3, 4]
    x, y = thue_morse(["u"], ["v"])
    h = [bytewords.sequence_hashes(bytewords.word_hashes(*ngram_words(w)), np.array([0]), np.array([len(w)]))[0] for w in (x, y)]
    assert h[0] != h[1]


def ngram_words(words):
    raw, edge = bytewords.bytes_of(pa.array([" ".join(words)]))
    return (raw, *bytewords.words_of(raw, edge)[:2])


def plain_units(text):
    """(words, characters) of each unit, word by word from the definition."""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    words = [m.group() for m in found]
    ends = {i for i, m in enumerate(found) if i + 1 == len(found) or m.group()[-1] in ".!?" or "\n" in text[m.end() : found[i + 1].start()]}
    h, sentence, begin = [plain_hash(w.encode()) for w in words], {}, 0
    for e in sorted(ends):
        sentence.update(dict.fromkeys(range(begin, e + 1), e + 1 - begin))
        begin = e + 1
    for i in range(len(words) - 8):
        k = min(range(i, i + 9), key=lambda j: (h[j], j))
        if sentence[k] > 10:
            ends.add(k)
    out, begin, at = [], 0, 0
    for e in sorted(ends):
        to = len(text) if e + 1 == len(words) else found[e].end()
        out.append((words[begin : e + 1], text[at:to]))
        begin, at = e + 1, to
    return out


def plain_runs(units, run=2, least=16):
    for i in range(len(units)):
        for j in range(i + run, len(units) + 1):
            if sum(len(w) for w, _ in units[i:j]) >= least:
                yield i, j, tuple(x for w, _ in units[i:j] for x in w)
                break
    for i in range(len(units) - run, -1, -1):  # the last run ends with the text
        if sum(len(w) for w, _ in units[i:]) >= least:
            yield i, len(units), tuple(x for w, _ in units[i:] for x in w)
            break


def plain_spans(docs):
    """Texts without what repeats; docs: (doc_id, text) of different ids or equal rows."""
    cut, first, gone = [plain_units(t or "") for _, t in docs], {}, [set() for _ in docs]
    for i in sorted(range(len(docs)), key=lambda i: docs[i][0]):
        for a, b, key in plain_runs(cut[i]):
            if first.setdefault(key, (docs[i], a, b)) != (docs[i], a, b):
                gone[i] |= set(range(a, b))
    return ["".join(s for j, (_, s) in enumerate(c) if j not in g) if g else t or "" for (_, t), c, g in zip(docs, cut, gone, strict=True)]


def test_sentence_spans(spark, monkeypatch):
    r = random.Random(5)
    sentence = lambda: " ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(r.randrange(2, 12))).capitalize() + r.choice(".!?")
    shared = [sentence() for _ in range(10)]
    texts = []
    for _ in range(60):
        s = [sentence() for _ in range(r.randrange(0, 8))]
        a = r.randrange(len(shared))
        s[len(s) // 2 : len(s) // 2] = shared[a : a + r.randrange(0, 6)]
        texts.append(r.choice([" ", "\n"]).join(s))
    texts += ["", None, " \n\t ", "a b. c\u00a0d " * 9, "One. " * 30, "\t".join(f"w{i % 90}" for i in range(260)), "  ".join(f"w{i % 90}" for i in range(5, 200)), ("w, " * 40 + "end. ") * 2, " ".join(f"w{i}" for i in range(300)), "x " + " ".join(f"w{i}" for i in range(300)), texts[0]]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, n_removed string")
    got = {x["doc_id"]: x for x in spans.without_repeats(df).collect()}
    want = plain_spans(docs)
    assert sum(len(w) < len(t or "") for w, t in zip(want, texts, strict=True)) > 20
    monkeypatch.setattr(spans, "HOT", 3)  # most runs are hot
    assert {x["doc_id"]: x["text"] for x in spans.without_repeats(df).collect()} == {i: x["text"] for i, x in got.items()}
    for i, t in docs:
        assert (got[i]["text"] or "") == want[i] and (got[i]["text"] is None) == (t is None), i
    assert got[len(texts) - 1]["text"] == ""  # a whole copy has nothing left
    assert all("".join(spans.sentences(t or "")) == (t or "") or not (t or "").split() for t in texts)
    assert [spans.sentences(t or "") for t in texts] == [[x for _, x in plain_units(t or "")] for t in texts]
    assert spans.without_repeats(df.limit(0)).isEmpty()


def test_shares():
    assert mixing.shares([100, 100, 100], [3, 1, 2], 450, 2) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.shares([10, 0], [1, 1], 100, 2) == [20.0, 0.0]
    assert mixing.shares([], [], 0, 2) == []


def test_flow():
    """Against the best of all ways on small cases: most words first, then least cost."""
    import itertools

    for case in range(30):
        r = random.Random(case)
        supplies = [(m, r.randrange(1, 4)) for m in ((0,), (1,), (0, 1))]
        quotas = [r.randrange(0, 6), r.randrange(0, 6)]
        got = mixing.flow(supplies, quotas, 2)
        cost = lambda ws: sum(max(0, w - z) for w, (_, z) in zip(ws, supplies, strict=True))
        best = min(
            (-(a + b + c + d), cost((a, b, c + d)))
            for a, b, c, d in itertools.product(*[range(2 * z + 1) for _, z in supplies], range(2 * supplies[2][1] + 1))
            if a + c <= quotas[0] and b + d <= quotas[1] and c + d <= 2 * supplies[2][1]
        )
        totals = [sum(x.values()) for x in got]
        assert (-sum(totals), cost(totals)) == best
        assert all(sum(x.get(s, 0) for x in got) <= q for s, q in enumerate(quotas))


def test_mixing(spark):
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.randrange(0, 60)), r.choice(["b", "a", "a", "a", "é", None])) for i in range(2000)] + [(5000, None, "a"), (5001, "w w", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    order = sorted({s for s in source.values()}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in size if source[i] == s) for s in order}
    want = dict(zip(order, mixing.shares([total[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(total.values()), 2), strict=True))
    taken = dict.fromkeys(order, 0)
    for x in got:
        s = source[x["doc_id"]]
        assert x["size"] == size[x["doc_id"]] and x["source_size"] == total[s] and x["target"] == pytest.approx(want[s]) and x["taken"] <= 2 * x["size"]
        taken[s] += x["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 30 + 1
    again = {x["doc_id"]: x["taken"] for x in mixing.mixed(docs.repartition(7)).collect()}
    assert again == {x["doc_id"]: x["taken"] for x in got}
    assert mixing.mixed(docs.limit(0)).isEmpty()


def test_overlapping_sources(spark):
    rows = [(i, ["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else []) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, s array<string>")
    got = mixing.mix(docs, F.col("s"), F.lit(10), mixing.by_turns(1, 1), share=1.0).collect()
    assert sum(x["taken"] for x in got) == pytest.approx(3000, abs=20)
    assert all(x["taken"] == 0 for x in got if not x["s"])


def test_quotas_of_overlapping_sources(spark):
    """Every source of three that overlap is given its target, but for what one document at each end of a share can miss."""
    r = random.Random(15)
    rows = [(i, r.choice(["a", "b", None]), r.choice(["en", "de"]), " ".join(["w"] * r.randrange(1, 40))) for i in range(3000)]
    docs = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "doc_id long, source string, lang string, text string, pattern string, lot string")
    mixed = mixing.overlapping(docs)
    found = {x["source"]: x for x in mixing.quotas(mixed).collect()}
    size = {i: len(t.split()) for i, _, _, t in rows}
    sources = sorted({x for _, s, g, _ in rows for x in ([f"source={s}"] if s else []) + [f"lang={g}"]})
    total = {x: sum(size[i] for i, s, g, _ in rows if x in (f"source={s}", f"lang={g}")) for x in sources}
    want = mixing.shares([total[x] for x in sources], [(3, 1, 2)[k % 3] for k in range(len(sources))], 1.5 * sum(size.values()), 2)
    for x, w in zip(sources, want, strict=True):
        assert found[x]["target"] == pytest.approx(w) and abs(found[x]["given"] - w) < 6 * 40, (x, w, found[x])
    member = {i: {f"source={s}", f"lang={g}"} for i, s, g, _ in rows}
    for x in mixed.collect():
        assert len(x["dealt"]) == x["copies"] <= 2 and {d["source"] for d in x["dealt"]} <= member[x["doc_id"]]
    assert mixed.columns == ["doc_id", "source", "lang", "n", "size", "source_size", "target", "copies", "taken", "dealt"]
    kept = mixing.mix(docs, F.array("source"), F.lit(1), mixing.by_turns(1))
    assert {"pattern", "lot"} <= set(kept.columns) and kept.where("pattern <> 'clash' or lot <> 'clash'").isEmpty()


def test_quality(spark):
    path = f"{DIR}/documents.parquet"
    docs, labels = spark.read.parquet(path), spark.read.parquet(f"{DIR}/labels.parquet")
    got = quality.scored(docs).join(labels, "doc_id").select("quality", (F.col("score") >= 0.5).cast("int").alias("k")).collect()
    right = sum(r["quality"] == r["k"] for r in got) / len(got)
    assert right > 0.95
    good = [r["k"] for r in got if r["quality"] == 1]
    assert sum(good) / len(good) > 0.97
    odd = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "a", "c"), (3, "a", "c")], "doc_id long, text string, score string")
    rows = quality.scored(odd).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(odd.limit(0)).isEmpty()


def test_quality_details(spark):
    """Long and short repetition count alike; rows that repeat weigh once in training; clashing names stay apart."""
    for n in (120, 1499, 1500, 40_000):
        assert quality.votes("spam ham " * n)[5] == quality.BAD
    assert quality.votes(" ".join(f"w{i}" for i in range(60_000)))[5] == quality.GOOD
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").withColumn("__votes", F.lit("mine"))
    many = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(3000)).select("doc_id", "text", "__votes"))
    a = {r["doc_id"]: r["score"] >= 0.5 for r in quality.scored(docs).collect()}
    got = quality.scored(many, train_rows=10_000)
    assert got.where("__votes <> 'mine'").isEmpty() and got.where("doc_id = 3").select("score").distinct().count() == 1
    b = {r["doc_id"]: r["score"] >= 0.5 for r in got.collect()}
    assert sum(a[k] == b[k] for k in a) > 0.95 * len(a)


def test_plain_scorer(spark):
    """Scores against a plain version: votes, counted trigrams, weights of the same training."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    counts: dict = {}
    for t in texts.values():
        counts[quality.votes(t)] = counts.get(quality.votes(t), 0) + 1
    posterior = quality.expectation(counts)[0]
    rows = quality.sample_features(docs).collect()
    w = quality.train(sorted(rows, key=lambda r: (r["v"], bytes(r["at"]), bytes(r["n"]))), posterior)
    got = {r["doc_id"]: r for r in quality.scored(docs).collect()}
    for i, t in texts.items():
        raw, v = t.encode(), quality.votes(t)
        places = [((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435761 % 2**32) >> 17 for k in range(len(raw) - 2)]
        z = sum(w[p] for p in places) / max(1, len(places)) * quality.SCALE + w[-1] + sum(0.5 * w[quality.DIMS + 3 * k + "01-".index(c)] for k, c in enumerate(v))
        assert got[i]["posterior"] == pytest.approx(posterior[v]) and got[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-3), i


def test_sample_of_long_texts(spark):
    """The sample of training texts is bounded in features too: the first by hash stay, one at least; a null text has none, equal rows count once."""
    rows = [(i, "ab cd " * (50 + i)) for i in range(40)] + [(7, "ab cd " * 57)] * 3 + [(100, None), (None, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = {r["h"]: r["text"] for r in df.select("text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    for most in (0, 1000, 5000, 60_000, 10**6):
        want, left = [], most
        for _, t in sorted(order.items()):
            left -= min(quality.DIMS, len(t or ""))
            if left < 0 and want:
                break
            want.append(t or "")
        assert sorted(r["text"] or "" for r in quality.drawn(df, 1.0, most).collect()) == sorted(want), most
    assert quality.drawn(df.limit(0), 1.0, 10).isEmpty()


def test_expectation():
    """Labels drawn from known accuracies: posteriors find the classes again."""
    r = random.Random(8)
    rates = [(0.6, 0.001), (0.5, 0.002), (0.4, 0.001), (0.5, 0.001)]
    counts, truth = {}, {}
    for _ in range(20_000):
        good = r.random() < 0.85
        v = "".join("0" if r.random() < (b if good else a) else "-" for a, b in rates)
        v += "".join("0" if r.random() < (0.02 if good else 0.4) else "1" for _ in range(4)) + "-"
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(good)
    post, table, prior = quality.expectation(counts)
    right = sum((post[v] >= 0.5) == g for v, gs in truth.items() for g in gs) / 20_000
    assert right > 0.9 and 0.6 < prior < 0.95, (right, prior)
    assert min(quality.accuracies(table, prior)[:4]) > 0.9
    assert quality.expectation({})[0] == {}


def test_fingerprints(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(r.choice([0, 3, 5, 40, 900]))) for _ in range(60)] + ["", None, "é" * 10, "one"]
    docs = [(3 * i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, sketch int").repartition(5)
    got = {x["doc_id"]: x for x in fingerprint.fingerprints(df, parts=7).collect()}
    assert len(got) == len(docs)
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(docs):
        t, nxt = t or "", docs[k - 1][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        x = got[i]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert abs(x["near_edited"] - like(sets(t), sets(edited))) < 0.15 and abs(x["near_next"] - like(sets(t), sets(nxt))) < 0.15
        assert abs(x["distinct_shingles"] - len(sets(t))) <= 0.25 * len(sets(t))
    one = fingerprint.fingerprints(df.where("doc_id = 1"), parts=7).first()
    assert one["near_next"] == 1.0
    assert fingerprint.fingerprints(df.limit(0)).isEmpty()


def test_fingerprints_of_one_id(spark):
    """An id that a third of all rows have, most of them equal, beside null ids: each row's next one is that of the whole order; no range holds the id's rows."""
    hot = [(50, f"same {i % 7} text of the id number fifty") for i in range(2100)] + [(50, "a rare text of that id, once only")]
    rows = [(i, f"text {i} of some words that follow") for i in range(4000) if i != 50] + hot + [(None, "null one"), (None, "null two"), (50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = fingerprint.in_ranges(df.fillna("", "text"), "doc_id", "text", 64)
    assert max(r["count"] for r in dealt.groupBy("__part").count().collect()) < 300
    got = fingerprint.fingerprints(df, parts=64)
    h = {r["text"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), h[x[1]]))
    edited = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    want = sorted((str(i), len(t), edited(t, order[(k + 1) % len(order)][1])) for k, (i, t) in enumerate(order))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got.select("doc_id", "n_chars", "edited_sha256").collect()) == want


def test_below(spark):
    cuts = sorted({(i * 7919) % 5003 for i in range(300)} | {-(2**63), 2**63 - 1})
    df = spark.range(-5, 5100, 3).select("id", fingerprint.below(cuts, F.col("id")).alias("n"))
    assert all(r["n"] == sum(c < r["id"] for c in cuts) for r in df.collect())


def test_merged_sketches(spark):
    """Sketches of parts merge to the sketch of the whole, for a hot key too."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(9).alias("k"), F.concat_ws(" ", *[F.col("id") + j for j in range(7)]).alias("t"))
    parts = fingerprint.with_sketch(df, "t", "s", k=16)
    got = {r["k"]: r["s"] for r in fingerprint.merged(parts, "k", "s", k=16, fan=4).collect()}
    every = {}
    for r in fingerprint.with_sketch(df, "t", "s", k=10**6).collect():
        every.setdefault(r["k"], set()).update(r["s"])
    assert got == {k: sorted(v)[:16] for k, v in every.items()}


def test_equal_sketches_merge_as_one(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), F.array(F.lit(5).cast("long"), F.lit(9).cast("long")).alias("s"))
    more = df.union(spark.createDataFrame([("k", [1, 9]), (None, None)], "k string, s array<long>"))
    assert {r["k"]: r["s"] for r in fingerprint.merged(more, "k", "s", k=3, fan=4).collect()} == {"k": [1, 5, 9], None: []}


@pytest.fixture(scope="module")
def counter():
    tokenizers = pytest.importorskip("public_tokenizers")
    return token_counts.Counter(open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read(), tokenizers.PATTERN)


def test_edited_counts(counter):
    r = random.Random(10)
    bits = ["a", "b", " ", "  ", "\n", "'s", "1", "é", "漢", "!?", "word", "\t", "'", "r", "e"]
    for _ in range(700):
        d = token_counts.Document(counter, "".join(r.choice(bits) for _ in range(r.choice([0, 5, 60, 900]))))
        for _ in range(5):
            a = r.randrange(len(d.text) + 2)
            d.edit(a, a + r.choice([0, 0, 1, 3, 80]), "".join(r.choice(bits) for _ in range(r.choice([0, 1, 3, 2000 if r.random() < 0.02 else 4]))))
            assert d.n_tokens == len(counter.coder.encode_ordinary(d.text)) and d.chars[1] == len(d.text)


def test_counts_stay_local(counter):
    d = token_counts.Document(counter, "some words " * 5000)
    d.edit(20_000, 20_003, "xyz")
    assert d.encoded < 100


def test_counts_table(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "hello world, once more"), (2, None), (2, None), (3, "")], "doc_id long, text string")
    rows = token_counts.counted(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).collect()
    assert len(rows) == 4 and {r["n_tokens"] for r in rows if r["doc_id"] == 2} == {0}
    assert token_counts.counted(docs.limit(0), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).isEmpty()


def plain_cut(texts, width):
    raw, seen = [(t or "").encode() for t in texts], {}
    for x in raw:
        for i in range(len(x) - width + 1):
            seen[x[i : i + width]] = seen.get(x[i : i + width], 0) + 1
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if seen[x[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(x), runs, bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [50_000, 3])
def test_suffix_dedup(spark, hot):
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("abé\u0000 ") for _ in range(n))
    shared = [noise(400) for _ in range(4)]
    texts = []
    for _ in range(40):
        s = r.choice(shared)
        a = r.randrange(200)
        texts.append(noise(r.randrange(0, 300)) + s[a : a + r.randrange(50, 400)] + noise(r.randrange(0, 200)))
    texts += [texts[0], "", None, "z" * 900, "ab" * 400, shared[0] * 2, texts[1][:250]]
    want = plain_cut(texts, 200)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {x["doc_id"]: x for x in suffix_dedup.cut_out(df, hot=hot, part_segments=50).collect()}
    for i, (n, runs, kept) in enumerate(want):
        assert (got[i]["n_bytes"], [tuple(s) for s in got[i]["spans"]], bytes(got[i]["kept"])) == (n, runs, kept), i
    assert suffix_dedup.cut_out(df.limit(0)).isEmpty()


def test_run_index():
    r = random.Random(12)
    for _ in range(60):
        segs = list({bytes(r.choice(b"ab\0") for _ in range(r.randrange(1, 120))) for _ in range(r.randrange(1, 8))})
        index = suffix_dedup.RunIndex(segs)
        m = index.matches()
        every = [(i, j) for i, s in enumerate(segs) for j in range(len(s))]
        for i, j in every:
            best = 0
            for a, b in every:
                if (a, b) != (i, j):
                    n = 0
                    while j + n < len(segs[i]) and b + n < len(segs[a]) and segs[i][j + n] == segs[a][b + n]:
                        n += 1
                    best = max(best, n)
            assert m[index.starts[i] + j] == best
        assert len(index.heads) <= len(index.text)


def test_sentence_spans_rows(spark):
    """Repeated rows, null ids and columns named as the operator's own; very long texts."""
    t, long = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i * i}" for i in range(60_000))
    rows = [(None, t), (1, t), (1, t), (None, "a " + t), (3, long), (4, "x " + long), (5, None)]
    df = spark.createDataFrame([(i, x, 7, 8, "k") for i, x in rows], "doc_id long, text string, rid int, marked int, __at string").repartition(3)
    got = spans.without_repeats(df)
    assert got.columns == ["doc_id", "text", "rid", "marked", "__at", "n_sentences", "n_removed"] and got.where("rid <> 7 or marked <> 8 or __at <> 'k'").isEmpty()
    found = {(x["doc_id"], len(x["text"] or "")) for x in got.collect()}
    assert got.count() == len(rows) and (1, len(t)) in found and (3, len(long)) in found and (5, 0) in found
    assert max(n for i, n in found if i == 4) < 100 and max(n for i, n in found if i is None) < 40


@pytest.mark.parametrize("marks", [" ,.", " "])
def test_passages_inside_sentences(marks):
    """A passage in the midst of sentences is always found, and of a long one no 50 words in a row are left."""
    r = random.Random(13)
    some = lambda n: "".join("".join(r.choice("abcdefg") for _ in range(r.randrange(1, 7))) + r.choice(r.choice([" ", " ", marks])).strip() + " " for _ in range(n)).split()
    for n in [50] * 300 + [120] * 100:
        p, before = some(n), r.randrange(100)
        a, b = (spans.Units(pa.array([" ".join(some(k) + p + some(60))])) for k in (60, before))
        found = set(a.run_hashes(*a.runs(2, spans.LEAST_WORDS)[:2]).tolist())
        gone = np.zeros(before + n + 60, bool)
        first, to, _ = b.runs(2, spans.LEAST_WORDS)
        for i, j, k in zip(first, to, b.run_hashes(first, to).tolist(), strict=True):
            if k in found:
                gone[b.words[i] : b.words[j]] = True
        inside = "".join("x" if x else "-" for x in gone[before : before + n])
        assert "x" in inside and max(map(len, inside.split("x"))) < 50


def test_units_are_short():
    for gap in " \t":
        assert max(len(s.split()) for s in spans.sentences(gap.join(f"w{i}" for i in range(500)))) <= spans.LONG
