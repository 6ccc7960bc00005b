"""FLAC, WARC and SentencePiece: exact round trips, independent readers, broken input."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard

from linkframe.llm import flac, sentencepiece_bpe, warc

TOKENIZERS = pytest.importorskip("public_tokenizers")


def slow_flac(stream):
    """A plain decoder, bit by bit: fixed and linear prediction, one Rice partition or several."""
    info, _, at = flac.layout(stream)
    bits = "".join(f"{b:08b}" for b in stream[at:])
    pos, out = 0, []

    def take(n):
        nonlocal pos
        pos += n
        return int(bits[pos - n : pos] or "0", 2)

    def signed(n):
        v = take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    while len(out) < info["samples"]:
        assert take(16) == 0xFFF8
        code = take(4)
        take(12)
        first = take(8)
        for _ in range(0 if first < 128 else bin(first)[2:].index("0") - 1):
            take(8)
        n = {2: 576}.get(code) or take(16) + 1
        take(8)
        kind = take(8) >> 1
        if kind == 0:
            x = [signed(8)] * n
        elif kind == 1:
            x = [signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [signed(8) for _ in range(order)]
            coef, shift = flac.FIXED[order] if kind < 32 else (), 0
            if kind >= 32:
                precision = take(4) + 1
                shift = signed(5)
                coef = [signed(precision) for _ in range(order)]
            assert take(2) == 0
            parts = 1 << take(4)
            for p in range(parts):
                k = take(4)
                for _ in range(n // parts - (order if p == 0 else 0)):
                    q = 0
                    while not take(1):
                        q += 1
                    u = q << k | take(k)
                    e = u >> 1 ^ -(u & 1)
                    x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
        out += x
        pos += -pos % 8 + 16
    return bytes((v + 128) & 255 for v in out)


PAYLOADS = [b"", b"a", bytes(575), b"\xff" * 576, bytes(range(256)) * 9, b"the cat sat on the mat " * 200, random.Random(1).randbytes(1700), bytes(128 + int(100 * np.sin(i / 9)) for i in range(3000))]


def joined(blocks):
    return b"".join((x + 128).astype(np.uint8).tobytes() for _, x in blocks)


def test_flac_round_trip():
    streams = flac.encode(PAYLOADS)
    assert [joined(b) for b in flac.decode(streams)] == PAYLOADS
    assert [slow_flac(s) for s in streams] == PAYLOADS
    assert len(streams[5]) < 0.8 * len(PAYLOADS[5]) or len(streams[7]) < 0.6 * len(PAYLOADS[7])


def test_flac_without_seek_points():
    """Streams whose seek table was taken out are read frame after frame."""
    bare = []
    for s in flac.encode(PAYLOADS):
        _, _, at = flac.layout(s)
        info = bytearray(s[4:42])
        info[0] |= 0x80
        bare.append(b"fLaC" + bytes(info) + s[at:])
    assert [joined(b) for b in flac.decode(bare)] == PAYLOADS


def test_flac_long_stream(monkeypatch):
    """Where a point per frame would not fit in the seek table, there are fewer, and the stream still reads."""
    monkeypatch.setattr(flac, "MOST", 40)
    s = flac.encode([PAYLOADS[5]])[0]
    assert len(flac.layout(s)[1]) == 2 and joined(flac.decode([s])[0]) == PAYLOADS[5]


def test_bytes_as_samples():
    every = np.arange(256, dtype=np.uint8)
    assert (flac.FROM_STORED[flac.TO_STORED[every]] == every).all() and len(set(flac.TO_STORED.tolist())) == 256
    assert flac.TO_STORED[32] == 128 and flac.TO_STORED[255] in (127, 129)


def test_flac_seek():
    s = flac.encode([PAYLOADS[5]])
    blocks = flac.decode(s, first=[2000])[0]
    assert [o for o, _ in blocks] == list(range(1728, len(PAYLOADS[5]), 576))
    assert joined(blocks) == PAYLOADS[5][1728:]


@pytest.mark.parametrize("at", [5, 60, 200, -1])
def test_flac_damage(at):
    s = bytearray(flac.encode([PAYLOADS[6]])[0])
    _, points, head = flac.layout(bytes(s))
    s[head + at if at > 0 else -1] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(s)])
    with pytest.raises(ValueError):
        flac.layout(b"OggS" + bytes(40))


def test_flac_query(spark):
    texts = ["héllo", "", None, "x" * 3000, "héllo"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r["doc_id"]: r for r in flac.digests(flac.with_media(docs)).collect()}
    for i, t in enumerate(texts):
        raw, n = flac.padded(t)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:])) and len(raw) % 576 == 0 and raw
    assert rows[0].asDict() | {"doc_id": 4} == rows[4].asDict()
    blocks = flac.pcm_blocks(flac.with_media(docs)).where("doc_id = 3").orderBy("sample_offset").collect()
    assert [r["sample_offset"] for r in blocks] == [576 * i for i in range(6)] and all(r["n_samples"] == 576 for r in blocks)
    assert flac.digests(flac.with_media(docs.limit(0))).isEmpty()


def test_warc(spark):
    big, small = "<p>" + "x" * 2000, "<p>small"
    pages = spark.createDataFrame([(1, "u\r\n1", big, 0), (2, None, small, 0), (5, "u5", big, 0), (3, "u3", big + "é", 0), (4, "u4", None, 0), (6, "u6", small, 0)], "page_id long, url string, html string, digest int")
    table = warc.archives(warc.deduplicated(pages), size=2500)
    assert table.count() >= 1
    rows = {r["page_id"]: r for r in warc.page_records(warc.records(table)).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in rows.items()} == {1: ("revisit", 5), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert rows[1]["payload_bytes"] == 2003 and rows[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    # an independent reader: the dictionary from the skippable frame, then frame by frame
    for a in table.collect():
        data = a["content"]
        size = struct.unpack_from("<I", data, 4)[0]
        words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        whole = zstandard.ZstdDecompressor(dict_data=words).stream_reader(data[8 + size :], read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == len(list(warc.read(data)))
    assert warc.records(warc.archives(warc.deduplicated(pages.limit(0)))).isEmpty()


def test_warc_repeated_rows(spark):
    big = "<p>" + "x" * 2000
    pages = spark.createDataFrame([(1, "u", big), (1, "u", big), (9, "u", big), (9, "v", big), (None, None, big)], "page_id long, url string, html string")
    rows = warc.page_records(warc.records(warc.archives(warc.deduplicated(pages)))).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows) == [("1", "revisit", 9), ("1", "revisit", 9), ("9", "response", None), ("9", "response", None), ("None", "revisit", 9)]


def test_warc_damage():
    good = warc.record("response", "u", "urn:page:1", b"abc", hashlib.sha1(b"abc").hexdigest(), 3, None)
    assert warc.parse(good)[1] == b"abc"
    for bad in (good.replace(b"Content-Length: 3", b"Content-Length: 4"), good.replace(b"WARC-Date", b"Other"), good[5:], good.replace(b"Content-Type:", b"Content-Type")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    data = warc.archive([good, good])
    assert len(list(warc.read(data))) == 2
    for cut in (data[:-3], data + b"junkjunk", data + b"j", data + b"jun"):
        with pytest.raises(ValueError):
            list(warc.read(cut))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.read(data[:9]))


def test_sentencepiece_exact(spark):
    library = pytest.importorskip("sentencepiece")
    path = TOKENIZERS.path("piece_bpe_32k.model")
    theirs = library.SentencePieceProcessor(model_file=path)
    ours = sentencepiece_bpe.Tokenizer(open(path, "rb").read(), kept=50)
    r = random.Random(3)
    alphabet = ["a", "e", "th", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "漢", "字", "😀", "\u0000", "<s>", "0", "12", "‍", "Ａ", "ﬁ"]
    texts = ["", " ", " " * 40, "a" * 500, "▁▁", "héllo wörld", *["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(1500)]]
    for t in texts:
        ids = theirs.encode(t, add_bos=True, add_eos=True)
        got = list(memoryview(ours.encode(t)).cast("I"))
        assert got == ids, t
        assert ours.decode(got) == theirs.decode(ids), t
    docs = spark.createDataFrame([(1, None), (2, "a b"), (2, "a b")], "doc_id long, text string")
    rows = sorted(map(tuple, sentencepiece_bpe.digests(docs, path).collect()))
    assert rows[0][:2] == (1, 2) and rows[1] == rows[2] and all(x[4] for x in rows)
    assert sentencepiece_bpe.tokens(docs.limit(0), path).isEmpty()


def test_blank_runs_merge_in_time():
    path = TOKENIZERS.path("piece_bpe_32k.model")
    ours = sentencepiece_bpe.Tokenizer(open(path, "rb").read())
    assert len(ours.encode(" " * 200_000)) < 4 * 200_000
