"""Exact merge-type (BPE) encoding with a SentencePiece model by backtracking, and its decoding.

The encoder walks a text with the longest vocabulary piece at each place (Aho-Corasick) and keeps
a piece only if it is compatible with the one before it: merging the two together again must give the
same two pieces. Where it isn't, the next shorter piece is tried, or a piece is taken back; a bit field
marks places that can't be the end of a piece, so no place is tried twice.

Texts are cut where no piece can reach across: before a blank that follows anything else, and
around characters outside the vocabulary, which become bytes. Parts recur, so their ids are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

BLANK = "▁"
KEPT = 400_000


class Kept(dict):
    """What ``make`` gives for short strings, kept while they recur: at most twice ``most`` of them."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, part):
        got = self.old.get(part)
        if got is None:
            got = self.make(part)
        if len(part) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = got
        return got


def varints(data: bytes):
    """The fields of a protocol buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Tokenizer:
    """A merge-type model file: identity normalization, a blank before the text, byte fallback."""

    def __init__(self, model: bytes, kept: int = KEPT):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        options = {}
        for field, value in varints(model):
            if field == 1:
                part = dict(varints(value))
                self.pieces.append(part[1].decode())
                self.kinds.append(part.get(3, 1))
                scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
            elif field in (2, 3):
                options[field] = dict(varints(value))
        trainer, norm = options.get(2, {}), options.get(3, {})
        if trainer.get(3, 1) != 2 or norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1) or not trainer.get(35):
            raise ValueError("only BPE models with identity normalization, a dummy prefix and byte fallback are supported")
        if any(k in (4, 5) for k in self.kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 1}
        #: What is merged first; pieces of equal score have equal rank.
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.surface = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.four = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        runs = {p for p in self.ids if len(p) > 1 and not p.strip(BLANK)}
        if any(BLANK in p.lstrip(BLANK) or p.startswith(2 * BLANK) and p not in runs for p in self.ids) or min(self.rank[p] for p in runs) <= max(r for p, r in self.rank.items() if len(p) > 1 and p not in runs):
            raise ValueError("texts can't be cut at blanks: a piece has blanks inside, or runs of blanks don't merge last")
        self.longest = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.longest.add_word(p, (len(p), i))
        self.longest.make_automaton()
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        inside = "".join(re.escape(c) for c in sorted(joined - {BLANK, " "}))
        #: Blanks with the run of characters of longer pieces that follows, or one character that never joins another.
        self.part = re.compile(rf"[ {BLANK}]*[{inside}]+|[ {BLANK}]+|.", re.S)
        self.shorter = self.prefixes()
        self.fits: dict[tuple[int, int], bool] = {}
        self.most = kept
        self.kept = Kept(self.encode_part, kept)

    def prefixes(self) -> list[int]:
        """Of each piece the longest other piece that it starts with, or -1."""
        out = [-1] * len(self.pieces)
        for p, i in self.ids.items():
            out[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1)
        return out

    def merge(self, text: str) -> list[int]:
        """Merge a string of known characters: the pair of the best score first, the leftmost of equals."""
        n = len(text)
        at, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (rank := self.rank.get(pair := at[i] + at[after[i]])) is not None:
                heapq.heappush(queue, (rank, i, pair))

        for i in range(n):
            offer(i)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if at[i] and j < n and at[i] + at[j] == pair:
                at[i], at[j] = pair, ""
                after[i] = after[j]
                if after[i] < n:
                    before[after[i]] = i
                offer(i)
                offer(before[i])
        return [self.ids[c] for c in at if c]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two pieces, put together and merged again, stay as they are."""
        got = self.fits.get((a, b))
        if got is None:
            got = self.fits[a, b] = self.merge(self.pieces[a] + self.pieces[b]) == [a, b]
            if len(self.fits) > 4 * self.most:
                self.fits.clear()
        return got

    def backtrack(self, text: str) -> list[int]:
        """The ids of a text all of whose characters are pieces."""
        n = len(text)
        start: list[int] = [-1] * n  # the longest piece at each place
        size = [0] * n
        for end, (length, i) in self.longest.iter(text):
            if length > size[end - length + 1]:
                size[end - length + 1], start[end - length + 1] = length, i
        # iter() gives every match, so shorter ones never hide the longest that starts at a place
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        at, token = 0, start[0] if n else -1
        while at < n:
            while True:
                end = at + len(self.pieces[token])
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = start[at] if at < n else -1
                    break
                token = self.shorter[token]
                if token < 0:
                    failed[at >> 3] |= 1 << (at & 7)
                    if not out:
                        raise ValueError("no encoding found")
                    token = out.pop()
                    at -= len(self.pieces[token])
        return out

    def encode_part(self, part: str) -> bytes:
        """A part's ids as little-endian 32-bit integers."""
        part = part.replace(" ", BLANK)
        if len(part) == 1:
            ids = [self.ids[part]] if part in self.ids else [self.bytes[b] for b in part.encode("utf-8", "replace")]
        else:
            word = part.lstrip(BLANK)
            blanks = len(part) - len(word)
            if blanks < 2:
                ids = self.backtrack(part)
            else:  # runs of blanks have one score, below all others: what is left of them merges last
                ids = self.backtrack(BLANK + word) if word else []
                blanks -= bool(ids)
                if ids and ids[0] == self.ids[BLANK]:
                    ids, blanks = ids[1:], blanks + 1
                ids = self.merge(BLANK * blanks) + ids
        return b"".join(map(self.four.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        """All ids with begin and end, as little-endian 32-bit integers. An empty text has just those two."""
        if not text:
            return self.four[self.bos] + self.four[self.eos]
        return b"".join([self.four[self.bos], *map(self.kept.__getitem__, self.part.findall(" " + text)), self.four[self.eos]])

    def decode(self, ids) -> str:
        """The text of ids: control pieces vanish, bytes join to characters, the blank put before the text goes."""
        raw = b"".join(map(self.surface.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


_models: dict[str, Tokenizer] = {}


def tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and decoded text of each row. Null text counts as empty; repeated rows stay; other columns are left out.

    The model is read on the driver (half a megabyte) and sent to the tasks, which keep it by its hash.
    """
    return docs.select(F.col(key).cast("long"), text).mapInArrow(_run(path, False), f"{key} long, ids binary, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and round_trip (whether the text comes back) of each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_run(path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def _run(path: str, digest: bool):
    with open(path, "rb") as f:
        model = f.read()
    name = hashlib.sha256(model).hexdigest()

    def run(batches):
        t = _models.get(name) or _models.setdefault(name, Tokenizer(model))
        for part in pieces(batches):
            texts = [x or "" for x in part.column(1).to_pylist()]
            ids = [t.encode(x) for x in texts]
            back = [t.decode(memoryview(x).cast("I")) for x in ids]
            if digest:
                sha = lambda x: hashlib.sha256(x).hexdigest()
                cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(x.encode("utf-8")) for x in back], pa.string()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            else:
                cols, names = [pa.array(ids, pa.binary()), pa.array(back, pa.string())], ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], [part.schema.names[0], *names])

    return run
