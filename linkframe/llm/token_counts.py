"""Edit-aware token counts.

A document's pre-tokens lie in chunks, and a segment tree over the chunks sums their characters and
tokens. An edit finds its place through the sums, cuts and counts anew only the pre-tokens that it touches and
those whose matching looked at what changed, until the new cuts meet an old one, and then updates the
sums above the chunks that changed.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces
from .sentencepiece_bpe import Kept

CHUNK = 64
#: A match looks at most this many characters past its end: a run of blanks gives back one and looks at the next.
LOOK = 2


class Counter:
    """Pre-token cuts and token counts of a byte-level BPE vocabulary in tiktoken form."""

    def __init__(self, ranks: bytes, pattern: str, kept: int = 400_000):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.cut = regex.compile(pattern)
        self.count = Kept(lambda p: len(self.coder.encode_ordinary(p)), kept).__getitem__


class Document:
    """A text with its pre-tokens (as (length, tokens)) in chunks under a segment tree."""

    def __init__(self, counter: Counter, text: str):
        self.counter = counter
        self.encoded = 0
        self.build(text, [(len(p), counter.count(p)) for p in counter.cut.findall(text)])

    def build(self, text: str, leaves: list[tuple[int, int]]) -> None:
        self.text = text
        self.chunks = [leaves[i : i + CHUNK] for i in range(0, len(leaves), CHUNK)] or [[]]
        self.width = 1 << (len(self.chunks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, c in enumerate(self.chunks):
            self.set(i, c)
        for i in range(self.width - 1, 0, -1):
            self.sum(i)

    def set(self, i: int, leaves: list[tuple[int, int]]) -> None:
        self.chunks[i] = leaves
        self.chars[self.width + i] = sum(x[0] for x in leaves)
        self.tokens[self.width + i] = sum(x[1] for x in leaves)

    def sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The chunk that holds character ``at`` (the last one with any, if beyond) and where it starts."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace characters start to end. Offsets beyond the text mean its end."""
        start, end = min(start, len(self.text)), min(max(start, end), len(self.text))
        text = self.text[:start] + put + self.text[end:]
        first, begin = self.find(max(0, start - LOOK))
        kept: list[tuple[int, int]] = []
        at = begin
        for size, n in self.chunks[first]:
            if at + size + LOOK > start:
                break
            kept.append((size, n))
            at += size
        # A long pre-token may start in an earlier chunk only if it ends there, before the context; so ``at`` is a cut.
        shift = len(put) - (end - start)
        cuts, chunk, base = [], first, begin  # old cuts from the edit's end on, taken chunk by chunk

        def more() -> bool:
            nonlocal chunk, base
            while chunk < len(self.chunks):
                p = base
                for i, (size, n) in enumerate(self.chunks[chunk]):
                    if p >= end:
                        cuts.append((p, chunk, i))
                    p += size
                base, chunk = p, chunk + 1
                if cuts:
                    return True
            return False

        fresh: list[tuple[int, int]] = []
        pos, tail, last = at, None, len(self.chunks) - 1
        more()
        for m in self.counter.cut.finditer(text, at):
            while cuts and cuts[0][0] + shift < pos:
                cuts.pop(0)
                if not cuts:
                    more()
            if cuts and cuts[0][0] + shift == pos and pos >= start + len(put):
                tail = cuts[0]
                break
            fresh.append((m.end() - m.start(), self.counter.count(m.group())))
            self.encoded += m.end() - m.start()
            pos = m.end()
        leaves = kept + fresh
        if tail:
            last = tail[1]
            leaves += self.chunks[last][tail[2] :]
        self.text = text
        if len(leaves) > 16 * CHUNK:
            every = [x for c in self.chunks[:first] for x in c] + leaves + [x for c in self.chunks[last + 1 :] for x in c]
            return self.build(text, every)
        self.set(first, leaves)
        for i in range(first + 1, last + 1):
            self.set(i, [])
        nodes = {(self.width + i) // 2 for i in range(first, last + 1)}
        while nodes - {0}:
            for i in nodes:
                self.sum(i)
            nodes = {i // 2 for i in nodes if i > 1}


def sample_edits(text: str) -> list[tuple[int, int, str]]:
    """Three edits that follow from the text alone: near its start, middle and end some characters give way to its first ones."""
    n = len(text)
    return [(n * k // 8, n * k // 8 + 5 + k, text[: 4 + 3 * k]) for k in (1, 4, 7)]


_counters: dict[str, Counter] = {}


def counted(docs: DataFrame, path: str, pattern: str, edits=sample_edits) -> DataFrame:
    """Tokens of each text before and after its edits, and how many characters were encoded again for them.

    Null text counts as empty; repeated rows stay; extra columns are left out. The vocabulary is read on the
    driver (under a megabyte) and sent to the tasks.
    """
    with open(path, "rb") as f:
        ranks = f.read()
    name = hashlib.sha256(ranks + pattern.encode()).hexdigest()

    def run(batches):
        counter = _counters.get(name) or _counters.setdefault(name, Counter(ranks, pattern))
        for part in pieces(batches):
            rows = []
            for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                d = Document(counter, text or "")
                before, chars = d.n_tokens, len(d.text)
                for e in edits(d.text):
                    d.edit(*e)
                rows.append((k, chars, before, len(d.text), d.n_tokens, d.encoded, hashlib.sha256(d.text.encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), COUNTS.types, strict=True)], schema=COUNTS)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, n_tokens long, n_chars_edited long, n_tokens_edited long, n_chars_encoded_again long, edited_sha256 string")


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_chars_edited", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_chars_encoded_again", pa.int64()), ("edited_sha256", pa.string())])
