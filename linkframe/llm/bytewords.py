"""Words of a batch of texts as arrays: where they lie in the bytes, and a hash of each; no Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Sum-of-powers hash of short byte ranges: its base and that base's inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPAN = 1 << 20
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


#: Bytes with A-Z as a-z, and which of eight bytes (little end first) belong to a lane of so many.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: What is added to a lane or word by its place, and to a sum by its length.
PLACE, LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LANES = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least ``n`` of them."""
    if len(POWERS.get(base, ())) < n:
        POWERS[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, SPAN), base, np.uint64)], dtype=np.uint64)
    return POWERS[base]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (and the last ends). Null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None and edge[-1] > edge[0] else np.zeros(0, np.uint8)
    return raw, edge - edge[0]


def words_of(raw: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (runs of no ASCII white space, within a text), and the number of each text's first word."""
    word = ~BLANK[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[edge] = True
    start = np.flatnonzero(word & (first[:-1] | ~np.r_[False, word[:-1]]))
    end = np.flatnonzero(word & (first[1:] | ~np.r_[word[1:], False])) + 1
    return start, end, np.searchsorted(start, edge)


def range_hashes(get, size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each range, by sorted starts, of the values that ``get(from, to)`` gives of ``size`` ones: their sum times powers of their
    places. Differences of running sums, in spans of bounded size. For ranges of a few hundred values: powers of any base modulo
    2 ** 64 make some texts of 1,024 bytes equal."""
    out = np.empty(len(start), np.uint64)
    cuts = np.unique(np.searchsorted(start, np.r_[np.arange(0, size, SPAN), size]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = int(start[a]), int(end[a:b].max())
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(get(lo, hi) * powers(BASE, hi - lo)[: hi - lo], out=sums[1:])
        x, y = start[a:b] - lo, end[a:b] - lo
        out[a:b] = (sums[y] - sums[x]) * powers(INVERSE, hi - lo)[x] + (y - x).astype(np.uint64)
    return mix64(out)


def _sums(count: np.ndarray, terms) -> np.ndarray:
    """For each row the sum of as many terms as ``count`` says; ``terms(row, i)`` gives those of these rows and numbers. In parts of bounded size."""
    out = np.zeros(len(count), np.uint64)
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LANES, side="right")))
        n = count[a:b]
        if b == a + 1 and n[0] > LANES:  # one long row
            for i in range(0, int(n[0]), LANES):
                k = np.arange(i, min(i + LANES, int(n[0])))
                out[a : a + 1] += terms(np.full(len(k), a), k).sum(dtype=np.uint64)
        else:
            row = np.repeat(np.arange(a, b), n)
            first = np.cumsum(n) - n
            some = n > 0
            if some.any():
                out[a:b][some] = np.add.reduceat(terms(row, np.arange(len(row)) - np.repeat(first, n)), first[some], dtype=np.uint64)
        a = b
    return out


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash of each word, or other range of bytes: eight bytes at a time are mixed with their place, so that no two lanes are alike to it, and summed up.
    ``fold``: A-Z count as a-z."""
    raw = LOWERED[raw] if fold else raw
    eights = np.ndarray(len(raw), "<u8", np.r_[raw, np.zeros(8, np.uint8)], strides=(1,)) if len(raw) else np.zeros(0, np.uint64)
    size = end - start

    def lanes(at: np.ndarray, left: np.ndarray, i) -> np.ndarray:
        return mix64((eights[at] & LANE[np.minimum(left, 8)]) + (np.asarray(i, np.uint64) + np.uint64(1)) * PLACE)

    out = np.zeros(len(start), np.uint64)
    some = np.flatnonzero(size > 0)
    for a in range(0, len(some), LANES):
        k = some[a : a + LANES]
        out[k] = lanes(start[k], size[k], 0)
    long = np.flatnonzero(size > 8)
    out[long] += _sums((size[long] - 1) // 8, lambda row, i: lanes(start[long[row]] + 8 * (i + 1), size[long[row]] - 8 * (i + 1), i + 1))
    return mix64(out + size.astype(np.uint64) * LENGTH)


def sequence_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of words, given their hashes: each mixed with its place in the run, and summed up."""
    size = end - start
    if len(size) and (size == size[0]).all() and size[0] < 16:
        out = np.zeros(len(start), np.uint64)
        for i, place in enumerate(np.arange(1, size[0] + 1).astype(np.uint64) * PLACE):
            out += mix64(words[start + i] + place)
    else:
        out = _sums(size, lambda row, i: mix64(words[start[row] + i] + (i.astype(np.uint64) + np.uint64(1)) * PLACE))
    return mix64(out + size.astype(np.uint64) * LENGTH)
