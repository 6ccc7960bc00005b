"""Media columns as FLAC: a mono encoder and decoder working on many frames at once, and tables of PCM blocks.

A frame holds one block of samples. The decoder reads every frame of a batch in step, one sample of
each per turn: Rice residuals, then the linear predictor, then the checksums of header (CRC-8) and
frame (CRC-16). A seek table with a point per frame lets any sample offset be read without what
precedes it; streams whose seek table is missing or sparse are read frame after frame.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Bytes of a seek point, and the most bytes that a metadata block can have. Fixed values of the format.
POINT, MOST = 18, (1 << 24) - 1
BLOCK = 576
LPC_ORDER = 4
PRECISION = 10
#: Coefficients of the fixed predictors, nearest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Codes of the frame header. Fixed values of the format.
SIZE_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {c: 256 << (c - 8) for c in range(8, 16)}
BITS_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def crc_table(bits: int, poly: int) -> np.ndarray:
    t = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        t = np.where(t >> (bits - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << bits) - 1)
    return t


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)
CRC8_LIST = CRC8.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8_LIST[c ^ b]
    return c


def crc16(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many spans of ``data``, in step."""
    c = np.zeros(len(start), np.int64)
    order = np.argsort(-size, kind="stable")
    at, left, live = start[order], size[order], len(order)
    for i in range(int(size.max(initial=0))):
        while live and left[live - 1] <= i:
            live -= 1
        x = c[:live]
        c[:live] = (x << 8 & 0xFFFF) ^ CRC16[x >> 8 ^ data[at[:live] + i]]
    out = np.empty_like(c)
    out[order] = c
    return out


@lru_cache(100_000)
def header(number: int, size: int) -> bytes:
    """A frame header: fixed block size, one channel, 8 bits a sample, 8 kHz."""
    code = next((c for c, n in SIZE_CODES.items() if n == size), 7)
    coded = bytes([number]) if number < 128 else None
    if coded is None:
        n = next(n for n in range(2, 8) if number < 1 << (5 * n + 1))
        tail = [0x80 | number >> 6 * i & 63 for i in range(n - 2, -1, -1)]
        coded = bytes([(0xFF00 >> n & 0xFF) | number >> 6 * (n - 1), *tail])
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + coded + ((size - 1).to_bytes(2, "big") if code == 7 else b"")
    return head + bytes([crc8(head)])


def packed(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings of each row's codes (``sizes`` at most 32 bits each), as bytes, and their lengths in bits."""
    rows, steps = values.shape
    bits = sizes.sum(1, dtype=np.int64)
    values, sizes = np.ascontiguousarray(values.T).astype(np.uint64), np.ascontiguousarray(sizes.T).astype(np.int64)  # a step's codes side by side
    out = np.zeros((rows, int(bits.max(initial=0)) // 32 + 2), np.uint32)
    acc, held, word, lane = np.zeros(rows, np.uint64), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.arange(rows)
    for i in range(steps):
        acc = acc << sizes[i].view(np.uint64) | values[i]
        held += sizes[i]
        full = np.flatnonzero(held >= 32)
        held[full] -= 32
        out[full, word[full]] = (acc[full] >> held[full].view(np.uint64)).astype(np.uint32)
        word[full] += 1
    rest = acc << np.maximum(32 - held, 0).astype(np.uint64)
    out[lane, word] = np.where(held > 0, rest, 0).astype(np.uint32)
    return out.astype(">u4").view(np.uint8).reshape(rows, -1), bits


def fitted(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Linear predictor of each row by the autocorrelation method: integer coefficients and shifts."""
    n = x.shape[1]
    y = (x * np.sin(np.pi * (np.arange(n) + 0.5) / n)).astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", y[:, k:], y[:, : n - k]) for k in range(order + 1)], 1).astype(np.float64)
    a, err = np.zeros((len(x), order)), r[:, 0] + 1e-9
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.frexp(np.abs(a).max(1, initial=0) + 1e-12)[1]
    shift = np.clip(PRECISION - 1 - top, 0, 15)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.round(a * np.exp2(shift)[:, None]), -most - 1, most).astype(np.int32), shift.astype(np.int32)


def residuals(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    p = coef.shape[1]
    guess = np.zeros((len(x), x.shape[1] - p), np.int32)
    for j in range(p):
        guess += coef[:, j : j + 1] * x[:, p - 1 - j : x.shape[1] - 1 - j]
    return x[:, p:] - (guess >> shift[:, None])


def frames(x: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Encode rows of 8-bit samples, each the cheapest of constant, verbatim, fixed or linear prediction."""
    rows, n = x.shape
    x = x.astype(np.int32)
    ways: list[tuple[int, np.ndarray, int, np.ndarray, np.ndarray]] = []  # subframe type, zigzag residual, order, coef, shift
    for p in range(min(3, n)):
        coef = np.tile(np.array(FIXED[p], np.int32), (rows, 1)).reshape(rows, p)
        ways.append((8 + p, residuals(x, coef, np.zeros(rows, np.int32)), p, coef, np.zeros(rows, np.int32)))
    if n > 2 * LPC_ORDER:
        coef, shift = fitted(x, LPC_ORDER)
        ways.append((31 + LPC_ORDER, residuals(x, coef, shift), LPC_ORDER, coef, shift))
    cost = []
    for kind, e, p, _, _ in ways:  # as if the residual were geometric about its mean
        mean = 2 * np.abs(e).sum(1, dtype=np.float64) / max(1, e.shape[1])
        k = np.clip(np.frexp(mean * 0.75 + 1e-9)[1], 0, 14)
        cost.append(e.shape[1] * (mean / np.exp2(k) + k + 0.6) + 8 * p + 10 + (9 + PRECISION * p) * (kind >= 32))
    best, least = np.argmin(cost, 0), np.min(cost, 0)
    plain = least >= 8 * n
    flat = (x == x[:, :1]).all(1)
    out: list[bytes] = [b""] * rows
    for w in range(-2, len(ways)):
        take = np.flatnonzero(flat if w == -2 else plain & ~flat if w == -1 else (best == w) & ~plain & ~flat)
        if not len(take):
            continue
        xs, col = x[take] & 0xFF, lambda v, m=len(take): np.broadcast_to(np.asarray(v, np.int32).reshape(-1, 1), (m, 1))
        if w < 0:
            body = xs[:, :1] if w == -2 else xs
            v, s = np.hstack([col(0 if w == -2 else 2), body]), np.full((len(take), 1 + body.shape[1]), 8, np.int32)
        else:
            kind, e, p, coef, shift = ways[w]
            e = e[take]
            u = e << 1 ^ e >> 31
            k = np.clip(np.frexp(u.mean(1) * 0.75 + 1e-9)[1] if n > p else np.zeros(len(take), np.int32), 0, 14)
            while (over := (u.max(1, initial=0) >> k) + 1 + k > 32).any():
                k = k + over
            q = u >> k[:, None]
            v, s = [col(kind << 1), xs[:, :p]], [col(8), np.full((len(take), p), 8, np.int32)]
            if kind >= 32:
                v += [col((PRECISION - 1) << 5 | shift[take]), coef[take] & ((1 << PRECISION) - 1)]
                s += [col(9), np.full((len(take), p), PRECISION, np.int32)]
            v += [col(k), (1 << k)[:, None] | u & ((1 << k) - 1)[:, None]]
            s += [col(10), q + 1 + k[:, None]]
            v, s = np.hstack(v), np.hstack(s)
        data, bits = packed(v, s)
        heads = [header(int(i), n) for i in numbers[take]]
        ends = (bits + 7) // 8
        whole = [h + data[i, : ends[i]].tobytes() for i, h in enumerate(heads)]
        size = np.array([len(f) for f in whole], np.int64)
        sums = crc16(np.frombuffer(b"".join(whole), np.uint8), np.cumsum(size) - size, size).astype(">u2")
        for i, f, c in zip(take, whole, sums, strict=True):
            out[i] = f + int(c).to_bytes(2, "big")
    return out


def encode(payloads: list[bytes], block: int = BLOCK, at_once: int = 4096) -> list[bytes]:
    """A FLAC stream of each payload's bytes as 8-bit samples (byte minus 128), with a seek point per frame.

    An empty payload gives a stream without frames. The last block may be shorter than ``block``.
    """
    found: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    todo: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        by_size: dict[int, list[tuple[int, int, bytes]]] = {}
        for t in todo:
            by_size.setdefault(len(t[2]), []).append(t)
        for n, same in by_size.items():
            x = np.frombuffer(b"".join(t[2] for t in same), np.uint8).reshape(-1, n).astype(np.int32) - 128
            for (i, j, _), f in zip(same, frames(x, np.array([t[1] for t in same])), strict=True):
                found[i][j] = f
        todo.clear()

    for i, p in enumerate(payloads):
        for j in range(len(found[i])):
            todo.append((i, j, p[j * block : (j + 1) * block]))
            if len(todo) >= at_once:
                flush()
    flush()
    out = []
    for p, fs in zip(payloads, found, strict=True):
        samples = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        sizes = [len(f) for f in fs] or [0]
        info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (8000 << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        points, at = [], 0
        for j, f in enumerate(fs):
            points.append((j * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, len(p) - j * block).to_bytes(2, "big"))
            at += len(f)
        seek = b"".join(points[:: -(-len(points) * POINT // MOST) or 1])  # a very long stream has fewer points than frames
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(fs))
    return out


class Bits:
    """Reads bit fields at a position of its own in each lane of one buffer."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        self.at = at * 8

    def window(self, at: np.ndarray) -> np.ndarray:
        """57 bits at least from each position, at the top of 64."""
        return self.view[np.minimum(at >> 3, len(self.view) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, n, live=True) -> np.ndarray:
        """``n`` bits (a number or one per lane, at most 32) of the live lanes; others get 0."""
        n = np.where(live, n, 0).astype(np.int64)
        got = self.window(self.at) >> np.where(n > 0, 64 - n, 63).astype(np.uint64)
        self.at += n
        return np.where(n > 0, got, 0).astype(np.int64)

    def signed(self, n, live=True) -> np.ndarray:
        v = self.take(n, live)
        return np.where(v >> np.maximum(np.asarray(n) - 1, 0) & 1, v - (np.int64(1) << n), v)

    def unary(self, live) -> np.ndarray:
        """Zeros before the next one, which is read too."""
        total = np.zeros(len(self.at), np.int64)
        live = np.broadcast_to(live, self.at.shape)
        while live.any():
            top = (self.window(self.at) >> np.uint64(11)).astype(np.float64)  # 46 true bits at least
            zeros = np.where(top > 0, 53 - np.frexp(top)[1], 99)
            some = zeros < 46
            total += np.where(live, np.where(some, zeros, 46), 0)
            self.at += np.where(live, np.where(some, zeros + 1, 46), 0)
            live = live & ~some
            if (self.at > 8 * len(self.view) + 64).any():
                raise ValueError("a FLAC frame runs past the end of its stream")
        return total


    def rice(self, k: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Rice codes with parameters ``k``: from one window where each fits in it, else part by part."""
        w = self.window(self.at)
        zeros = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        size = zeros + 1 + k
        if (size[live] > 46).any():
            return self.unary(live) << k | self.take(k, live)
        low = w << (zeros + 1).view(np.uint64) >> np.uint64(1) >> (63 - k).view(np.uint64)
        self.at += size * live
        return zeros << k | low.view(np.int64)


def read_frames(data: np.ndarray, start: np.ndarray, bits_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decode the frames at ``start``, all in step: samples (a row each), block sizes, frame numbers, ends.

    ``data`` needs 16 spare bytes at its end. A wrong sync code or checksum, or a stereo frame, raises ValueError.
    """
    lanes = len(start)
    b = Bits(data, start.astype(np.int64))
    if (b.take(15) != 0x7FFC).any():
        raise ValueError("no FLAC frame where one should start")
    b.take(1)
    size_code, _rate, channel, bits_code, _ = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
    if channel.any():
        raise ValueError("only mono FLAC is supported")
    number = b.take(8)
    more = np.where(number < 0x80, 0, np.where(number < 0xE0, 1, np.where(number < 0xF0, 2, np.where(number < 0xF8, 3, np.where(number < 0xFC, 4, np.where(number < 0xFE, 5, 6))))))
    number = np.where(more > 0, number & ((1 << (6 - more).clip(0)) - 1), number)
    for i in range(int(more.max(initial=0))):
        number = np.where(more > i, number << 6 | b.take(8, more > i) & 63, number)
    size = np.array([SIZE_CODES.get(c, 0) for c in range(16)])[size_code]
    size = np.where(size_code == 6, b.take(8, size_code == 6) + 1, np.where(size_code == 7, b.take(16, size_code == 7) + 1, size))
    b.take(np.select([_rate == 12, (_rate == 13) | (_rate == 14)], [8, 16], 0))
    ends = b.at >> 3
    c = np.zeros(lanes, np.int64)
    for i in range(int((ends - start).max(initial=0))):
        c = np.where(start + i < ends, CRC8[c ^ data[np.minimum(start + i, len(data) - 1)]], c)
    if (b.take(8) != c).any():
        raise ValueError("a FLAC frame header fails its CRC-8")
    depth = np.where(bits_code == 0, bits_of, np.array([BITS_CODES.get(c, 0) for c in range(8)])[bits_code])
    kind = b.take(7)
    wasted = b.take(1)
    wasted = np.where(wasted > 0, b.unary(wasted > 0) + 1, 0)
    depth = depth - wasted
    flat, plain, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), (kind >= 32) & (kind < 64)
    if not (flat | plain | fixed | lpc).all():
        raise ValueError("unknown FLAC subframe")
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
    most, p = int(size.max(initial=0)), int(order.max(initial=0))
    out = np.zeros((most, lanes), np.int64)
    once = b.signed(depth, flat)
    for i in range(p):
        out[i] = b.signed(depth, i < order)
    precision = b.take(4, lpc) + 1
    shift = b.signed(np.full(lanes, 5), lpc)
    coef = np.zeros((p, lanes), np.int64)
    for j in range(p):
        coef[j] = b.signed(precision, lpc & (j < order))
        for q in range(j + 1, 5):
            coef[j] = np.where(fixed & (order == q), FIXED[q][j], coef[j])
    coded = fixed | lpc
    wide = np.where(b.take(2, coded) == 1, 5, 4)
    per = np.where(coded, size >> b.take(4, coded), most + 1)
    param, raw, edge = np.zeros(lanes, np.int64), np.full(lanes, -1), np.where(coded, 0, most + 1)
    all_plain, no_plain, soon, some_raw = not coded.any(), not plain.any(), 0, False
    for i in range(most):
        inside = i < size
        if not no_plain:
            out[i] += b.signed(depth, plain & inside)
        if all_plain:
            continue
        if i >= soon:
            turn = coded & inside & (i >= edge)
            got = b.take(wide, turn)
            escape = turn & (got == (1 << wide) - 1)
            raw = np.where(turn, np.where(escape, b.take(5, escape), -1), raw)
            param = np.where(turn, got, param)
            edge = np.where(turn, edge + per, edge)
            soon, some_raw = int(edge.min()), bool((raw >= 0).any())
        live = coded & inside & (i >= order)
        esc = live & (raw >= 0) if some_raw else None
        if some_raw:
            live &= ~esc
        u = b.rice(param, live)
        e = np.where(live, u >> 1 ^ -(u & 1), 0)
        if some_raw:
            e += b.signed(raw, esc & (raw > 0))
            live |= esc
        guess = np.zeros(lanes, np.int64)
        for j in range(min(p, i)):
            guess += coef[j] * out[i - 1 - j]
        out[i] += np.where(live, e + (guess >> shift), 0)
    out = np.where(flat, once, out) << wasted
    b.at = (b.at + 7) // 8 * 8
    ends = b.at >> 3
    if (b.take(16) != crc16(data, start, ends - start)).any():
        raise ValueError("a FLAC frame fails its CRC-16")
    return out.T, size, number, ends + 2


def layout(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """A stream's STREAMINFO, its seek points (sample, offset from the first frame, samples) and its first frame's offset."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points = 4, {}, []
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            packed_info = int.from_bytes(body[10:18], "big")
            info = {"block": int.from_bytes(body[2:4], "big"), "rate": packed_info >> 44, "bits": (packed_info >> 36 & 31) + 1, "samples": packed_info & (1 << 36) - 1, "md5": body[18:34]}
        elif kind & 127 == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            points = [p for p in points if p[0] != (1 << 64) - 1]
        at += 4 + size
        if kind & 128:
            return info, points, at


def decode(streams: list[bytes], first: list[int] | None = None, at_once: int = 4096) -> list[list[tuple[int, np.ndarray]]]:
    """The blocks (sample offset, samples) of each stream, from the block that holds sample ``first`` on.

    With a seek point per frame the frames are read all in step; else a stream's frames follow one another.
    A whole stream is held against the MD5 of its samples.
    """
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    out: list[dict[int, np.ndarray]] = [{} for _ in streams]
    todo, slow = [], []
    heads = [layout(s) for s in streams]
    for i, (info, points, at) in enumerate(heads):
        if not info["samples"]:
            continue
        covered = sum(p[2] for p in points) == info["samples"]
        want = first[i] if first else 0
        if covered:
            todo += [(i, int(base[i]) + at + off, s) for s, off, n in points if s + n > want]
        else:
            slow.append((i, int(base[i]) + at, 0))

    def run(jobs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        start, depth = np.array([j[1] for j in jobs]), np.array([heads[j[0]][0]["bits"] for j in jobs])
        x, size, _, ends = read_frames(data, start, depth)
        for (i, _, s), row, n in zip(jobs, x, size, strict=True):
            if s + n > (first[i] if first else 0):
                out[i][s] = row[:n].copy()
        return [(i, int(e), s + int(n)) for (i, _, s), e, n in zip(jobs, ends, size, strict=True) if s + n < heads[i][0]["samples"]]

    for k in range(0, len(todo), at_once):
        run(todo[k : k + at_once])
    while slow:
        slow = run(slow)
    for i, (info, _, _) in enumerate(heads):
        if not first and info["bits"] == 8:
            pcm = np.concatenate([out[i][s] for s in sorted(out[i])]) if out[i] else np.zeros(0)
            if hashlib.md5(pcm.astype(np.int8).tobytes()).digest() != info["md5"]:
                raise ValueError("decoded samples fail the stream's MD5")
    return [sorted(x.items()) for x in out]


#: Text bytes by about how frequent they are, with the padding among them; all others follow by value. The first is the sample nearest to zero.
FREQUENT = b" e\xfftaoinsrhldcumfpgwybvkxjqz.,\n0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RANKED = np.array(list(dict.fromkeys([*FREQUENT, *range(256)])), np.uint8)
#: The stored unsigned form of each byte's sample (sample plus 128), and back: ranks 0, 1, 2, ... are samples 0, -1, 1, -2, ...
TO_STORED, FROM_STORED = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
TO_STORED[RANKED] = (np.arange(256) >> 1 ^ -(np.arange(256) & 1)) + 128
FROM_STORED[TO_STORED] = np.arange(256)


def padded(text: str | None, block: int = BLOCK) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // block)) * block
    return raw + b"\xff" * (size - len(raw)), len(raw)


def with_media(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8, padded with bytes 255 to a positive multiple of ``block``, as FLAC.

    A byte is stored as the sample of its rank among text bytes (``TO_STORED``), so that frequent ones are small samples with short Rice codes.
    Null text counts as empty. Repeated rows stay. Other columns are left out.
    """

    def run(batches):
        for part in pieces(batches, 256, 4 << 20):
            both = [padded(t, block) for t in part.column("text").to_pylist()]
            stored = encode([TO_STORED[np.frombuffer(p, np.uint8)].tobytes() for p, _ in both], block)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for _, n in both], pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per block: key, sample_offset, n_samples, pcm (signed 8-bit samples). Null media gives no rows."""

    def run(batches):
        for part in pieces(batches, 256, 4 << 20):
            for k, blocks in zip(part.column(0).to_pylist(), decode([x or SILENCE for x in part.column(1).to_pylist()]), strict=True):
                if blocks:
                    yield pa.RecordBatch.from_pylist([{"key": k, "sample_offset": s, "n_samples": len(x), "pcm": x.astype(np.int8).tobytes()} for s, x in blocks], pa.schema([("key", pa.int64()), ("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))

    return media.select(F.col(key).cast("long"), column).mapInArrow(run, "key long, sample_offset long, n_samples int, pcm binary").withColumnRenamed("key", key)


SILENCE = encode([b""])[0]


def feature(x: np.ndarray) -> str:
    """Loudness, zero crossings and mean step of eight equal spans of the samples, as text."""
    cuts = np.linspace(0, len(x), 9).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        y = x[a:b]
        step = np.abs(np.diff(y)).mean() if len(y) > 1 else 0.0
        turn = np.count_nonzero(y[1:] * y[:-1] < 0) / max(1, len(y) - 1)
        out.append(f"{np.sqrt(np.mean(y * y)) if len(y) else 0:.2f}/{turn:.3f}/{step:.2f}")
    return " ".join(out)


def digests(media: DataFrame) -> DataFrame:
    """Read stored media back: digests of payload and stored form, the CRC-32 of the last 32 payload bytes, a feature.

    Input: what ``with_media`` returns; repeated rows stay, other columns are left out. A null or damaged stream raises ValueError.
    """

    def run(batches):
        for part in pieces(batches, 256, 4 << 20):
            streams = [x.as_py() or b"" for x in part.column("media")]
            rows = []
            for k, n, s, blocks in zip(part.column("doc_id").to_pylist(), part.column("n_bytes").to_pylist(), streams, decode(streams), strict=True):
                x = np.concatenate([y for _, y in blocks]) if blocks else np.zeros(0, np.int64)
                raw = FROM_STORED[(x + 128).astype(np.uint8)].tobytes()
                rows.append((k, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(s), hashlib.sha256(s).hexdigest(), feature(x), len(blocks)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGEST.types, strict=True)], schema=DIGEST)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_blocks", pa.int64())])
