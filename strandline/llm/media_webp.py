"""Media columns: lossless WebP (VP8L) written and read as binary values.

The reader handles the whole lossless format: prefix codes (simple and normal, with meta codes),
back-references with the near-distance map, the colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. Many images are read together: a step decodes the next symbol of
each of them by canonical limits, so the loop runs over the symbols of the longest image, not over all;
only images with several groups of codes are read pixel by pixel.

The writer chooses for each image what makes it small: a palette where colours are few, else the
predictor or the cross-colour transform where the samples' entropy falls, back-references to earlier
runs of pixels, a colour cache where it is hit, and prefix codes of the image's own counts. An image
that this would not shrink has flat 8-bit codes. All choices depend on the image alone.

A payload of 4 n bytes is an image of n pixels, 144 wide; the bytes of a pixel are its green, red,
blue and alpha sample, the order in which the format codes them. More than 32 rows go on in a
further image; a value holds its images one behind the other, so a long text is many images.

Null texts are empty; an empty text is one block of padding. Equal texts have equal values.
Repeated rows are rows of their own. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_buffers, written

BLOCK, WIDE, MOST_ROWS = 576, 144, 32
REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), axis=1, bitorder="little")[:, 0]

# Fixed values of the format: the order of code length codes, and the near distances (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR, N_LENGTHS, N_DISTANCES = 0x1E35A7BD, 24, 40


class BitWriter:
    def __init__(self):
        self.value = self.n = 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.window, self.base = 0, -1

    def peek(self, bits: int) -> int:
        first = self.at >> 3
        return (int.from_bytes(self.data[first : first + 8], "little") >> (self.at & 7)) & ((1 << bits) - 1)

    def get(self, bits: int) -> int:
        if self.at + bits > len(self.data) * 8:
            raise ValueError("the image ends early")
        got = self.peek(bits)
        self.at += bits
        return got


_REV15 = np.zeros(1 << 15, np.int32)
for _k in range(15):
    _REV15 |= ((np.arange(1 << 15) >> _k) & 1).astype(np.int32) << (14 - _k)


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of code lengths: limit and base of each length, symbols in order of their codes, number of symbols.

    The next 15 bits, first bit highest, are of length L if they are below limit[L] and of no smaller one;
    the symbol is at base[L] plus the bits cut to L.
    """
    rows, alphabet = lengths.shape
    order = np.argsort(np.where(lengths > 0, lengths.astype(np.int32), 99) * 4096 + np.arange(alphabet), axis=1)
    count = np.stack([(lengths == n).sum(1) for n in range(16)], 1).astype(np.int64)
    count[:, 0] = 0
    space = np.cumsum(count << (15 - np.arange(16)), 1)
    base = np.cumsum(count, 1) - count - ((space - (count << (15 - np.arange(16)))) >> (15 - np.arange(16)))
    used = count.sum(1)
    if (used == 0).any():
        raise ValueError("a code without symbols")
    if (space[used > 1, 15] != 1 << 15).any():
        raise ValueError("a code that is not complete")
    return space.astype(np.int32), base.astype(np.int32), order.astype(np.int32), used


class Code:
    """A canonical prefix code, read one symbol at a time."""

    def __init__(self, lengths: list[int]):
        limit, base, order, used = canonical(np.array([lengths]))
        self.only = int(order[0, 0]) if used[0] == 1 else None
        self.limit, self.base, self.symbols = limit[0].tolist(), base[0].tolist(), order[0].tolist()

    def read(self, r: BitReader) -> int:
        if self.only is not None:
            return self.only
        v, n = int(_REV15[r.peek(15)]), 1
        while v >= self.limit[n]:
            n += 1
        r.get(n)
        return self.symbols[self.base[n] + (v >> (15 - n))]


_LENGTH_CODES: dict[tuple, list[tuple[int, int]]] = {}


def _length_code(own: tuple) -> list[tuple[int, int]]:
    """(symbol, bits) for each value of the next 7 bits; a code of few lengths comes up in many images."""
    if own not in _LENGTH_CODES:
        limit, base, order, used = (x[0] for x in canonical(np.array([own])))
        if used == 1:
            table = [(int(order[0]), 0)] * 128
        else:
            table = []
            for bits in range(128):
                v, n = int(_REV15[bits]), 1
                while v >= limit[n]:
                    n += 1
                table.append((int(order[base[n] + (v >> (15 - n))]), n))
        if len(_LENGTH_CODES) > 4096:
            _LENGTH_CODES.clear()
        _LENGTH_CODES[own] = table
    return _LENGTH_CODES[own]


def read_lengths(r: BitReader, alphabet: int) -> list[int]:
    """The code lengths of a prefix code; a single symbol has length 1."""
    lengths = [0] * alphabet
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        symbols = [r.get(8 if wide else 1)] + ([r.get(8)] if two else [])
        for s in symbols:
            lengths[s] = 1
        return lengths
    own = [0] * 19
    for k in LENGTH_ORDER[: 4 + r.get(4)]:
        own[k] = r.get(3)
    most = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else alphabet
    table, s, last, data, at = _length_code(tuple(own)), 0, 8, r.data, r.at
    while s < alphabet and most:
        most -= 1
        bits = int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)
        k, n = table[bits & 127]
        at += n
        if k < 16:
            lengths[s] = k
            s += 1
            last = k or last
            continue
        bits >>= n
        value, n, extra = (last, 3 + (bits & 3), 2) if k == 16 else (0, 3 + (bits & 7), 3) if k == 17 else (0, 11 + (bits & 127), 7)
        at += extra
        if s + n > alphabet:
            raise ValueError("code lengths run over")
        if value:
            lengths[s : s + n] = [value] * n
        s += n
    if at > len(data) * 8:
        raise ValueError("the image ends early")
    r.at = at
    return lengths


def read_code(r: BitReader, alphabet: int) -> Code:
    return Code(read_lengths(r, alphabet))


def _prefixed(symbol: int, r: BitReader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.get(extra) + 1


def _alphabets(cache_bits: int) -> tuple[int, ...]:
    return (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)


def _pixels(r: BitReader, wide: int, high: int, top: bool):
    """ARGB values (uint32) of an entropy-coded image; a Pending one if it is of the top level and has one group of codes.

    What is read here symbol by symbol is small (what belongs to a transform) or has several groups of codes.
    """
    cache_bits = r.get(4) if r.get(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    group_of, bits, meta_wide = None, 0, 0
    if top and r.get(1):
        bits = r.get(3) + 2
        meta = _pixels(r, (wide + (1 << bits) - 1) >> bits, (high + (1 << bits) - 1) >> bits, False)
        group_of, meta_wide = (meta >> 8) & 0xFFFF, (wide + (1 << bits) - 1) >> bits
    total = wide * high
    if top and group_of is None:
        return Pending(r.data, r.at, total, wide, cache_bits)
    groups = [[read_code(r, n) for n in _alphabets(cache_bits)] for _ in range(int(group_of.max()) + 1 if group_of is not None else 1)]
    out, cache, at, lately = np.zeros(total, np.uint32), np.zeros(1 << cache_bits, np.uint32), 0, 0
    while at < total:
        codes = groups[int(group_of[(at // wide >> bits) * meta_wide + (at % wide >> bits)])] if group_of is not None else groups[0]
        s = codes[0].read(r)
        if s < 256:
            red, blue, alpha = codes[1].read(r), codes[2].read(r), codes[3].read(r)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 256 + N_LENGTHS:
            n, d = _prefixed(s - 256, r), _distance(_prefixed(codes[4].read(r), r), wide)
            _copy(out, at, n, d, 0, total)
            at += n
        else:
            for v in out[lately:at].tolist():
                cache[(CACHE_FACTOR * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
            lately = at
            out[at] = cache[s - 256 - N_LENGTHS]
            at += 1
    return out


def _distance(d: int, wide: int) -> int:
    if d > len(NEAR):
        return d - len(NEAR)
    x, y = NEAR[d - 1]
    return max(1, x + y * wide)


def _copy(out: np.ndarray, at: int, n: int, d: int, first: int, stop: int) -> None:
    """Copies n pixels from d before; out holds an image from first to stop."""
    if d > at - first or at + n > stop:
        raise ValueError("a back-reference leaves the image")
    if d >= n:
        out[at : at + n] = out[at - d : at - d + n]
    else:
        out[at : at + n] = np.resize(out[at - d : at], n)


class Pending:
    """The pixels of an image that are still to be read: where their codes start, and what shape they have."""

    def __init__(self, data: bytes, at: int, total: int, wide: int, cache_bits: int):
        self.data, self.at, self.total, self.wide, self.cache_bits = data, at, total, wide, cache_bits


class Streams:
    """The data of many images one behind the other, and a place in each, in bits."""

    def __init__(self, images: list[Pending]):
        size = np.array([len(x.data) for x in images], np.int64)
        begin = np.cumsum(size + 24) - (size + 24)
        self.raw = np.frombuffer(b"".join(y for x in images for y in (x.data, bytes(24))), np.uint8)
        self.window = self.raw[:-3].astype(np.uint32)  # the 32 bits from each byte
        for k in range(1, 4):
            self.window |= self.raw[k : len(self.raw) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
        self.at, self.last = begin * 8 + np.array([x.at for x in images], np.int64), (begin + size) * 8

    def peek(self, which: np.ndarray) -> np.ndarray:
        """25 bits at least."""
        p = self.at[which]
        return self.window[p >> 3] >> (p & 7).astype(np.uint32)

    def take(self, which: np.ndarray, bits) -> np.ndarray:
        got = self.peek(which).astype(np.int64) & ((1 << np.asarray(bits, np.int64)) - 1)
        self.at[which] += bits
        if (self.at[which] > self.last[which]).any():
            raise ValueError("the image ends early")
        return got


def read_lengths_of_many(streams: Streams, alphabet: np.ndarray) -> np.ndarray:
    """read_lengths for the next code of each stream, one symbol of each at a time."""
    lengths = np.zeros((len(alphabet), int(alphabet.max()) + 140), np.uint8)
    simple = streams.take(np.arange(len(alphabet)), 1) == 1
    some = np.flatnonzero(simple)
    if len(some):
        two, wide = streams.take(some, 1) == 1, streams.take(some, 1) == 1
        lengths[some, streams.take(some, np.where(wide, 8, 1))] = 1
        lengths[some[two], streams.take(some[two], 8)] = 1
    some = np.flatnonzero(~simple)
    if not len(some):
        return lengths[:, : int(alphabet.max())]
    own, count = np.zeros((len(some), 19), np.int64), 4 + streams.take(some, 4)
    for j, k in enumerate(LENGTH_ORDER):
        has = count > j
        own[has, k] = streams.take(some[has], 3)
    limited = streams.take(some, 1) == 1
    most = alphabet[some].copy()
    if limited.any():
        most[limited] = 2 + streams.take(some[limited], 2 + 2 * streams.take(some[limited], 3))
    kinds, kind = np.unique(own, axis=0, return_inverse=True)
    tables = np.array([_length_code(tuple(x)) for x in kinds.tolist()])  # kinds, 128, (symbol, bits)
    symbol, width, kind = tables[:, :, 0].reshape(-1), tables[:, :, 1].reshape(-1), kind.reshape(-1) << 7
    at, s, last, end = streams.at[some], np.zeros(len(some), np.int64), np.full(len(some), 8), alphabet[some]
    rows, stop = some, streams.last[some]
    done_rows, done_at = [], []
    while len(rows):
        bits = (streams.window[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.int64)
        e = kind + (bits & 127)
        k, n = symbol[e], width[e]
        at += n
        single = k < 16
        if single.all():
            lengths[rows, s] = k
            s += 1
            last = np.where(k > 0, k, last)
        else:
            lengths[rows[single], s[single]] = k[single]
            bits >>= n
            n = np.where(k == 16, 3 + (bits & 3), np.where(k == 17, 3 + (bits & 7), 11 + (bits & 127)))
            at += np.where(single, 0, np.where(k == 16, 2, np.where(k == 17, 3, 7)))
            again = np.flatnonzero(k == 16)
            for j in range(6 if len(again) else 0):
                x = again[n[again] > j]
                lengths[rows[x], s[x] + j] = last[x]
            last = np.where(single & (k > 0), k, last)
            s += np.where(single, 1, n)
        most -= 1
        if (s > end).any():
            raise ValueError("code lengths run over")
        if (at > stop).any():
            raise ValueError("the image ends early")
        live = (s < end) & (most > 0)
        if not live.all():
            done_rows.append(rows[~live])
            done_at.append(at[~live])
            rows, at, s, last, end, kind, most, stop = (x[live] for x in (rows, at, s, last, end, kind, most, stop))
    streams.at[np.concatenate(done_rows)] = np.concatenate(done_at)
    return lengths[:, : int(alphabet.max())]


#: Bits that a look-up of read_pending covers; longer codes are read by their limits.
LOOK = 11


def _look_ups(lengths: np.ndarray) -> tuple[np.ndarray, tuple]:
    """For rows of code lengths and the next LOOK bits: symbol and length, 16 times the one plus the other; 15 for a longer code."""
    limit, base, order, used = canonical(lengths)
    n = np.take_along_axis(lengths, order, 1).astype(np.int64)
    n[used == 1] = 0
    size = np.where(n > 0, (1 << LOOK) >> n, 0)
    size[used == 1, 0] = 1 << LOOK
    short = size.sum(1)
    entry = (order.astype(np.uint16) << np.uint16(4)) | n.astype(np.uint16)
    # Symbols in order of their codes fill the table in order of the bits, first bit highest.
    table = np.repeat(np.concatenate([entry, np.full((len(lengths), 1), 15, np.uint16)], 1).reshape(-1), np.concatenate([size, (1 << LOOK) - short[:, None]], 1).reshape(-1))
    return table.reshape(len(lengths), 1 << LOOK)[:, _REV15[np.arange(1 << LOOK)] >> (15 - LOOK)].reshape(-1), (limit, base.reshape(-1), order, used)


def read_pending(images: list[Pending]) -> list[np.ndarray]:
    """The ARGB values of many images, one symbol of each at a time."""
    if not images:
        return []
    m, streams = len(images), Streams(images)
    sizes = np.array([_alphabets(x.cache_bits) for x in images])
    parts = [read_lengths_of_many(streams, sizes[:, c]) for c in range(5)]
    # Codes of a channel are of one width, so each channel has tables of its own.
    made = [_look_ups(x) for x in parts]
    table, slow = np.concatenate([x[0] for x in made]), [x[1] for x in made]
    flat = np.array([not x.cache_bits for x in images])
    for x in parts[:4]:
        flat &= (x[:, :256] == 8).all(1) & ~x[:, 256:].any(1)
    del parts, made
    raw, raw32 = streams.raw, streams.window
    total = np.array([x.total for x in images], np.int64)
    first = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint32)
    cache_bits = np.array([x.cache_bits for x in images], np.int64)
    cache_first = np.cumsum(1 << cache_bits) - (1 << cache_bits)  # without a cache one place that nothing reads
    shifts = (32 - cache_bits).astype(np.uint64)
    cache, mask, factor = np.zeros(int((1 << cache_bits).sum()), np.uint32), (1 << LOOK) - 1, np.uint32(CACHE_FACTOR)

    def read(channel, k, p):
        """(symbols, their lengths) of a channel of the images k at the bits p."""
        window = raw32[p >> 3] >> (p & 7).astype(np.uint32)
        e = table[(k + channel * m << LOOK) | (window & np.uint32(mask))]
        n = e & np.uint16(15)
        symbol = e >> np.uint16(4)
        if (n == 15).any():
            far = np.flatnonzero(n == 15)
            limit, base, symbols, _ = slow[channel]
            v = _REV15[window[far] & np.uint32(0x7FFF)]
            deep = (v[:, None] >= limit[k[far], 1:15]).sum(1) + 1
            n[far] = deep
            symbol[far] = symbols[k[far], base[k[far] * 16 + deep] + (v >> (15 - deep))]
        return symbol, n

    def remember(k, value) -> None:
        cache[cache_first[k] + (value * factor >> shifts[k]).astype(np.int64)] = value

    for x in np.flatnonzero(flat).tolist():
        r = BitReader(images[x].data)
        r.at = int(streams.at[x] - streams.last[x]) + len(images[x].data) * 8
        out[first[x] : first[x] + total[x]] = _flat(r, int(total[x]))
    k = np.flatnonzero((total > 0) & ~flat)
    p, q, stop, last = streams.at[k], first[k].copy(), (first + total)[k], streams.last[k]
    while len(k):
        s, n = read(0, k, p)
        p += n
        plain = s < 256
        if plain.all():
            value = s.astype(np.uint32) << np.uint32(8)
            for channel, shift in ((1, 16), (2, 0), (3, 24)):
                x, n = read(channel, k, p)
                p += n
                value |= x.astype(np.uint32) << np.uint32(shift)
            out[q] = value
            q += 1
            remember(k, value)
        else:
            one = np.flatnonzero(plain)
            if len(one):
                value, at, own = s[one].astype(np.uint32) << np.uint32(8), p[one], k[one]
                for channel, shift in ((1, 16), (2, 0), (3, 24)):
                    x, n = read(channel, own, at)
                    at += n
                    value |= x.astype(np.uint32) << np.uint32(shift)
                p[one] = at
                out[q[one]] = value
                q[one] += 1
                remember(own, value)
            other = np.flatnonzero(s >= 256 + N_LENGTHS)
            if len(other):
                value = cache[cache_first[k[other]] + s[other] - 256 - N_LENGTHS]
                out[q[other]] = value
                q[other] += 1
                remember(k[other], value)
            for x in np.flatnonzero(~plain & (s < 256 + N_LENGTHS)).tolist():
                image = images[int(k[x])]
                r = BitReader(raw[int(p[x]) >> 3 : (int(p[x]) >> 3) + 16].tobytes())
                r.at = int(p[x]) & 7
                length = _prefixed(int(s[x]) - 256, r)
                d, n = read(4, k[x : x + 1], p[x : x + 1] - (int(p[x]) & 7) + r.at)
                r.at += int(n[0])
                d = _distance(_prefixed(int(d[0]), r), image.wide)
                p[x] += r.at - (int(p[x]) & 7)
                a = int(q[x])
                _copy(out, a, length, d, int(first[k[x]]), int(stop[x]))
                q[x] += length
                if image.cache_bits:
                    remember(np.full(length, k[x]), out[a : a + length])
        if (p > last).any():
            raise ValueError("the image ends early")
        live = q < stop
        if not live.all():
            k, p, q, stop, last = k[live], p[live], q[live], stop[live], last[live]
    return [out[a:z] for a, z in zip(first.tolist(), (first + total).tolist(), strict=True)]


def _flat(r: BitReader, total: int) -> np.ndarray:
    if r.at + 32 * total > len(r.data) * 8:
        raise ValueError("the image ends early")
    first, off = r.at >> 3, r.at & 7
    raw = np.frombuffer(r.data, np.uint8, 4 * total + bool(off), first)
    if off:
        wide = raw.astype(np.uint16)
        raw = (wide[:-1] >> off | wide[1:] << (8 - off)).astype(np.uint8)
    r.at += 32 * total
    g = REVERSED[raw].reshape(total, 4).astype(np.uint32)
    return g[:, 3] << np.uint32(24) | g[:, 1] << np.uint32(16) | g[:, 0] << np.uint32(8) | g[:, 2]


def _channels(px: np.ndarray) -> np.ndarray:
    """(n, 4) alpha, red, green, blue as int32."""
    return np.stack([px >> 24, px >> 16 & 255, px >> 8 & 255, px & 255], -1).astype(np.int32)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predicted(mode: int, left, top, right, corner):
    half = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0], np.int32)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode < 11:
        return (half(half(left, right), top), half(left, corner), half(left, top), half(corner, top), half(top, right), half(half(left, corner), half(top, right)))[mode - 5]
    if mode == 11:
        from_left, from_top = np.abs(top - corner).sum(), np.abs(left - corner).sum()
        return left if from_left < from_top else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = half(left, top)
    delta = mean - corner
    return np.clip(mean + (np.sign(delta) * (np.abs(delta) >> 1)), 0, 255)


def undo_predictor(px: np.ndarray, wide: int, high: int, modes: np.ndarray, bits: int) -> np.ndarray:
    c, across = _channels(px).reshape(high, wide, 4), (wide + (1 << bits) - 1) >> bits
    kinds = set((modes >> 8 & 15).tolist())
    if kinds <= {1} or kinds <= {2}:  # one neighbour everywhere: sums
        c[0, 0] += np.array([255, 0, 0, 0], np.int32)
        if kinds <= {1}:
            c[:, 0] = np.cumsum(c[:, 0], 0)
            return _joined(np.cumsum(c, 1)).reshape(-1)
        c[0] = np.cumsum(c[0], 0)
        return _joined(np.cumsum(c, 0)).reshape(-1)
    for y in range(high):
        for x in range(wide):
            if y == 0:
                guess = c[0, x - 1] if x else np.array([255, 0, 0, 0], np.int32)
            elif x == 0:
                guess = c[y - 1, 0]
            else:
                mode = int(modes[(y >> bits) * across + (x >> bits)]) >> 8 & 15
                right = c[y - 1, x + 1] if x + 1 < wide else c[y, 0]
                guess = _predicted(mode, c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])
            c[y, x] = (c[y, x] + guess) & 255
    return _joined(c).reshape(-1)


def undo_cross_colour(px: np.ndarray, wide: int, high: int, factors: np.ndarray, bits: int) -> np.ndarray:
    signed = lambda v: ((v & 255) ^ 128) - 128
    y, x = np.divmod(np.arange(wide * high), wide)
    t = _channels(factors)[(y >> bits) * ((wide + (1 << bits) - 1) >> bits) + (x >> bits)]
    c = _channels(px)
    green = signed(c[:, 2])
    red = (c[:, 1] + (signed(t[:, 3]) * green >> 5)) & 255
    blue = c[:, 3] + (signed(t[:, 2]) * green >> 5) + (signed(t[:, 1]) * signed(red) >> 5)
    return _joined(np.stack([c[:, 0], red, c[:, 2], blue], -1))


def undo_subtract_green(px: np.ndarray) -> np.ndarray:
    c = _channels(px)
    c[:, 1] += c[:, 2]
    c[:, 3] += c[:, 2]
    return _joined(c)


def undo_palette(px: np.ndarray, wide: int, high: int, colours: np.ndarray, bits: int) -> np.ndarray:
    """px is packed (1 << bits pixels in one); wide is the true width."""
    across, each = (wide + (1 << bits) - 1) >> bits, 8 >> bits
    x = np.arange(wide)
    green = (px.reshape(high, across) >> 8 & 255)[:, x >> bits]
    index = green >> ((x & ((1 << bits) - 1)) * each).astype(np.uint32) & np.uint32((1 << each) - 1)
    full = np.zeros(256, np.uint32)
    full[: len(colours)] = colours
    return full[index].reshape(-1)


def _opened(data: bytes) -> tuple[int, int, list, object]:
    """(columns, rows, what undoes the transforms, pixels or Pending) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    (n,) = struct.unpack_from("<I", data, 16)
    r = BitReader(data[20 : 20 + n])
    if r.get(8) != 0x2F:
        raise ValueError("no lossless signature")
    wide, high = r.get(14) + 1, r.get(14) + 1
    r.get(1)
    if r.get(3):
        raise ValueError("unknown version")
    undo, across, seen = [], wide, set()
    while r.get(1):
        kind = r.get(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (0, 1):
            bits = r.get(3) + 2
            data_px = _pixels(r, (across + (1 << bits) - 1) >> bits, (high + (1 << bits) - 1) >> bits, False)
            f = undo_predictor if kind == 0 else undo_cross_colour
            undo.append(lambda px, f=f, w=across, d=data_px, b=bits: f(px, w, high, d, b))
        elif kind == 2:
            undo.append(undo_subtract_green)
        else:
            size = r.get(8) + 1
            colours = _joined(np.cumsum(_channels(_pixels(r, size, 1, False)), 0))
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append(lambda px, w=across, d=colours, b=bits: undo_palette(px, w, high, d, b))
            across = (across + (1 << bits) - 1) >> bits
    return wide, high, undo, _pixels(r, across, high, True)


def decode_images(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of lossless WebP files as (rows, columns, 4) bytes: red, green, blue, alpha."""
    opened = [_opened(x) for x in files]
    pending = iter(read_pending([x[3] for x in opened if isinstance(x[3], Pending)]))
    out = []
    for wide, high, undo, px in opened:
        px = next(pending) if isinstance(px, Pending) else px
        for f in reversed(undo):
            px = f(px)
        out.append(px.astype("<u4").view(np.uint8).reshape(high, wide, 4)[:, :, [2, 1, 0, 3]])
    return out


def decode_image(data: bytes) -> np.ndarray:
    return decode_images([data])[0]


def _flat_head(high: int, wide: int = WIDE) -> bytes:
    """Everything before the pixels, ending at a byte's end."""
    w = BitWriter()
    w.put(0x2F, 8), w.put(wide - 1, 14), w.put(high - 1, 14), w.put(1, 1), w.put(0, 3)
    w.put(0, 1)  # no transform
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one group of codes

    def flat(limit: bool, spare: int) -> None:
        """256 lengths of 8: the length's own code has 8 and `repeat`, one bit each; `spare` adds bits."""
        w.put(0, 1)
        w.put(len(LENGTH_ORDER[:12]) - 4, 4)
        for k in LENGTH_ORDER[:12]:
            w.put(1 if k in (8, 16) else 0, 3)
        runs = [6] * 42 + [3]
        for k in range(spare):
            runs[k] = 5
        tokens = 1 + len(runs) + spare
        w.put(int(limit), 1)
        if limit:
            w.put(2, 3), w.put(tokens - 2, 6)
        w.put(0, 1)
        for n in runs:
            w.put(1, 1), w.put(n - 3, 2)
        for _ in range(spare):
            w.put(0, 1)

    flat(True, 0), flat(False, 0), flat(False, 0)
    after = w.n
    flat(False, 0)
    spare = -(w.n + 4) % 8
    w.value &= (1 << after) - 1
    w.n = after
    flat(False, spare)
    w.put(1, 1), w.put(0, 1), w.put(0, 1), w.put(0, 1)  # distances: one symbol
    assert w.n % 8 == 0
    return w.bytes()


_HEADS: dict[int, bytes] = {}


def _flat_body(px: np.ndarray) -> bytes:
    high = len(px) // BLOCK
    if high not in _HEADS:
        _HEADS[high] = _flat_head(high)
    return _HEADS[high] + REVERSED[px].tobytes()


#: The longest code that the writer makes.
DEEP = 11


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of complete prefix codes for rows of counts: -log2 of the share, rounded up, then what is left given to frequent symbols.

    Rows of one symbol have length 1 there; rows without symbols count the first one.
    """
    counts = counts.copy()
    counts[counts.sum(1) == 0, 0] = 1
    total, used = counts.sum(1, keepdims=True), (counts > 0).sum(1)
    with np.errstate(divide="ignore"):
        n = np.where(counts > 0, np.clip(np.ceil(np.log2(total / np.maximum(counts, 1))), 1, DEEP), 0).astype(np.int64)
    rows = np.flatnonzero(used > 1)
    left = (1 << DEEP) - np.where(n[rows] > 0, 1 << (DEEP - n[rows]), 0).sum(1)
    wide = counts.shape[1]
    order = np.argsort(-counts[rows] * wide + np.arange(wide), axis=1)[:, : int(used.max())]
    while (left < 0).any():  # rare symbols cut to DEEP bits took too much
        open_ = np.flatnonzero(left < 0)
        for k in range(order.shape[1] - 1, -1, -1):
            at = order[open_, k]
            own = n[rows[open_], at]
            gives = (own > 0) & (own < DEEP) & (left[open_] < 0)
            n[rows[open_[gives]], at[gives]] += 1
            left[open_[gives]] += 1 << (DEEP - own[gives] - 1)
    while (left > 0).any():
        open_ = np.flatnonzero(left > 0)
        for k in range(order.shape[1]):
            at = order[open_, k]
            own = n[rows[open_], at]
            cost = np.where(own > 1, 1 << (DEEP - own), 1 << 30)
            gives = (own > 0) & (cost <= left[open_])
            n[rows[open_[gives]], at[gives]] -= 1
            left[open_[gives]] -= cost[gives]
            if k % 8 == 7:
                open_ = open_[left[open_] > 0]
    return n.astype(np.uint8)


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol's code, first bit lowest."""
    order = np.argsort(np.where(lengths > 0, lengths.astype(np.int32), 99) * 4096 + np.arange(lengths.shape[1]), axis=1)
    n = np.take_along_axis(lengths, order, 1).astype(np.int64)
    size = np.where(n > 0, 1 << (15 - n), 0)
    out = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(out, order, _REV15[np.minimum(np.cumsum(size, 1) - size, (1 << 15) - 1)].astype(np.int64), 1)
    return out


_PLAIN_LENGTHS = tuple(4 if k < 14 or k in (17, 18) else 0 for k in range(19))
_PLAIN_CODE = {k: int(_REV15[i << 11]) for i, k in enumerate([*range(14), 17, 18])}


def _length_tokens(lengths: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, bits) that write rows of code lengths, of which the first alphabet[row] count."""
    rows, wide = lengths.shape
    used = (lengths > 0).sum(1)
    only = np.where(used == 1, lengths.argmax(1), 0)
    simple = (used == 1) & (only < 256)
    parts = []  # (row, order in the row, value, bits)
    at = np.flatnonzero(simple)
    parts.append((at, np.full(len(at), -2), 1 | 4 | only[at] << 3, np.full(len(at), 11)))
    at = np.flatnonzero(~simple)
    head, n_head = 0, 0
    for value, bits in [(0, 1), (17 - 4, 4), *[(_PLAIN_LENGTHS[k], 3) for k in LENGTH_ORDER[:17]], (0, 1)]:
        head, n_head = head | value << n_head, n_head + bits
    parts.append((at, np.full(len(at), -2), np.full(len(at), head & ((1 << 28) - 1)), np.full(len(at), 28)))
    parts.append((at, np.full(len(at), -1), np.full(len(at), head >> 28), np.full(len(at), n_head - 28)))
    inside = np.arange(wide) < alphabet[:, None]
    own = inside & ~simple[:, None]
    r, c = np.nonzero(own & (lengths > 0))
    of_length = np.array([_PLAIN_CODE.get(k, 0) for k in range(16)])
    parts.append((r, c * 8, of_length[lengths[r, c]], np.full(len(r), 4)))
    zero = np.zeros((rows, wide + 2), np.int8)
    zero[:, 1:-1] = own & (lengths == 0)
    edge = np.diff(zero, axis=1)
    r, c = np.nonzero(edge == 1)
    n = np.nonzero(edge == -1)[1] - c
    turn = 0
    while len(r):
        long, some = n >= 11, (n >= 3) & (n < 11)
        take = np.where(long, np.minimum(n, 138), np.where(some, n, 1))
        value = np.where(long, _PLAIN_CODE[18] | (take - 11) << 4, np.where(some, _PLAIN_CODE[17] | (take - 3) << 4, _PLAIN_CODE[0]))
        parts.append((r, c * 8 + np.minimum(turn, 7), value, np.where(long, 11, np.where(some, 7, 4))))
        c, n = c + take, n - take
        r, c, n = r[n > 0], c[n > 0], n[n > 0]
        turn += 1
    row, order, value, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((order, row))
    return row[order], value[order], bits[order]


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their number) of lengths or distances."""
    d = v - 1
    h = np.where(d > 0, np.int64(np.log2(np.maximum(d, 1))), 0)
    n = np.maximum(h - 1, 0)
    return np.where(d < 4, d, 2 * h + (d >> n & 1)), d & ((1 << n) - 1), np.where(d < 4, 0, n)


#: The shortest run of pixels that is copied, the longest one, bits of a colour cache, and the share of pixels that must hit it.
MIN_COPY, MAX_COPY, CACHE_BITS, CACHE_SHARE = 3, 4096, 8, 0.04


def _copies(px: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, length, distance) of copies in images that lie one after the other, ascending."""
    n = len(px)
    if n <= MIN_COPY:
        return []
    key = px.astype(np.uint64)
    h = key[: n - 2] * np.uint64(0x9E3779B97F4A7C15) ^ key[1 : n - 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ key[2:] * np.uint64(0xD6E8FEB86659FD93)
    image = np.repeat(np.arange(len(first)), size)
    h ^= image[: n - 2].astype(np.uint64) << np.uint64(40)
    # One sort of packed words: 36 bits of the hash, 28 of the position.
    order = np.sort((h >> np.uint64(28) << np.uint64(28)) | np.arange(n - 2, dtype=np.uint64))
    same = order[1:] >> np.uint64(28) == order[:-1] >> np.uint64(28)
    order = (order & np.uint64((1 << 28) - 1)).astype(np.int64)
    here, there = order[1:][same], order[:-1][same]
    ok = (image[here] == image[there]) & (px[here] == px[there]) & (px[here + 1] == px[there + 1]) & (px[here + 2] == px[there + 2]) & (image[here + 2] == image[here])
    here, there = here[ok], there[ok]
    order = np.argsort(here)
    stop, out, free = first + size, [], 0
    for a, b, k in zip(here[order].tolist(), there[order].tolist(), image[here[order]].tolist(), strict=True):
        if a < free:
            continue
        most = min(int(stop[k]) - a, MAX_COPY)
        unlike = np.flatnonzero(px[a : a + most] != px[b : b + most])
        n = int(unlike[0]) if len(unlike) else most
        out.append((a, n, a - b))
        free = a + n
    return out


def _entropy_bits(of: np.ndarray, samples: np.ndarray, n: int) -> np.ndarray:
    """Bits that the samples (pixels, 4) of each of n images take by the entropy of each channel."""
    out = np.zeros(n)
    for c in range(samples.shape[1]):
        h = np.bincount(of * 256 + samples[:, c], minlength=n * 256).reshape(n, 256).astype(np.float64)
        total = h.sum(1)
        out += total * np.log2(np.maximum(total, 1)) - (h * np.log2(np.maximum(h, 1))).sum(1)
    return out


class Bits:
    """Bit strings of many images, written part by part: every part has its tokens in the order of the images."""

    def __init__(self, n: int):
        self.n, self.parts, self.size = n, [], np.zeros(n, np.int64)

    def add(self, of: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """Tokens of at most 28 bits."""
        keep = bits > 0
        of, value, bits = of[keep], value[keep], bits[keep]
        upto = np.cumsum(bits)
        own = np.bincount(of, bits, self.n).astype(np.int64)
        begin = np.cumsum(own) - own
        self.parts.append((of, value, upto - bits - begin[of] + self.size[of]))
        self.size += own

    def each(self, value: int, bits: int, which: np.ndarray | None = None) -> None:
        which = np.arange(self.n) if which is None else which
        self.add(which, np.full(len(which), value, np.int64), np.full(len(which), bits, np.int64))

    def bytes(self) -> list[bytes]:
        words = -(-self.size // 32) + 1
        first = np.cumsum(words) - words
        out = np.zeros(int(words.sum()) + 1)
        for of, value, at in self.parts:
            word, shift = first[of] + (at >> 5), at & 31
            value = value.astype(np.int64) << shift
            # No two tokens share a bit, so sums are unions, and exact.
            out += np.bincount(word, (value & 0xFFFFFFFF).astype(np.float64), len(out))
            out += np.bincount(word + 1, (value >> 32).astype(np.float64), len(out))
        raw = out.astype(np.uint32).astype("<u4").tobytes()
        return [raw[4 * a : 4 * a + -(-n // 8)] for a, n in zip(first.tolist(), self.size.tolist(), strict=True)]


def _entropy_code(bits: Bits, which: np.ndarray, px: np.ndarray, size: np.ndarray, wide: np.ndarray, top: bool, used: dict) -> None:
    """Adds the entropy-coded images of the pixels px, size[k] of them for image which[k]."""
    m, n = len(which), len(px)
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(m), size)
    copy_at = np.zeros((0, 3), np.int64)
    if top:
        copy_at = np.array(_copies(px, first, size), np.int64).reshape(-1, 3)
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, copy_at[:, 0] + 1, 1)
    np.add.at(covered, copy_at[:, 0] + copy_at[:, 1], -1)
    alive = np.cumsum(covered)[:n] == 0  # the first pixel of a copy stands for it
    is_copy = np.zeros(n, bool)
    is_copy[copy_at[:, 0]] = True
    hit, index, with_cache = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(m, bool)
    if top and n:
        index = (px.astype(np.int64) * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - CACHE_BITS)
        order = np.sort((of << CACHE_BITS | index) << 28 | np.arange(n))
        slot, order = order >> 28, order & ((1 << 28) - 1)
        hit[order[1:]] = (slot[1:] == slot[:-1]) & (px[order[1:]] == px[order[:-1]])
        hit &= alive & ~is_copy
        with_cache = np.bincount(of[hit], minlength=m) > CACHE_SHARE * size
        hit &= with_cache[of]
    cells = np.stack([px >> 8 & 255, px >> 16 & 255, px & 255, px >> 24], 1).astype(np.int64)
    l_symbol, l_extra, l_bits = _prefix(copy_at[:, 1])
    d = copy_at[:, 2]
    d_symbol, d_extra, d_bits = _prefix(np.where(d == 1, 2, np.where(d == wide[of[copy_at[:, 0]]], 1, d + len(NEAR))) if len(d) else d)
    green = cells[:, 0].copy()
    green[copy_at[:, 0]] = 256 + l_symbol
    green[hit] = 256 + N_LENGTHS + index[hit]
    plain = alive & ~is_copy & ~hit
    alphabets = np.array([_alphabets(CACHE_BITS if c else 0) for c in with_cache]).reshape(m, 5)
    copied = of[copy_at[:, 0]]
    shown = ((of[alive], green[alive]), *((of[plain], cells[plain, c]) for c in (1, 2, 3)), (copied, d_symbol))
    lengths, codes = [], []
    for c, (image, symbol) in enumerate(shown):
        widest = int(alphabets[:, c].max())
        counts = np.bincount(image * widest + symbol, minlength=m * widest).reshape(m, widest)
        if c == 0:
            counts[:, 0] += ((counts > 0).sum(1) == 1) & (counts[:, :256].sum(1) == 0)  # a single symbol above 255 has no simple code
        lengths.append(code_lengths(counts))
        codes.append(_codes(lengths[-1]))
    if top:
        bits.add(which, np.where(with_cache, 1 | CACHE_BITS << 1, 0), np.where(with_cache, 5, 1))
        bits.each(0, 1, which)  # one group of codes
        used["cache"][which] = with_cache
        used["copies"][which] = np.bincount(of[copy_at[:, 0]], minlength=m) > 0
    else:
        bits.each(0, 1, which)
    for c in range(5):
        row, value, n_bits = _length_tokens(lengths[c], alphabets[:, c])
        bits.add(which[row], value, n_bits)
    lengths = [np.where(((x > 0).sum(1) == 1)[:, None], 0, x) for x in lengths]
    value, n_bits = np.zeros((n, 4), np.int32), np.zeros((n, 4), np.int32)
    value[:, 0], n_bits[:, 0] = codes[0][of, green], lengths[0][of, green]
    at, image = np.flatnonzero(plain), of[plain]
    for c in (1, 2, 3):
        value[at, c], n_bits[at, c] = codes[c][image, cells[at, c]], lengths[c][image, cells[at, c]]
    a = copy_at[:, 0]
    value[a, 1], n_bits[a, 1] = l_extra, l_bits
    value[a, 2], n_bits[a, 2] = codes[4][copied, d_symbol], lengths[4][copied, d_symbol]
    value[a, 3], n_bits[a, 3] = d_extra, d_bits
    bits.add(np.repeat(which[of[alive]], 4), value[alive].reshape(-1), n_bits[alive].reshape(-1))


def _one_pixel(bits: Bits, which: np.ndarray, green: int, red: int = 0, blue: int = 0) -> None:
    """An image of one pixel, all of whose codes are single symbols; alpha is 255."""
    bits.each(0, 1, which)
    for symbol in (green, red, blue, 255, 0):
        bits.each(1 | 4 | symbol << 3, 11, which)


CHOICES = ("plain", "left", "above", "cross", "palette")


def encode_images(raw: np.ndarray, rows: np.ndarray) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """Files of images of rows[k] rows whose bytes lie one after the other, and which features each one uses."""
    m, size = len(rows), rows * WIDE
    cells = raw.reshape(-1, 4)  # green, red, blue, alpha
    px = cells[:, 3].astype(np.uint32) << np.uint32(24) | cells[:, 1].astype(np.uint32) << np.uint32(16) | cells[:, 0].astype(np.uint32) << np.uint32(8) | cells[:, 2]
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(m), size)
    inside = np.arange(len(px)) - first[of]
    left = cells.astype(np.int16)
    before = np.zeros_like(left)
    before[1:] = left[:-1]
    above = np.zeros_like(left)
    above[WIDE:] = left[:-WIDE]
    edge, top = inside % WIDE == 0, inside < WIDE
    start = np.array([0, 0, 0, 255], np.int16)
    by_left = left - np.where(edge[:, None], np.where(top[:, None], start, above), before) & 255
    by_above = left - np.where(top[:, None], np.where(edge[:, None], start, before), above) & 255
    cross = left.copy()
    signed = (left[:, 0] ^ 128) - 128
    cross[:, 1], cross[:, 2] = left[:, 1] - signed & 255, left[:, 2] - signed & 255
    forms = [cells, by_left, by_above, cross]
    cost = np.stack([_entropy_bits(of, x.astype(np.int64), m) + 80 * (k > 0) for k, x in enumerate(forms)])
    colour = of.astype(np.uint64) << np.uint64(32) | px
    sorted_ = np.sort(colour)
    n_colours = np.bincount((sorted_[np.append(True, sorted_[1:] != sorted_[:-1])] >> np.uint64(32)).astype(np.int64), minlength=m)
    few = n_colours <= np.minimum(256, size // 2)
    colours, index, count = np.unique(colour[few[of]], return_inverse=True, return_counts=True)
    image_of = (colours >> np.uint64(32)).astype(np.int64)
    many = np.bincount(image_of, count * np.log2(count), m)
    cost = np.vstack([cost, np.where(few, size * np.log2(size) - many + 30.0 * n_colours + 600, np.inf)])
    cost[1:] *= 1.03  # a transform must be worth it
    choice = cost.argmin(0)
    used = {"palette": choice == 4, "predictor": (choice == 1) | (choice == 2), "cross": choice == 3, "cache": np.zeros(m, bool), "copies": np.zeros(m, bool), "coded": np.ones(m, bool)}
    bits = Bits(m)
    bits.each(0x2F, 8)
    bits.each(WIDE - 1, 14)
    bits.add(np.arange(m), rows - 1, np.full(m, 14))
    bits.each(1, 4)  # alpha is used; version 0
    for k, mode in ((1, 1), (2, 2)):
        own = np.flatnonzero(choice == k)
        bits.each(1 | 0 << 1 | 7 << 3, 6, own)  # one mode for blocks of 512 pixels: for all
        _one_pixel(bits, own, mode)
    own = np.flatnonzero(choice == 3)
    bits.each(1 | 1 << 1 | 7 << 3, 6, own)
    _one_pixel(bits, own, 32, 0, 32)  # red and blue are told from green, as a whole
    own = np.flatnonzero(choice == 4)
    wide = np.full(m, WIDE)
    out_px, out_size = [], size.copy()
    for k in range(4):
        f = forms[k]
        out_px.append(f[:, 3].astype(np.uint32) << np.uint32(24) | f[:, 1].astype(np.uint32) << np.uint32(16) | f[:, 0].astype(np.uint32) << np.uint32(8) | f[:, 2].astype(np.uint32))
    main = np.choose(choice[of].clip(0, 3), out_px)
    pieces = None
    if len(own):
        bits.add(own, 1 | 3 << 1 | (n_colours[own] - 1) << 3, np.full(len(own), 11))
        of_colour = np.flatnonzero(choice[image_of] == 4)
        own_colours = (colours[of_colour] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        head = np.append(True, image_of[of_colour][1:] != image_of[of_colour][:-1])
        delta = _channels(own_colours)
        delta[1:][~head[1:]] -= _channels(own_colours[:-1])[~head[1:]]
        _entropy_code(bits, own, _joined(delta), n_colours[own], n_colours[own], False, used)
        colour_first = np.searchsorted(image_of, np.arange(m))
        rank = np.zeros(len(px), np.int64)
        rank[few[of]] = index.reshape(-1) - colour_first[of[few[of]]]
        pieces = []
        for k in range(m):
            a, z = int(first[k]), int(first[k] + size[k])
            if choice[k] != 4:
                pieces.append(main[a:z])
                continue
            each = 3 if n_colours[k] <= 2 else 2 if n_colours[k] <= 4 else 1 if n_colours[k] <= 16 else 0
            packed = rank[a:z].reshape(-1, 1 << each)  # rows are a multiple of 8 pixels
            packed = (packed << (np.arange(1 << each) * (8 >> each))).sum(1)
            pieces.append((packed.astype(np.uint32) << np.uint32(8)) | np.uint32(255 << 24))
            wide[k], out_size[k] = WIDE >> each, len(packed)
        main = np.concatenate(pieces)
    bits.each(0, 1)  # no more transforms
    _entropy_code(bits, np.arange(m), main, out_size, wide, True, used)
    files = []
    for k, body in enumerate(bits.bytes()):
        if len(body) >= 4 * size[k]:
            body = _flat_body(raw[4 * first[k] : 4 * (first[k] + size[k])])
            for x in used.values():
                x[k] = False
        pad = len(body) & 1
        files.append(b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad)
    return files, used


def encode_payloads(raw: np.ndarray, blocks: np.ndarray) -> list[bytes]:
    """The stored forms of payloads of blocks[k] blocks of 576 bytes that lie one after the other."""
    images_of = -(-blocks // MOST_ROWS)
    of = np.repeat(np.arange(len(blocks)), images_of)
    nth = np.arange(len(of)) - (np.cumsum(images_of) - images_of)[of]
    files, _ = encode_images(raw, np.minimum(MOST_ROWS, blocks[of] - nth * MOST_ROWS))
    upto = np.cumsum(images_of).tolist()
    return [b"".join(files[a:z]) for a, z in zip([0, *upto[:-1]], upto, strict=True)]


def encode_payload(payload) -> bytes:
    """Lossless WebP images of a payload whose length is a multiple of 576."""
    raw = np.frombuffer(payload, np.uint8)
    return encode_payloads(raw, np.array([len(raw) // BLOCK]))[0]


def images(media: bytes):
    """The files of a value that holds several, one behind the other."""
    at = 0
    while at < len(media):
        (n,) = struct.unpack_from("<I", media, at + 4)
        yield media[at : at + 8 + n]
        at += 8 + n


def decode_payloads(media: list[bytes]) -> list[np.ndarray]:
    """The payloads' bytes from their images: green, red, blue, alpha of each pixel."""
    files = [list(images(x)) for x in media]
    px = iter(decode_images([f for own in files for f in own]))
    return [np.concatenate([next(px)[:, :, [1, 0, 2, 3]].reshape(-1) for _ in own]) for own in files]


def decode_payload(media: bytes) -> np.ndarray:
    return decode_payloads([media])[0]


def feature(px: np.ndarray) -> str:
    """Mean and spread of each sample of the pixels and the entropy of all, from whole counts."""
    n, parts = len(px), []
    for c in range(4):
        h = np.bincount(px[c::4], minlength=256)
        mean = float((h * np.arange(256)).sum()) / (n // 4)
        parts.append(f"{mean:.3f}/{float(((np.arange(256) - mean) ** 2 * h).sum() / (n // 4)) ** 0.5:.3f}")
    p = np.bincount(px, minlength=256) / n
    p = p[p > 0]
    return " ".join([*parts, f"{float(-(p * np.log2(p)).sum()):.4f}"])


#: Bytes of text that are written at a time, and of stored values that are read at a time.
WRITE_BYTES, READ_BYTES = 1 << 20, 4 << 20


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = WRITE_BYTES) -> DataFrame:
    """A table (doc_id, n_bytes, media) of every whole text in the shared folder."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, start, end = text_buffers(batch.column(1))
            for i, j in slices(start, end, slice_bytes):
                size = end[i:j] - start[i:j]
                blocks = np.maximum(1, -(-size // BLOCK))
                at = (np.cumsum(blocks) - blocks) * BLOCK
                whole = np.full(int(blocks.sum()) * BLOCK, 255, np.uint8)
                for s, e, a in zip(start[i:j].tolist(), end[i:j].tolist(), at.tolist(), strict=True):
                    whole[a : a + e - s] = raw[s:e]
                media, upto = [], np.cumsum(blocks)
                for x, y in slices(upto - blocks, upto, slice_bytes // BLOCK):
                    a, z = int(upto[x] - blocks[x]), int(upto[y - 1])
                    media += encode_payloads(whole[a * BLOCK : z * BLOCK], blocks[x:y]) if z - a <= 4 * slice_bytes // BLOCK else [_long_payload(whole[a * BLOCK : z * BLOCK], slice_bytes)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return written(own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"), "media")


def _long_payload(raw: np.ndarray, slice_bytes: int) -> bytes:
    """A payload of many images, some of them at a time."""
    step = max(1, slice_bytes // (BLOCK * MOST_ROWS)) * BLOCK * MOST_ROWS
    return b"".join(encode_payload(raw[a : a + step]) for a in range(0, len(raw), step))


def _media(batches, column: int):
    """(slice of a batch, payloads) of stored values, some MB at a time."""
    for batch in batches:
        _, start, end = text_buffers(batch.column(column))
        for i, j in slices(start, end, READ_BYTES):
            part = batch.slice(i, j - i)
            yield part, part.column(column).to_pylist()


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the stored values, from their decoded samples."""

    def run(batches):
        import pyarrow as pa

        for batch, stored in _media(batches, 2):
            rows = []
            for n, own, px in zip(batch.column(1).to_pylist(), stored, decode_payloads(stored), strict=True):
                raw = px.tobytes()
                rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(own), hashlib.sha256(own).hexdigest(), feature(px)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def read_pixels(media: DataFrame) -> DataFrame:
    """The pixel arrays: doc_id, image (from 0), high, wide and rgba, the bytes of its pixels row by row."""

    def run(batches):
        import pyarrow as pa

        for batch, stored in _media(batches, 2):
            files = [list(images(x)) for x in stored]
            px = decode_images([f for own in files for f in own])
            of = np.repeat(np.arange(len(files)), [len(x) for x in files])
            nth = [k for own in files for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(nth, pa.int32()), pa.array([x.shape[0] for x in px], pa.int32()), pa.array([x.shape[1] for x in px], pa.int32()), pa.array([x.tobytes() for x in px], pa.binary())], ["doc_id", "image", "high", "wide", "rgba"])

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, image int, high int, wide int, rgba binary")


def op8_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(write_media(table(spark, sf_dir, "documents")))
