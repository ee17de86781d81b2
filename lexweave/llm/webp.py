"""Lossless WebP: a decoder of the whole format, an encoder, and media columns of byte payloads.

The decoder reads prefix codes (one group or many by a meta image), back-references and the colour cache, and inverts
predictor, cross-colour, subtract-green and palette transforms.  Runs of literals are decoded for all bit positions of a
chunk at once: for each position the lengths of the codes that would start there give the next pixel's position, and one
walk along these picks the pixels.  Meta images and colour caches go pixel by pixel.

A payload of bytes is stored as 8-bit samples, the green channel of opaque pixels, 64 to a row, in images of at most
IMAGE_BYTES each, one after another.  An image has a palette (two, four or eight samples to a pixel where the palette
allows), or predicts samples from the left or from above where that is estimated to be shorter; then come literals by the
image's own prefix code and back-references to what occurred before.  pixel_arrays() gives the decoded samples as columns;
read_back() gives digests of the same arrays.

Defined cases: null and empty texts are 64 zero bytes; equal texts give equal values in every column but doc_id; repeated
rows and ties do not matter; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, documents, stored

#: Samples in a row of a payload's image, and payload bytes of an image at most (16,384 rows); bounds a worker's memory.
ROW, IMAGE_BYTES = 64, 1 << 20
#: Longest code of a sample in payload images, and the shortest back-reference.
CODE_LIMIT, MATCH = 12, 24
#: Bytes of a stream whose bit positions a decoder looks at together.
CHUNK_BYTES = 1 << 16
#: Pixels of one step of a walk, at most 60 bits each, so that a step from within a chunk stays in what is read beyond it.
LEAP = 4

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7))
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Bits of a byte string, the lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        at, self.at = self.at, self.at + n
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


@lru_cache(maxsize=1 << 16)
def _reversed(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2)


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code with its first bit lowest, length), for symbols with a length."""
    out, code = {}, 0
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    last = used[0][0] if used else 0
    for n, symbol in used:
        code <<= n - last
        last = n
        out[symbol] = (_reversed(code, n), n)
        code += 1
    return out


class Code:
    """A prefix code; tables by the next `width` bits give symbol and length. A lone symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [(s, n) for s, n in enumerate(lengths) if n]
        self.width = max((n for _, n in used), default=0)
        if len(used) <= 1:
            self.width, self.symbols, self.sizes = 0, np.array([used[0][0] if used else 0], dtype=np.int32), np.zeros(1, dtype=np.uint8)
        else:
            if sum(2.0**-n for _, n in used) != 1:
                raise ValueError("prefix code is not complete")
            self.symbols, self.sizes = np.zeros(1 << self.width, dtype=np.int32), np.zeros(1 << self.width, dtype=np.uint8)
            for symbol, (code, n) in canonical(lengths).items():
                self.symbols[code :: 1 << n], self.sizes[code :: 1 << n] = symbol, n
        self.steps = self.sizes.astype(np.int64)
        self.literal = bool(self.symbols.max() < 256)
        #: The same for a code of literals and lengths: a length is no step.
        self.literal_steps = self.steps if self.literal else np.where(self.symbols < 256, self.steps, 0)

    def read(self, bits: Bits) -> int:
        if not self.width:
            return int(self.symbols[0])
        k = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 4], "little") >> (bits.at & 7) & ((1 << self.width) - 1)
        bits.at += int(self.steps[k])
        return int(self.symbols[k])


@lru_cache(maxsize=64)
def code_of(lengths: tuple[int, ...]) -> Code:
    """The code of these lengths, without zeros at the end, so that equal codes of different alphabets are one."""
    return Code(list(lengths))


def _code(lengths: list[int]) -> Code:
    n = len(lengths)
    while n > 1 and not lengths[n - 1]:
        n -= 1
    return code_of(tuple(lengths[:n]))


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        second, wide = bits.read(1), bits.read(1)
        for k in range(second + 1):
            lengths[bits.read(8 if k or wide else 1)] = 1
        return _code(lengths)
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[CODE_LENGTH_ORDER[k]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    inner, at, previous = _code(first), 0, 8
    while at < alphabet and left:
        left -= 1
        n = inner.read(bits)
        if n < 16:
            lengths[at] = n
            previous = n or previous
            at += 1
        else:
            value, times = (previous, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
            lengths[at : at + times] = [value] * times
            at += times
    return _code(lengths[:alphabet])


def _run(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


_heads: dict[tuple[int, int], tuple[int, int, list]] = {}


def _codes(bits: Bits, cache_bits: int, groups: int) -> list[list[Code]]:
    size = 1 << cache_bits if cache_bits else 0
    return [[read_code(bits, n) for n in (280 + size, 256, 256, 256, 40)] for _ in range(groups)]


def _read_group(bits: Bits, cache_bits: int, groups: int) -> list[list[Code]]:
    """Prefix codes; those of one group are kept by their bits, as many images share a table."""
    if groups > 1:
        return _codes(bits, cache_bits, groups)
    at = bits.at
    key = (bits.read(256), cache_bits)
    bits.at = at
    known = _heads.get(key)
    if known and bits.read(known[1]) == known[0]:
        return known[2]
    bits.at = at
    codes = _codes(bits, cache_bits, 1)
    used, bits.at = bits.at - at, at
    if len(_heads) < 256:
        _heads[key] = (bits.read(used), used, codes)
    bits.at = at + used
    return codes


class Walk:
    """Runs of literals of one group: where the next pixel starts is found for all bit positions of a chunk at once, and a
    walk along these picks the pixels. A position where no literal starts leads to itself."""

    def __init__(self, bits: Bits, group: list[Code]):
        self.bits, self.codes, self.first, self.limit = bits, group[:4], 0, -1

    def _load(self) -> None:
        bits, (g, r, b, a) = self.bits, self.codes
        self.first = bits.at >> 3
        raw = np.frombuffer(bits.data, np.uint8, min(len(bits.data) - self.first, CHUNK_BYTES + 256), self.first)
        wide = np.zeros(raw.size + 64, dtype=np.int64)
        wide[: raw.size] = raw
        wide = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
        self.window = (wide[:, None] >> np.arange(8)).reshape(-1)
        self.limit = 8 * min(raw.size, CHUNK_BYTES)
        self.end = 8 * (len(bits.data) - self.first)
        last = self.window.size - 1
        here = np.arange(self.window.size)
        ahead = here
        for code in (g, r, b, a):
            if code.width:
                key = self.window if ahead is here else self.window[ahead]
                ahead = ahead + (code.literal_steps if code is g else code.steps)[key & ((1 << code.width) - 1)]
                ahead[-64:] = np.minimum(ahead[-64:], last)  # only there can a step of at most 60 bits leave the window
        if not g.literal and any(code.width for code in (r, b, a)):
            ahead = np.where(g.symbols[self.window & ((1 << g.width) - 1)] >= 256, here, ahead)
        #: Places 1, 2, 4, ... LEAP pixels ahead.
        self.aheads = [ahead]
        while 1 << len(self.aheads) <= LEAP:
            self.aheads.append(self.aheads[-1].take(self.aheads[-1]))
        self.leap = memoryview(self.aheads[-1])

    def __call__(self, most: int) -> np.ndarray:
        """Pixels of the run of literals that starts here, at most `most`; the bits' place moves behind it."""
        bits, parts, left = self.bits, [], most
        while left:
            if not 0 <= bits.at - 8 * self.first < self.limit:
                self._load()
            leap, at, limit, places = self.leap, bits.at - 8 * self.first, self.limit, []
            add = places.append
            for _ in range(-(-left // LEAP)):  # LEAP pixels at a time
                add(at)
                step = leap[at]
                if step == at:
                    break
                at = step
                if at >= limit:
                    break
            many = np.empty((len(places), LEAP), dtype=np.int64)
            many[:, 0] = places
            for k in range(len(self.aheads) - 2, -1, -1):  # those between, by halves
                half = 1 << k
                many[:, half :: 2 * half] = self.aheads[k].take(many[:, :: 2 * half])
            place = many.reshape(-1)
            after = self.aheads[0].take(place)
            stops = np.flatnonzero(after == place)  # no literal starts there
            n = min(left, int(stops[0]) if stops.size else place.size)
            at = int(after[n - 1]) if n else bits.at - 8 * self.first
            if at > self.end:
                raise ValueError("the data end within a pixel")
            bits.at = 8 * self.first + at
            left -= n
            parts.append(self._pixels(place[:n]))
            if stops.size or at >= self.end:
                break
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)

    def _pixels(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(place.size, dtype=np.uint32)
        for code, left in zip(self.codes, (8, 16, 0, 24), strict=True):
            if code.width:
                k = self.window.take(place) & ((1 << code.width) - 1)
                out |= code.symbols[k].astype(np.uint32) << np.uint32(left)
                place = place + code.sizes[k]
            else:
                out |= np.uint32(int(code.symbols[0]) << left)
        return out


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, flat."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, block = None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = _blocks(width, block)
        meta = (read_pixels(bits, across, (height + (1 << block) - 1) >> block, False) >> np.uint32(8)) & np.uint32(0xFFFF)
    groups = _read_group(bits, cache_bits, 1 if meta is None else int(meta.max()) + 1)
    total = width * height
    out = np.zeros(total, dtype=np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else None
    at, kept = 0, 0
    walk = Walk(bits, groups[0]) if meta is None and cache is None and any(c.width for c in groups[0][:4]) else None
    while at < total:
        if walk:
            literals = walk(total - at)
            out[at : at + literals.size] = literals
            at += literals.size
            if at == total:
                break
            group = groups[0]
        else:
            group = groups[0] if meta is None else groups[int(meta[(at // width >> block) * across + (at % width >> block)])]
        if bits.at > 8 * len(bits.data):
            raise ValueError("the data end within the image")
        green = group[0].read(bits)
        if green < 256 and meta is None and cache is None and not any(c.width for c in group[:4]):
            red, blue, alpha = (int(c.symbols[0]) for c in group[1:4])
            out[at:] = alpha << 24 | red << 16 | green << 8 | blue  # every pixel takes no bits
            at = total
        elif green < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | green << 8 | blue
            at += 1
        elif green < 280:
            length, far = _run(bits, green - 256), _run(bits, group[4].read(bits))
            if far > 120:
                far -= 120
            else:
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            if far > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            if far >= length:
                out[at : at + length] = out[at - far : at - far + length]
            else:
                out[at : at + length] = np.resize(out[at - far : at], length)
            at += length
        else:
            while kept < at:
                colour = int(out[kept])
                cache[(CACHE_FACTOR * colour & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
                kept += 1
            out[at] = cache[green - 280]
            at += 1
    return out


def _blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _average(a, b):
    return ((a.astype(np.int16) + b.astype(np.int16)) >> 1).astype(np.uint8)


def _predict(mode: int, left, top, right, corner) -> np.ndarray:
    """The prediction of a pixel's four channels from its neighbours."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255], dtype=np.uint8)
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode < 11:
        return (lambda: _average(_average(left, right), top), lambda: _average(left, corner), lambda: _average(left, top), lambda: _average(corner, top), lambda: _average(top, right), lambda: _average(_average(left, corner), _average(top, right)))[mode - 5]()
    i = [x.astype(np.int16) for x in (left, top, corner)]
    if mode == 11:
        return left if np.abs(i[1] - i[2]).sum() < np.abs(i[0] - i[2]).sum() else top
    if mode == 12:
        return np.clip(i[0] + i[1] - i[2], 0, 255).astype(np.uint8)
    mean = _average(left, top).astype(np.int16)
    half = (mean - i[2]).astype(np.int32)
    return np.clip(mean + np.sign(half) * (np.abs(half) >> 1), 0, 255).astype(np.uint8)


def _along(channels: np.ndarray, mode: int, forward: bool) -> np.ndarray:
    """As _predicted, where every block predicts from the left (1) or from above (2): differences and sums along rows and columns."""
    out, start = channels.copy(), np.array([0, 0, 0, 255], dtype=np.uint8)
    if forward:
        out[0, 0] -= start
        out[0, 1:] -= channels[0, :-1]
        out[1:, 0] -= channels[:-1, 0]
        out[1:, 1:] -= channels[1:, :-1] if mode == 1 else channels[:-1, 1:]
        return out
    out[0, 0] += start
    if mode == 1:
        out[:, 0] = out[:, 0].cumsum(axis=0, dtype=np.uint8)
        return out.cumsum(axis=1, dtype=np.uint8)
    out[0] = out[0].cumsum(axis=0, dtype=np.uint8)
    return out.cumsum(axis=0, dtype=np.uint8)


def _predicted(channels: np.ndarray, modes: np.ndarray, block: int, forward: bool) -> np.ndarray:
    """Residuals to pixels, or pixels to residuals; channels (height, width, 4) in memory order blue, green, red, alpha."""
    height, width, _ = channels.shape
    if np.isin(modes, (1, 2)).all() and (modes == modes[0]).all():
        return _along(channels, int(modes[0]), forward)
    across, flat, done = _blocks(width, block), channels.reshape(-1, 4), channels.reshape(-1, 4).copy()
    known = flat if forward else done
    for at in range(height * width):
        y, x = divmod(at, width)
        if not at:
            guess = np.array([0, 0, 0, 255], dtype=np.uint8)
        elif not y:
            guess = known[at - 1]
        elif not x:
            guess = known[at - width]
        else:
            guess = _predict(int(modes[(y >> block) * across + (x >> block)]), known[at - 1], known[at - width], known[at - width + 1], known[at - width - 1])
        done[at] = flat[at] - guess if forward else flat[at] + guess
    return done.reshape(channels.shape)


def _crossed(channels: np.ndarray, elements: np.ndarray, block: int, forward: bool) -> np.ndarray:
    height, width, _ = channels.shape
    across = _blocks(width, block)
    y, x = np.mgrid[0:height, 0:width]
    element = elements[(y >> block) * across + (x >> block)]
    to = [((element >> np.uint32(s)) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32) for s in (0, 8, 16)]  # green to red, green to blue, red to blue
    delta = lambda t, c: (t * c.view(np.int8).astype(np.int32)) >> 5
    blue, green, red = (np.ascontiguousarray(channels[:, :, k]) for k in range(3))
    sign = -1 if forward else 1
    new_red = (red + sign * delta(to[0], green)).astype(np.uint8)
    out = channels.copy()
    out[:, :, 2] = new_red
    out[:, :, 0] = (blue + sign * (delta(to[1], green) + delta(to[2], red if forward else new_red))).astype(np.uint8)
    return out


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width) as unsigned 32-bit alpha, red, green, blue of one lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    transforms, stored_width = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            transforms.append((kind, stored_width, block, read_pixels(bits, _blocks(stored_width, block), _blocks(height, block), False)))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, stored_width, 0, None))
        else:
            size = bits.read(8) + 1
            colours = read_pixels(bits, size, 1, False).view(np.uint8).reshape(-1, 4).cumsum(axis=0, dtype=np.uint8)
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            transforms.append((kind, stored_width, pack, np.ascontiguousarray(colours).view(np.uint32).reshape(-1)))
            stored_width = _blocks(stored_width, pack)
    pixels = read_pixels(bits, stored_width, height, True)
    for kind, width_, block, extra in reversed(transforms):
        if kind == PALETTE:
            index = ((pixels >> np.uint32(8)) & np.uint32(255)).reshape(height, -1)
            per = 8 >> block
            index = ((index[:, :, None] >> (np.arange(1 << block, dtype=np.uint32) * np.uint32(per))) & np.uint32((1 << per) - 1)).reshape(height, -1)[:, :width_]
            table = np.zeros(256, dtype=np.uint32)
            table[: extra.size] = extra
            pixels = table[index].reshape(-1)
            continue
        channels = np.ascontiguousarray(pixels).view(np.uint8).reshape(height, width_, 4)
        if kind == SUBTRACT_GREEN:
            channels = channels.copy()
            channels[:, :, 0] += channels[:, :, 1]
            channels[:, :, 2] += channels[:, :, 1]
        elif kind == PREDICTOR:
            channels = _predicted(channels, (extra >> np.uint32(8)) & np.uint32(255), block, False)
        else:
            channels = _crossed(channels, extra, block, False)
        pixels = np.ascontiguousarray(channels).view(np.uint32).reshape(-1)
    return pixels.reshape(height, width)


class Writer:
    """Bits as one number; for heads and small images."""

    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def code_lengths(counts: list[int], limit: int) -> list[int]:
    """Lengths of a prefix code of at most `limit` bits: counts are raised until the tree is flat enough."""
    used = [s for s, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            out[s] = 1
        return out
    least = 1
    while True:
        heap = [(max(counts[s], least), k) for k, s in enumerate(used)]
        heapq.heapify(heap)
        parent, k = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            n, a = heapq.heappop(heap)
            m, b = heap[0]
            parent[a] = parent[b] = k
            heapq.heapreplace(heap, (n + m, k))
            k += 1
        depth = [0] * k
        for node in range(k - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[: len(used)]) <= limit:
            for s, n in zip(used, depth, strict=False):
                out[s] = n
            return out
        least *= 2


def write_code(w: Writer, lengths: list[int]) -> None:
    """A code's lengths; a code with at most one symbol, or two small ones, in the short form."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        w.put(1, 1)
        w.put(int(len(used) == 2), 1)
        w.put(1, 1)
        for s in used or [0]:
            w.put(s, 8)
        return
    w.put(0, 1)
    tokens = []
    for n, run in groupby(lengths):
        times = len(list(run))
        while not n and times >= 3:
            part = min(times, 138)
            tokens.append((18, part - 11, 7) if part >= 11 else (17, part - 3, 3))
            times -= part
        tokens += [(n, 0, 0)] * times
    counts = [0] * 19
    for n, _, _ in tokens:
        counts[n] += 1
    if sum(map(bool, counts)) == 1:
        counts[0 if not counts[0] else 1] += 1
    inner = code_lengths(counts, 7)
    last = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if inner[s] or k < 4)
    w.put(last - 3, 4)
    for s in CODE_LENGTH_ORDER[: last + 1]:
        w.put(inner[s], 3)
    w.put(0, 1)
    codes = canonical(inner)
    for n, extra, size in tokens:
        code, bits = codes[n]
        w.put(code | extra << bits, bits + size)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits' value and count for a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    return 2 * extra + 2 + ((value >> extra) & 1), value & ((1 << extra) - 1), extra


def write_pixels(w: Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, references: bool = True, meta: tuple[int, np.ndarray] | None = None) -> None:
    """An entropy-coded image, pixel by pixel: literals, runs of earlier pixels, colours in the cache."""
    flat = pixels.reshape(-1).tolist()
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups, block, group_of = 1, 0, None
    if main:
        w.put(int(meta is not None), 1)
        if meta is not None:
            block, group_of = meta
            w.put(block - 2, 3)
            write_pixels(w, group_of.astype(np.uint32) << np.uint32(8), _blocks(width, block), False)
            groups = int(group_of.max()) + 1
    cache, seen, tokens, at = [0] * (1 << cache_bits), {}, [], 0
    while at < len(flat):
        g = 0 if group_of is None else int(group_of.reshape(-1)[(at // width >> block) * _blocks(width, block) + (at % width >> block)])
        best, from_ = 0, seen.get(tuple(flat[at : at + 3])) if references else None
        if from_ is not None:
            while best < 4096 and at + best < len(flat) and flat[from_ + best] == flat[at + best]:
                best += 1
        key = (CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if best >= 3:
            far = at - from_
            near = [k for k, (dx, dy) in enumerate(NEAR) if max(1, dx + dy * width) == far]
            tokens.append((g, 256 + _prefix(best)[0], _prefix(best)[1:], _prefix(near[0] + 1 if near else far + 120)))
            n = best
        else:
            tokens.append((g, 280 + key, None, None) if cache_bits and cache[key] == flat[at] and at else (g, flat[at] >> 8 & 255, flat[at], None))
            n = 1
        for k in range(at, at + n):
            seen[tuple(flat[k : k + 3])] = k
            if cache_bits:
                cache[(CACHE_FACTOR * flat[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[k]
        at += n
    counts = [[[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(groups)]
    for g, green, extra, far in tokens:
        counts[g][0][green] += 1
        if far is not None:
            counts[g][4][far[0]] += 1
        elif green < 256:
            for k, s in ((1, 16), (2, 0), (3, 24)):
                counts[g][k][extra >> s & 255] += 1
    lengths = [[code_lengths(c, 15) for c in group] for group in counts]
    for group in lengths:
        for n in group:
            write_code(w, n)
    codes = [[canonical(n) if sum(map(bool, n)) > 1 else {} for n in group] for group in lengths]
    for g, green, extra, far in tokens:
        c = codes[g]
        w.put(*c[0].get(green, (0, 0)))
        if far is not None:
            w.put(*extra)
            w.put(*c[4].get(far[0], (0, 0)))
            w.put(*far[1:])
        elif green < 256:
            for k, s in ((1, 16), (2, 0), (3, 24)):
                w.put(*c[k].get(extra >> s & 255, (0, 0)))


def _file(stream: bytes) -> bytes:
    stream = b"\x2f" + stream
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: bool = True, meta: tuple[int, np.ndarray] | None = None) -> bytes:
    """A lossless WebP file of pixels (height, width). transforms, in order: (PREDICTOR, block, modes), (CROSS_COLOUR, block, elements), (SUBTRACT_GREEN,), (PALETTE,)."""
    height, width = pixels.shape
    w = Writer()
    for value, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    pixels = np.ascontiguousarray(pixels, dtype=np.uint32)
    for kind, *rest in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        channels = pixels.view(np.uint8).reshape(height, width, 4).copy()
        if kind == PALETTE:
            colours, index = np.unique(pixels, return_inverse=True)
            w.put(colours.size - 1, 8)
            steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
            write_pixels(w, np.ascontiguousarray(steps).view(np.uint32), colours.size, False)
            pack = 3 if colours.size <= 2 else 2 if colours.size <= 4 else 1 if colours.size <= 16 else 0
            across = _blocks(width, pack)
            wide = np.zeros((height, across << pack), dtype=np.uint32)
            wide[:, :width] = index.reshape(height, width)
            per = np.arange(1 << pack, dtype=np.uint32) * np.uint32(8 >> pack)
            pixels = np.bitwise_or.reduce(wide.reshape(height, across, -1) << per, axis=2) << np.uint32(8) | np.uint32(0xFF000000)
            width = across
            continue
        if kind == SUBTRACT_GREEN:
            channels[:, :, 0] -= channels[:, :, 1]
            channels[:, :, 2] -= channels[:, :, 1]
        else:
            block, extra = rest
            w.put(block - 2, 3)
            extra = np.ascontiguousarray(extra, dtype=np.uint32).reshape(-1)
            write_pixels(w, extra << np.uint32(8) if kind == PREDICTOR else extra, _blocks(width, block), False)
            channels = _predicted(channels, extra, block, True) if kind == PREDICTOR else _crossed(channels, extra, block, True)
        pixels = np.ascontiguousarray(channels).view(np.uint32).reshape(height, width)
    w.put(0, 1)
    write_pixels(w, pixels, width, True, cache_bits, references, meta)
    return _file(w.bytes())


def _repeats(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of back-references, in order: MATCH samples or more that occurred before.

    The nearest earlier occurrence of every window of MATCH samples comes from one sort of the windows' hashes."""
    n = samples.size - MATCH + 1
    if n < 2:
        return []
    raw = samples.tobytes() + bytes(8)
    words = np.zeros(samples.size + 8, dtype=np.uint64)
    for k in range(8):
        part = np.frombuffer(raw, "<u8", (len(raw) - k) // 8, k)
        words[k : k + 8 * part.size : 8] = part
    hashes = np.zeros(n, dtype=np.uint64)
    for k in range(0, MATCH, 8):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    # The hash's high bits and the place in one number: a plain sort of these gives equal hashes in order of place.
    low = np.uint64((1 << n.bit_length()) - 1)
    keyed = np.sort((hashes * np.uint64(0x9E3779B97F4A7C15)) & ~low | np.arange(n, dtype=np.uint64))
    same = np.flatnonzero((keyed[1:] ^ keyed[:-1]) <= low)
    if not same.size:
        return []
    order = (keyed & low).astype(np.int64)
    earlier = np.full(n, -1, dtype=np.int64)
    earlier[order[same + 1]] = order[same]
    places = np.flatnonzero(earlier >= 0)
    out, at, k = [], 0, 0
    while k < places.size:
        place = int(places[k])
        from_, most = int(earlier[place]), min(4096, samples.size - place)
        other = np.flatnonzero(samples[place : place + most] != samples[from_ : from_ + most])
        length = int(other[0]) if other.size else most
        if length >= MATCH:
            out.append((place, length, place - from_))
            at = place + length
            k = int(np.searchsorted(places, at))
        else:
            k += 1
    return out


def _bits_of(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their sizes by symbol; a lone symbol takes no bits."""
    value, size = np.zeros(len(lengths), dtype=np.uint64), np.zeros(len(lengths), dtype=np.int64)
    if sum(map(bool, lengths)) > 1:
        for s, (code, bits) in canonical(lengths).items():
            value[s], size[s] = code, bits
    return value, size


def _put_all(start: Writer, value: np.ndarray, size: np.ndarray) -> bytes:
    """What start holds, then every value in its size of bits, summed into 64-bit words."""
    ends = np.cumsum(size) + start.size
    at = ends - size
    total = int(ends[-1])
    words = np.zeros((total >> 6) + 2, dtype=np.uint64)
    lead = start.value.to_bytes(-(-start.size // 64) * 8, "little")
    words[: len(lead) // 8] = np.frombuffer(lead, "<u8")
    word, within = at >> 6, (at & 63).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] |= np.bitwise_or.reduceat(value << within, first)
    over = np.flatnonzero((ends - 1) >> 6 > word)
    words[word[over] + 1] |= value[over] >> (np.uint64(64) - within[over])
    return words.tobytes()[: (total + 7) // 8]


def _write_palette(w: Writer, used: np.ndarray) -> None:
    """The palette of opaque colours with these green samples, as steps from one to the next, in literals."""
    steps = np.diff(used, prepend=0).tolist()
    lengths = code_lengths(np.bincount(steps, minlength=280).tolist(), 15)
    w.put(0, 1)  # no colour cache
    write_code(w, lengths)
    for lone in (0, 0):
        w.put(0b101 | lone << 3, 11)
    many = len(steps) > 1
    w.put(0b111 | 0 << 3 | 255 << 11 if many else 0b101 | 255 << 3, 19 if many else 11)  # alpha: 255, then steps of 0
    w.put(0b101, 11)
    codes = canonical(lengths) if sum(map(bool, lengths)) > 1 else {}
    for k, step in enumerate(steps):
        w.put(*codes.get(step, (0, 0)))
        w.put(int(many and not k), int(many))


def _write_samples(start: Writer, samples: np.ndarray, width: int, alpha: int) -> bytes:
    """The main image: samples in green, the other channels the same everywhere; literals and back-references."""
    refs = _repeats(samples)
    literal = np.ones(samples.size, dtype=bool)
    for place, length, _ in refs:
        literal[place : place + length] = False
    at = np.flatnonzero(literal)
    near = _near(width)
    ends = [(place, _prefix(length), _prefix(near.get(far, far + 120))) for place, length, far in refs]
    green = np.bincount(samples[at], minlength=280).tolist()
    far = [0] * 40
    for _, a, b in ends:
        green[256 + a[0]] += 1
        far[b[0]] += 1
    lengths = code_lengths(green, CODE_LIMIT), code_lengths(far, 15)
    for _ in range(2):
        start.put(0, 1)  # no colour cache, no meta image
    write_code(start, lengths[0])
    for lone in (0, 0, alpha):
        start.put(0b101 | lone << 3, 11)  # the short form: one symbol, in eight bits
    write_code(start, lengths[1])
    (value, size), (far_value, far_size) = map(_bits_of, lengths)
    places, values, sizes = [at * 4], [value[samples[at]]], [size[samples[at]]]
    if ends:
        where = np.array([e[0] for e in ends]) * 4
        a, b = (np.array([e[k] for e in ends]) for k in (1, 2))
        places += [where, where + 1, where + 2, where + 3]
        values += [value[256 + a[:, 0]], a[:, 1].astype(np.uint64), far_value[b[:, 0]], b[:, 1].astype(np.uint64)]
        sizes += [size[256 + a[:, 0]], a[:, 2], far_size[b[:, 0]], b[:, 2]]
    order = np.argsort(np.concatenate(places), kind="stable")
    return _put_all(start, np.concatenate(values)[order], np.concatenate(sizes)[order])


@lru_cache(maxsize=64)
def _near(width: int) -> dict[int, int]:
    """Short codes of distances in images of a width."""
    return {max(1, dx + dy * width): k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR)))}


def _cost(samples: np.ndarray, more: float) -> float:
    """An estimate of the bits that samples take: their entropy, a code length for each symbol, and `more` for each."""
    counts = np.bincount(samples, minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(samples.size / counts)).sum()) + (5 + more) * counts.size


def encode_payload(payload: bytes) -> bytes:
    """A lossless WebP file whose pixels' green samples are the payload's bytes, ROW to a row.

    The palette transform, or prediction from the left or from above, goes first: whichever is estimated to be shortest."""
    raw = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    w = Writer()
    for value, n in ((ROW - 1, 14), (raw.shape[0] - 1, 14), (1, 1), (0, 3), (1, 1)):
        w.put(value, n)
    used = np.flatnonzero(np.bincount(raw.reshape(-1), minlength=256))
    entry = np.zeros(256, dtype=np.uint8)
    entry[used] = np.arange(used.size)
    index = entry[raw]
    pack = 3 if used.size <= 2 else 2 if used.size <= 4 else 1 if used.size <= 16 else 0
    index = np.bitwise_or.reduce(index.reshape(raw.shape[0], -1, 1 << pack) << (np.arange(1 << pack, dtype=np.uint8) * np.uint8(8 >> pack)), axis=2)
    costs = [_cost(index.reshape(-1), 5), *(_cost(_residual(raw, mode).reshape(-1), 0) for mode in (1, 2))]
    best = costs.index(min(costs))
    if best == 0:
        w.put(PALETTE, 2)
        w.put(used.size - 1, 8)
        _write_palette(w, used)
        samples = index
    else:
        block = 9
        w.put(PREDICTOR, 2)
        w.put(block - 2, 3)
        n = _blocks(ROW, block) * _blocks(raw.shape[0], block)
        write_pixels(w, np.full(n, best << 8, dtype=np.uint32), _blocks(ROW, block), False)
        samples = _residual(raw, best)
    w.put(0, 1)
    alpha = 0 if best else 255  # pixels are opaque; a prediction is, too
    return _file(_write_samples(w, samples.reshape(-1), samples.shape[1], alpha))


def _residual(raw: np.ndarray, mode: int) -> np.ndarray:
    out = raw.copy()
    out[0, 1:] -= raw[0, :-1]
    out[1:, 0] -= raw[:-1, 0]
    out[1:, 1:] -= raw[1:, :-1] if mode == 1 else raw[:-1, 1:]
    return out


def pack_text(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def encode_media(payload: bytes) -> bytes:
    return b"".join(encode_payload(payload[at : at + IMAGE_BYTES]) for at in range(0, len(payload), IMAGE_BYTES))


def files(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield media[at : at + size]
        at += size


def sample_arrays(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of a media value's images: green samples, (height, width) of unsigned 8 bits."""
    return [((decode(f) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8) for f in files(media)]


def decode_media(media: bytes) -> bytes:
    return b"".join(x.tobytes() for x in sample_arrays(media))


def feature(payload: bytes) -> str:
    """A short description of the samples: their mean, spread and the shares of 16 ranges, in thousandths."""
    raw = np.frombuffer(payload, np.uint8)
    counts = np.bincount(raw, minlength=256)
    values = np.arange(256)
    mean = float((counts * values).sum()) / raw.size
    spread = float((counts * (values - mean) ** 2).sum() / raw.size) ** 0.5
    return f"mean={mean:.3f};std={spread:.3f};hist=" + ",".join(str(int(1000 * c // raw.size)) for c in counts.reshape(16, 16).sum(axis=1).tolist())


MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
BACK = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text as lossless WebP files."""

    def make():
        def batch(rows: dict) -> dict:
            packed = [pack_text(t) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "n_bytes": [n for n, _ in packed], "media": [encode_media(p) for _, p in packed]}

        return batch

    return arrow_map(docs.select("doc_id", "text"), make, MEDIA)


PIXELS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("images", T.ArrayType(T.StructType([
        T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("samples", T.BinaryType()),
    ]))),
])


def pixel_arrays(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, images: the decoded pixel arrays of each media value, rows of samples one after another."""

    def make():
        def batch(rows: dict) -> dict:
            images = [[{"height": x.shape[0], "width": x.shape[1], "samples": x.tobytes()} for x in sample_arrays(m)] for m in rows["media"]]
            return {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "images": images}

        return batch

    return arrow_map(media.select("doc_id", "n_bytes", "media"), make, PIXELS)


def read_back(media: DataFrame) -> DataFrame:
    """Digests and features of the decoded pixel arrays, and of the stored form."""

    def row(doc_id: int | None, n_bytes: int, stored_form: bytes) -> tuple:
        payload = decode_media(stored_form)
        digest, form = hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored_form).hexdigest()
        return doc_id, n_bytes, len(payload), digest, zlib.crc32(payload[-64:]), len(stored_form), form, feature(payload)

    def make():
        return lambda rows: dict(zip(BACK.names, zip(*map(row, rows["doc_id"], rows["n_bytes"], rows["media"]), strict=True), strict=True))

    return arrow_map(media.select("doc_id", "n_bytes", "media"), make, BACK)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the media column as a table in the shared folder and reads it back."""
    return read_back(stored(media_column(documents(spark, sf_dir)), "media"))
