"""Lossless WebP: a decoder for whole files, and an encoder for grey images.

Pixels are unsigned 32-bit ARGB. The decoder reads prefix codes, back-references and the colour cache, and inverts the predictor,
cross-colour, subtract-green and palette transforms. Images whose red, blue and alpha codes have one symbol each and that use no
cache and no groups (as the encoder's) are decoded for all bit positions at once.
"""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: the order of code length codes, and the (x, y) steps of the first 120 distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
STEPS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
MAX_BITS = 15
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Reads bits, the lowest of a byte first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > len(self.data) * 8:
            raise ValueError("the image data ends early")
        return value


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The bit-reversed canonical code of each symbol with a length."""
    symbols = np.flatnonzero(lengths)
    order = symbols[np.lexsort((symbols, lengths[symbols]))]
    size = lengths[order].astype(np.int64)
    # in units of the longest code each code begins where the last one ended
    top = np.concatenate([[0], np.cumsum(1 << (MAX_BITS - size))[:-1]])
    codes = np.zeros(len(lengths), np.int64)
    value = top
    out = np.zeros_like(value)
    for _ in range(MAX_BITS):
        out = out << 1 | (value & 1)
        value = value >> 1
    codes[order] = out & ((1 << size) - 1)
    return codes


class Code:
    """A prefix code as a table over the next 15 bits: symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code has no symbol")
        self.single = int(used[0]) if len(used) == 1 else -1
        if self.single >= 0:
            self.table = np.full(1 << MAX_BITS, self.single << 4, np.int32)
            return
        size = lengths[used].astype(np.int64)
        if (1 << (MAX_BITS - size)).sum() != 1 << MAX_BITS:
            raise ValueError("a prefix code is not complete")
        order = used[np.lexsort((used, size))]
        each = lengths[order].astype(np.int64)
        sorted_ = np.repeat((order << 4 | each).astype(np.int32), 1 << (MAX_BITS - each))
        self.table = sorted_[_reversed()]

    def read(self, bits: Bits) -> int:
        if self.single >= 0:
            return self.single
        byte = bits.at >> 3
        entry = int(self.table[int.from_bytes(bits.data[byte : byte + 4], "little") >> (bits.at & 7) & 0x7FFF])
        bits.at += entry & 15
        return entry >> 4


_reverse: list[np.ndarray] = []


def _reversed() -> np.ndarray:
    if not _reverse:
        value, out = np.arange(1 << MAX_BITS), np.zeros(1 << MAX_BITS, np.int64)
        for _ in range(MAX_BITS):
            out, value = out << 1 | (value & 1), value >> 1
        _reverse.append(out)
    return _reverse[0]


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):  # one or two symbols
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    of_lengths = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + bits.read(4)]:
        of_lengths[k] = bits.read(3)
    code = Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        k = code.read(bits)
        if k < 16:
            lengths[at] = k
            at += 1
            before = k or before
        else:
            value, n = (before, 3 + bits.read(2)) if k == 16 else (0, 3 + bits.read(3)) if k == 17 else (0, 11 + bits.read(7))
            if at + n > alphabet:
                raise ValueError("code lengths run over")
            lengths[at : at + n] = value
            at += n
    return Code(lengths)


def _value(prefix: int, bits: Bits) -> int:
    """A length or distance from its prefix and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = STEPS[code - 1]
    return max(1, x + y * width)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, tile, tiles = 1, 0, None
    if main and bits.read(1):
        tile = bits.read(3) + 2
        tiles = (read_pixels(bits, (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False) >> 8) & 0xFFFF
        groups = int(tiles.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    total = width * height
    if groups == 1 and not cache_bits and all(c.single >= 0 for c in codes[0][1:4]):
        return _read_green(bits, width, total, codes[0]).reshape(height, width)
    out = np.zeros(total, np.uint32)
    cache = np.zeros(cache_size, np.uint32)
    shift = 32 - cache_bits
    at = cached = 0

    def catch_up(cached: int, at: int) -> int:
        if cache_bits:
            for v in out[cached:at].tolist():
                cache[(v * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = v
        return at

    while at < total:
        y, x = divmod(at, width)
        green, red, blue, alpha, far = codes[int(tiles[y >> tile, x >> tile]) if tiles is not None else 0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = _value(s - 256, bits)
            d = _distance(_value(far.read(bits), bits), width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            if d >= n:
                out[at : at + n] = out[at - d : at - d + n]
            else:
                out[at : at + n] = np.resize(out[at - d : at], n)
            at += n
        else:
            cached = catch_up(cached, at)
            out[at] = cache[s - 280]
            at += 1
    return out.reshape(height, width)


def _read_green(bits: Bits, width: int, total: int, codes: list[Code]) -> np.ndarray:
    """An image in which only green varies: what a symbol at any bit position would be is looked up for all positions at once;
    then the chain of real positions is followed."""
    green, red, blue, alpha, far = codes
    rest = np.uint32(alpha.single << 24 | red.single << 16 | blue.single)
    if green.single >= 0 and green.single < 256:
        return np.full(total, rest | np.uint32(green.single << 8), np.uint32)
    data = np.frombuffer(bits.data, np.uint8)[bits.at >> 3 :]
    data = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    words = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16)
    entry = green.table[((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(0x7FFF)).reshape(-1)]
    nxt = (entry & 15) + np.arange(len(entry), dtype=np.int32)
    base = bits.at & ~7
    copies: dict[int, tuple[int, int]] = {}
    chain, p, seen, left = [], bits.at & 7, memoryview(nxt), total
    has_copies = int(green.table.max()) >> 4 >= 256
    limit = len(entry) - 24
    if has_copies:
        kinds = memoryview(entry)
        while left > 0:
            if p > limit:
                raise ValueError("the image data ends early")
            chain.append(p)
            if kinds[p] >= 4096:
                bits.at = base + seen[p]
                n = _value((kinds[p] >> 4) - 256, bits)
                d = _distance(_value(far.read(bits), bits), width)
                copies[len(chain) - 1] = (n, d)
                left -= n
                p = bits.at - base
            else:
                left -= 1
                p = seen[p]
    else:
        for _ in range(total):
            chain.append(p)
            p = seen[p]
        if p > limit + 16:
            raise ValueError("the image data ends early")
    bits.at = base + p
    symbols = (entry[np.asarray(chain, np.int64)] >> 4).astype(np.uint8)
    if copies:
        out, raw, done = bytearray(), symbols.tobytes(), 0
        for i, (n, d) in copies.items():
            out += raw[done:i]
            done = i + 1
            if d > len(out):
                raise ValueError("a back-reference leaves the image")
            out += out[-d : len(out) - d + n] if d >= n else (out[-d:] * (n // d + 1))[:n]
        out += raw[done:]
        symbols = np.frombuffer(bytes(out[:total]), np.uint8)
    return rest | symbols.astype(np.uint32) << np.uint32(8)


def _channels(v: int) -> tuple[int, int, int, int]:
    return v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255


def _joined(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def _mean(a: int, b: int) -> int:
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _select(left: int, top: int, corner: int) -> int:
    """Left or top, whichever is nearer to left + top - corner."""
    to_left = sum(abs(t - c) for t, c in zip(_channels(top), _channels(corner)))
    to_top = sum(abs(l - c) for l, c in zip(_channels(left), _channels(corner)))
    return left if to_left < to_top else top


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predicted pixel; right and corner are those above to the right and left."""
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode < 11:
        return (lambda: _mean(_mean(left, right), top), lambda: _mean(left, corner), lambda: _mean(left, top), lambda: _mean(corner, top), lambda: _mean(top, right), lambda: _mean(_mean(left, corner), _mean(top, right)))[mode - 5]()
    if mode == 11:
        return _select(left, top, corner)
    clamp = lambda v: min(255, max(0, v))
    if mode == 12:
        return _joined(clamp(l + t - c) for l, t, c in zip(_channels(left), _channels(top), _channels(corner)))
    return _joined(clamp(m + int((m - c) / 2)) for m, c in zip(_channels(_mean(left, top)), _channels(corner)))


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    height, width = pixels.shape
    done: list[list[int]] = []
    residual = pixels.tolist()
    for y in range(height):
        row: list[int] = []
        for x in range(width):
            if y == 0:
                guess = row[x - 1] if x else 0xFF000000
            elif x == 0:
                guess = done[y - 1][0]
            else:
                above = done[y - 1]
                guess = predict(int(modes[y >> tile, x >> tile]), row[x - 1], above[x], above[x + 1] if x + 1 < width else row[0], above[x - 1])
            v = residual[y][x]
            row.append(((v & 0xFF00FF) + (guess & 0xFF00FF) & 0xFF00FF) | ((v & 0xFF00FF00) + (guess & 0xFF00FF00) & 0xFF00FF00))
        done.append(row)
    return np.array(done, np.uint32)


def undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    height, width = pixels.shape
    each = np.repeat(np.repeat(factors, 1 << tile, 0), 1 << tile, 1)[:height, :width]
    signed = lambda v, shift: ((v >> np.uint32(shift)) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(pixels, 8)
    red = (signed(pixels, 16) + (signed(each, 0) * green >> 5)) & 255
    blue = signed(pixels, 0) + (signed(each, 8) * green >> 5)
    blue = (blue + (signed(each, 16) * red.astype(np.uint8).view(np.int8).astype(np.int32) >> 5)) & 255
    return pixels & np.uint32(0xFF00FF00) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> np.uint32(8) & np.uint32(255)
    return pixels & np.uint32(0xFF00FF00) | ((pixels & np.uint32(0xFF00FF)) + (green << np.uint32(16) | green)) & np.uint32(0xFF00FF)


def undo_palette(pixels: np.ndarray, colours: np.ndarray, width: int, packed: int) -> np.ndarray:
    index = pixels >> np.uint32(8) & np.uint32(255)
    if packed:
        bits = 8 >> packed
        parts = index[:, :, None] >> (np.arange(1 << packed, dtype=np.uint32) * np.uint32(bits)) & np.uint32((1 << bits) - 1)
        index = parts.reshape(len(index), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index]


def decode(file: bytes) -> np.ndarray:
    """The ARGB pixels (height x width) of a lossless WebP file."""
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP" or file[12:16] != b"VP8L":
        raise ValueError("not a lossless WebP file")
    bits = Bits(file[20 : 20 + struct.unpack("<I", file[16:20])[0]])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            side = 1 << tile
            image = read_pixels(bits, (inner + side - 1) >> tile, (height + side - 1) >> tile, False)
            undo.append((kind, image, tile))
        elif kind == PALETTE:
            size = bits.read(8) + 1
            deltas = read_pixels(bits, size, 1, False)[0]
            channels = np.cumsum(deltas.astype("<u4").view(np.uint8).reshape(-1, 4), 0, dtype=np.uint64).astype(np.uint8)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, np.ascontiguousarray(channels).view("<u4").reshape(-1).astype(np.uint32), (inner, packed)))
            inner = (inner + (1 << packed) - 1) >> packed
        else:
            undo.append((kind, None, None))
    pixels = read_pixels(bits, inner, height, True)
    for kind, image, how in reversed(undo):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, image >> np.uint32(8) & np.uint32(255), how)
        elif kind == CROSS_COLOUR:
            pixels = undo_cross_colour(pixels, image, how)
        elif kind == PALETTE:
            pixels = undo_palette(pixels, image, *how)
        else:
            pixels = undo_subtract_green(pixels)
    return pixels


class Writer:
    """Collects (value, number of bits), the lowest bit first."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, size: int) -> None:
        self.values.append(value)
        self.sizes.append(size)

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.extend(values.tolist())
        self.sizes.extend(sizes.tolist())

    def pack(self, more: tuple[np.ndarray, np.ndarray] | None = None) -> bytes:
        values, sizes = np.asarray(self.values, np.uint64), np.asarray(self.sizes, np.int64)
        if more is not None:
            values, sizes = np.concatenate([values, more[0].astype(np.uint64)]), np.concatenate([sizes, more[1].astype(np.int64)])
        at = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        shifted = values << (at & 31).astype(np.uint64)
        words = np.zeros((total >> 5) + 3, np.uint64)
        # values do not overlap in a word, so a sum over each word's values is their union
        word = at >> 5
        if len(word):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            words[word[first]] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
            words[word[first] + 1] += np.add.reduceat(shifted >> np.uint64(32), first)
        return words.astype("<u4").tobytes()[: (total + 7) >> 3]


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of a prefix code for the symbols with a count, none above most."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weights = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weights, kind="stable")
        leaves, n = weights[order].tolist(), len(used)
        made, parent = [], [0] * (2 * n - 1)
        i = j = 0
        for k in range(n - 1):  # two queues: leaves and made nodes are both in order
            total = 0
            for _ in range(2):
                if j >= len(made) or i < n and leaves[i] <= made[j]:
                    total += leaves[i]
                    parent[i] = n + k
                    i += 1
                else:
                    total += made[j]
                    parent[n + j] = n + k
                    j += 1
            made.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= most:
            lengths[used[order]] = depth[:n]
            return lengths
        weights = (weights + 1) // 2


def put_code(out: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and used.max(initial=0) < 256:
        symbols = used.tolist() or [0]
        out.put(1, 1)
        out.put(len(symbols) - 1, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(s, 8)
        return
    out.put(0, 1)
    of = np.array([4] * 13 + [5] * 3 + [0, 4, 5], np.int64)  # complete, whatever the image: five bits for what is rare
    codes = canonical(of)
    out.put(15, 4)
    for k in LENGTH_ORDER:
        out.put(int(of[k]), 3)
    listed: list[tuple[int, int, int]] = []
    end, at = int(used[-1]) + 1, 0
    values = lengths[:end].tolist()
    while at < end:
        if values[at]:
            listed.append((values[at], 0, 0))
            at += 1
            continue
        n = 1
        while values[at + n] == 0 and n < 138:
            n += 1
        if n < 3:
            listed += [(0, 0, 0)] * n
        else:
            listed.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
        at += n
    whole = end == len(lengths)
    if whole or len(listed) < 2:
        out.put(0, 1)
        if not whole:
            n, rest = 0, len(lengths) - end
            while rest:
                n = min(rest, 138)
                if n < 11:
                    listed += [(0, 0, 0)] * n
                else:
                    listed.append((18, n - 11, 7))
                rest -= n
    else:
        out.put(1, 1)
        out.put(4, 3)
        out.put(len(listed) - 2, 10)
    for symbol, extra, size in listed:
        out.put(int(codes[symbol]), int(of[symbol]))
        if size:
            out.put(extra, size)


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra value, extra bits) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def container(data: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


#: Runs of one value from this length on become a back-reference to the pixel before.
LEAST_RUN = 12


def encode_grey(image: np.ndarray) -> bytes:
    """A grey image (height x width, 8 bits) as a lossless file: at most 16 values as a packed palette, else subtract-green."""
    height, width = image.shape
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 4)
    values = np.flatnonzero(np.bincount(image.reshape(-1), minlength=256))
    inner = width
    if len(values) <= 16:
        packed = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(values) - 1, 8)
        deltas = np.diff(values, prepend=0)
        _put_small(out, deltas, np.where(np.arange(len(values)) == 0, 255, 0))
        rank = np.zeros(256, np.int64)
        rank[values] = np.arange(len(values))
        inner = (width + (1 << packed) - 1) >> packed
        index = np.zeros((height, inner << packed), np.int64)
        index[:, :width] = rank[image]
        image = (index.reshape(height, inner, -1) << (np.arange(1 << packed) * (8 >> packed))).sum(2)
    else:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
    out.put(0, 1)
    out.put(0, 2)  # no cache, no groups
    flat = image.reshape(-1).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
    long = np.flatnonzero(np.diff(edge) > LEAST_RUN)
    symbols, extra, size = flat, None, None
    if len(long):
        keep = np.ones(len(flat), bool)
        extra, size, prefix = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64), flat.copy()
        for a, b in zip(edge[long].tolist(), edge[long + 1].tolist()):
            at = a + 1
            while at < b:
                n = min(4096, b - at)
                p, e, s = prefix_of(n)
                prefix[at], extra[at], size[at] = 256 + p, e, s
                keep[at + 1 : at + n] = False
                at += n
        symbols, extra, size = prefix[keep], extra[keep], size[keep]
    lengths = code_lengths(np.bincount(symbols, minlength=280))
    put_code(out, lengths)
    one = np.zeros(256, np.int64)
    for v in (0, 0, 255):
        one[:] = 0
        one[v] = 1
        put_code(out, one)
    far = np.zeros(40, np.int64)
    far[1] = 1  # the second step is the pixel to the left
    put_code(out, far)
    codes = canonical(lengths)
    widths = lengths * (np.count_nonzero(lengths) > 1)
    bits, n = codes[symbols] * (widths[symbols] > 0), widths[symbols]
    if extra is not None:
        bits, n = bits | extra << n, n + size
    return container(out.pack((bits, n)))


def _put_small(out: Writer, grey: np.ndarray, alpha: np.ndarray) -> None:
    """A one-row image of few pixels with equal red, green and blue."""
    out.put(0, 1)
    colour, opaque = code_lengths(np.bincount(grey, minlength=280)), code_lengths(np.bincount(alpha, minlength=256))
    put_code(out, colour)
    put_code(out, colour[:256])
    put_code(out, colour[:256])
    put_code(out, opaque)
    far = np.zeros(40, np.int64)
    far[0] = 1
    put_code(out, far)
    many, many_alpha = np.count_nonzero(colour) > 1, np.count_nonzero(opaque) > 1
    c, a = canonical(colour), canonical(opaque)
    for g, x in zip(grey.tolist(), alpha.tolist()):
        for _ in range(3):
            out.put(int(c[g]) if many else 0, int(colour[g]) if many else 0)
        out.put(int(a[x]) if many_alpha else 0, int(opaque[x]) if many_alpha else 0)
