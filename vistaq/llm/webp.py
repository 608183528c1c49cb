"""Lossless WebP: a writer, and a reader of prefix codes, back-references, colour cache and all four transforms.

Images are numpy arrays of uint32, a pixel as alpha << 24 | red << 16 | green << 8 | blue.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache
from itertools import groupby

import numpy as np

#: Fixed values of the format: the order in which lengths of the code-length code are written.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (x, y) that the first 120 distance codes stand for, x to the left and y up.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
MAX_SIDE = 1 << 14
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE = 0xFF000000
_ALPHABETS = (256 + 24, 256, 256, 256, 40)


# ---- bits


class _Bits:
    """Reads a byte string from the lowest bit of each byte on, through a window of one whole number."""

    WINDOW = 256

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.end = data, at, 8 * len(data)
        self.base, self.word = -8 * self.WINDOW, 0

    def peek(self, n: int) -> int:
        """The next n bits, 32 at most; zeros beyond the end."""
        place = self.at - self.base
        if place < 0 or place > 8 * self.WINDOW - 32:
            first = self.at >> 3
            self.base, self.word = 8 * first, int.from_bytes(self.data[first : first + self.WINDOW], "little")
            place = self.at - self.base
        return self.word >> place & (1 << n) - 1

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the image data end too soon")
        value = self.peek(n)
        self.at += n
        return value


class _Out:
    """Collects values with their numbers of bits."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.uint64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []
        for low in range(0, len(values), 1 << 16):
            self.parts.append((values[low : low + (1 << 16)], sizes[low : low + (1 << 16)]))

    def bytes(self) -> bytes:
        self.put_all(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        bits = []
        for values, sizes in self.parts:
            ends = np.cumsum(sizes)
            place = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
            bits.append((np.repeat(values, sizes) >> place.astype(np.uint64)).astype(np.uint8) & 1)
        return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


# ---- prefix codes


_REVERSED = np.packbits(np.unpackbits(np.arange(1 << 16, dtype=">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, ::-1], axis=1).view(">u2").reshape(-1).astype(np.int64)


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in the order of their codes, these codes and their lengths, which must be 16 at most."""
    symbols = np.flatnonzero(lengths)
    own = lengths[symbols]
    order = np.argsort(own, kind="stable")
    symbols, own = symbols[order], own[order]
    if not len(own):
        return symbols, own, own
    spare = own[-1] - own
    room = 1 << spare
    return symbols, (np.cumsum(room) - room) >> spare, own


class _Code:
    """A prefix code for reading: bits is the length of its longest code, symbol and size are tables by the next bits."""

    list = None

    def __init__(self, lengths: np.ndarray):
        symbols, _, own = _canonical(lengths)
        if not len(symbols):
            raise ValueError("a prefix code has no symbol")
        if len(symbols) == 1:
            self._alone(int(symbols[0]))
            return
        self.bits = int(own[-1])
        room = 1 << (self.bits - own)
        if int(room.sum()) != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        place = _REVERSED[: 1 << self.bits] >> (16 - self.bits)
        self.symbol, self.size = np.repeat(symbols, room)[place], np.repeat(own, room)[place]

    def _alone(self, symbol: int) -> None:
        self.bits, self.symbol, self.size = 0, np.array([symbol]), np.zeros(1, np.int64)

    @classmethod
    def alone(cls, symbol: int) -> _Code:
        """The code of one symbol, which takes no bits."""
        out = cls.__new__(cls)
        out._alone(symbol)
        return out

    def read(self, bits: _Bits) -> int:
        if self.list is None:
            self.list = list(zip(self.symbol.tolist(), self.size.tolist(), strict=True)) if self.bits < 12 else ()
        k = bits.peek(self.bits)
        symbol, n = self.list[k] if self.list else (int(self.symbol[k]), int(self.size[k]))
        bits.at += n
        return symbol


def _read_code(bits: _Bits, size: int) -> _Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        if not two and first < size:
            return _Code.alone(first)
        lengths = np.zeros(max(size, 256), np.int64)
        lengths[[first, *([bits.read(8)] if two else [])]] = 1
        return _Code(lengths[:size])
    lengths = np.zeros(max(size, 256), np.int64)
    own = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        own[CODE_ORDER[k]] = bits.read(3)
    code, left = _Code(own), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, before, made = 0, 8, []
    # a symbol and its bits take 14 at most, so some bytes hold all of them
    first = bits.at >> 3
    word, place = int.from_bytes(bits.data[first : first + 2 * min(size, left) + 16], "little"), bits.at & 7
    table, mask = list(zip(code.symbol.tolist(), code.size.tolist(), strict=True)), (1 << code.bits) - 1
    while at < size and left:
        left -= 1
        s, n = table[word >> place & mask]
        place += n
        if s < 16:
            made.append(s)
            at, before = at + 1, s or before
        else:
            least, more = ((3, 2), (3, 3), (11, 7))[s - 16]
            n = least + (word >> place & (1 << more) - 1)
            place += more
            if at + n > size:
                raise ValueError("code lengths run over")
            made += [before if s == 16 else 0] * n
            at += n
    bits.at = 8 * first + place
    if bits.at > bits.end:
        raise ValueError("the image data end too soon")
    lengths[: len(made)] = made
    return _Code(lengths[:size])


def _huffman(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Code lengths for counts, none over most."""
    used = np.flatnonzero(counts).tolist()
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(c, floor), i) for i, c in enumerate(counts[used].tolist())]
        heapq.heapify(heap)
        above = [0] * (2 * len(used) - 1)
        for n in range(len(used), len(above)):
            (a, i), (b, j) = heapq.heappop(heap), heap[0]
            above[i] = above[j] = n
            heapq.heapreplace(heap, (a + b, n))
        depth = [0] * len(above)
        for i in range(len(above) - 2, -1, -1):
            depth[i] = depth[above[i]] + 1
        if max(depth[: len(used)]) <= most:
            lengths[used] = depth[: len(used)]
            return lengths
        floor *= 2


def _write_code(out: _Out, lengths: np.ndarray) -> None:
    every = lengths.tolist()
    used = [s for s, n in enumerate(every) if n]
    if len(used) <= 2 and (not used or used[-1] < 256):
        used = used or [0]
        out.put(1 | len(used) - 1 << 1 | 1 << 2 | used[0] << 3, 11)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    out.put(0, 1)
    # runs of zeros by codes 17 and 18, of other lengths by 16 after the first
    tokens: list[tuple[int, int, int]] = []
    for value, same in groupby(every):
        n = len(list(same))
        if value:
            tokens.append((value, 0, 0))
            n -= 1
        while n >= 3:
            k = min(n, 138 if not value else 6)
            tokens.append((16, k - 3, 2) if value else (17, k - 3, 3) if k < 11 else (18, k - 11, 7))
            n -= k
        tokens += [(value, 0, 0)] * n
    own = _huffman(np.bincount([t[0] for t in tokens], minlength=19), 7)
    n = max(4, 1 + max(k for k, s in enumerate(CODE_ORDER) if own[s]))
    kept = own.tolist()
    out.put(n - 4 | sum(kept[s] << 4 + 3 * k for k, s in enumerate(CODE_ORDER[:n])), 5 + 3 * n)
    values, sizes = (x.tolist() for x in _book(own))
    out.values += [values[s] | extra << sizes[s] for s, extra, _ in tokens]
    out.sizes += [sizes[s] + more for s, _, more in tokens]


def _book(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By symbol the bits to write, the first lowest, and how many; a lone symbol takes none."""
    symbols, codes, own = _canonical(lengths)
    values, sizes = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    if len(symbols) > 1:
        sizes[symbols] = own
        values[symbols] = _REVERSED[codes] >> (16 - own)
    return values, sizes


# ---- pixels


def _value(bits: _Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _run(prefix: int, word: int, used: int) -> tuple[int, int]:
    """_value, of the bits of a number, and the bits used by then."""
    if prefix < 4:
        return prefix + 1, used
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + (word & (1 << extra) - 1) + 1, used + extra


def _prefix(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, their value) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, high - 1, v - ((2 + second) << (high - 1))


def _slot(pixel: int, bits: int) -> int:
    return (0x1E35A7BD * pixel & 0xFFFFFFFF) >> (32 - bits)


@lru_cache(64)
def _codes_of_distances(width: int) -> dict[int, int]:
    """The codes of the distances that have a short one in an image of width."""
    near: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR):
        near.setdefault(max(1, x + y * width), code + 1)
    return near


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


#: Bytes of coded pixels that are looked up at once.
LOOK = 1 << 18


def _read_green(bits: _Bits, width: int, total: int, green: _Code, distances: _Code) -> np.ndarray:
    """Green of total pixels that differ in nothing else.

    What each bit would begin is looked up for many bits at once, and from that where eight literals after one another
    would lead. So the codes are followed eight at a time, and one by one before a back-reference. Only places are kept on
    the way: literals are looked up together, and then back-references copied in their order.
    """
    out, at = np.empty(total, np.uint8), 0
    literal = green.symbol < 256
    if not green.bits:
        if not literal[0]:
            raise ValueError("a back-reference leaves the image")
        out[:] = green.symbol[0]
        return out
    steps_of, mask = np.where(literal, green.size, 0).astype(np.uint8), np.uint32((1 << green.bits) - 1)
    symbol_of = np.where(literal, green.symbol, 0).astype(np.uint8)
    data, base, n_bits = np.frombuffer(bits.data, np.uint8), 0, 0
    copies: list[tuple[int, int, int]] = []
    raw, green_mask, far_mask = bits.data, (1 << green.bits) - 1, (1 << distances.bits) - 1
    from_8, to_8, from_1, to_1 = [], [], [], []
    one = values = one_by_one = by_eight = None

    def flush() -> None:
        if to_1:
            out[to_1] = symbol_of[values[from_1]]
        if to_8:
            p, o = np.array(from_8), np.array(to_8)
            for _ in range(8):
                out[o] = symbol_of[values[p]]
                p, o = p + one[p], o + 1
        for held in (from_8, to_8, from_1, to_1):
            held.clear()

    while at < total:
        p = bits.at - base
        if p >= n_bits:
            flush()
            first = bits.at >> 3
            if first >= len(data):
                raise ValueError("the image data end too soon")
            some = np.zeros(min(LOOK, len(data) - first) + 2, np.uint32)
            there = data[first : first + len(some)]
            some[: len(there)] = there
            word = some[:-2] | some[1:-1] << 8 | some[2:] << 16
            values = ((word[:, None] >> np.arange(8, dtype=np.uint32)) & mask).reshape(-1)
            base, n_bits = 8 * first, len(values)
            one = np.zeros(n_bits + 128, np.uint8)  # beyond, no step leads on
            one[:n_bits] = steps_of[values]
            steps, places = one, np.arange(n_bits + 128)
            for _ in range(3):  # twice as many codes each time; from a place without a step none leads on
                more = steps.take(places + steps)
                steps = (steps + more) * (more > 0)
            one_by_one, by_eight = one.tobytes(), steps.tobytes()
            p = bits.at - base
        for _ in range((total - at) // 8):
            step = by_eight[p]
            if not step:
                break
            from_8.append(p), to_8.append(at)
            p, at = p + step, at + 8
        while at < total:
            step = one_by_one[p]
            if not step:
                break
            from_1.append(p), to_1.append(at)
            p, at = p + step, at + 1
        bits.at = base + p
        if at == total or p >= n_bits:
            continue
        # a back-reference takes 58 bits at most: its length's code and bits, its distance's code and bits
        start = bits.at
        word = int.from_bytes(raw[start >> 3 : (start >> 3) + 10], "little") >> (start & 7)
        k = word & green_mask
        prefix, used = int(green.symbol[k]) - 256, int(green.size[k])
        n, used = _run(prefix, word >> used, used)
        k = word >> used & far_mask
        prefix, used = int(distances.symbol[k]), used + int(distances.size[k])
        d, used = _run(prefix, word >> used, used)
        d = _distance(d, width)
        bits.at = start + used
        if d > at or at + n > total:
            raise ValueError("a back-reference leaves the image")
        copies.append((at, n, d))
        at += n
    if bits.at > 8 * len(data):
        raise ValueError("the image data end too soon")
    flush()
    for at, n, d in copies:
        out[at : at + n] = out[at - d : at - d + n] if d >= n else np.resize(out[at - d : at], n)
    return out


def _read_pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, shift = None, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        w, h = _side(width, shift), _side(height, shift)
        meta = (_read_pixels(bits, w, h, False).reshape(h, w) >> 8 & 0xFFFF).astype(np.int64)
    groups = []
    for _ in range(int(meta.max()) + 1 if meta is not None else 1):
        groups.append([_read_code(bits, n + (1 << cache_bits if i == 0 and cache_bits else 0)) for i, n in enumerate(_ALPHABETS)])
    total = width * height
    green, red, blue, alpha, distances = groups[0]
    if len(groups) == 1 and not cache_bits and red.bits == blue.bits == alpha.bits == 0:
        rest = int(alpha.symbol[0]) << 24 | int(red.symbol[0]) << 16 | int(blue.symbol[0])
        return _read_green(bits, width, total, green, distances).astype(np.uint32) << 8 | np.uint32(rest)
    return _read_mixed(bits, width, total, groups, meta, shift, cache_bits)


def _read_mixed(bits: _Bits, width: int, total: int, groups, meta, shift: int, cache_bits: int) -> np.ndarray:
    out, cache = [0] * total, [0] * (1 << cache_bits)
    at, noted = 0, 0
    while at < total:
        g = groups[int(meta[at // width >> shift, at % width >> shift])] if meta is not None else groups[0]
        s = g[0].read(bits)
        if s < 256:
            red, blue, alpha = g[1].read(bits), g[2].read(bits), g[3].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            n, d = _value(bits, s - 256), _distance(_value(bits, g[4].read(bits)), width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + n):
                out[i] = out[i - d]
            at += n
        else:
            for i in range(noted, at):
                cache[_slot(out[i], cache_bits)] = out[i]
            noted = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


# ---- transforms


def _channels(p: np.ndarray) -> np.ndarray:
    """(..., 4) as alpha, red, green, blue."""
    return np.stack([p >> s & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predict(mode: int, left, top, right, corner):
    """The prediction from left, top, top right and top left, lists of four channels."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        # the estimate left + top - corner: whichever of left and top is nearer
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        # division rounds to zero
        return [clamp(a + int((a - c) / 2)) for a, c in zip(half(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def _predictions(c: list, width: int, modes: np.ndarray, shift: int, inverse: bool) -> list:
    """Adds the predictions to residuals (inverse), or takes them from pixels."""
    out = c if inverse else [list(x) for x in c]
    for i in range(len(c)):
        y, x = divmod(i, width)
        if i == 0:
            p = [255, 0, 0, 0]
        elif y == 0:
            p = c[i - 1]
        elif x == 0:
            p = c[i - width]
        else:
            p = _predict(int(modes[y >> shift, x >> shift]), c[i - 1], c[i - width], c[i - width + 1], c[i - width - 1])
        out[i] = [(a + b if inverse else a - b) & 0xFF for a, b in zip(c[i], p, strict=True)]
    return out


def _from_one_side(p: np.ndarray, mode: int, inverse: bool) -> np.ndarray:
    """Predictions of every pixel from its left (mode 1) or top (mode 2) neighbour, for all pixels at once: differences one way, running sums the other."""
    c = _channels(p)
    if inverse:
        c[0, 0] += (255, 0, 0, 0)
        if mode == 1:
            c[:, 0] = np.cumsum(c[:, 0], 0)
            return _joined(np.cumsum(c, 1))
        c[0] = np.cumsum(c[0], 0)
        return _joined(np.cumsum(c, 0))
    out = c.copy()
    if mode == 1:
        out[:, 1:] -= c[:, :-1]
        out[1:, 0] -= c[:-1, 0]
    else:
        out[1:] -= c[:-1]
        out[0, 1:] -= c[0, :-1]
    out[0, 0] -= (255, 0, 0, 0)
    return _joined(out)


def _predicted(p: np.ndarray, modes: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """p with the predictions of modes, one to a block, added (inverse) or taken off."""
    one = int(modes.flat[0])
    if one in (1, 2) and (modes == one).all():
        return _from_one_side(p, one, inverse)
    return _joined(np.array(_predictions(_channels(p).reshape(-1, 4).tolist(), p.shape[1], modes, shift, inverse))).reshape(p.shape)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    signed = lambda v: (v & 0xFF ^ 0x80) - 0x80
    return signed(t) * signed(c) >> 5


def _cross(p: np.ndarray, block: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """block: a pixel per block with red to blue, green to blue and green to red as red, green and blue."""
    h, w = p.shape
    c, b = _channels(p), _channels(block)[np.arange(h)[:, None] >> shift, np.arange(w)[None, :] >> shift]
    sign = 1 if inverse else -1
    red = c[..., 1] + sign * _delta(b[..., 3], c[..., 2])
    own = red if inverse else c[..., 1]
    blue = c[..., 3] + sign * (_delta(b[..., 2], c[..., 2]) + _delta(b[..., 1], own))
    return _joined(np.stack([c[..., 0], red, c[..., 2], blue], -1))


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _side(n: int, shift: int) -> int:
    return (n + (1 << shift) - 1) >> shift


# ---- images


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end, body = 12, 8 + struct.unpack_from("<I", data, 4)[0], None
    while at + 8 <= min(end, len(data)):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            body = data[at + 8 : at + 8 + size]
            break
        at += 8 + size + (size & 1)
    if not body or body[0] != 0x2F:
        raise ValueError("no lossless image in it")
    bits = _Bits(body, 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    w, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            bw, bh = _side(w, shift), _side(height, shift)
            undo.append((kind, w, shift, _read_pixels(bits, bw, bh, False).reshape(bh, bw)))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _channels(_read_pixels(bits, n, 1, False))
            undo.append((kind, w, _bundle(n), _joined(np.cumsum(steps, 0))))
            w = _side(w, _bundle(n))
        else:
            undo.append((kind, w, 0, None))
    p = _read_pixels(bits, w, height, True).reshape(height, w)
    for kind, w, shift, extra in reversed(undo):
        if kind == PREDICTOR:
            p = _predicted(p, extra >> 8 & 0xFF, shift, True)
        elif kind == CROSS_COLOUR:
            p = _cross(p, extra, shift, True)
        elif kind == SUBTRACT_GREEN:
            green = p >> 8 & 0xFF
            p = p & 0xFF00FF00 | ((p >> 16 & 0xFF) + green & 0xFF) << 16 | (p & 0xFF) + green & 0xFF
        else:
            index, each = p >> 8 & 0xFF, 8 >> shift
            if shift:
                index = np.stack([index >> k * each & (1 << each) - 1 for k in range(1 << shift)], -1).reshape(height, -1)[:, :w]
            table = np.zeros(256, np.uint32)
            table[: len(extra)] = extra
            p = table[index]
    return p.astype(np.uint32)


#: Bytes by which a repeat is found, and how many more have to go on from there.
SEED, LEAST = 8, 16


def _repeats(green: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of runs that were there before, LEAST or longer, from left to right: by the last place of the same SEED bytes."""
    n = len(green) - SEED + 1
    if n < LEAST:
        return []
    raw = green.tobytes()
    key = np.ndarray(n, "<u8", raw, 0, (1,)).copy()  # SEED bytes from each place on
    order = np.argsort((key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16), kind="stable")  # of 16 bits: no comparisons
    same = key[order[1:]] == key[order[:-1]]
    before = np.full(n, -1)
    before[order[1:][same]] = order[:-1][same]
    far = LEAST - SEED
    some = np.flatnonzero((before[:-far] >= 0) & (before[far:] - before[:-far] == far)) if n > far else []
    out, done = [], 0
    for at, d in zip(some.tolist(), (some - before[some]).tolist(), strict=True) if len(some) else ():
        if at < done:
            continue
        k = _alike(raw, at, at - d, min(4096, len(raw) - at))
        if k >= LEAST:
            out.append((at, k, d))
            done = at + k
    return out


def _alike(raw: bytes, a: int, b: int, most: int) -> int:
    """How many bytes from a on are those from b on, most at most: the lowest bit in which two numbers differ is in the first other byte."""
    k, step = 0, 32
    while k < most:
        n = min(step, most - k)
        x = int.from_bytes(raw[a + k : a + k + n], "little") ^ int.from_bytes(raw[b + k : b + k + n], "little")
        if x:
            return k + ((x & -x).bit_length() - 1 >> 3)
        k, step = k + n, 4 * step
    return most


def _write_green(out: _Out, pixels: np.ndarray, width: int, back: bool) -> None:
    """Pixels that differ in green alone: prefix codes for its values, and back-references."""
    first, green = int(pixels[0]), (pixels >> 8 & 0xFF).astype(np.uint8)
    near = _codes_of_distances(width)
    found = [(at, n, _prefix(n), _prefix(near.get(d, d + 120))) for at, n, d in (_repeats(green) if back else [])]
    alone = np.ones(len(green), bool)
    for at, n, *_ in found:
        alone[at : at + n] = False
    counts = np.bincount(green[alone], minlength=280)
    counts += np.bincount([256 + n[0] for *_, n, _ in found], minlength=280) if found else 0
    lengths = _huffman(counts)
    _write_code(out, lengths)
    for s in (first >> 16 & 0xFF, first & 0xFF, first >> 24):
        out.put(1 | 1 << 2 | s << 3, 11)
    away = _huffman(np.bincount([d[0] for *_, d in found], minlength=40)) if found else np.zeros(40, np.int64)
    _write_code(out, away)
    values, sizes = _book(lengths)
    v, k = values[green], sizes[green]
    if found:
        far, far_k = (x.tolist() for x in _book(away))
        run, run_k = values[256:].tolist(), sizes[256:].tolist()
        places, whole, lengths_ = [], [], []
        for at, _, (a, n_bits, extra), (b, m_bits, more) in found:  # a back-reference is one value of fewer than 64 bits, in the place of its first pixel
            size = run_k[a]
            value = run[a] | extra << size
            size += n_bits
            value |= far[b] << size
            size += far_k[b]
            places.append(at)
            whole.append(value | more << size)
            lengths_.append(size + m_bits)
        v[places], k[places], alone[places] = np.array(whole, np.uint64), lengths_, True
        v, k = v[alone], k[alone]
    out.put_all(v, k)


def _tokens(p: np.ndarray, width: int, cache_bits: int, back: bool):
    """Literals, (length, distance) and cache slots that make up the pixels."""
    p, out, at, last = p.tolist(), [], 0, {}
    cache = [None] * (1 << cache_bits) if cache_bits else None
    while at < len(p):
        n = 0
        if back and at + 3 <= len(p):
            before = last.get(tuple(p[at : at + 3]))
            if before is not None:
                while n < 4096 and at + n < len(p) and p[before + n] == p[at + n]:
                    n += 1
        if n >= 3:
            out.append(("back", n, at - before))
        else:
            n = 1
            slot = _slot(p[at], cache_bits) if cache_bits else 0
            out.append(("slot", slot, 0) if cache_bits and cache[slot] == p[at] else ("pixel", p[at], 0))
        for i in range(at, at + n):
            if cache_bits:
                cache[_slot(p[i], cache_bits)] = p[i]
            if i + 3 <= len(p):
                last[tuple(p[i : i + 3])] = i
        at += n
    return out


def _write_mixed(out: _Out, p: np.ndarray, width: int, cache_bits: int, back: bool, meta, shift: int) -> None:
    near = _codes_of_distances(width)
    groups = int(meta.max()) + 1 if meta is not None else 1
    counts = [[np.zeros(n + (1 << cache_bits if i == 0 and cache_bits else 0), np.int64) for i, n in enumerate(_ALPHABETS)] for _ in range(groups)]
    made, at = [], 0
    for kind, a, b in _tokens(p, width, cache_bits, back):
        g = int(meta[at // width >> shift, at % width >> shift]) if meta is not None else 0
        if kind == "pixel":
            parts = [(0, a >> 8 & 0xFF), (1, a >> 16 & 0xFF), (2, a & 0xFF), (3, a >> 24)]
        elif kind == "slot":
            parts = [(0, 280 + a)]
        else:
            n, d = _prefix(a), _prefix(near.get(b, b + 120))
            parts = [(0, 256 + n[0]), (None, n), (4, d[0]), (None, d)]
        for i, s in parts:
            if i is not None:
                counts[g][i][s] += 1
        made.append((g, parts))
        at += a if kind == "back" else 1
    books = []
    for g in range(groups):
        book = []
        for x in counts[g]:
            lengths = _huffman(x)
            _write_code(out, lengths)
            book.append([(v, k) for v, k in zip(*(x.tolist() for x in _book(lengths)), strict=True)])
        books.append(book)
    for g, parts in made:
        for i, s in parts:
            out.put(*(books[g][i][s] if i is not None else (s[2], s[1])))


def _write_pixels(out: _Out, p: np.ndarray, main: bool, cache_bits: int = 0, back: bool = False, meta=None, shift: int = 0) -> None:
    flat = p.reshape(-1)
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(int(meta is not None), 1)
        if meta is not None:
            out.put(shift - 2, 3)
            _write_pixels(out, (meta.astype(np.uint32) << 8) | np.uint32(OPAQUE), False)
    if meta is None and not cache_bits and bool(((flat ^ flat[0]) & np.uint32(0xFFFF00FF) == 0).all()):
        _write_green(out, flat, p.shape[1], back)
    else:
        _write_mixed(out, flat, p.shape[1], cache_bits, back, meta, shift)


def encode(pixels: np.ndarray, predictor: np.ndarray | None = None, cross: np.ndarray | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, back: bool = False, meta: np.ndarray | None = None, shift: int = 2) -> bytes:
    """A lossless WebP file. predictor: a mode per block of 1 << shift pixels a side; cross: a multiplier pixel per block; meta: a group of prefix codes per block; back: whether to look for back-references."""
    p = np.ascontiguousarray(pixels, np.uint32)
    height, width = p.shape
    out = _Out()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(bool((p >> 24 != 255).any())), 1), (0, 3)):
        out.put(value, n)
    if palette:
        colours = np.unique(p)
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        c = _channels(colours)
        _write_pixels(out, _joined(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)))[None, :], False)
        k = _bundle(len(colours))
        index, each = np.searchsorted(colours, p).astype(np.uint32), 8 >> k
        if k:
            wide = np.zeros((height, _side(width, k) << k), np.uint32)
            wide[:, :width] = index
            wide = wide.reshape(height, -1, 1 << k)
            index = np.bitwise_or.reduce(wide << (np.arange(1 << k, dtype=np.uint32) * np.uint32(each)), axis=2)
        p = index << 8 | np.uint32(OPAQUE)
    if subtract_green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        green = p >> 8 & 0xFF
        p = p & np.uint32(0xFF00FF00) | ((p >> 16 & 0xFF) - green & 0xFF) << 16 | (p & 0xFF) - green & 0xFF
    if predictor is not None:
        out.put(1 | PREDICTOR << 1, 3)
        out.put(shift - 2, 3)
        _write_pixels(out, predictor.astype(np.uint32) << 8 | np.uint32(OPAQUE), False)
        p = _predicted(p, np.asarray(predictor), shift, False)
    if cross is not None:
        out.put(1 | CROSS_COLOUR << 1, 3)
        out.put(shift - 2, 3)
        _write_pixels(out, cross.astype(np.uint32), False)
        p = _cross(p, cross, shift, False)
    out.put(0, 1)
    _write_pixels(out, p, True, cache_bits, back, meta, shift)
    body = out.bytes()
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad
