"""Stored pictures as arrays of (height, width, 3) bytes, and back: PNG, baseline JPEG, GIF. Bad files raise ValueError."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np

#: Pixels of a picture, at most: more are an error, not a task out of memory.
MOST = 50_000_000
#: JPEG files are decoded at a half, a quarter or an eighth of their size as long as both sides keep so many pixels.
DRAFT = 1024


def decode(data: bytes, draft: int | None = DRAFT) -> np.ndarray:
    """By the first bytes, not the name. Of an animation the middle frame (n // 2). Transparency is dropped, not blended."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return read_png(data)
        if data[:2] == b"\xff\xd8":
            return read_jpeg(data, draft)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return read_gif(data)
    except ValueError:
        raise
    except (LookupError, ArithmeticError, TypeError, struct.error, zlib.error, MemoryError) as error:
        raise ValueError(f"broken picture: {error}") from error
    raise ValueError("no picture that can be read")


def _room(width: int, height: int) -> None:
    if not 0 < width * height <= MOST:
        raise ValueError(f"{width} x {height} pixels")


# ---- PNG

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Of an interlaced picture each pass: first column and row, and steps.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _predicted(kind: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What the filters of a byte foresee, by the filter's number."""
    guess = left + up - corner
    a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    return np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, paeth], 0)


def _foreseen(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray):
    """As _predicted, of one filter for all."""
    if kind < 4:
        return (left + up) >> 1 if kind == 3 else (0, left, up)[kind]
    a, b = up - corner, left - corner
    c = np.abs(a + b)
    a, b = np.abs(a), np.abs(b)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))


def _unfiltered_bytes(kinds: list[int], rows: np.ndarray) -> np.ndarray:
    """As _unfiltered, byte by byte: of a small picture that takes less than the calls for each diagonal."""
    h, w, depth = rows.shape
    n, out = w * depth, bytearray()
    up = bytes(n)
    for kind, row in zip(kinds, rows.reshape(h, n), strict=True):
        line = bytearray(row.tobytes())
        if kind == 1:
            for i in range(depth, n):
                line[i] = line[i] + line[i - depth] & 255
        elif kind == 2:
            for i in range(n):
                line[i] = line[i] + up[i] & 255
        elif kind == 3:
            for i in range(n):
                line[i] = line[i] + ((line[i - depth] if i >= depth else 0) + up[i] >> 1) & 255
        elif kind == 4:
            for i in range(min(depth, n)):  # without a left neighbour it is the one above
                line[i] = line[i] + up[i] & 255
            for i in range(depth, n):
                left, above, corner = line[i - depth], up[i], up[i - depth]
                a, b, c = abs(above - corner), abs(left - corner), abs(left + above - corner - corner)
                line[i] = line[i] + (left if a <= b and a <= c else above if b <= c else corner) & 255
        out += line
        up = line
    return np.frombuffer(bytes(out), np.uint8).reshape(h, w, depth)


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows of (pixels, bytes of a pixel) without their filters. Where a byte hangs on its left neighbour and on the row above, all bytes of a diagonal are done at once."""
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    h, w, depth = rows.shape
    if not kinds.any():
        return rows
    if rows.size < 200 * (w + h):
        return _unfiltered_bytes(kinds.tolist(), rows)
    out = np.zeros((h + 1, w + 1, depth), np.int32)
    if kinds.max(initial=0) < 3:
        for y in range(h):
            row = rows[y] if kinds[y] != 1 else np.add.accumulate(rows[y], axis=0, dtype=np.uint8)
            out[y + 1, 1:] = row if kinds[y] != 2 else (row + out[y, 1:]) & 255
        return out[1:, 1:].astype(np.uint8)
    for t in range(w + h - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x = t - y
        guess = _predicted(kinds[y, None], out[y + 1, x], out[y, x + 1], out[y, x])
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _samples(data: np.ndarray, at: int, width: int, height: int, channels: int, bits: int) -> tuple[np.ndarray, int]:
    """(height, width, channels) samples of a pass that begins at a place of the inflated bytes, and where it ends. Of 16 bits the upper 8."""
    line = (width * channels * bits + 7) // 8
    size = height * (line + 1)
    if at + size > len(data):
        raise ValueError("picture data ends early")
    raw = data[at : at + size].reshape(height, line + 1)
    depth = max(1, channels * bits // 8)
    got = _unfiltered(raw[:, 0].astype(np.int32), raw[:, 1:].reshape(height, line // depth, depth)).reshape(height, line)
    if bits == 16:
        got = got[:, ::2]
    elif bits < 8:
        shifts = np.arange(8 - bits, -1, -bits)
        got = ((got[:, :, None] >> shifts) & ((1 << bits) - 1)).reshape(height, -1)[:, : width * channels].astype(np.uint8)
    return got.reshape(height, width, channels), at + size


def read_png(data: bytes) -> np.ndarray:
    at, parts, head, palette = 8, [], None, None
    while at + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(name + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk is broken")
        at += 12 + n
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            parts.append(body)
        elif name == b"IEND":
            break
    if head is None:
        raise ValueError("no header")
    width, height, bits, kind, _, _, laced = head
    _room(width, height)
    channels = _CHANNELS[kind]
    most = (width * channels * bits + 7) // 8 * height * 2 + 64 * (height + width) + 1024  # with the passes' filters and rounding
    inflated = np.frombuffer(zlib.decompressobj().decompress(b"".join(parts), most), np.uint8)
    if not laced:
        got, _ = _samples(inflated, 0, width, height, channels, bits)
    else:
        got, at = np.zeros((height, width, channels), np.uint8), 0
        for x, y, dx, dy in _PASSES:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                got[y::dy, x::dx], at = _samples(inflated, at, w, h, channels, bits)
    if kind == 3:
        if palette is None or got.max(initial=0) >= len(palette):
            raise ValueError("a colour is not in the palette")
        return palette[got[:, :, 0]]
    if bits < 8:
        got = (got.astype(np.int32) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    return np.repeat(got[:, :, :1], 3, 2) if channels < 3 else np.ascontiguousarray(got[:, :, :3])


def write_png(pixels: np.ndarray, kinds: np.ndarray | None = None, laced: bool = False) -> bytes:
    """Pixels of 1 (grey), 2 (with alpha), 3 or 4 channels of bytes. kinds: the filter of each row, by turns; else for each row the one whose bytes are least in sum."""
    height, width, channels = pixels.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    out = []
    for x, y, dx, dy in _PASSES if laced else ((0, 0, 1, 1),):
        part = pixels[y::dy, x::dx].astype(np.int32)
        if not part.size:
            continue
        padded = np.zeros((part.shape[0] + 1, part.shape[1] + 1, channels), np.int32)
        padded[1:, 1:] = part
        asked = range(5) if kinds is None else set(kinds[: len(part)].tolist())
        every = {k: ((part - _foreseen(k, padded[1:, :-1], padded[:-1, 1:], padded[:-1, :-1])) & 255).astype(np.uint8) for k in asked}
        if kinds is None:
            chosen = np.stack([np.abs(e.astype(np.int8).astype(np.int32)).sum((1, 2)) for e in every.values()]).argmin(0)
        else:
            chosen = np.resize(kinds, len(part))
        out += [bytes([k]) + every[k][i].tobytes() for i, k in enumerate(chosen.tolist())]
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, int(laced))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(out))) + chunk(b"IEND", b"")


# ---- JPEG

#: Where the k-th stored coefficient of a block of 8 x 8 belongs: along the diagonals, by turns up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


@lru_cache(8)
def _cosines(n: int) -> np.ndarray:
    """(n, n): the orthonormal cosine transform; row k is the k-th wave."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos((2 * x + 1) * k * np.pi / (2 * n))


#: Bits that a code's table is asked with at once; longer codes are looked for among themselves.
SHORT = 9
MASK = (1 << SHORT) - 1


def _code_lengths_to_table(sizes: bytes, symbols: bytes) -> tuple[list[int], list[int], list[int]]:
    """For each SHORT bits that may come, the length of the code they begin with times 256, and its symbol; 0 where none does. Then of longer codes the first 16 bits that begin with them, in order, and the same number."""
    short, lows, long = [0] * (1 << SHORT), [], []
    code, k = 0, 0
    for n, count in enumerate(sizes, 1):
        for _ in range(count):
            low = code << (16 - n)
            if low >= 1 << 16:
                raise ValueError("more codes than fit")
            if n <= SHORT:
                at = low >> (16 - SHORT)
                short[at : at + (1 << (SHORT - n))] = [n << 8 | symbols[k]] * (1 << (SHORT - n))
            else:
                lows.append(low)
                long.append(n << 8 | symbols[k])
            code, k = code + 1, k + 1
        code <<= 1
    return short, lows, long


def _longer(lows: list[int], long: list[int], bits: int) -> int:
    """What a code of more than SHORT bits that these 16 begin with stands for, or 0."""
    i = bisect_right(lows, bits) - 1
    return long[i] if i >= 0 and bits - lows[i] < 1 << (16 - (long[i] >> 8)) else 0


def _scan(data: bytes, at: int, order: list[tuple[int, tuple, tuple]], mcus: int, restart: int, blocks: list[np.ndarray]) -> None:
    """Fills blocks (coefficients of each component, block by block as they come) from the coded bytes. order: for each block of a unit, its component and its two tables."""
    end = at
    while (end := data.find(b"\xff", end)) >= 0 and (data[end + 1 : end + 2] == b"\x00" or 0xD0 <= data[end + 1] <= 0xD7):
        end += 2
    raw = data[at:] if end < 0 else data[at:end]
    spans, low = [], 0
    for k in range(len(raw) - 1) if restart and b"\xff" in raw else ():
        if raw[k] == 0xFF and raw[k + 1] != 0:
            spans.append(raw[low:k])
            low = k + 2
    spans.append(raw[low:])
    places, filled = ZIGZAG.tolist(), [0] * len(blocks)
    flat = [b.reshape(-1) for b in blocks]
    step = restart or mcus
    for part, first in enumerate(range(0, mcus, step)):
        if part >= len(spans):
            raise ValueError("picture data ends early")
        bits = spans[part].replace(b"\xff\x00", b"\xff") + bytes(8)
        acc = n = pos = 0
        last = [0] * len(blocks)
        most = len(bits) + 64
        for _ in range(min(step, mcus - first)):
            for c, dc, ac in order:
                base, k = filled[c] * 64, 0
                filled[c] += 1
                short, lows, long = dc
                while k < 64:
                    if n < 32:  # a code and its bits take no more
                        acc = (acc & ((1 << n) - 1)) << 48 | int.from_bytes(bits[pos : pos + 6].ljust(6, b"\0"), "big")
                        n, pos = n + 48, pos + 6
                        if pos > most:
                            raise ValueError("picture data ends early")
                    found = short[acc >> (n - SHORT) & MASK] or _longer(lows, long, acc >> (n - 16) & 0xFFFF)
                    if not found:
                        raise ValueError("an unknown code")
                    n -= found >> 8
                    size = found & 15
                    if k:
                        if not size:
                            if found & 255 != 0xF0:
                                break
                            k += 16
                            continue
                        k += found >> 4 & 15
                        if k > 63:
                            raise ValueError("a block is too long")
                    elif found & 255 > 15:
                        raise ValueError("a first coefficient is too large")
                    if size:
                        n -= size
                        value = acc >> n & ((1 << size) - 1)
                        if value < 1 << (size - 1):
                            value -= (1 << size) - 1
                    else:
                        value = 0
                    if not k:
                        value = last[c] = last[c] + value
                        short, lows, long = ac
                    if value:
                        flat[c][base + places[k]] = value
                    k += 1


def _doubled(x: np.ndarray, axis: int) -> np.ndarray:
    """Twice as many samples along an axis: each a quarter of the way to its neighbour."""
    x = np.moveaxis(x, axis, 0)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    out = np.stack([(3 * x + before) / 4, (3 * x + after) / 4], 1).reshape(-1, *x.shape[1:])
    return np.moveaxis(out, 0, axis)


def read_jpeg(data: bytes, draft: int | None = DRAFT) -> np.ndarray:
    at, quant, tables, restart, frame = 2, {}, {}, 0, None
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker where one has to be")
        mark, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = _code_lengths_to_table(body[1:17], body[17 : 17 + count])
                body = body[17 + count :]
        elif mark in (0xC0, 0xC1):
            bits, height, width, count = struct.unpack_from(">BHHB", body)
            if bits != 8 or count not in (1, 3):
                raise ValueError(f"{count} components of {bits} bits")
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("not a baseline picture")
        elif mark == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif mark == 0xDA:
            break
        elif mark == 0xD9:
            raise ValueError("no picture data")
    if frame is None or body[0] != len(frame):
        raise ValueError("no frame, or components that come apart")
    _room(width, height)
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    across, down = max(f[1] for f in frame), max(f[2] for f in frame)
    mw, mh = -(-width // (8 * across)), -(-height // (8 * down))
    chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    order = [(i, tables[chosen[c] >> 4], tables[0x10 | chosen[c] & 15]) for i, (c, h, v, _) in enumerate(frame) for _ in range(h * v)]
    blocks = [np.zeros((mw * mh * h * v, 64), np.int32) for _, h, v, _ in frame]
    _scan(data, at, order, mw * mh, restart, blocks)
    n = 8  # pixels that a block of 8 becomes
    while draft and n > 1 and min(width, height) * n // 16 >= draft:
        n //= 2
    back, planes = _cosines(n), []
    for (_, h, v, q), b in zip(frame, blocks, strict=True):
        steps = np.zeros(64)
        steps[ZIGZAG] = quant[q]
        low = (b * steps).reshape(-1, 8, 8)[:, :n, :n] * (n / 8)
        pixels = back.T @ low @ back + 128
        plane = pixels.reshape(mh, mw, v, h, n, n).transpose(0, 2, 4, 1, 3, 5).reshape(mh * v * n, mw * h * n)
        plane = plane[: -(-height * v * n // (8 * down)), : -(-width * h * n // (8 * across))]  # so edges are spread, not what pads them
        for axis, times in ((0, down // v), (1, across // h)):
            plane = _doubled(plane, axis) if times == 2 else np.repeat(plane, times, axis)
        planes.append(plane[: -(-height * n // 8), : -(-width * n // 8)])
    y = planes[0]
    if len(planes) == 1:
        rgb = np.repeat(y[:, :, None], 3, 2)
    else:
        cb, cr = planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.round(rgb), 0, 255).astype(np.uint8)


# The steps of brightness and colour that the standard proposes, row by row, for quality 50.
BRIGHT_STEPS = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
COLOUR_STEPS = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


def _codes(symbols: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """A table (sizes, symbols) and each symbol's code and length, by how often symbols occur: the length is the logarithm of the share, rounded up, so all codes fit, and one more for the code of ones alone."""
    counts = np.bincount(symbols, minlength=256).astype(float)
    used = np.flatnonzero(counts)
    share = counts[used] + counts.sum() / 4096  # none beyond 16 bits
    lengths = np.maximum(1, np.ceil(-np.log2(share / (share.sum() * 1.01 + 1)))).astype(int)
    order = np.lexsort((used, lengths))
    code, before, codes, sizes = 0, 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    for k in order.tolist():
        code <<= int(lengths[k]) - before
        before = int(lengths[k])
        codes[used[k]], sizes[used[k]] = code, before
        code += 1
    return bytes(np.bincount(lengths, minlength=17)[1:17].tolist()), bytes(used[order].tolist()), codes, sizes


def _packed(values: np.ndarray, widths: np.ndarray, some: int = 1 << 16) -> bytes:
    """Numbers of so many bits one after another, what is left of the last byte ones; so many numbers are spread to bits at once."""
    out = []
    for low in range(0, len(values), some):
        v, w = values[low : low + some], widths[low : low + some]
        ends = np.cumsum(w)
        out.append((np.repeat(v, w) >> (np.repeat(ends, w) - 1 - np.arange(ends[-1])) & 1).astype(np.uint8))
    bits = np.concatenate(out)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def write_jpeg(pixels: np.ndarray, quality: int = 70, half: bool = True, restart: int = 0) -> bytes:
    """A baseline file of RGB pixels, or of grey ones (one channel). half: colours at half the width and height."""
    height, width, channels = pixels.shape
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(np.int64) for t in (BRIGHT_STEPS, COLOUR_STEPS)]
    x = pixels.astype(np.float64)
    if channels == 1:
        planes, times = [x[:, :, 0]], 1
    else:
        r, g, b = x[:, :, 0], x[:, :, 1], x[:, :, 2]
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes, times = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128], 2 if half else 1
    mw, mh = -(-width // (8 * times)), -(-height // (8 * times))
    wave, units = _cosines(8), []
    for i, p in enumerate(planes):
        p = np.pad(p, ((0, mh * 8 * times - height), (0, mw * 8 * times - width)), mode="edge") - 128
        k = times
        if i and times == 2:
            p, k = p.reshape(mh * 8, 2, mw * 8, 2).mean((1, 3)), 1
        blocks = p.reshape(mh, k, 8, mw, k, 8).transpose(0, 3, 1, 4, 2, 5).reshape(mh * mw, k * k, 8, 8)
        waves = (wave @ blocks @ wave.T).reshape(mh * mw, k * k, 64)
        units.append(np.round(waves / steps[i > 0]).astype(np.int64)[:, :, ZIGZAG])
    # blocks as they come, unit by unit, and each one's difference of first coefficients to the one before of its component
    m = mh * mw
    whole = np.concatenate(units, 1)
    of = np.repeat(np.arange(len(units)), [u.shape[1] for u in units])
    for i, u in enumerate(units):
        d = np.diff(u[:, :, 0].reshape(-1), prepend=0).reshape(m, -1)
        if restart:  # begins at 0 again
            d[::restart, 0] = u[::restart, 0, 0]
        whole[:, of == i, 0] = d
    whole, of = whole.reshape(-1, 64), np.tile(of > 0, m)
    # symbols: (block, place, book, symbol, extra bits, their number); a place is the coefficient's, 64 of the end
    first = np.arange(len(whole))
    at, place = np.nonzero(whole[:, 1:])
    place += 1
    gap = np.where(np.diff(at, prepend=-1) != 0, place, np.diff(place, prepend=0)) - 1
    far = np.repeat(np.flatnonzero(gap > 15), gap[gap > 15] // 16)
    final = np.zeros(len(whole), np.int64)
    np.maximum.at(final, at, place)
    ends = np.flatnonzero(final < 63)
    value = np.concatenate([whole[:, 0], whole[at, place]])
    size = np.frexp(np.abs(value).astype(np.float64))[1].astype(np.int64)
    n, z = len(far), len(ends)
    block = np.concatenate([first, at, at[far], ends])
    key = np.concatenate([np.zeros_like(first), 2 * place, 2 * place[far] - 1, np.full(z, 128)])
    symbol = np.concatenate([size[: len(first)], gap % 16 << 4 | size[len(first) :], np.full(n, 0xF0), np.zeros(z, np.int64)])
    extra = np.concatenate([np.where(value >= 0, value, value + (1 << size) - 1), np.zeros(n + z, np.int64)])
    size = np.concatenate([size, np.zeros(n + z, np.int64)])
    book = 2 * of[block] + (key > 0)
    order = np.argsort(block * 129 + key, kind="stable")
    books = {k: _codes(symbol[book == k]) for k in np.unique(book).tolist()}
    codes, lengths = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    for k, (_, _, c, w) in books.items():
        codes[k], lengths[k] = c, w
    block, book, symbol, extra, size = block[order], book[order], symbol[order], extra[order], size[order]
    bits, width_of = codes[book, symbol] << size | extra, lengths[book, symbol] + size
    per = len(of) // m * restart  # blocks between restarts
    cuts = np.searchsorted(block, np.arange(per, len(whole), per)).tolist() if restart else []
    parts = [_packed(bits[a:b], width_of[a:b]) for a, b in zip([0, *cuts], [*cuts, len(bits)], strict=True)]
    segment = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    out = [b"\xff\xd8"]
    out += [segment(0xDB, bytes([i]) + bytes(steps[i][ZIGZAG].tolist())) for i in range(min(2, len(planes)))]
    sampling = [(1, times << 4 | times, 0), (2, 0x11, 1), (3, 0x11, 1)][: len(planes)]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(map(bytes, sampling))))
    out += [segment(0xC4, bytes([(k & 1) << 4 | k >> 1]) + b[0] + b[1]) for k, b in sorted(books.items())]
    if restart:
        out.append(segment(0xDD, struct.pack(">H", restart)))
    out.append(segment(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0x11 * (i > 0)]) for i in range(len(planes))) + b"\x00\x3f\x00"))
    for i, part in enumerate(parts):
        out.append(part.replace(b"\xff", b"\xff\x00"))
        if i + 1 < len(parts):
            out.append(bytes([0xFF, 0xD0 + i % 8]))
    return b"".join(out) + b"\xff\xd9"


# ---- GIF


def _lzw(data: bytes, start: int, most: int) -> bytes:
    """Colours of a picture of at most most pixels. Codes grow by a bit when the table does, up to 12."""
    clear, out = 1 << start, bytearray()
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    size, last, acc, n = start + 1, None, 0, 0
    for byte in data:
        acc |= byte << n
        n += 8
        while n >= size:
            code, acc, n = acc & ((1 << size) - 1), acc >> size, n - size
            if code == clear:
                del table[clear + 2 :]
                size, last = start + 1, None
                continue
            if code == clear + 1 or len(out) >= most:
                return bytes(out[:most])
            if last is None:
                if code > clear:
                    raise ValueError("a code before its time")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise ValueError("a code before its time")
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
            last = entry
    return bytes(out[:most])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _frames(data: bytes) -> tuple[int, int, np.ndarray | None, list[tuple]]:
    """Size, common palette and frames (x, y, w, h, palette, interlaced, transparent, disposal, start code, coded bytes); what is coded isn't decoded yet."""
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    _room(width, height)
    colours = lambda at, flags: np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
    at, common = 13, None
    if flags & 0x80:
        common = colours(at, flags)
        at += common.size
    frames, clear, disposal = [], None, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, clear = body[0] >> 2 & 7, body[3] if body[0] & 1 else None
            at = end
        elif data[at] == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at, own = at + 10, common
            if flags & 0x80:
                own = colours(at, flags)
                at += own.size
            start = data[at]
            if not 2 <= start <= 8 or own is None:
                raise ValueError("no palette, or a code size out of range")
            body, at = _blocks(data, at + 1)
            frames.append((x, y, w, h, own, bool(flags & 0x40), clear, disposal, start, body))
            clear, disposal = None, 0
        else:
            raise ValueError("an unknown block")
    if at >= len(data):
        raise ValueError("picture data ends early")
    return width, height, common, frames


def read_gif(data: bytes, frame: int | None = None) -> np.ndarray:
    """A frame as it is shown, the middle one (n // 2) if none is given: over what the frames before left, each as its disposal says. Where nothing was drawn is black."""
    width, height, _, frames = _frames(data)
    if not frames:
        raise ValueError("no frame")
    canvas = np.zeros((height, width, 3), np.uint8)
    for k, (x, y, w, h, colours, laced, clear, disposal, start, body) in enumerate(frames):
        if w * h > MOST:
            raise ValueError(f"{w} x {h} pixels")
        before = canvas.copy() if disposal == 3 else None
        got = np.frombuffer(_lzw(body, start, w * h), np.uint8)
        if len(got) < w * h:
            raise ValueError("picture data ends early")
        got = got.reshape(h, w)
        if laced:
            rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            got = got[np.argsort(rows)]
        if got.max(initial=0) >= len(colours):
            raise ValueError("a colour is not in the palette")
        got = got[: max(0, height - y), : max(0, width - x)]
        part = canvas[y : y + h, x : x + w]
        part[...] = colours[got] if clear is None else np.where((got == clear)[:, :, None], part, colours[got])
        if k == (len(frames) // 2 if frame is None else frame):
            return canvas
        if disposal == 2:
            canvas[y : y + h, x : x + w] = 0
        elif disposal == 3:
            canvas = before
    raise ValueError("no such frame")


def write_gif(width: int, height: int, palette: np.ndarray, frames: list[dict]) -> bytes:
    """frames: x, y, pixels (palette numbers), and if they have them clear (the transparent colour), disposal, laced. Codes of one width with a fresh table before it would grow: larger files, but any reader takes them."""
    bits = max(2, int(len(palette) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(palette)] = palette
    out = [b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | bits - 1, 0, 0) + table.tobytes()]
    for f in frames:
        p = np.asarray(f["pixels"], np.uint8)
        if f.get("laced"):
            p = np.concatenate([p[a::b] for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
        flags = f.get("disposal", 0) << 2 | ("clear" in f)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, 5, f.get("clear", 0)) + b"\x00")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.get("x", 0), f.get("y", 0), p.shape[1], len(p), 0x40 * bool(f.get("laced"))) + bytes([bits]))
        acc = n = 0
        body, room, every = bytearray(), (1 << bits) - 2, p.reshape(-1).tolist()
        for i in range(0, max(1, len(every)), room):
            for code in [1 << bits, *every[i : i + room]]:
                acc |= code << n
                n += bits + 1
        acc |= ((1 << bits) + 1) << n
        body = acc.to_bytes((n + bits + 8) // 8, "little")
        out += [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)]
        out.append(b"\x00")
    return b"".join(out) + b"\x3b"
