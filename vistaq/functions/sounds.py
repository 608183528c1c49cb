"""Stored sounds through ranged reads: how long they are, and parts of them as samples. WAV and FLAC are decoded; of MP3, Ogg and MP4 the length is told."""

from __future__ import annotations

import struct

import numpy as np

#: Bytes at the front and at the end of a file that its length is looked for in, and headers that are stepped over. So a length takes no more than BOUND bytes.
HEAD, TAIL, STEPS = 1 << 16, 1 << 16, 64
BOUND = 2 * HEAD + TAIL + 32 * STEPS
#: Bytes in which a FLAC block is looked for at once, and in which the one after it has to follow.
PROBE, PIECE = 1 << 15, 1 << 17


class Ranged:
    """Reads parts of a file, by a handle with read_at(n, offset) or of bytes, and counts what was read. Of a handle the file may be a part only, from start on."""

    def __init__(self, source, size: int | None = None, start: int = 0):
        self.source, self.size, self.start, self.read = source, len(source) if size is None else size, start, 0

    def at(self, offset: int, n: int) -> bytes:
        n = max(0, min(n, self.size - offset))
        got = b"" if not n or offset < 0 else self.source[offset : offset + n] if isinstance(self.source, (bytes, bytearray, memoryview)) else self.source.read_at(n, self.start + offset)
        self.read += len(got)
        return bytes(got)


def kind(head: bytes) -> str | None:
    """By the first bytes, not the name."""
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return "wav"
    if head[:4] == b"fLaC":
        return "flac"
    if head[:4] == b"OggS":
        return "ogg"
    if head[4:8] == b"ftyp":
        return "mp4"
    return "mp3" if head[:3] == b"ID3" or _frame(head, 0) else None


def duration(f: Ranged) -> float | None:
    """Seconds, or None where the file doesn't tell or isn't known; at most BOUND bytes are read."""
    what = kind(f.at(0, 16))
    try:
        return {"wav": _wav_seconds, "flac": _flac_seconds, "ogg": _ogg_seconds, "mp4": _mp4_seconds, "mp3": _mp3_seconds}[what](f) if what else None
    except (LookupError, struct.error, ZeroDivisionError, ValueError):
        return None


# ---- WAV


def wav_form(f: Ranged) -> tuple[int, int, int, bool, int, int]:
    """Rate, channels, bytes of a sample, whether it is a float, where the data begins and its bytes."""
    at, form = 12, None
    for _ in range(STEPS):
        head = f.at(at, 8)
        if len(head) < 8:
            break
        name, n = struct.unpack("<4sI", head)
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.at(at + 8, 16))
            if code == 0xFFFE:  # the code proper begins what follows
                code = struct.unpack("<H", f.at(at + 8 + 24, 2))[0]
            if code not in (1, 3) or bits not in (8, 16, 24, 32, 64) or not channels or not rate:
                raise ValueError(f"samples of form {code} with {bits} bits")
            form = rate, channels, bits // 8, code == 3
        elif name == b"data":
            if form is None:
                raise ValueError("data before its form")
            return *form, at + 8, min(n, f.size - at - 8)
        at += 8 + n + n % 2
    raise ValueError("no data")


def _wav_seconds(f: Ranged) -> float:
    rate, channels, width, _, _, n = wav_form(f)
    return n // (channels * width) / rate


def wav_samples(f: Ranged, form: tuple, start: int, count: int) -> np.ndarray:
    """count frames from frame start, mono, from -1 to 1. Only these are read."""
    _, channels, width, is_float, at, n = form
    block = channels * width
    count = max(0, min(count, n // block - start))
    raw = np.frombuffer(f.at(at + start * block, count * block), np.uint8)
    raw = raw[: len(raw) // block * block]
    if is_float:
        x = raw.view("<f8" if width == 8 else "<f4").astype(np.float32)
    elif width == 1:
        x = (raw.astype(np.float32) - 128) / 128
    else:  # to the upper bytes of 32 bits
        whole = np.zeros((len(raw) // width, 4), np.uint8)
        whole[:, 4 - min(width, 4) :] = raw.reshape(-1, width)[:, -4:]
        x = whole.view("<i4")[:, 0].astype(np.float64) / (1 << 31)
    return x.reshape(-1, channels).mean(1).astype(np.float32)


# ---- FLAC


def flac_form(f: Ranged) -> tuple[int, int, int, int, int]:
    """Rate, channels, bits, frames in all (0 where unknown) and where the first block of samples begins."""
    at, form = 4, None
    for _ in range(STEPS):
        head = f.at(at, 4)
        n = int.from_bytes(head[1:4], "big")
        if head[0] & 0x7F == 0:
            x = int.from_bytes(f.at(at + 4, 34)[10:18], "big")
            form = x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1
        at += 4 + n
        if head[0] & 0x80:
            break
    if not form or not form[0]:
        raise ValueError("no form")
    return *form, at


def _flac_seconds(f: Ranged) -> float | None:
    rate, _, _, total, _ = flac_form(f)
    return total / rate if total else None


def _crc8_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = x << 1 ^ (0x07 if x & 0x80 else 0)
        out.append(x & 0xFF)
    return out


_CRC8 = _crc8_table()


def flac_header(data: bytes, at: int) -> tuple[int, int, int, int, int] | None:
    """Of a block that begins at a place: its first frame, its frames, channel form, bits of a sample (0: as the file says), and where its channels begin. None if no header with the right check sum is there. Fixed block sizes number blocks, not frames: the first is told as minus the number and minus one."""
    b = data[at : at + 16]
    if len(b) < 6 or b[0] != 0xFF or b[1] & 0xFE != 0xF8:
        return None
    size, rate, form, width = b[2] >> 4, b[2] & 15, b[3] >> 4, b[3] >> 1 & 7
    if not size or rate == 15 or form > 10 or width == 3 or b[3] & 1:
        return None
    lead = b[4]
    more = 0 if lead < 0x80 else 8 - ((~lead & 0xFF).bit_length()) - 1
    if lead >= 0x80 and not 1 <= more <= 6:
        return None
    number = lead & (0x7F if not more else 0x3F >> more)
    for c in b[5 : 5 + more]:
        number = number << 6 | c & 0x3F
    k = 5 + more
    if size in (6, 7):
        frames, k = int.from_bytes(b[k : k + size - 5], "big") + 1, k + size - 5
    else:
        frames = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    k += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    check = 0
    for c in b[:k]:
        check = _CRC8[check ^ c]
    if k >= len(b) or check != b[k]:
        return None
    return number if b[1] & 1 else -number - 1, frames, form, (0, 8, 12, 0, 16, 20, 24, 32)[width], at + k + 1


class _Bits:
    """Numbers of a block's bytes, and runs of Rice codes: the next 1 from each place is found for all places at once."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.n, self.at = len(self.bits), 0
        ones = np.where(self.bits > 0, np.arange(self.n), self.n)
        self.next = np.minimum.accumulate(ones[::-1])[::-1].tolist() + [self.n]

    def take(self, n: int) -> int:
        self.at += n
        if self.at > self.n:
            raise IndexError("a block ends early")
        part = self.bits[self.at - n : self.at]
        return int("".join(map(str, part.tolist())), 2) if n else 0

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> n - 1 else x

    def rows(self, count: int, width: int) -> np.ndarray:
        """count signed numbers of width bits each."""
        part = self.bits[self.at : self.at + count * width].reshape(count, width).astype(np.int64)
        self.at += count * width
        x = part @ (1 << np.arange(width - 1, -1, -1))
        return np.where(part[:, 0] > 0, x - (1 << width), x) if width else np.zeros(count, np.int64)

    def rice(self, count: int, low: int) -> np.ndarray:
        at, nexts, ends = self.at, self.next, []
        start = [at]
        for _ in range(count):
            one = nexts[at]
            ends.append(one)
            at = one + 1 + low
            start.append(at)
        if at > self.n:
            raise IndexError("a block ends early")
        self.at = at
        ones, first = np.array(ends, np.int64), np.array(start[:-1], np.int64)
        x = (ones - first) << low
        if low:
            x |= self.bits[(ones + 1)[:, None] + np.arange(low)].astype(np.int64) @ (1 << np.arange(low - 1, -1, -1))
        return x >> 1 ^ -(x & 1)


def _residual(bits: _Bits, frames: int, order: int) -> np.ndarray:
    wide, parts = (4, 5)[bits.take(2)], 1 << bits.take(4)
    out = []
    for k in range(parts):
        count, low = frames // parts - (order if not k else 0), bits.take(wide)
        if low == (1 << wide) - 1:
            width = bits.take(5)
            out.append(bits.rows(count, width) if width else np.zeros(count, np.int64))
        else:
            out.append(bits.rice(count, low))
    return np.concatenate(out)


def _channel(bits: _Bits, frames: int, width: int) -> np.ndarray:
    bits.take(1)
    form, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.next[bits.at] - bits.at + 1
        bits.at += wasted
    width -= wasted
    if form == 0:
        x = np.full(frames, bits.signed(width), np.int64)
    elif form == 1:
        x = bits.rows(frames, width)
    elif 8 <= form <= 12:  # sums of sums of the rest
        order = form - 8
        head = bits.rows(order, width)
        rest = _residual(bits, frames, order)
        firsts = [int(np.diff(head, k)[-1]) for k in range(order)]  # the last difference of each degree before the rest begins
        for k in range(order - 1, -1, -1):
            rest = np.cumsum(rest) + firsts[k]
        x = np.concatenate([head, rest])
    elif form >= 32:
        order = form - 31
        out = bits.rows(order, width).tolist()
        precision = bits.take(4) + 1
        shift = bits.signed(5)
        weights = [bits.signed(precision) for _ in range(order)][::-1]
        for k, r in enumerate(_residual(bits, frames, order).tolist()):
            out.append(r + (sum(a * b for a, b in zip(weights, out[k:])) >> shift))
        x = np.array(out, np.int64)
    else:
        raise ValueError(f"a channel of form {form}")
    return x << wasted


def flac_block(data: bytes, header: tuple, width: int) -> tuple[np.ndarray, int]:
    """(frames, channels) of a block whose header is known, and where it ends in data."""
    _, frames, form, own, at = header
    bits, width = _Bits(data[at:]), own or width
    if form < 8:
        x = [_channel(bits, frames, width) for _ in range(form + 1)]
    else:  # one of two channels is a difference, of a bit more
        a = _channel(bits, frames, width + (form == 9))
        b = _channel(bits, frames, width + (form != 9))
        if form == 8:
            x = [a, a - b]
        elif form == 9:
            x = [a + b, b]
        else:
            whole = (a << 1) | (b & 1)
            x = [(whole + b) >> 1, (whole - b) >> 1]
    return np.stack(x, 1), at + (bits.at + 7) // 8 + 2


def _next_block(f: Ranged, at: int, end: int, blocks: int) -> tuple[int, int, tuple] | None:
    """The first block that begins at or after a place: its place, its first frame and its header. blocks: frames of a block where these are of one size. In what isn't a header by chance the check sum is wrong, but for one of 256; so the next one has to follow on, and more is read until it does."""
    data, k = f.at(at, PROBE), 0
    while at + k < end:
        k = data.find(b"\xff", k)
        if k < 0 or k + 16 > len(data):
            k = len(data) - 15 if k < 0 else k
            more = f.at(at + len(data), PROBE)
            if not more:
                return None
            at, data, k = at + max(0, k), data[max(0, k) :] + more, 0
            continue
        if head := flac_header(data, k):
            while not (sure := _follows(data, k, head)) and len(data) - k < PIECE and (more := f.at(at + len(data), PROBE)):
                data += more
            if sure or at + len(data) >= f.size:
                return at + k, head[0] if head[0] >= 0 else (-head[0] - 1) * blocks, head
        k += 1
    return None


def _follows(data: bytes, at: int, head: tuple) -> bool:
    k = at + 2
    while (k := data.find(b"\xff", k)) >= 0:
        other = flac_header(data, k)
        if other and (other[0] == head[0] + head[1] if head[0] >= 0 else other[0] == head[0] - 1):
            return True
        k += 1
    return False


def flac_samples(f: Ranged, form: tuple, start: int, count: int) -> np.ndarray:
    """count frames from frame start, mono, from -1 to 1. The block is looked for between two places whose blocks are known, halving them; what is read doesn't grow with the file but for that."""
    _, _, width, total, first = form
    one = flac_header(f.at(first, 16), 0)
    if one is None:
        raise ValueError("no block where the first has to be")
    blocks = one[1]
    low, high = first, f.size
    while high - low > PIECE:
        middle = (low + high) // 2
        found = _next_block(f, middle, high, blocks)
        if found is None or found[1] > start:
            high = middle
        else:
            low = found[0]
    at, out, have, data, room = low, [], 0, b"", None  # data begins at the block; each byte is read once
    while have < count:
        if len(data) < PROBE:
            data += f.at(at + len(data), PROBE)
        head = flac_header(data, 0)
        if head is None:
            if not data or out:
                break
            raise ValueError("a block is broken")
        # a block takes no more than its channels as they are
        most = head[1] * (head[2] + 1 if head[2] < 8 else 2) * (width + 1) // 8 + 64 if room is None else room
        if len(data) < most:
            data += f.at(at + len(data), most - len(data))
        try:
            x, end = flac_block(data[:most], head, width)
            room = None
        except IndexError:
            if at + len(data) >= f.size and most >= len(data):
                break
            room = 2 * most  # one larger than usual
            continue
        begins = head[0] if head[0] >= 0 else (-head[0] - 1) * blocks
        if begins + len(x) > start:
            x = x[max(0, start - begins) :][: count - have]
            out.append(x)
            have += len(x)
        at, data = at + end, data[end:]
    x = np.concatenate(out) if out else np.zeros((0, 1))
    return (x.mean(1) / (1 << width - 1)).astype(np.float32)


# ---- Ogg


def _ogg_seconds(f: Ranged) -> float | None:
    head = f.at(0, 512)
    serial, body = head[14:18], head[27 + head[26] :]
    if body[:7] == b"\x01vorbis":
        rate, skip = struct.unpack_from("<I", body, 12)[0], 0
    elif body[:8] == b"OpusHead":
        rate, skip = 48_000, struct.unpack_from("<H", body, 10)[0]
    elif body[:5] == b"\x7fFLAC":
        rate, skip = int.from_bytes(body[27:30], "big") >> 4, 0
    else:
        return None
    tail = f.at(max(0, f.size - TAIL), TAIL)
    k = len(tail)
    while (k := tail.rfind(b"OggS", 0, k)) >= 0:  # the last page of the stream that tells where it is
        if tail[k + 14 : k + 18] == serial and k + 27 <= len(tail):
            at = struct.unpack_from("<q", tail, k + 6)[0]
            if at >= 0:
                return max(0, at - skip) / rate
    return None


# ---- MP4


def _mp4_seconds(f: Ranged) -> float | None:
    at, end = 0, f.size
    for _ in range(STEPS):
        head = f.at(at, 16)
        if len(head) < 8 or at >= end:
            return None
        n, name = struct.unpack_from(">I4s", head)
        inside = 8
        if n == 1:
            n, inside = struct.unpack_from(">Q", head, 8)[0], 16
        elif n == 0:
            n = end - at
        if n < inside:
            return None
        if name == b"moov":  # the header of the whole is in it
            at, end = at + inside, min(end, at + n)
            continue
        if name == b"mvhd":
            body = f.at(at + inside, 32)
            scale, length = struct.unpack_from(">IQ" if body[0] else ">II", body, 20 if body[0] else 12)
            return None if not scale or length in ((1 << 32) - 1, (1 << 64) - 1) else length / scale
        at += n
    return None


# ---- MP3

# Thousands of bits a second by number, of version 1 layers 1 to 3 and of version 2 layer 1 and layers 2 and 3; rates of version 1.
_RATES = (
    (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
)
_SAMPLING = (44_100, 48_000, 32_000)


def _frame(data: bytes, at: int) -> tuple[int, int, int, int, int] | None:
    """Of a frame that begins at a place: its bytes, its samples, their rate, bits a second, and where a header of its own would stand."""
    b = data[at : at + 4]
    if len(b) < 4 or b[0] != 0xFF or b[1] & 0xE0 != 0xE0:
        return None
    version, layer, bit, rate = b[1] >> 3 & 3, 4 - (b[1] >> 1 & 3), b[2] >> 4, b[2] >> 2 & 3
    if version == 1 or layer == 4 or bit in (0, 15) or rate == 3:
        return None
    speed = 1000 * _RATES[layer - 1 if version == 3 else 3 if layer == 1 else 4][bit]
    hertz = _SAMPLING[rate] >> (0 if version == 3 else 1 if version == 2 else 2)
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    pad = b[2] >> 1 & 1
    size = (12 * speed // hertz + pad) * 4 if layer == 1 else samples // 8 * speed // hertz + pad
    side = (17 if b[3] >> 6 == 3 else 32) if version == 3 else (9 if b[3] >> 6 == 3 else 17)
    return size, samples, hertz, speed, at + 4 + side


def _mp3_seconds(f: Ranged) -> float | None:
    at, head = 0, f.at(0, 10)
    if head[:3] == b"ID3":
        at = 10 + sum((c & 0x7F) << 7 * (3 - i) for i, c in enumerate(head[6:10])) + (10 if head[5] & 0x10 else 0)
    data, k = f.at(at, HEAD), 0
    while (k := data.find(b"\xff", k)) >= 0:  # a frame that another, or the end, follows
        one = _frame(data, k)
        if one and (_frame(data, k + one[0]) or at + k + one[0] in (f.size, f.size - 128)):
            break
        k += 1
    else:
        return None
    size, samples, hertz, _, own = one
    if data[own : own + 4] in (b"Xing", b"Info") and data[own + 7] & 1:
        return struct.unpack_from(">I", data, own + 8)[0] * samples / hertz
    if data[k + 36 : k + 40] == b"VBRI":
        return struct.unpack_from(">I", data, k + 36 + 14)[0] * samples / hertz
    # without a count: what the frames in HEAD come to, carried on to the end
    end = f.size - (128 if f.at(max(0, f.size - 128), 3) == b"TAG" else 0)
    used = total = 0
    while (one := _frame(data, k + used)) and one[2] == hertz:
        used, total = used + one[0], total + one[1]
        if at + k + used >= end:
            return total / hertz
    return total * (end - at - k) / used / hertz


# ---- writing FLAC


def _crc16_table() -> list[int]:
    out = []
    for x in range(256):
        x <<= 8
        for _ in range(8):
            x = x << 1 ^ (0x8005 if x & 0x8000 else 0)
        out.append(x & 0xFFFF)
    return out


_CRC16 = _crc16_table()


def _number(x: int, n: int) -> np.ndarray:
    return np.array([x >> k & 1 for k in range(n - 1, -1, -1)], np.uint8)


def _numbers(x: np.ndarray, width: int) -> np.ndarray:
    return ((x[:, None] >> np.arange(width - 1, -1, -1)) & 1).astype(np.uint8).ravel()


def _coded(x: np.ndarray, width: int) -> list[np.ndarray]:
    """A channel of a block: one value, or the differences of the degree whose sum is least, as Rice codes in two parts, or as it is where that is shorter."""
    if len(x) and (x == x[0]).all():
        return [_number(0, 8), _number(int(x[0]), width)]
    order = min(range(min(5, len(x))), key=lambda k: (np.abs(np.diff(x, k)).sum() if k else np.abs(x).sum(), k))
    parts = 1 if len(x) % 2 == 0 and order < len(x) // 2 else 0
    rest, out, at = np.diff(x, order), [_number((8 + order) << 1, 8), _numbers(x[:order], width), _number(0, 2), _number(parts, 4)], 0
    for k in range(1 << parts):
        n = len(x) // (1 << parts) - (0 if k else order)
        r = rest[at : at + n]
        at += n
        r = r << 1 ^ r >> 63
        low = max(0, min(14, int(np.log2(max(1.0, r.mean() if n else 1.0)))))
        ends = np.cumsum((r >> low) + 1 + low)
        bits = np.zeros(int(ends[-1]) if n else 0, np.uint8)
        if n:
            bits[ends - low - 1] = 1
            if low:
                bits[(ends - low)[:, None] + np.arange(low)] = _numbers(r & (1 << low) - 1, low).reshape(n, low)
        out += [_number(low, 4), bits]
    if sum(map(len, out)) > 8 + len(x) * width:
        return [_number(2, 8), _numbers(x, width)]
    return out


def write_flac(samples: np.ndarray, rate: int, bits: int = 16, block: int = 4096, total: bool = True) -> bytes:
    """A file of whole samples (frames, channels). Two channels are stored as the left one and the difference. total: whether the length is told."""
    samples = np.asarray(samples, np.int64)
    frames, channels = samples.shape
    head = struct.pack(">HH", block, block) + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | (frames if total else 0)).to_bytes(8, "big") + bytes(16)
    out = [b"fLaC\x80\x00\x00\x22" + head]
    for n, low in enumerate(range(0, frames, block)):
        x = samples[low : low + block]
        lead = bytes([0xFF, 0xF8, 7 << 4, (8 if channels == 2 else channels - 1) << 4])
        if n < 0x80:
            coded = bytes([n])
        else:
            more = next(k for k in range(1, 7) if n < 1 << 5 * k + 6)
            coded = bytes([0xFF << 7 - more & 0xFF | n >> 6 * more]) + bytes(0x80 | n >> 6 * k & 0x3F for k in range(more - 1, -1, -1))
        lead += coded + struct.pack(">H", len(x) - 1)
        check = 0
        for c in lead:
            check = _CRC8[check ^ c]
        parts = _coded(x[:, 0], bits) + (_coded(x[:, 0] - x[:, 1], bits + 1) if channels == 2 else [p for c in range(1, channels) for p in _coded(x[:, c], bits)])
        body = lead + bytes([check]) + np.packbits(np.concatenate(parts)).tobytes()
        check = 0
        for c in body:
            check = (check << 8 & 0xFFFF) ^ _CRC16[check >> 8 ^ c]
        out.append(body + struct.pack(">H", check))
    return b"".join(out)
