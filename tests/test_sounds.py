"""Lengths by ranged reads, windows by seek, FLAC blocks, resampling."""

import struct

import numpy as np
import pytest

from vistaq.functions import audio
from vistaq.functions import sounds as S

R = np.random.default_rng(6)


def wav(x, width, rate=8000, channels=1, code=1):
    if code == 3:
        data = x.astype("<f8" if width == 8 else "<f4").tobytes()
    elif width == 1:
        data = (x + 128).astype(np.uint8).tobytes()
    else:
        data = x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    return b"RIFF" + struct.pack("<I", 0) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, code, channels, rate, rate * width * channels, width * channels, 8 * width) + b"data" + struct.pack("<I", len(data)) + data


@pytest.mark.parametrize(("width", "code"), [(1, 1), (2, 1), (3, 1), (4, 1), (4, 3), (8, 3)])
def test_wav_windows(width, code):
    top = 1 if code == 3 else 1 << 8 * width - 1
    x = R.uniform(-1, 1, 4000) if code == 3 else R.integers(-top, top, 4000)
    f = S.Ranged(wav(x, width, channels=2, code=code))
    form = S.wav_form(f)
    before = f.read
    got = S.wav_samples(f, form, 500, 100)
    assert np.allclose(got, (x / top).reshape(-1, 2)[500:600].mean(1), atol=1e-6) and f.read - before == 100 * 2 * width
    assert S.duration(f) == 2000 / 8000 and len(S.wav_samples(f, form, 1990, 100)) == 10 and len(S.wav_samples(f, form, 5000, 9)) == 0


def shapes():
    t = np.arange(30_000)
    tone = np.round(9000 * np.sin(t / 25) + R.normal(size=len(t)) * 30)
    yield np.stack([tone, tone // 3 + 5], 1), 16
    yield np.stack([tone], 1), 16
    yield R.integers(-(1 << 15), 1 << 15, (9000, 2)), 16  # noise: as it is
    yield np.full((9000, 2), -77), 16
    yield np.stack([tone * 200, -tone * 150, tone], 1), 24
    yield R.integers(-128, 128, (5, 1)), 8


def test_flac_windows():
    for x, bits in shapes():
        x = x.astype(int)
        data = S.write_flac(x, 44_100, bits)
        form = S.flac_form(S.Ranged(data))
        want = (x.mean(1) / (1 << bits - 1)).astype(np.float32)
        for start, n in ((0, 10), (0, len(x)), (len(x) // 2, 5000), (len(x) - 3, 99), (4095, 2)):
            got = S.flac_samples(S.Ranged(data), form, start, n)
            assert np.allclose(got, want[start : start + n], atol=1e-6) and len(got) == len(want[start : start + n])
        assert S.duration(S.Ranged(data)) == len(x) / 44_100 and S.duration(S.Ranged(S.write_flac(x, 44_100, bits, total=False))) is None


def test_flac_reads_do_not_grow_with_the_file():
    reads = []
    for times in (1, 6):
        x = np.tile(R.integers(-(1 << 15), 1 << 15, (100_000, 2)), (times, 1))
        f = S.Ranged(S.write_flac(x, 48_000))
        S.flac_samples(f, S.flac_form(f), len(x) // 2, 20_000)
        reads.append(f.read)
    assert reads[1] < reads[0] + 4 * S.PIECE


def linear(x, order, bits=16):
    """A block of one channel with linear prediction, weights shifted by 9, and wasted bits."""
    weights = {1: [510], 2: [1000, -490], 3: [1500, -1480, 490]}[order]
    rest = [int(x[i]) - (sum(w * int(x[i - 1 - k]) for k, w in enumerate(weights)) >> 9) for i in range(order, len(x))]
    bits_ = [S._number((32 + order - 1) << 1, 8), S._numbers(x[:order], bits), S._number(11, 4), S._number(9, 5), *(S._number(w & 0xFFF, 12) for w in weights), S._number(1, 2), S._number(0, 4), S._number(31, 5), S._number(20, 5), S._numbers(np.array(rest), 20)]
    lead = bytes([0xFF, 0xF8, 7 << 4, 0, 0]) + struct.pack(">H", len(x) - 1)
    check = 0
    for c in lead:
        check = S._CRC8[check ^ c]
    return lead + bytes([check]) + np.packbits(np.concatenate(bits_)).tobytes() + b"\0\0"


def test_flac_linear_prediction_and_side_channels():
    x = np.round(5000 * np.sin(np.arange(700) / 9)).astype(np.int64)
    for order in (1, 2, 3):
        data = linear(x, order)
        got, end = S.flac_block(data, S.flac_header(data, 0), 16)
        assert (got[:, 0] == x).all() and end == len(data)
    left, right = R.integers(-1000, 1000, (2, 300))
    for form, a, b in ((8, left, left - right), (9, left - right, right), (10, (left + right) >> 1, left - right)):
        body = np.packbits(np.concatenate([S._number(2, 8), S._numbers(a, 16 + (form == 9)), S._number(2, 8), S._numbers(b, 16 + (form != 9))])).tobytes()
        got, _ = S.flac_block(body, (0, 300, form, 0, 0), 16)
        assert (got == np.stack([left, right], 1)).all()
    wasted = np.packbits(np.concatenate([S._number(2 << 0 | 1, 8), S._number(1, 3), S._numbers(left, 13)])).tobytes()
    assert (S.flac_block(wasted, (0, 300, 0, 0, 0), 16)[0][:, 0] == left << 3).all()


def test_flac_numbers_and_false_headers():
    for n in (0, 127, 128, 2047, 2048, 65_535, 65_536, (1 << 21) - 1, 1 << 21, 1 << 26, 1 << 30):
        more = 0 if n < 128 else next(k for k in range(1, 7) if n < 1 << 5 * k + 6)
        coded = bytes([n]) if not more else bytes([0xFF << 7 - more & 0xFF | n >> 6 * more]) + bytes(0x80 | n >> 6 * k & 0x3F for k in range(more - 1, -1, -1))
        lead = bytes([0xFF, 0xF8, 0xC0, 0x08]) + coded
        check = 0
        for c in lead:
            check = S._CRC8[check ^ c]
        head = S.flac_header(lead + bytes([check]) + bytes(16), 0)
        assert head[:3] == (-n - 1, 4096, 0) and S.flac_header(lead + bytes([check ^ 1]) + bytes(16), 0) is None


def test_what_tells_no_length_is_null():
    for data in (b"", b"x" * 50, b"RIFF1234WAVE", b"fLaC", b"OggS" + bytes(60), b"\0\0\0\x10ftypM4A " + bytes(8), b"ID3\x04\0\0\0\0\0\0" + bytes(99), b"\xff\xfb\x90\0" + bytes(50)):
        f = S.Ranged(data)
        assert S.duration(f) is None and f.read <= S.BOUND
    mvhd = lambda body: (lambda b: b"\0\0\0\x10ftypM4A " + bytes(4) + struct.pack(">I4s", 8 + len(b), b"moov") + b)(struct.pack(">I4s", 8 + len(body), b"mvhd") + body)
    assert S.duration(S.Ranged(mvhd(bytes(12) + struct.pack(">II", 600, 0xFFFFFFFF)))) is None
    assert S.duration(S.Ranged(mvhd(bytes(12) + struct.pack(">II", 600, 300)))) == 0.5
    r = np.random.default_rng(0)
    for _ in range(300):  # whatever comes, few bytes are read and nothing breaks
        head = r.choice([b"RIFF1234WAVEfmt ", b"fLaC", b"OggS", b"1234ftyp", b"ID3"])
        f = S.Ranged(bytes(head) + r.bytes(int(r.integers(0, 3000))))
        S.duration(f)
        assert f.read <= S.BOUND


def test_long_mp3_without_a_count():
    frame = b"\xff\xfb\x90\0" + bytes(413)
    f = S.Ranged(frame * 4000)
    assert S.duration(f) == pytest.approx(4000 * 1152 / 44_100, rel=1e-3) and f.read <= S.BOUND
    counted = frame[:36] + b"Xing" + struct.pack(">II", 1, 123) + frame[48:]
    vbri = frame[:36] + b"VBRI" + bytes(10) + struct.pack(">I", 77) + frame[54:]
    assert S.duration(S.Ranged(b"junk" * 5 + b"")) is None
    assert S.duration(S.Ranged(b"ID3\x04\0\0\0\0\0\x0a" + bytes(10) + counted + frame)) == 123 * 1152 / 44_100
    assert S.duration(S.Ranged(vbri + frame)) == 77 * 1152 / 44_100


def test_resampling():
    for old, new, hertz in ((44_100, 48_000, 1000), (48_000, 44_100, 15_000), (8000, 48_000, 3000), (96_000, 48_000, 18_000)):
        t = np.arange(old)
        y = audio.Resampler(old, new)(np.sin(2 * np.pi * hertz * t / old))
        want = np.sin(2 * np.pi * hertz * np.arange(len(y)) / new)
        assert len(y) == new and np.abs(y - want)[2000:-2000].max() < 2e-3
    for old, hertz in ((96_000, 30_000), (96_000, 24_500), (64_000, 25_000)):  # what the new rate can't hold is gone
        y = audio.Resampler(old, 48_000)(np.sin(2 * np.pi * hertz * np.arange(old) / old))
        assert 20 * np.log10(np.abs(y[3000:-3000]).max()) < -80
    x, one = R.normal(size=20_000), audio.Resampler(22_050, 48_000)
    whole = one(x)
    assert all((one(x, block) == whole).all() for block in (1, 7, 1000, 1 << 20))
    assert np.allclose(one(np.ones(5000))[500:-500], 1, atol=1e-9) and len(one(np.zeros(0))) == 0


def test_tables_of_files(spark, tmp_path):
    tone = np.round(8000 * np.sin(np.arange(16_000 * 31) / 16_000 * 2 * np.pi * 700)).astype(int)
    for name, data in {"a.flac": S.write_flac(tone[:, None], 16_000), "b.wav": wav(tone * 256, 3, 16_000), "short.wav": wav(tone[:800], 2, 16_000), "bad.wav": b"RIFF0000WAVEzz", "c.mp3": b"\xff\xfb\x90\0" + bytes(413) + b"\xff\xfb\x90\0" + bytes(413)}.items():
        (tmp_path / name).write_bytes(data)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    by_path, by_content = (sorted(((r.path.rsplit("/", 1)[1], r.window, r.seconds, r.error, None if r.mel is None else round(float(np.mean(r.mel)), 3)) for r in audio.log_mels(df).collect()), key=repr) for df in (files.select("path"), files))
    assert by_path == by_content and [r[:3] for r in by_path if not r[3]] == [("a.flac", 0, 31.0), ("a.flac", 1, 31.0), ("a.flac", 2, 31.0), ("b.wav", 0, 31.0), ("b.wav", 1, 31.0), ("b.wav", 2, 31.0), ("short.wav", 0, 0.1)]
    assert {r[0] for r in by_path if r[3]} == {"bad.wav", "c.mp3"}
    flac, other = ([r[4] for r in by_path if r[0] == n] for n in ("a.flac", "b.wav"))
    assert np.allclose(flac, other, atol=0.5)
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.durations(files.select("path")).collect()}
    assert got["a.flac"].seconds == 31 and got["c.mp3"].seconds == 2 * 1152 / 44_100 and got["bad.wav"].seconds is None and all(r.read <= S.BOUND for r in got.values())
    missing = audio.durations(spark.createDataFrame([(f"file://{tmp_path}/none.wav",), (None,)], "path string")).collect()
    assert len(missing) == 2 and all(r.error and r.seconds is None for r in missing)
