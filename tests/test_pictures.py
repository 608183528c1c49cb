"""Pictures: forms of PNG, JPEG and GIF against known pixels; bad files; thumbnails that are written once."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaq.functions import images, pictures
from vistaq.operators import media

R = np.random.default_rng(8)


def chunked(head, body, palette=None):
    chunk = lambda name, b: struct.pack(">I", len(b)) + name + b + struct.pack(">I", zlib.crc32(name + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("laced", [False, True])
def test_png_filters(channels, laced):
    for h, w in ((1, 1), (2, 9), (9, 2), (23, 17)):
        p = R.integers(0, 256, (h, w, channels)).astype(np.uint8)
        want = np.repeat(p[:, :, :1], 3, 2) if channels < 3 else p[:, :, :3]
        for kinds in (None, [0, 1, 2], [0, 1, 2, 3, 4], [4], [3], [1]):
            assert (pictures.decode(pictures.write_png(p, None if kinds is None else np.array(kinds), laced)) == want).all()


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_png_depths_and_palettes(bits):
    h, w = 7, 13
    p = R.integers(0, 1 << min(bits, 8), (h, w)).astype(np.uint8)
    line = lambda row: np.packbits(((row[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8)).tobytes() if bits < 8 else row.tobytes() if bits == 8 else np.stack([row, row ^ 77], 1).tobytes()
    body = b"".join(b"\x00" + line(row) for row in p)
    grey = pictures.decode(chunked(struct.pack(">IIBBBBB", w, h, bits, 0, 0, 0, 0), body))
    assert (grey[:, :, 1] == p.astype(int) * 255 // ((1 << min(bits, 8)) - 1)).all()
    if bits <= 8:
        palette = R.integers(0, 256, (1 << bits, 3)).astype(np.uint8)
        head = struct.pack(">IIBBBBB", w, h, bits, 3, 0, 0, 0)
        assert (pictures.decode(chunked(head, body, palette.tobytes())) == palette[p]).all()
        with pytest.raises(ValueError, match="palette"):
            pictures.decode(chunked(head, b"".join(b"\x00" + line(np.full(w, (1 << bits) - 1, np.uint8)) for _ in p), palette[:1].tobytes()))


def test_bad_pictures_are_value_errors():
    good = [pictures.write_png(R.integers(0, 256, (9, 9, 3)).astype(np.uint8)), pictures.write_jpeg(R.integers(0, 256, (20, 20, 3)).astype(np.uint8)), pictures.write_gif(5, 5, np.zeros((4, 3)), [{"pixels": R.integers(0, 4, (5, 5))}])]
    for data in good:
        assert pictures.decode(data).shape[2] == 3
        for cut in range(len(data)):
            try:
                pictures.decode(data[:cut])
            except ValueError:
                continue
            assert cut >= len(data) - (12 if data[:2] != b"\xff\xd8" else 60)  # the last chunk, and a JPEG's last bytes, may be lost without loss
        for _ in range(300):
            broken = bytearray(data)
            for k in R.integers(0, len(data), 3):
                broken[k] = R.integers(0, 256)
            try:
                pictures.decode(bytes(broken))
            except ValueError:
                pass
    for odd in (b"", b"\xff\xd8", b"GIF89a", b"no picture", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises(ValueError):
            pictures.decode(odd)
    with pytest.raises(ValueError, match="pixels"):
        pictures.decode(chunked(struct.pack(">IIBBBBB", 60_000, 60_000, 8, 2, 0, 0, 0), bytes(100)))
    with pytest.raises(ValueError, match="early"):
        pictures.decode(chunked(struct.pack(">IIBBBBB", 2000, 2000, 8, 2, 0, 0, 0), bytes(100)))


def waves(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([128 + 100 * np.sin(x / 30 + y / 50), 128 + 90 * np.cos(y / 35), 128 + 60 * np.sin((x + y) / 60)], 2).astype(np.uint8)


@pytest.mark.parametrize(("quality", "half", "restart", "off"), [(95, False, 0, 3), (95, True, 0, 4), (70, True, 0, 9), (90, True, 5, 5), (90, False, 3, 5)])
def test_jpeg(quality, half, restart, off):
    for h, w in ((150, 201), (1, 1), (8, 17), (33, 8)):
        p = waves(h, w)
        got = pictures.decode(pictures.write_jpeg(p, quality, half, restart))
        assert got.shape == p.shape and np.abs(got.astype(int) - p).max() <= off
        grey = pictures.decode(pictures.write_jpeg(p[:, :, :1], quality, half, restart))
        assert np.abs(grey.astype(int) - p[:, :, :1]).max() <= off
    noise = R.integers(0, 256, (40, 40, 3)).astype(np.uint8)
    assert np.abs(pictures.decode(pictures.write_jpeg(noise, 100, False)).astype(int) - noise).max() <= 3


def test_jpeg_draft():
    p = np.kron(waves(128, 192), np.ones((8, 8, 1), np.uint8))
    data = pictures.write_jpeg(p, 90)
    for draft, n in ((None, 1), (1000, 1), (512, 2), (256, 4), (128, 8), (1, 8)):
        got = pictures.decode(data, draft)
        assert got.shape == (1024 // n, 1536 // n, 3)
        assert np.abs(got.astype(int) - p[n // 2 :: n, n // 2 :: n]).mean() < 2
    with pytest.raises(ValueError, match="baseline"):
        pictures.decode(data.replace(b"\xff\xc0", b"\xff\xc2", 1))


def lzw(data, start):
    """Codes that grow, with a table that fills up."""
    clear, out, n = 1 << start, 0, 0

    def put(code, size):
        nonlocal out, n
        out |= code << n
        n += size

    size, table, at, now = start + 1, {bytes([i]): i for i in range(clear)}, clear + 2, b""
    put(clear, size)
    for b in data:
        if now + bytes([b]) in table:
            now += bytes([b])
            continue
        put(table[now], size)
        if at < 4096:
            table[now + bytes([b])] = at
            at += 1
            if at - 1 == 1 << size and size < 12:
                size += 1
        else:
            put(clear, size)
            size, table, at = start + 1, {bytes([i]): i for i in range(clear)}, clear + 2
        now = bytes([b])
    put(table[now], size)
    put(clear + 1, size)
    return out.to_bytes((n + 7) // 8, "little")


def test_gif_codes():
    for n in (1, 5, 300, 5000, 60_000):
        for start in (2, 4, 8):
            data = np.minimum(R.geometric(0.3, n), (1 << start) - 1).astype(np.uint8).tobytes()
            assert pictures._lzw(lzw(data, start), start, n) == data
            assert pictures._lzw(lzw(data, start), start, n // 2) == data[: n // 2]


@pytest.mark.parametrize("disposal", [0, 1, 2, 3])
def test_gif_disposals(disposal):
    colours = np.array([[10, 0, 0], [0, 20, 0], [0, 0, 30], [9, 9, 9]])
    frames = [{"pixels": np.full((4, 4), 0)}, {"x": 1, "y": 1, "pixels": np.array([[1, 3], [3, 1]]), "clear": 3, "disposal": disposal}, {"x": 2, "y": 2, "pixels": np.full((9, 9), 2), "laced": True}]
    data = pictures.write_gif(4, 4, colours, frames)
    first = np.full((4, 4), 0)
    second = first.copy()
    second[1, 1] = second[2, 2] = 1
    left = {0: second, 1: second, 2: first, 3: first}[disposal]
    shown = [colours[x].astype(np.uint8) for x in (first, second, left)]
    if disposal == 2:
        shown[2][1:3, 1:3] = 0
    shown[2][2:, 2:] = colours[2]
    for k in range(3):
        assert (pictures.read_gif(data, k) == shown[k]).all()
    assert (pictures.decode(data) == shown[1]).all()  # of three frames the second
    assert (pictures.decode(pictures.write_gif(4, 4, colours, frames[:1])) == shown[0]).all()


def files(spark, root, contents):
    os.makedirs(root, exist_ok=True)
    for name, data in contents.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    return spark.read.format("binaryFile").load(root)


def test_decoded_and_model_input(spark, tmp_path):
    p = waves(40, 60)
    found = files(spark, f"{tmp_path}/in", {"a.png": pictures.write_png(p), "b.jpg": pictures.write_jpeg(p, 95), "bad.png": b"\x89PNG\r\n\x1a\nxx"})
    rows = {r.path.rsplit("/", 1)[1]: r for r in media.decoded(found).collect()}
    assert bytes(rows["a.png"].pixels) == p.tobytes() and (rows["a.png"].width, rows["a.png"].height, rows["a.png"].error) == (60, 40, None)
    assert rows["bad.png"].error and rows["bad.png"].pixels is None and rows["bad.png"].width is None
    made = {r.path.rsplit("/", 1)[1]: r for r in media.prepared(found, None, size=32, mean=(0.4, 0.5, 0.6), std=(0.2, 0.3, 0.4)).collect()}
    want = images.preprocess(p, 32, (0.4, 0.5, 0.6), (0.2, 0.3, 0.4)).reshape(-1)
    assert np.allclose(made["a.png"].input, want, atol=1e-6) and made["bad.png"].input is None and made["bad.png"].error
    nothing = media.decoded(spark.createDataFrame([(None, None), ("x", b"")], "path string, content binary")).collect()
    assert len(nothing) == 2 and all(r.error for r in nothing)


def test_thumbnails_are_written_once(spark, tmp_path):
    contents = {f"{i}.png": pictures.write_png(waves(300 + i, 500)) for i in range(6)} | {"bad.png": b"zz"}
    found, root = files(spark, f"{tmp_path}/in", contents), f"file://{tmp_path}/thumbs"
    first = media.prepared(found, root, size=None).collect()
    assert sorted(r.written for r in first if not r.error) == [True] * 6 and sum(r.error is not None for r in first) == 1
    at = f"{tmp_path}/thumbs"
    names = sorted(x for x in os.listdir(at) if x.endswith(".jpg"))
    assert len(names) == 6 and os.listdir(f"{at}/_writing") == []
    times = {n: os.stat(f"{at}/{n}").st_mtime_ns for n in names}
    again = media.prepared(found, root, size=None).collect()
    assert not any(r.written for r in again) and times == {n: os.stat(f"{at}/{n}").st_mtime_ns for n in names}
    os.remove(f"{at}/{names[0]}")
    known = spark.createDataFrame([(n,) for n in names[1:]], "name string")
    some = [r for r in media.prepared(found, root, size=None, known=known).collect() if not r.error]
    assert [(r.thumb, r.written) for r in some] == [(names[0], True)]
    shape = pictures.decode(open(f"{at}/{names[0]}", "rb").read()).shape
    assert max(shape[:2]) == 256


def test_a_killed_task_leaves_no_half_file(tmp_path, monkeypatch):
    sink = media.Sink(f"file://{tmp_path}")
    sink.put("whole.jpg", b"abc")

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def move(self, a, b):
            raise OSError("killed")

        def __getattr__(self, name):
            return getattr(self.fs, name)

    whole, sink.fs = sink.fs, Broken(sink.fs)
    with pytest.raises(OSError, match="killed"):
        sink.put("half.jpg", b"xyz")
    assert not sink.has("half.jpg") and sink.has("whole.jpg") and sorted(x for x in os.listdir(tmp_path) if x != "_writing") == ["whole.jpg"]
    sink.fs = whole
    sink.put("half.jpg", b"xyz")  # the task's next attempt, and a second one beside it
    sink.put("half.jpg", b"xyz")
    assert open(f"{tmp_path}/half.jpg", "rb").read() == b"xyz"
    assert media.sweep(f"file://{tmp_path}") == 1 and media.sweep(f"file://{tmp_path}") == 0


def test_sizes_agree_with_columns(spark):
    pairs = [(int(w), int(h)) for w, h in R.integers(1, 2000, (200, 2))] + [(1, 4000), (4000, 1), (256, 256), (257, 256)]
    df = spark.createDataFrame(pairs, "w int, h int")
    got = df.select("w", "h", images.fitted(F.col("w"), F.col("h")).alias("s")).collect()
    assert all((r.s.w, r.s.h) == media.fit(r.w, r.h) for r in got)
