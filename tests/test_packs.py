"""Small files in packs: few large files however many rows, the same bytes, and what is read of them."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaq.functions import audio, pictures, sounds
from vistaq.operators import media
from vistaq.plans import queries
from vistaq.sources import packs

SF = "/root/testdata/sf0.001"
R = np.random.default_rng(5)


def stored(root):
    return [f"{at}/{x}" for at, _, names in os.walk(root) for x in names if not x.startswith((".", "_"))]


def rows_of(spark, n):
    return spark.range(n).select(F.concat("id", F.lit(".bin")).alias("name"), F.col("id").alias("k"))


def test_parts_of_packs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packs, "LEAST", 20)
    made = lambda row: bytes([row["k"] % 256]) * (row["k"] % 7)
    got = packs.write(rows_of(spark, 300), f"file://{tmp_path}/x", made)
    places = got.collect()
    assert len(places) == 300 and len(stored(tmp_path)) <= 2 * 2 * spark.sparkContext.defaultParallelism
    reader = packs.Reader()
    for r in places:
        k = int(r.path.rsplit("/", 1)[1][:-4])
        assert reader.whole(r.asDict()) == made({"k": k})
    assert packs.write(rows_of(spark, 0), f"file://{tmp_path}/none", made).count() == 0


def test_a_pack_ends_when_it_is_full(spark, tmp_path):
    rows = rows_of(spark, 3).withColumn("n", F.lit(packs.PACK // 2 + 1)).coalesce(1)
    got = packs.write(rows, f"file://{tmp_path}/x", lambda row: bytes(row["n"])).collect()
    assert all(r.start in (0, packs.PACK // 2 + 1) for r in got) and len({r.pack for r in got}) >= 2


def test_readers_of_packs(spark, tmp_path):
    p = R.integers(0, 256, (9, 8, 3)).astype(np.uint8)
    made = [pictures.write_png(p), b"broken", b"", b"fLaC\x80\x00\x00\x22" + bytes(10) + (8000 << 44 | 1 << 41 | 15 << 36 | 16_000).to_bytes(8, "big") + bytes(400_000)]
    found = packs.write(rows_of(spark, 4), f"file://{tmp_path}/x", lambda row: made[row["k"]])
    seen = {r.path[-5]: r for r in media.decoded(found).collect()}
    assert bytes(seen["0"].pixels) == p.tobytes() and all(seen[k].error for k in "123")
    told = {r.path[-5]: r for r in audio.durations(found).collect()}
    assert (told["3"].kind, told["3"].seconds) == ("flac", 2.0) and told["3"].read <= sounds.BOUND and told["2"].seconds is None
    thumbs = media.prepared(found, f"file://{tmp_path}/thumbs", size=4).where("error is null").collect()
    assert [(t.written, len(t.input)) for t in thumbs] == [(True, 48)]
    # a file by its path alone
    one = media.decoded(spark.createDataFrame([(f"file://{tmp_path}/thumbs/{thumbs[0].thumb}",), (f"file://{tmp_path}/thumbs/none.jpg",)], "path string")).collect()
    assert sorted((r.width or 0, r.error is None) for r in one) == [(0, False), (8, True)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize(("name", "table"), [("picture_pixels", "customer"), ("sound_lengths", "customer"), ("gif_middle", "part")])
def test_files_do_not_grow_with_rows(spark, tmp_path, monkeypatch, name, table):
    monkeypatch.setattr(queries, "scratch", lambda spark, what: f"file://{tmp_path}/{what}")
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert queries.QUERIES[name](spark, SF).count() == rows
    assert len(stored(tmp_path)) <= max(4, rows // 20)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_thumbnails_are_read_by_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch", lambda spark, what: f"file://{tmp_path}/{what}")
    n = queries.QUERIES["thumbs_written"](spark, SF).count()
    names = [os.path.basename(x) for x in stored(tmp_path)]
    assert n == sum(bool(re.fullmatch(r"[0-9a-f]{16}\.jpg", x)) for x in names) and not any(x.endswith(".png") for x in names)


def test_long_codes_of_a_jpeg():
    # a table of 512 places for codes of up to 9 bits; longer ones are found, and those that don't exist aren't
    sizes, symbols = bytes([0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]), bytes(range(15))
    short, lows, long = pictures._code_lengths_to_table(sizes, symbols)
    assert len(short) == 1 << pictures.SHORT
    code = 0
    for k, n in enumerate(range(2, 17)):
        for rest in (0, (1 << (16 - n)) - 1):
            bits = code << (16 - n) | rest
            assert (short[bits >> (16 - pictures.SHORT)] or pictures._longer(lows, long, bits)) == n << 8 | k
        code = code + 1 << 1
    assert not pictures._longer(lows, long, 0xFFFF) and not short[0xFFFF >> (16 - pictures.SHORT)]


def test_filters_byte_by_byte():
    for depth in (1, 2, 3, 4, 6):
        for h, w in ((1, 1), (5, 1), (1, 5), (7, 11), (90, 80)):
            raw, kinds = R.integers(0, 256, (h, w, depth)).astype(np.uint8), R.integers(0, 5, h)
            want = np.zeros((h + 1, w + 1, depth), np.int32)
            for y in range(h):
                for x in range(w):
                    guess = pictures._predicted(np.array(kinds[y]), want[y + 1, x], want[y, x + 1], want[y, x])
                    want[y + 1, x + 1] = (raw[y, x] + guess) & 255
            assert (pictures._unfiltered_bytes(kinds.tolist(), raw) == want[1:, 1:]).all()
            assert (pictures._unfiltered(kinds, raw) == want[1:, 1:]).all()
