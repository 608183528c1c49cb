"""Media columns: byte payloads kept as lossless WebP, read back as pixel arrays, with features."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .common import exact_ids, id_text, read_table, ship

#: Bytes of a row of pixels, and of which a payload is a multiple.
ROW = 64
_COLUMNS = "doc_id string, n_bytes long, media binary"
_DIGESTS = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_FEATURES = "payload binary, feature string"


def padded(data: bytes, row: int = ROW) -> bytes:
    return data + bytes(-len(data) % row if data else row)


def _spread(counts: np.ndarray) -> float:
    """Bits a value by Renyi's entropy of order 2."""
    return float(2 * np.log2(counts.sum()) - np.log2(np.dot(counts, counts)))


def store(payload: bytes, row: int = ROW) -> bytes:
    """A payload of a multiple of row bytes as grey pixels, row to a line: a WebP file, or several, one after another, where there are more lines than an image may have.

    Up to 16 different bytes make a palette, of which several fit a pixel; else green is taken off red and blue, so one
    channel is left, and each pixel is predicted from its left or top neighbour if the differences have less entropy than
    the bytes. Then come prefix codes and back-references to what was there before.
    """
    out, most = [], row * webp.MAX_SIDE
    for at in range(0, len(payload), most):
        grey = np.frombuffer(payload[at : at + most], np.uint8).reshape(-1, row)
        pixels = grey.astype(np.uint32) * np.uint32(0x010101) | np.uint32(webp.OPAQUE)
        counts = np.bincount(grey.reshape(-1))
        if np.count_nonzero(counts) <= 16:
            out.append(webp.encode(pixels, palette=True, back=True))
            continue
        steps = {mode: np.bincount(np.diff(grey, axis=2 - mode).reshape(-1)) for mode in (1, 2) if len(grey) > 1}
        bits = {0: _spread(counts)} | {mode: _spread(n) for mode, n in steps.items()}
        mode = min(bits, key=lambda k: (bits[k], k))
        modes = np.full((-(-len(grey) // 512), -(-row // 512)), mode) if mode else None
        out.append(webp.encode(pixels, subtract_green=True, predictor=modes, shift=9, back=True))
    return b"".join(out)


def images(media: bytes) -> Iterator[np.ndarray]:
    """The pixel arrays of WebP files that follow one another."""
    at = 0
    while at < len(media):
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield webp.decode(media[at:end])
        at = end


def load(media: bytes) -> bytes:
    return b"".join((p & 0xFF).astype(np.uint8).tobytes() for p in images(media))


def describe(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits, different values and mean step between neighbours, each to three places."""
    counts = np.bincount(samples)
    values = np.flatnonzero(counts)
    p = counts[values] / len(samples)
    mean = float(p @ values)
    steps = np.abs(np.diff(samples.astype(np.int16)))
    return f"mean={mean:.3f};std={max(0.0, float(p @ (values - mean) ** 2)) ** 0.5:.3f};entropy={abs(float(p @ np.log2(p))):.3f};values={len(p)};step={steps.mean():.3f}"


#: Bytes that a task keeps of what it has made, for texts that come again.
KEPT = 16 << 20


class _Seen:
    """What a function gave for byte strings, so that one that comes again in a task isn't worked on twice; it starts anew once KEPT bytes are there."""

    def __init__(self, make, most: int = KEPT):
        self.make, self.most, self.made, self.n = make, most, {}, 0

    def __call__(self, data: bytes):
        key = hashlib.sha256(data).digest()
        if key not in self.made:
            got = self.make(data)
            size = 200 + (len(got) if isinstance(got, bytes) else 500)
            if self.n + size > self.most:
                self.made, self.n = {}, 0
            self.made[key] = got
            self.n += size
        return self.made[key]


def _described(media: bytes) -> tuple:
    x = load(media)
    return len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(np.frombuffer(x, np.uint8))


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    stored = _Seen(lambda raw: store(padded(raw)))
    for pdf in batches:
        for low in range(0, len(pdf), 500):
            part = pdf.iloc[low : low + 500]
            raw = [(t or "").encode() for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_bytes": [len(x) for x in raw], "media": [stored(x) for x in raw]})


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of each row. Null and empty texts give a row of zeros; equal texts equal bytes."""
    ship(docs.sparkSession)
    return exact_ids(docs.select(id_text(docs), "text").mapInPandas(_store, _COLUMNS))


def _read(media: pd.Series) -> pd.DataFrame:
    found = [load(m) for m in media]
    return pd.DataFrame({"payload": found, "feature": [describe(np.frombuffer(x, np.uint8)) for x in found]})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    described = _Seen(_described)
    for pdf in batches:
        out = [(doc_id, n, *described(bytes(media))) for doc_id, n, media in zip(pdf["doc_id"], pdf["n_bytes"], pdf["media"], strict=True)]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pd.DataFrame(out, columns=names)


def read_media(table: DataFrame) -> DataFrame:
    """table with payload (the bytes read back from media) and feature, in place of columns of these names."""
    ship(table.sparkSession)
    made = F.pandas_udf(_read, _FEATURES)("media")
    return table.withColumn("_media_made", made).withColumns({c: F.col(f"_media_made.{c}") for c in ("payload", "feature")}).drop("_media_made")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = write_media(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return exact_ids(stored.select(id_text(stored), "n_bytes", "media").mapInPandas(_digests, _DIGESTS))
