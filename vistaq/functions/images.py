"""Images as arrays: the model's input and the size of a thumbnail."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fitted(width: Column, height: Column, most: int = 256) -> Column:
    """A struct (w, h): the size of a thumbnail that keeps the shape, no side over most; smaller images stay. Of the two whole numbers that a side may be rounded to, the one nearer the shape is taken, the lower of equal ones."""
    shape = width / height
    # the other side of a side of most, as a number, and how far off the shape a whole one is
    ideal = F.when(shape <= 1, most * shape).otherwise(most / shape)
    low = F.floor(ideal)
    off = lambda n: F.abs(shape - F.when(shape <= 1, n / most).when(n == 0, 0).otherwise(F.lit(most) / n))
    other = F.greatest(F.when(off(low) <= off(F.ceil(ideal)), low).otherwise(F.ceil(ideal)), F.lit(1)).cast("int")
    small = (width <= most) & (height <= most)
    w = F.when(small, width).when(shape <= 1, other).otherwise(most).cast("int")
    h = F.when(small, height).when(shape <= 1, most).otherwise(other).cast("int")
    return F.struct(w.alias("w"), h.alias("h"))


@lru_cache(256)
def _weights(old: int, new: int) -> np.ndarray:
    """(new, old): cubic weights (a = -1/2), widened where an image shrinks, as each new pixel sees what it covers."""
    scale = max(1.0, old / new)
    at = (np.arange(new) + 0.5) * old / new
    x = np.abs(np.arange(old)[None, :] + 0.5 - at[:, None]) / scale
    near, far = (1.5 * x - 2.5) * x * x + 1, ((-0.5 * x + 2.5) * x - 4) * x + 2
    w = np.where(x < 1, near, np.where(x < 2, far, 0))
    return w / w.sum(1, keepdims=True)


def preprocess(pixels: np.ndarray, size: int, mean, std) -> np.ndarray:
    """(channels, size, size) of an image (height, width, channels) of bytes: resized to the square at once, bicubic, without a crop; then scaled to 1 and normalized."""
    h, w, c = pixels.shape
    rows = (_weights(h, size) @ pixels.reshape(h, w * c).astype(np.float64)).reshape(size, w, c)
    out = (_weights(w, size) @ rows.transpose(1, 0, 2).reshape(w, size * c)).reshape(size, size, c).transpose(1, 0, 2)
    out = np.clip(np.round(out), 0, 255).astype(np.float32) / np.float32(255)
    return ((out - np.asarray(mean, np.float32)) / np.asarray(std, np.float32)).transpose(2, 0, 1)
