"""Media files (path, content as binaryFile gives them; or path alone, or path and place in a pack, see sources.packs) to arrays, model input and thumbnails, inside Arrow functions."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images, pictures
from ..functions.text import thumb_name
from ..sources import packs

#: Bytes of results that a task holds before it hands them on.
HELD = 16 << 20
#: Sides of a model's input and of a thumbnail, and the quality it is stored at. Fixed values.
SIZE, SIDE, QUALITY = 224, 256, 70


def each(make: Callable[[dict], dict], columns: list[str], weigh: Callable[[dict], int]):
    """A function over batches of files: make gives a file's row; what goes wrong there is the row's error, and its other columns are null. A file is decoded alone, and results leave as soon as HELD bytes are there, so memory follows the largest file, not the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            for file in pdf.to_dict("records"):
                try:
                    row = {"path": file["path"], **make(file), "error": None}
                except Exception as error:  # one bad file is a row with its error, not a failed job
                    row = {**dict.fromkeys(columns), "path": file["path"], "error": str(error) or type(error).__name__}
                held.append(row)
                n += weigh(row) + 200
                if n >= HELD:
                    yield pd.DataFrame(held, columns=["path", *columns, "error"], dtype=object)
                    held, n = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", *columns, "error"], dtype=object)

    return run


def decoded(files: DataFrame, draft: int | None = pictures.DRAFT) -> DataFrame:
    """path, width, height and pixels (bytes, row by row, red, green, blue) of each picture, or its error. Of an animation the middle frame. Null and empty contents are errors; binaryFile itself leaves empty files out."""

    reader = packs.Reader()

    def make(file: dict) -> dict:
        p = pictures.decode(reader.whole(file), draft)
        return {"width": p.shape[1], "height": p.shape[0], "pixels": p.tobytes()}

    run = each(make, ["width", "height", "pixels"], lambda r: len(r["pixels"] or b""))
    return files.select("path", *packs.source_of(files)).mapInPandas(run, "path string, width int, height int, pixels binary, error string")


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bicubic, each new pixel of what it covers."""
    h, w, c = pixels.shape
    rows = pixels.astype(np.float64)
    if h != height:
        rows = (images._weights(h, height) @ rows.reshape(h, w * c)).reshape(height, w, c)
    out = rows
    if w != width:
        out = (images._weights(w, width) @ rows.transpose(1, 0, 2).reshape(w, height * c)).reshape(width, height, c).transpose(1, 0, 2)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def fit(width: int, height: int, most: int = SIDE) -> tuple[int, int]:
    """The size of a thumbnail, as images.fitted says it for columns."""
    if width <= most and height <= most:
        return width, height
    shape = width / height
    ideal = most * shape if shape <= 1 else most / shape
    off = lambda n: abs(shape - (n / most if shape <= 1 else 0 if n == 0 else most / n))
    low, high = int(np.floor(ideal)), int(np.ceil(ideal))
    other = max(1, low if off(low) <= off(high) else high)
    return (other, most) if shape <= 1 else (most, other)


class Sink:
    """A folder, on whatever file system pyarrow opens, in which a file is either whole or not there.

    A file is written under a name of its own below _writing and then moved, so a task that is killed, run again or run
    twice at once leaves no half file; what is there already is left. Files that broke off stay below _writing until
    swept.
    """

    def __init__(self, root: str):
        from pyarrow.fs import FileSystem

        self.fs, self.at = FileSystem.from_uri(root)
        self.fs.create_dir(f"{self.at}/_writing", recursive=True)

    def has(self, name: str) -> bool:
        from pyarrow.fs import FileType

        return self.fs.get_file_info(f"{self.at}/{name}").type == FileType.File

    def put(self, name: str, data: bytes) -> None:
        part = f"{self.at}/_writing/{name}-{uuid.uuid4().hex}-{os.getpid()}"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, f"{self.at}/{name}")


def sweep(root: str) -> int:
    """Deletes what tasks that broke off have left below root; only while nothing is written. How many."""
    from pyarrow.fs import FileSelector

    s = Sink(root)
    left = s.fs.get_file_info(FileSelector(f"{s.at}/_writing"))
    for f in left:
        s.fs.delete_file(f.path)
    return len(left)


def prepared(files: DataFrame, root: str | None = None, size: int | None = SIZE, mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5), side: int = SIDE, quality: int = QUALITY, known: DataFrame | None = None) -> DataFrame:
    """A row per picture: path, input (size x size x 3 numbers, by channels, as the model takes them), thumb (its file's name), written, or error. A file is decoded once for both.

    Thumbnails are baseline JPEG files of at most side x side, named by thumb_name of the path with .jpg, written once: a
    name that is there is left. root: their folder, or None for none; size: None for no input. known (name): thumbnails
    that are known to be there; their pictures aren't even read if no input is asked for.
    """
    named = files.withColumn("thumb", thumb_of(F.col("path")))
    if known is not None and size is None:
        named = named.join(known.select(F.col("name").alias("thumb")).distinct(), "thumb", "left_anti")
    sink: list[Sink] = []
    reader = packs.Reader()

    def make(file: dict) -> dict:
        row: dict = {"thumb": file["thumb"], "written": None, "input": None}
        there = False
        if root:
            if not sink:
                sink.append(Sink(root))
            there = sink[0].has(file["thumb"])
            row["written"] = False
        if there and size is None:
            return row
        p = pictures.decode(reader.whole(file))
        if root and not there:
            w, h = fit(p.shape[1], p.shape[0], side)
            sink[0].put(file["thumb"], pictures.write_jpeg(resized(p, w, h), quality))
            row["written"] = True
        if size is not None:
            row["input"] = images.preprocess(p, size, mean, std).reshape(-1)
        return row

    run = each(make, ["thumb", "written", "input"], lambda r: 4 * len(r["input"]) if r["input"] is not None else 0)
    return named.select("path", *packs.source_of(files), "thumb").mapInPandas(run, "path string, thumb string, written boolean, input array<float>, error string")


def thumb_of(path):
    return F.regexp_replace(thumb_name(path), "webp$", "jpg")
