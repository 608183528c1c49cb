"""Many small files as parts of a few large ones, beside a table of where each lies: no folder has an entry, and no task a split, per file."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .scratch import ship

#: Bytes after which a task begins another pack, and rows that a task takes; of fewer rows a task gets no less than LEAST, if that leaves some for all cores.
PACK, ROWS, LEAST = 256 << 20, 5_000, 200
#: The columns that tell where a file lies.
PLACE = ["pack", "start", "size"]


def write(rows: DataFrame, root: str, make: Callable[[dict], bytes]) -> DataFrame:
    """Stores a file per row (name, and what make needs) below root; path, pack, start and size of each.

    A pack is written by one attempt of a task under a name of its own, and the table is committed by Spark, so what an
    attempt that broke off has left is in no row of it.
    """
    spark = rows.sparkSession
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(root)
        fs.create_dir(at, recursive=True)
        pack = name = None
        n = 0
        try:
            for pdf in batches:
                out = []
                for row in pdf.to_dict("records"):
                    data = make(row)
                    if pack is None or n >= PACK:
                        if pack is not None:
                            pack.close()
                        name, n = f"{uuid.uuid4().hex}.pack", 0
                        pack = fs.open_output_stream(f"{at}/{name}", buffer_size=1 << 20)
                    pack.write(data)
                    out.append((f"{root}/{row['name']}", f"{root}/{name}", n, len(data)))
                    n += len(data)
                yield pd.DataFrame(out, columns=["path", *PLACE])
        finally:
            if pack is not None:
                pack.close()

    count = rows.count()
    parts = max(math.ceil(count / ROWS), min(2 * spark.sparkContext.defaultParallelism, math.ceil(count / LEAST)), 1)
    rows.repartition(parts, "name").mapInPandas(run, "path string, pack string, start long, size long").write.parquet(f"{root}/parts")
    return spark.read.parquet(f"{root}/parts")


class Reader:
    """Opens files for a task: (a handle with read_at, where the file begins, its bytes). The pack that was read last stays open, since a pack's files come one after another."""

    def __init__(self):
        self.name = self.handle = None

    def __call__(self, file: dict) -> tuple:
        if "pack" not in file:
            handle = opened(file["path"])
            return handle, 0, handle.size()
        if file["pack"] != self.name:
            if self.handle is not None:
                self.handle.close()
            self.handle, self.name = opened(file["pack"]), file["pack"]
        return self.handle, file["start"], file["size"]

    def whole(self, file: dict) -> bytes:
        """A file's bytes: its content if it has one, else as it is stored."""
        if "content" in file:
            return bytes(file["content"] or b"")
        handle, start, size = self(file)
        try:
            return handle.read_at(size, start)
        finally:
            if "pack" not in file:
                handle.close()


def opened(path: str):
    """A file of any file system that pyarrow opens."""
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.open_input_file(at)


def source_of(files: DataFrame) -> list[str]:
    """The columns that a file's bytes come by: content if there is one, else its place in a pack, else none but its path."""
    return ["content"] if "content" in files.columns else PLACE if "pack" in files.columns else []
