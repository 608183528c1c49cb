"""Passes over a library: batches that fall back on their halves, failures that are remembered, and a clean-up that waits for a whole pass."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_dir
from .deltas import DeltaIndex
from .index import SAME_TIME, orphans

#: Rows that an encoder gets at once, and times that a file that fails is tried. Fixed value, and a parameter.
BATCH, TRIES = 16, 3


def halved(encode: Callable[[list], np.ndarray], items: list) -> list[tuple[np.ndarray | None, str | None]]:
    """(vector, error) for each item: of a batch that fails both halves are tried, down to the item that is to blame. One bad item of n costs about 2 log2(n) calls more."""
    try:
        found = encode(items)
        if len(found) != len(items):
            raise ValueError(f"{len(found)} vectors for {len(items)} items")
        return [(v, None) for v in found]
    except Exception as error:
        if len(items) == 1:
            return [(None, str(error) or type(error).__name__)]
        half = len(items) // 2
        return halved(encode, items[:half]) + halved(encode, items[half:])


def encoded(rows: DataFrame, encode: Callable[[list], np.ndarray], column: str, batch: int = BATCH) -> DataFrame:
    """rows with vector and error, in place of columns of these names: encode gets lists of column's values, batch at a time, null ones left out (an error). A failed batch doesn't fail the rest, and a failed row has no vector, not one of zeros, so that it is tried again."""

    def run(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in values:
            out: list = [(None, "nothing to encode")] * len(s)
            there = [i for i, v in enumerate(s) if v is not None]
            for low in range(0, len(there), batch):
                some = there[low : low + batch]
                for i, found in zip(some, halved(encode, [s.iloc[i] for i in some]), strict=True):
                    out[i] = found
            yield pd.DataFrame({"vector": [v if v is None else np.asarray(v, np.float32) for v, _ in out], "error": [e for _, e in out]})

    run.__annotations__ = {"values": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}  # as types, which Spark reads
    made = F.pandas_udf(run, "vector array<float>, error string")
    return rows.withColumn("_made", made(F.col(column))).withColumns({c: F.col(f"_made.{c}") for c in ("vector", "error")}).drop("_made")


def letters_after(letters: DataFrame | None, made: DataFrame) -> DataFrame:
    """The table of failures (path_norm, p, m, error, tries) after a pass that made rows (p, m, error): one more try where the same file failed again; files that were made, or have changed and failed for the first time, start anew."""
    now = made.select(norm_dir(F.col("p")).alias("path_norm"), "p", "m", "error")
    now = now.groupBy("path_norm").agg(F.max_by(F.struct("p", "m", "error"), "m").alias("r")).select("path_norm", "r.*")
    fresh = now.where("error is not null").withColumn("tries", F.lit(1))
    if letters is None:
        return fresh
    was = letters.select("path_norm", F.col("m").alias("_m"), F.col("tries").alias("_tries"))
    again = fresh.join(was, "path_norm", "left").withColumn("tries", F.when(F.abs(F.col("m") - F.col("_m")) < SAME_TIME, F.col("_tries") + 1).otherwise(1)).drop("_m", "_tries")
    return letters.join(now, "path_norm", "left_anti").unionByName(again)


def worth_trying(files: DataFrame, letters: DataFrame | None, tries: int = TRIES) -> DataFrame:
    """files (p, m) without those that failed tries times with the same time; what has changed since is tried again."""
    if letters is None:
        return files
    given_up = letters.where(F.col("tries") >= tries).select("path_norm", F.col("m").alias("_m"))
    both = files.withColumn("path_norm", norm_dir(F.col("p"))).join(given_up, "path_norm", "left")
    return both.where(~F.coalesce(F.abs(F.col("m") - F.col("_m")) < SAME_TIME, F.lit(False))).drop("path_norm", "_m")


class Manifest:
    """Which version of an index a whole pass has led to: one JSON file a version below root, written last."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def complete(self, version: int, rows: int) -> None:
        part = self._path(f"{self.root}/_{version:010d}")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps({"version": version, "rows": rows}).encode()))
        out.close()
        at = self._path(f"{self.root}/{version:010d}.json")
        self._fs.delete(at, False)
        self._fs.rename(part, at)

    def rows(self, version: int) -> int | None:
        """The rows of a version that a whole pass led to; None if none did."""
        at = self._path(f"{self.root}/{version:010d}.json")
        if not self._fs.exists(at):
            return None
        return self.spark.read.schema("version long, rows long").json(at.toString()).first()["rows"]


def whole_pass(index: DeltaIndex, manifest: Manifest, files: DataFrame, make: Callable[[DataFrame], DataFrame], blocks: int = 1) -> None:
    """A pass over a whole listing (see DeltaIndex.refresh), and at its end, not before, the note that it was one."""
    index.refresh(files, make, blocks)
    found = index.read()
    manifest.complete(index.version(), 0 if found is None else found.count())


def collectable(thumbs: DataFrame, index: DeltaIndex, manifest: Manifest) -> DataFrame:
    """Thumbnails (name) of no item, if a whole pass has led to the index as it is now, and to as many rows; none while a pass is under way or has broken off, since what it hasn't come to yet would look like an orphan."""
    found, rows = index.read(), manifest.rows(index.version())
    if found is None or rows is None or found.count() != rows:
        return thumbs.limit(0)
    return orphans(thumbs, found)
