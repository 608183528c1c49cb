"""An index kept as a log of runs: a batch writes what it changes, readers take the newest row of each path, folding keeps the runs few."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_dir
from .index import SAME_TIME

#: A run is folded with those after it once it is no more than so many times as large as they are together.
FACTOR = 1.0
#: Keys of changed rows that are sent to all tasks when an index is read, at most; beyond, they are shuffled.
TOLD = 200_000
_NAME = re.compile(r"r(\d{10})-(\d{10})-(.*)-([0-9a-f]{8})")


@dataclass(frozen=True)
class Run:
    """The changes of versions low to high in one folder; writer tells which batch of which stream made it."""

    low: int
    high: int
    writer: str
    path: str
    time: int


class DeltaIndex:
    """Rows by path (p, m and others) below root.

    A run is a Parquet folder with the rows that versions low to high put or took away (_op), in the normalized spelling
    of their path (path_norm), so two spellings are one row. It counts once Spark's commit has left its marker, and is
    never written again. A reader takes a chain of runs from version 1 on, the longest where several begin alike. Folding
    writes the runs at the end of the chain as one, when the one before them has become no larger than they are together;
    so a row is written again about as often as the index doubles, and the chain stays short. What begins at version 1
    needs no tombstones. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- runs

    def _folders(self) -> list[tuple[Run, bool]]:
        at, out = self._path(self.root), []
        for s in self._fs.listStatus(at) if self._fs.exists(at) else ():
            if m := _NAME.fullmatch(s.getPath().getName()):
                run = Run(int(m[1]), int(m[2]), m[3], str(s.getPath()), s.getModificationTime())
                out.append((run, self._fs.exists(self._path(s.getPath(), "_SUCCESS"))))
        return out

    def runs(self) -> list[Run]:
        """All that are committed."""
        return [run for run, done in self._folders() if done]

    def chain(self, version: int | None = None) -> list[Run]:
        """Runs that together hold versions 1 to version, or to the last: few and large ones first."""
        all_, out, at = self.runs(), [], 1
        while nexts := [r for r in all_ if r.low == at and (version is None or r.high <= version)]:
            # of runs of one version the first counts, as a batch that has run isn't run again
            out.append(max(nexts, key=lambda r: (r.high, -r.time, r.path)))
            at = out[-1].high + 1
        return out

    def version(self) -> int:
        chain = self.chain()
        return chain[-1].high if chain else 0

    def done(self, writer: str) -> bool:
        """Whether a batch of this name has been written, though its run may be folded and gone by now."""
        return any(r.writer == writer for r in self.runs()) or self._fs.exists(self._path(f"{self.root}/writers/{writer}"))

    def size(self, run: Run) -> int:
        return self._fs.getContentSummary(self._path(run.path)).getLength()

    # ---- reading

    def _load(self, runs: list[Run]) -> DataFrame:
        """Runs as one table with their version; columns that an older run hasn't are null there."""
        parts = [self.spark.read.parquet(r.path).withColumn("_version", F.lit(r.high)) for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _newest(self, runs: list[Run]) -> DataFrame:
        """Of runs the last row of each path, tombstones too. A run has a path once, so only those of later ones are dealt out where the first is large."""
        if len(runs) == 1:
            return self._load(runs).drop("_version")
        later = self._load(runs[1:])
        rest = [c for c in later.columns if c not in ("path_norm", "_version")]
        later = later.groupBy("path_norm").agg(F.max_by(F.struct(*rest), "_version").alias("_r")).select("path_norm", "_r.*")
        keys = self.spark.read.parquet(*(r.path for r in runs[1:])).select("path_norm").distinct()
        few = self.spark.read.parquet(*(r.path for r in runs[1:])).count() <= TOLD  # from the files' footers
        first = self.spark.read.parquet(runs[0].path).join(F.broadcast(keys) if few else keys, "path_norm", "left_anti")
        return first.unionByName(later, allowMissingColumns=True)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of the index as of a version, the last if none is given, with path_norm; None where there is none yet."""
        runs = self.chain(version)
        return self._newest(runs).where("_op = 'put'").drop("_op") if runs else None

    # ---- writing

    def _write(self, rows: DataFrame, low: int, high: int, writer: str) -> Run:
        at = f"{self.root}/r{low:010d}-{high:010d}-{writer}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(at)
        return Run(low, high, writer, at, int(time.time() * 1000))

    def append(self, rows: DataFrame, writer: str | None = None, fold: bool = True) -> bool:
        """The next version: rows (p, and others) with _op, put or gone, each path once. A writer's name that has been here is not written again, so a batch that is run twice counts once. Whether it was written."""
        writer = re.sub(r"[^A-Za-z0-9_.]", "_", writer or uuid.uuid4().hex)
        if self.done(writer):
            return False
        at = self.version() + 1
        keyed = rows if "path_norm" in rows.columns else rows.withColumn("path_norm", norm_dir(F.col("p")))
        self._write(keyed, at, at, writer)
        if fold:
            self.fold()
        return True

    def fold(self, factor: float = FACTOR) -> Run | None:
        """Folds the runs at the end of the chain that have to be, if any."""
        chain = self.chain()
        sizes = [self.size(r) for r in chain]
        first, after = len(chain) - 1, sizes[-1] if sizes else 0
        for k in range(len(chain) - 2, -1, -1):
            if sizes[k] <= factor * after:
                first = k
            after += sizes[k]
        if first >= len(chain) - 1:
            return None
        some = chain[first:]
        rows = self._newest(some)
        if some[0].low == 1:
            rows = rows.where("_op = 'put'")
        return self._write(rows, some[0].low, some[-1].high, "fold")

    def vacuum(self, keep: int = 1, grace: float = 3600.0) -> int:
        """Deletes folders that none of the last keep versions is read from, if they are older than grace seconds: what others may still read or write stays. How many."""
        last, now = self.version(), time.time() * 1000
        needed = {r.path for v in range(max(1, last - keep + 1), last + 1) for r in self.chain(v)}
        gone = [r for r, _ in self._folders() if r.path not in needed and now - r.time >= grace * 1000]
        # a batch that is known by its writer has to be known later: its marker stays
        for r in gone:
            if r.writer != "fold":
                self._remember(r.writer)
            self._fs.delete(self._path(r.path), True)
        return len(gone)

    def _remember(self, writer: str) -> None:
        self._fs.create(self._path(f"{self.root}/writers/{writer}"), True).close()

    # ---- passes

    def changed(self, files: DataFrame) -> DataFrame:
        """Of files (p, m, and gone if any) what the index hasn't: path_norm, p, m, _op. Of several rows of a path the last by m counts, and of equal ones a deletion."""
        gone = F.coalesce("gone", F.lit(False)) if "gone" in files.columns else F.lit(False)
        rows = files.select(norm_dir(F.col("p")).alias("path_norm"), F.struct("m", gone.alias("gone"), "p").alias("r"))
        now = rows.groupBy("path_norm").agg(F.max("r").alias("r")).select("path_norm", "r.p", "r.m", F.when(F.col("r.gone"), "gone").otherwise("put").alias("_op"))
        old = self.read()
        if old is None:
            return now.where("_op = 'put'")
        both = now.join(old.select("path_norm", F.col("m").alias("_m")), "path_norm", "left")
        new = F.when(F.col("_op") == "gone", F.col("_m").isNotNull()).otherwise(F.coalesce(F.abs(F.col("m") - F.col("_m")) >= SAME_TIME, F.lit(True)))
        return both.where(new).drop("_m")

    def apply(self, files: DataFrame, make: Callable[[DataFrame], DataFrame], writer: str | None = None) -> bool:
        """A batch of files as the next version: make gives the rows of those that are new or changed, with error where it failed. What failed leaves the index, as its old row is of another file by now, and is made again when it comes again. Whether it was written."""
        if writer and self.done(re.sub(r"[^A-Za-z0-9_.]", "_", writer)):
            return False
        todo = self.changed(files)
        made = make(todo.where("_op = 'put'").select("p", "m"))
        failed = F.col("error").isNotNull() if "error" in made.columns else F.lit(False)
        puts = made.withColumn("_op", F.when(failed, "gone").otherwise("put")).drop("error")
        return self.append(puts.unionByName(todo.where("_op = 'gone'").select("p", "m", "_op"), allowMissingColumns=True), writer)

    def refresh(self, files: DataFrame, make: Callable[[DataFrame], DataFrame], blocks: int = 1) -> None:
        """A whole listing: files that are new or changed are made, those of the index that are missing go. With blocks, files are made in so many parts, drawn by a hash of their path, each a version of its own: a pass that breaks off has kept the parts before."""
        old = self.read()
        if old is not None:
            here = files.select(norm_dir(F.col("p")).alias("path_norm"))
            lost = old.join(here, "path_norm", "left_anti").select("p", "m", F.lit("gone").alias("_op"))
            if not lost.isEmpty():
                self.append(lost)
        for b in range(blocks):
            self.apply(files.where(part_of(F.col("p"), blocks) == b) if blocks > 1 else files, make)


def part_of(p: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(norm_dir(p)), F.lit(blocks))
