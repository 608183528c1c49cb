"""The incremental index: what a listing changes, counters, orphaned thumbnails, criteria, snapshots."""

from __future__ import annotations

import logging
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm_dir, stem, suffix, thumb_name

#: Times count as equal within this many seconds.
SAME_TIME = 1e-6
# Directories that are left out, and those that are left out even where everything is taken.
SKIPPED = ("__macosx", "thumbs", "tokens", "subjects", "portraits", "icons", "ui", "fonts", "cards", "items", "spells", "covers")
ALWAYS_SKIPPED = ("__macosx", "thumbs")
SOUNDS_SKIPPED = ("__macosx",)


def admitted(listing: DataFrame, folders: DataFrame, extensions, videos=()) -> DataFrame:
    """Files (p, m, size, side) that a folder takes in, each once, by the first folder that does.

    A folder (path, ord, min_side, min_kb, ignored, everything) takes files with one of extensions below it, not in a
    directory that is left out or ignored, and not named as a thumbnail; images have to reach its least size in bytes and
    its least side, where side is known. Filters come before the choice of folder: what one folder refuses another may take.
    """
    from .masks import in_folders

    skipped, small = F.array(*map(F.lit, SKIPPED)), F.array(*map(F.lit, ALWAYS_SKIPPED))
    files = listing.where(suffix(F.col("p")).isin(*extensions, *videos) & ~F.endswith(F.lower(stem(F.col("p"))), F.lit("-thumb")))
    both = in_folders(files.withColumn("_path", norm_dir(F.col("p"))), folders)
    dirs = _below(F.col("_path"), F.col("folder"))
    out = F.arrays_overlap(dirs, F.when(F.col("everything"), small).otherwise(skipped)) | F.arrays_overlap(dirs, F.transform("ignored", lambda x: F.lower(x)))
    enough = (F.col("size") >= F.col("min_kb") * 1024) & (F.coalesce(F.col("side"), F.col("min_side")) >= F.col("min_side"))
    good = both.where(~F.coalesce(out, F.lit(False)) & (suffix(F.col("p")).isin(*videos) if videos else F.lit(False)) | ~F.coalesce(out, F.lit(False)) & enough)
    names = [c for c in listing.columns if c != "_path"]
    return good.groupBy("_path").agg(F.min_by(F.struct(*names, F.col("folder")), "ord").alias("_r")).select("_r.*")


def _below(path: Column, folder: Column) -> Column:
    """The directories between a folder and a file in it."""
    parts = F.split(F.substr(path, F.length(norm_dir(folder)) + 2), r"\\")
    return F.slice(parts, 1, F.size(parts) - 1)


def scan(listing: DataFrame, config: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Images and videos of a listing (p, m, size, side) that the configured folders admit (see masks.folder_options and admitted).

    known (p, m): files of an older index. One of the same time needs no header read: its side counts as large enough,
    so side may be null for it, and only the size in bytes is still tested.
    """
    from ..functions.text import IMAGES, VIDEOS
    from .masks import folder_options

    files = listing
    if known is not None:
        was = known.select(norm_dir(F.col("p")).alias("_n"), F.col("m").alias("_m"))
        files = listing.withColumn("_n", norm_dir(F.col("p"))).join(was, "_n", "left")
        same = F.coalesce(F.abs(F.col("m") - F.col("_m")) < SAME_TIME, F.lit(False))
        files = files.withColumn("side", F.when(same, F.lit(None)).otherwise(F.col("side"))).drop("_n", "_m")
    return admitted(files, folder_options(config), IMAGES, VIDEOS)


def scan_sounds(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """Sounds of a listing below folders (path, ord), each path once, by the first folder."""
    from ..functions.text import SOUNDS
    from .masks import in_folders

    files = listing.where(suffix(F.col("p")).isin(*SOUNDS)).withColumn("_path", norm_dir(F.col("p")))
    both = in_folders(files, folders.select("path", "ord"))
    both = both.where(~F.arrays_overlap(_below(F.col("_path"), F.col("folder")), F.array(*map(F.lit, SOUNDS_SKIPPED))))
    return both.groupBy("_path").agg(F.min_by(F.struct(*listing.columns, F.col("folder")), "ord").alias("_r")).select("_r.*")


def diff(files: DataFrame, old: DataFrame, thumbs: DataFrame | None = None) -> DataFrame:
    """(path_norm, p, status): kept where the old index has the path with the same time and, if thumbs (name) is given, the thumbnail is there; added or changed to be done; deleted where no file is left."""
    new = files.select(norm_dir(F.col("p")).alias("path_norm"), "p", "m")
    was = old.select(norm_dir(F.col("p")).alias("path_norm"), F.col("p").alias("_p"), F.col("m").alias("_m"), F.col("t").alias("_t") if "t" in old.columns else thumb_name(F.col("p")).alias("_t"))
    both = new.join(was, "path_norm", "full_outer")
    same = F.abs(F.col("m") - F.col("_m")) < SAME_TIME
    if thumbs is not None:
        both = both.join(thumbs.select(F.col("name").alias("_t"), F.lit(True).alias("_has")).distinct(), "_t", "left")
        same = same & F.coalesce("_has", F.lit(False))
    status = F.when(F.col("_p").isNull(), "added").when(F.col("p").isNull(), "deleted").when(same, "kept").otherwise("changed")
    return both.select("path_norm", F.coalesce("p", "_p").alias("p"), status.alias("status"))


def counts(changes: DataFrame) -> DataFrame:
    """One row: total, kept, added, and removed, in which changed files count as they do among added; changed and deleted apart."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return changes.agg(n("kept", "added", "changed").alias("total"), n("kept").alias("kept"), n("added", "changed").alias("added"), n("changed", "deleted").alias("removed"), n("changed").alias("changed"), n("deleted").alias("deleted"))


def needs_content(sounds: DataFrame) -> DataFrame:
    """Sounds without a content vector: none at all, or one shorter than a half, as an empty one is."""
    from ..functions.vectors import norm

    return sounds.where(F.col("cemb").isNull() | (norm(F.col("cemb")) < 0.5))


def realigned(files: DataFrame, old: DataFrame, columns: tuple[str, ...] = ("nemb", "cemb")) -> DataFrame:
    """files (p, m, ...) with the columns that an older index has for files of the same path and time, null for others. Rows are found by path, so no order has to be kept."""
    was = old.select(norm_dir(F.col("p")).alias("_n"), F.col("m").alias("_m"), *columns)
    both = files.drop(*columns).withColumn("_n", norm_dir(F.col("p"))).join(was, "_n", "left")
    same = F.coalesce(F.abs(F.col("m") - F.col("_m")) < SAME_TIME, F.lit(False))
    return both.select(*(c for c in both.columns if c not in ("_n", "_m", *columns)), *(F.when(same, F.col(c)).alias(c) for c in columns))


def content_counts(made: DataFrame) -> DataFrame:
    """One row of rows (error) that content vectors were made for, or tried: total, added, errors."""
    return made.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("added"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def orphans(thumbs: DataFrame, items: DataFrame) -> DataFrame:
    """Thumbnails (name) of no item."""
    return thumbs.join(items.select(thumb_name(F.col("p")).alias("name")), "name", "left_anti")


def criterion(folders: DataFrame) -> DataFrame:
    """One row with the signature of what folders admit: it changes with any option of any folder. All folders come together in that row: they are a configuration's, hundreds or thousands, each written by somebody."""
    row = F.struct("ord", norm_dir(F.col("path")).alias("path"), "min_side", "min_kb", F.array_sort("ignored").alias("ignored"), "everything")
    return folders.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(row))), 256).alias("criterion"))


def merge(kept: DataFrame, new: DataFrame) -> DataFrame:
    """The next snapshot: rows kept, and rows made anew without those that failed (error)."""
    good = new.where(F.col("error").isNull()).drop("error") if "error" in new.columns else new
    return kept.unionByName(good, allowMissingColumns=True)


def save_snapshot(df: DataFrame, root: str, version: int) -> str:
    """Writes a version into a folder of its own, a new one each time; it counts once Spark's commit has left its marker. So a version that is written again never touches what is there."""
    at = f"{root.rstrip('/')}/v{version:08d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(at)
    return at


def latest_snapshot(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """The newest committed version, of those below before if it is given; or None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return None
    done = {}
    for s in fs.listStatus(at):
        name = re.match(r"v(\d+)", s.getPath().getName())
        if name and (before is None or int(name[1]) < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            done[int(name[1]), s.getModificationTime()] = str(s.getPath())
    return spark.read.parquet(done[max(done)]) if done else None


def usable_snapshot(snapshot: DataFrame | None, dim: int, vector: str = "emb", names: str | None = "nemb") -> DataFrame | None:
    """A snapshot as it may be used: None if a row has no vector of dim numbers, as after a change of models, so that all is built anew; how many there are is logged. Name vectors of another length are dropped alone, to be made again."""
    if snapshot is None:
        return None
    wrong = F.coalesce(F.size(vector) != dim, F.lit(True))
    if not snapshot.where(wrong).isEmpty():
        logging.getLogger(__name__).warning("%d rows without a vector of %d numbers: the index isn't used", snapshot.where(wrong).count(), dim)
        return None
    if names and names in snapshot.columns:
        return snapshot.withColumn(names, F.when(F.size(names) == dim, F.col(names)))
    return snapshot


def clash_names(files: DataFrame, order: Column) -> DataFrame:
    """files (dir, name, ext) with file: the name, and from the second of one name on -1, -2 and so forth before the extension.

    Rows are cut into ranges of name and order, stored, and numbered within name and range; before that come the name's
    rows in the ranges before, of which there is a count each. So a name that very many files share is no one task's work.
    """
    from ..sources.scratch import scratch

    spark, name = files.sparkSession, ["dir", "name", "ext"]
    parts, at = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), scratch(spark, "names")
    dealt = files.withColumn("_order", order).repartitionByRange(parts, *name, "_order")
    dealt.withColumn("_part", F.spark_partition_id()).write.parquet(at)  # a range is drawn once
    rows = spark.read.parquet(at)
    sizes = rows.groupBy(*name, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*name).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    sizes = sizes.select(*(F.col(c).alias(f"_{c}") for c in name), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *name).orderBy("_order")))
    same = F.col("_part") == F.col("_p")
    for c in name:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    n = F.col("_before") + F.col("_at") - 1
    file = F.concat("name", F.when(n > 0, F.concat(F.lit("-"), n)).otherwise(""), "ext")
    return placed.join(sizes, same).select(*files.columns, file.alias("file"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files below root: p, m (seconds), size; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.col("path").alias("p"), (F.unix_micros("modificationTime") / 1e6).alias("m"), F.col("length").alias("size"))


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(suffix(F.col("p")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


def size_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.round(F.sum("size") / 1e6, 6).alias("total_mb"), F.percentile("size", F.lit(0.5)).alias("median"), F.max("size").alias("max"))


def strided(files: DataFrame, n: int, order: str = "p") -> DataFrame:
    """n rows at even steps of the order, which should be without ties.

    Rows are cut into ranges at fixed bounds, drawn once from a bounded sample, so any evaluation puts a row in the same
    range; a row's place is its number within its range, after the rows of all ranges before it, of which there is a
    count each. No task sorts more than a range.
    """
    spark = files.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = files.count()
    if not total:
        return files
    seen = files.select(order).sample(min(1.0, 100 * parts / total), seed=7).collect() if parts > 1 else []  # about 100 a range
    values = sorted(r[0] for r in seen if r[0] is not None)
    bounds = sorted({values[len(values) * k // parts] for k in range(1, parts)}) if values else []
    kind = files.schema[order].dataType
    here = F.size(F.filter(F.array(*(F.lit(v).cast(kind) for v in bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    dealt = files.withColumn("_part", F.when(F.col(order).isNull(), -1).otherwise(here))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per range
    starts, done = [], 0
    for k in sorted(sizes):
        starts += [F.lit(k), F.lit(done)]
        done += sizes[k]
    step = max(1, total // n)
    place = F.create_map(*starts)[F.col("_part")] + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return dealt.withColumn("_at", place).where((F.col("_at") % step == 0) & (F.col("_at") < step * n)).drop("_part", "_at")


def share(df: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Each stage's sum and percentage of all."""
    sums = df.groupBy(stage).agg(F.sum(seconds).alias("total"))
    return sums.withColumn("percent", F.round(100 * F.col("total") / F.sum("total").over(Window.partitionBy()), 6))


