"""Small tables that outlive a session, as JSON: favourites, recents, the catalogue, the translation memory."""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm_dir
from ..operators.masks import folder_options

#: The form of a stored catalogue; another is not read.
VERSION = 2


def _folder(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, at: str) -> list[str]:
    """The committed versions below at, oldest first."""
    path, fs = _folder(spark, at)
    found = [s.getPath() for s in fs.listStatus(path(at))] if fs.exists(path(at)) else []
    return sorted(str(p) for p in found if re.match(r"v\d{20}-", p.getName()) and fs.exists(path(p, "_SUCCESS")))


def _write(rows: DataFrame, at: str) -> None:
    """The next version in a folder of its own, which counts once it is whole: a crash leaves what was there. The version before stays too, for whoever reads it still."""
    spark = rows.sparkSession
    rows.write.json(f"{at}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
    path, fs = _folder(spark, at)
    for old in _versions(spark, at)[:-2]:
        fs.delete(path(old), True)


def _read(spark: SparkSession, at: str, schema: str) -> DataFrame:
    """The newest version; none yet gives no rows."""
    found = _versions(spark, at)
    return spark.read.schema(schema).json(found[-1]) if found else spark.createDataFrame([], schema)


def save_favourites(favs: DataFrame, at: str) -> None:
    """favs (kind: v or a, p), each path once and in order."""
    _write(favs.select("kind", norm_dir(F.col("p")).alias("p")).distinct().repartitionByRange("kind", "p").sortWithinPartitions("kind", "p"), at)


def load_favourites(spark: SparkSession, at: str) -> DataFrame:
    return _read(spark, at, "kind string, p string")


def save_recents(recent: DataFrame, at: str, cap: int = 100) -> None:
    """recent (p, a, ts): the newest cap."""
    _write(recent.select("p", "a", "ts").orderBy(F.col("ts").desc(), "p").limit(cap), at)


def load_recents(spark: SparkSession, at: str) -> DataFrame:
    return _read(spark, at, "p string, a int, ts double")


def save_memory(memory: DataFrame, at: str) -> None:
    """The translation memory (pt, en)."""
    _write(memory.select("pt", "en"), at)


def load_memory(spark: SparkSession, at: str) -> DataFrame:
    return _read(spark, at, "pt string, en string")


def read_memory_file(spark: SparkSession, at: str) -> DataFrame:
    """The memory (pt, en) of JSON files that are one object each, of queries and their translations; what is no object gives none. Of files that disagree the first translation by letter."""
    told = spark.read.text(at, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("pt", "en"))
    return told.where("en is not null").groupBy(F.trim("pt").alias("pt")).agg(F.min("en").alias("en")).where("pt <> ''")


def save_catalogue(rows: DataFrame, at: str, now: float, version: int = VERSION) -> bool:
    """Stores rows (title, url, thumb, source, cat, ord, pos) with their time of fetching; an empty fetch leaves what is there. Whether it was stored."""
    if rows.isEmpty():
        return False
    _write(rows.withColumns({"version": F.lit(version), "fetched_at": F.lit(float(now))}), at)
    return True


def load_catalogue(spark: SparkSession, at: str, now: float, version: int = VERSION) -> DataFrame:
    """The stored rows while they are fresh (see actions.fresh); none otherwise."""
    from ..operators.actions import fresh

    schema = "source string, ord long, pos long, title string, url string, thumb string, cat string, version int, fetched_at double"
    return fresh(_read(spark, at, schema), now, version).drop("version", "fetched_at")


# The names of a folder's options in the stored configuration.
_FOLDER = "caminho string, tudo boolean, min_side int, min_kb int, ignorar array<string>, tipo string, categoria string"


def load_folders(spark: SparkSession, at: str) -> DataFrame:
    """The folders of a stored configuration, one JSON object: ord, path and options with their defaults (see masks.folder_options). A folder is a path or an object with options."""
    told = spark.read.text(at, wholetext=True).select(F.from_json("value", "folders array<string>, min_side int, min_kb int").alias("c"))
    each = told.select("c.min_side", "c.min_kb", F.posexplode("c.folders").alias("i", "text"))
    each = each.withColumn("o", F.when(F.startswith(F.ltrim("text"), F.lit("{")), F.from_json("text", _FOLDER)))
    rows = each.select(
        (F.col("i") + 1).alias("ord"), F.when(F.col("o").isNull(), F.col("text")).otherwise(F.col("o.caminho")).alias("path"),
        F.coalesce("o.min_side", F.when(~F.coalesce("o.tudo", F.lit(False)), F.col("min_side"))).alias("min_side"), F.coalesce("o.min_kb", F.when(~F.coalesce("o.tudo", F.lit(False)), F.col("min_kb"))).alias("min_kb"),
        F.col("o.ignorar").alias("ignored"), F.col("o.tudo").alias("everything"), F.col("o.tipo").alias("kind"), F.col("o.categoria").alias("category"),
    )
    return folder_options(rows)
