"""Visibility, categories and favourites as predicates; joins by path prefix in three readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import map_key, norm_dir


def conjunction(*masks: Column | None) -> Column | None:
    """All masks that there are; None if there is none."""
    have = [m for m in masks if m is not None]
    return reduce(lambda a, b: a & b, have) if have else None


def keep(items: DataFrame, *masks: Column | None) -> DataFrame:
    """Filters before scoring: what is masked needs no score."""
    mask = conjunction(*masks)
    return items if mask is None else items.where(mask)


def ancestors(path: Column) -> Column:
    r"""The normalized directories above a path: of a\b\c, a and a\b."""
    p = F.split(norm_dir(path), r"\\")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda n: F.array_join(F.slice(p, 1, n), "\\"))


def in_folders(items: DataFrame, folders: DataFrame) -> DataFrame:
    """A row per item and folder (path, ord, ...) that it lies in. An equi-join on the item's directories, so neither side has to be small and no pair is tried in vain."""
    dirs = folders.select(F.col("path").alias("folder"), *(c for c in folders.columns if c != "path")).withColumn("_dir", norm_dir(F.col("folder")))
    return items.withColumn("_dir", F.explode(F.array_distinct(ancestors(F.col("p"))))).join(dirs, "_dir").drop("_dir")


def visible(items: DataFrame, off: DataFrame) -> DataFrame:
    """Items in no folder that is off."""
    hidden = in_folders(items.select("idx", "p"), off).select("idx").distinct()
    return items.join(hidden, "idx", "left_anti")


def in_category(items: DataFrame, folders: DataFrame, category: str) -> DataFrame:
    """Items in any folder of a category. An item may be in several categories."""
    some = in_folders(items.select("idx", "p"), folders.where(F.col("category") == category)).select("idx").distinct()
    return items.join(some, "idx", "left_semi")


def animated() -> Column:
    return F.coalesce(F.col("k"), F.lit("i")) == "v"


def favourites(items: DataFrame, favs: DataFrame) -> DataFrame:
    """Items whose path is among favs (p)."""
    keys = favs.select(norm_dir(F.col("p")).alias("_n")).distinct()
    return items.withColumn("_n", norm_dir(F.col("p"))).join(keys, "_n", "left_semi").drop("_n")


def scenes_with_maps(items: DataFrame, folders: DataFrame) -> DataFrame:
    """Items of scenes or maps whose map has files in both."""
    keyed = items.withColumn("_key", map_key(F.col("p")))
    scene, plan = in_category(keyed, folders, "scenes"), in_category(keyed, folders, "maps")
    both = scene.select("_key").intersect(plan.select("_key"))
    return scene.union(plan).dropDuplicates(["idx"]).join(both, "_key", "left_semi").drop("_key")


def first_folder(items: DataFrame, folders: DataFrame) -> DataFrame:
    """Each item's folder of least ord, by one aggregation."""
    return in_folders(items.select("idx", "p"), folders.select("path", "ord")).groupBy("idx").agg(F.min_by("folder", "ord").alias("folder"))


def folder_counts(items: DataFrame, folders: DataFrame, first: bool = True) -> DataFrame:
    """(path, n) for each folder: items by their first folder, or by all that they lie in; 0 where there is none."""
    hits = first_folder(items, folders) if first else in_folders(items.select("idx", "p"), folders.select("path", "ord"))
    counts = hits.groupBy(F.col("folder").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return folders.select("path").join(counts, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def folder_options(config: DataFrame, min_side: int = 1024, min_kb: int = 60) -> DataFrame:
    """Folder rows with their defaults: everything admits all sizes; kind scenes; pieces are assets, others scenes."""
    everything = F.coalesce(F.col("everything"), F.lit(False))
    kind = F.coalesce(F.col("kind"), F.lit("cenas"))
    return config.select(
        "ord", "path",
        F.coalesce("min_side", F.when(everything, 0), F.lit(min_side)).alias("min_side"), F.coalesce("min_kb", F.when(everything, 0), F.lit(min_kb)).alias("min_kb"),
        F.coalesce("ignored", F.array().cast("array<string>")).alias("ignored"), everything.alias("everything"), kind.alias("kind"),
        F.coalesce("category", F.when(kind == "pecas", "assets"), F.lit("scenes")).alias("category"),
    )


def merged_options(given: Column, defaults: dict[str, str], fixed=("port",)) -> Column:
    """A map of options: defaults overlaid by what a map column gives under their keys, but for fixed ones. A null map gives the defaults."""
    own = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    taken = F.map_filter(F.coalesce(given, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*(k for k in defaults if k not in fixed)))
    return F.map_from_entries(F.transform(F.map_entries(own), lambda e: F.struct(e.key.alias("key"), F.coalesce(F.try_element_at(taken, e.key), e.value).alias("value"))))


def merge_defaults(given: dict, defaults: dict, fixed=("port",)) -> dict:
    """Defaults overlaid by what is given under their keys, but for fixed ones."""
    return defaults | {k: v for k, v in given.items() if k in defaults and k not in fixed}
