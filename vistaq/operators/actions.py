"""Recents, favourites and cached answers from logs of actions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECENTS, TTL = 100, 300.0


def recents(log: DataFrame, cap: int = RECENTS) -> DataFrame:
    """The newest action per item of log (item, ts), newest first, at most cap."""
    return log.groupBy("item").agg(F.max("ts").alias("ts")).orderBy(F.col("ts").desc(), "item").limit(cap)


def last_wins(log: DataFrame) -> DataFrame:
    """Items that are favourites after log (item, on, ts, seq): the last action counts, by ts and then seq."""
    last = log.groupBy("item").agg(F.max_by("on", F.struct("ts", "seq")).alias("on"), F.max("ts").alias("ts"))
    return last.where("on").drop("on")


def toggled(log: DataFrame) -> DataFrame:
    """Items on after log (item) of toggles: those toggled an odd number of times."""
    return log.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("item")


def home(items: DataFrame, recent: DataFrame, favs: DataFrame, n_recent: int = 24, n_favs: int = 24) -> DataFrame:
    """(section, place, idx): recent items that still exist, newest first, and favourites by path."""
    rec = recent.join(items.select(F.col("idx").alias("item"), "p"), "item").orderBy(F.col("ts").desc(), "item").limit(n_recent)
    fav = favs.join(items.select(F.col("idx").alias("item"), "p"), "item").orderBy(F.lower("p"), "item").limit(n_favs)
    from pyspark.sql import Window

    rec = rec.select(F.lit("recent").alias("section"), F.row_number().over(Window.orderBy(F.col("ts").desc(), "item")).alias("place"), F.col("item").alias("idx"))
    fav = fav.select(F.lit("favourite").alias("section"), F.row_number().over(Window.orderBy(F.lower("p"), "item")).alias("place"), F.col("item").alias("idx"))
    return rec.union(fav)


def home_sounds(sounds: DataFrame, favs: DataFrame, n: int = 12) -> DataFrame:
    """(section, place, idx): favourite sounds by path."""
    from pyspark.sql import Window

    fav = favs.join(sounds.select(F.col("idx").alias("item"), "p"), "item").orderBy(F.lower("p"), "item").limit(n)
    return fav.select(F.lit("sound").alias("section"), F.row_number().over(Window.orderBy(F.lower("p"), "item")).alias("place"), F.col("item").alias("idx"))


def favourites_listing(items: DataFrame, favs: DataFrame, cards: int = 60, variants: int = 40) -> DataFrame:
    """(map_key, idx, n_variants): favourite items (item) by path, one card per group."""
    from ..functions.text import map_key

    rows = items.join(favs.select(F.col("item").alias("idx")), "idx").withColumn("map_key", map_key(F.col("p")))
    groups = rows.groupBy("map_key").agg(F.min(F.struct(F.lower("p").alias("p"), "idx")).alias("h"), F.count(F.lit(1)).alias("c"))
    return groups.orderBy("h").limit(cards).select("map_key", "h.idx", F.least(F.col("c") - 1, F.lit(variants)).cast("long").alias("n_variants"))


def favourite_sounds(sounds: DataFrame, favs: DataFrame, n: int = 60) -> DataFrame:
    """The first n favourite sounds in the order of the index."""
    return sounds.join(favs.select(F.col("item").alias("idx")), "idx", "left_semi").orderBy("idx").limit(n)


def _scan(ttl: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, since = None, 0.0
        for pdf in batches:
            hits = []
            for k, at in zip(pdf["key"], pdf["at"], strict=True):
                hit = k == key and at - since < ttl
                if not hit:
                    key, since = k, at
                hits.append(hit)
            yield pdf.assign(hit=hits)

    return run


def ttl_hits(requests: DataFrame, ttl: float = TTL) -> DataFrame:
    """requests (key, at in seconds, seq) with hit: whether an answer fetched less than ttl before is there. A hit doesn't renew an answer, so each depends on those before; keys are dealt out, sorted and streamed, never gathered. A key's requests pass through one task, as each answer depends on the one before."""
    spark = requests.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = requests.select("key", "at", "seq").repartition(parts, "key").sortWithinPartitions("key", "at", "seq")
    # as text past Python, where numbers beside a null become floats
    asked = dealt.withColumn("seq", F.col("seq").cast("string"))
    kind = dealt.schema["seq"].dataType
    out = asked.mapInPandas(_scan(ttl), T.StructType([*asked.schema.fields, T.StructField("hit", T.BooleanType())]))
    return out.withColumn("seq", F.col("seq").cast(kind))


def fresh(snapshot: DataFrame, now: float, version: int = 2, ttl: float = 86_400.0) -> DataFrame:
    """Rows of a catalogue snapshot (version, fetched_at) that may still be served."""
    return snapshot.where((F.col("version") == version) & (F.lit(now) - F.col("fetched_at") < ttl))
