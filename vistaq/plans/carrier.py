r"""The library that the given tables stand for: items with paths, vectors and times, folders, favourites, old snapshots.

An item is a row of embeddings with its document and a part: X:\lib\{lang}\{source}\{PartName}_{variant}.webp.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "X:\\lib"
#: lang to category; es has none.
CATEGORIES = (("en", "scenes"), ("fr", "maps"), ("de", "assets"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(64)
def rows_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    """How many rows a table has, counted once a session: the tables don't change."""
    return table(spark, sf_dir, name).count()


def items(spark: SparkSession, sf_dir: str, names: bool = False) -> DataFrame:
    """idx, p, m, k, emb, label, lang, source, and with names nemb: the next item's vector."""
    part, e, d = (table(spark, sf_dir, t) for t in ("part", "embeddings", "documents"))
    n_parts = rows_of(spark, sf_dir, "part")
    variant = F.element_at(F.array(F.lit("Day"), F.lit("Night"), F.lit("Gridless")), (F.col("doc_id") % 3 + 1).cast("int"))
    camel = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    out = e.join(d.select("doc_id", "lang", "source", "n_chars"), e["vec_id"] == d["doc_id"]).join(part.select("p_partkey", "p_name"), F.col("vec_id") % n_parts == F.col("p_partkey"))
    path = F.concat(F.lit(ROOT + "\\"), F.col("lang"), F.lit("\\"), F.col("source"), F.lit("\\"), camel, F.lit("_"), variant, F.lit(".webp"))
    out = out.select(
        F.col("vec_id").alias("idx"), path.alias("p"), F.col("n_chars").cast("double").alias("m"), F.when(F.col("doc_id") % 5 == 0, "v").otherwise("i").alias("k"),
        F.col("embedding").alias("emb"), "label", "lang", "source", "p_name",
    )
    if names:
        count = rows_of(spark, sf_dir, "embeddings")
        nxt = e.select(((F.col("vec_id") + count - 1) % count).alias("idx"), F.col("embedding").alias("nemb"))
        out = out.join(nxt, "idx")
    return out


def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, p, m, d (seconds), nemb, cemb: the items as sounds; every fourth has no content vector."""
    rows = items(spark, sf_dir, True)
    path = F.concat(F.regexp_replace("p", r"\.webp$", ""), F.lit("_"), F.col("idx").cast("string"), F.lit(".mp3"))
    return rows.select("idx", path.alias("p"), "m", F.round(F.col("m") / 100, 1).alias("d"), "nemb", F.when(F.col("idx") % 4 != 0, F.col("emb")).alias("cemb"), "lang", "source")


def folders(spark: SparkSession) -> DataFrame:
    """The configured folders in order, one of them inside another."""
    rows = [(1, f"{ROOT}\\en", "scenes"), (2, f"{ROOT}\\fr\\src3", "maps"), (3, f"{ROOT}\\fr\\", "maps"), (4, "X:/lib/de", "assets"), (5, f"{ROOT}\\it", "scenes")]
    return spark.createDataFrame(rows, "ord int, path string, category string")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and favourite switches: item, ts, seq, kind, on."""
    e = table(spark, sf_dir, "events")
    on = F.when(F.col("event_type").isin("click", "purchase"), True).when(F.col("event_type") == "error", False)
    return e.select(F.col("user_id").alias("item"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), on.alias("on"))


def vector(spark: SparkSession, sf_dir: str, idx: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == idx).select("embedding").first()[0])


ITEMS_SQL = r"""
items AS (
  SELECT e.vec_id AS idx,
    'X:\lib\' || d.lang || '\' || d.source || '\' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '')
      || '_' || CASE d.doc_id % 3 WHEN 0 THEN 'Day' WHEN 1 THEN 'Night' ELSE 'Gridless' END || '.webp' AS p,
    d.n_chars::DOUBLE AS m, CASE WHEN d.doc_id % 5 = 0 THEN 'v' ELSE 'i' END AS k, e.embedding::DOUBLE[] AS emb, n.embedding::DOUBLE[] AS nemb, e.label, d.lang, d.source, p_name
  FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id JOIN part ON p_partkey = e.vec_id % (SELECT count(*) FROM part)
  JOIN embeddings n ON n.vec_id = (e.vec_id + 1) % (SELECT count(*) FROM embeddings)
)"""
SOUNDS_SQL = r"""
sounds AS (SELECT idx, p[:-6] || '_' || idx || '.mp3' AS p, m, round(m / 100, 1) AS d, nemb, CASE WHEN idx % 4 <> 0 THEN emb END AS cemb, lang, source FROM items)"""
FOLDERS_SQL = r"""
folders AS (SELECT * FROM (VALUES (1, 'X:\lib\en', 'scenes'), (2, 'X:\lib\fr\src3', 'maps'), (3, 'X:\lib\fr\', 'maps'), (4, 'X:/lib/de', 'assets'), (5, 'X:\lib\it', 'scenes')) f(ord, path, category)),
hits AS (SELECT idx, p, f.ord, f.path, f.category FROM items JOIN folders f ON starts_with(lower(p), lower(rtrim(replace(f.path, '/', '\'), '\')) || '\'))"""
ACTIONS_SQL = """
actions AS (SELECT user_id AS item, ts, event_id AS seq, event_type AS kind, CASE WHEN event_type IN ('click', 'purchase') THEN true WHEN event_type = 'error' THEN false END AS "on" FROM events),
favs AS (SELECT item FROM (SELECT item, arg_max("on", ts) AS "on" FROM actions WHERE "on" IS NOT NULL GROUP BY item) WHERE "on")"""
