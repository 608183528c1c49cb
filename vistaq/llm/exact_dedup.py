"""Exact dedup by skew-safe combining: local winners, winners of salted digest groups, global winners; whole texts are compared at each stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, hot_keys, orderable, read_table, row_of, salted_join

SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, work: Workspace, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The aggregations group by the text itself beside its digest, so equal digests never merge different texts:
    1. each task keeps one row per text it reads (the partial aggregation), so a text with a third of all rows leaves
       each task once; 2. the salt, from the task's number, spreads those; 3. the salts' winners meet by (digest, text).
    A digest that stands for one text alone, which 3 has established, then leads each document to its group without its
    text. If texts ever share a digest, their documents take another join, by the text.

    Null texts count as empty. Of equal texts the largest doc_id stays, null being the smallest; rows that repeat both
    are all marked kept (drop_exact_duplicates leaves one). Other columns are not looked at.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_digest", digest(F.col("_text")))
    local = rows.withColumn("_salt", F.spark_partition_id() % salts).groupBy("_digest", "_salt", "_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    winners = local.groupBy("_digest", "_text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = winners.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = work.save(groups, "groups")
    one = groups.where("_texts = 1").drop("_texts")
    hot = hot_keys(groups, "_digest", "group_size")
    out = salted_join(rows.select("doc_id", "_digest", sha256(F.col("_text")).alias("text_sha256")), one, "_digest", hot, "doc_id")
    shared = groups.where("_texts > 1").select("_digest")
    if not shared.isEmpty():
        several = rows.join(shared, "_digest", "left_semi")
        texts = several.groupBy("_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        several = several.join(work.save(texts, "texts"), "_text").withColumn("text_sha256", sha256(F.col("_text")))
        out = out.unionByName(several.drop("_text"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """docs with one row per text, that with the largest doc_id (of rows that tie, the largest by their other columns).

    The winner carries its own columns through the same three combining steps, so no join follows. Null texts count as
    empty; the kept row has its own text back, null or empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    others = docs.select(*(F.col(f"`{c}`") for c in rest))
    row = F.struct("doc_id", F.col("text").isNotNull().alias("has"), *([row_of(others).alias("rest")] if rest else []))
    rows = docs.select(F.coalesce("text", F.lit("")).alias("_text"), row.alias("_row")).withColumn("_digest", sha256(F.col("_text")))
    best = F.max_by("_row", F.struct("_row.doc_id", "_row.has", *([orderable(others, "_row.rest")] if rest else []))).alias("_row")
    local = rows.withColumn("_salt", F.spark_partition_id() % salts).groupBy("_digest", "_salt", "_text").agg(best)
    kept = local.groupBy("_digest", "_text").agg(best)
    back = {"text": F.when(F.col("_row.has"), F.col("_text")), "doc_id": F.col("_row.doc_id")}
    return kept.select(*((back[c] if c in back else F.col("_row.rest").getField(c)).alias(c) for c in docs.columns))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "exact")
    return work.result(exact_groups(read_table(spark, sf_dir, "documents"), work))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER t AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
WINDOW t AS (PARTITION BY text)
"""
