"""Mixing sources to target weights: tokens per source, repetition rates, then whole copies plus one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Workspace, broadcast_if_small, hot_keys, read_table, row_of, salted_join, unpacked

#: Weights dealt to the sources in the order of their names.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size, and a document at most so many copies.
MOST = 3
SEED = "mix"


def size(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: a row per source (source, source_size). Adds weight, target and rate.

    Targets share the whole by weight; none is above most times its source's size, and the excess is shared again by
    weight among the rest. Sources are capped in the order of size to weight, so the level that the rest share follows
    from running sums over the sources alone, in whole numbers until the one division. The windows, which have one task,
    see a row per source: sources may be millions, not billions.
    """
    ranked = sizes.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int")).cast("long"))
    by_room = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "_k")
    before, after, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    r = ranked.withColumns({
        "_left": F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "_weights": F.sum("weight").over(after),
    })
    # a source is below its cap if, with all sources of less room capped, its share fits
    r = r.withColumn("_fits", F.col("_left") * F.col("weight") <= most * F.col("source_size") * F.col("_weights"))
    level = F.min_by(F.struct("_left", "_weights"), F.when(F.col("_fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("_k")))).over(whole)
    r = r.withColumn("_level", level)
    share = F.col("_level._left") * F.col("weight") / F.col("_level._weights")
    r = r.withColumn("target", F.when(F.col("_fits") , share).otherwise(F.lit(float(most)) * F.col("source_size")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return r.withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 (in) to 1 (out) from the id alone: reruns, retries and other partitionings draw the same."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix_counts(docs: DataFrame, work: Workspace, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with _size, source_size, target and _copies: floor(rate), plus 1 where the document's draw is below the rest.

    Null texts have size 0; the null source is a source, last in the order. Sources without a word have target 0. Rows of
    the same doc_id get the same draw. An empty table gives none. Other columns of docs pass through, if their names
    aren't those made here; mix keeps any.
    """
    sized = docs.withColumn("_size", size(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    sizes = work.save(sizes, "sizes")
    targets = work.save(source_targets(sizes.select("source", "source_size"), weights, most), "targets")
    # the join key: a source's name with null told apart
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("_source")
    right = targets.select(key, F.col("source_size"), "target", "rate")
    left = sized.withColumn("_source", key)
    if targets.limit(10_001).count() <= 10_000:
        out = left.join(broadcast_if_small(right), "_source")
    else:
        out = salted_join(left, right, "_source", hot_keys(sizes.select(key, "_n"), "_source", "_n"), "doc_id")
    rest = F.col("rate") - F.floor("rate")
    copies = F.floor("rate") + F.when(draw(F.col("doc_id"), seed) < rest, 1).otherwise(0)
    return out.withColumn("_copies", copies.cast("int")).drop("_source", "rate")


def mix(docs: DataFrame, work: Workspace, **how) -> DataFrame:
    """The mixed corpus: each document _copies times, with the columns of docs."""
    counted = mix_counts(docs.select(row_of(docs), "doc_id", "text", "source"), work, **how).where("_copies > 0")
    return unpacked(counted.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    work = Workspace(spark, "mix")
    out = mix_counts(docs, work)
    return work.result(out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken")))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE C ASC NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s
), r AS (
  SELECT *, sum(source_size) OVER ()::BIGINT
      - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
    sum(weight) OVER (ORDER BY source_size / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights
  FROM w
), f AS (SELECT *, rest * weight <= 3 * source_size * weights AS fits FROM r),
l AS (SELECT rest, weights FROM f WHERE fits ORDER BY source_size / weight, k LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN fits THEN (l.rest * f.weight)::DOUBLE / l.weights::DOUBLE ELSE 3.0::DOUBLE * source_size::DOUBLE END AS target
  FROM f LEFT JOIN l ON true
), c AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c
"""
