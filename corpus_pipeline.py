"""From documents to packed training sequences: five operators, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vistaq.llm import exact_dedup, mixing, near_dedup, packing, quality
from vistaq.llm.common import Workspace, read_table, row_of, unpacked

# A stage writes its own tables to work, which whoever gives it closes once the stage's result is stored. Without one it
# takes a workspace of its own, and leaves there what its result is still read from: ids, sources or pieces, no texts.


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Documents that the classifier scores quality.REJECT or more; the others go."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select(row_of(docs), "text"), model)
    return unpacked(scored.where(f"score >= {quality.REJECT}"), docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.drop_near_duplicates(docs, work or Workspace(spark, "near"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mix(docs, work or Workspace(spark, "mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, work: Workspace | None = None) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs, work or Workspace(spark, "pack"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: A classifier is learned on the way, which SQL doesn't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is stored as Parquet in the shared folder and read again by the next. What was before goes then; in the end the last result is left. Runs don't share anything."""
    docs, kept = read_table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        work = Workspace(spark, f"stage{k}")
        docs = kept.save(stage(spark, docs, sf_dir, work), f"stage{k}")
        work.close()
        kept.clear(f"stage{k}")
    return docs
