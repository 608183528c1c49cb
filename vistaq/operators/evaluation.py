"""Retrieval quality: ranks of relevant rows, MRR, recall, hits; comparisons of models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import subject
from ..sources.scratch import scratch
from . import blocks


def scored_pairs(rows: DataFrame, queries: DataFrame, block: int = blocks.BLOCK) -> DataFrame:
    """(query, idx, score, relevant) of all rows (idx, vector, label) for each of queries (query, vector, label) but the row itself; see blocks.over_blocks."""

    def kernel(some, chunk, products, near):
        q, i = np.nonzero(np.isfinite(products))
        asked, own = _numbered(some, chunk)
        relevant = asked[q] == own[i]
        return pd.DataFrame({"query": some["query"].to_numpy()[q], "idx": chunk["idx"].to_numpy()[i], "score": blocks.exact(some, chunk, q, i), "relevant": relevant})

    return blocks.over_blocks(_labelled(rows, "idx"), _labelled(queries, "query"), kernel, "query long, idx long, score double, relevant boolean", block)


def _labelled(df: DataFrame, name: str) -> DataFrame:
    """Labels as texts; a null is no other row's label."""
    none = F.concat(F.lit(f"-{name}:"), F.col(name).cast("string"))
    return df.select(F.col(name).cast("long").alias(name), "vector", F.coalesce(F.concat(F.lit("+"), F.col("label").cast("string")), none).alias("label"))


def _numbered(some: pd.DataFrame, chunk: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the labels of queries and of a chunk's rows: the same for the same ones."""
    own, names = pd.factorize(chunk["label"])
    return names.get_indexer(some["label"]), own


def query_ranks(rows: DataFrame, queries: DataFrame, within: int, block: int = blocks.BLOCK) -> DataFrame:
    """(query, first), as first_ranks of scored_pairs, without the pairs: a task gives a query's best relevant row of each of its chunks, and in a second pass the number of rows before the best of all."""
    rows, queries = _labelled(rows, "idx"), _labelled(queries, "query")

    def relevant(some, chunk, products, near):
        asked, own = _numbered(some, chunk)
        products[asked[:, None] != own[None, :]] = -np.inf
        return blocks.best(some, chunk, products, 1, near, lambda q, i: blocks.exact(some, chunk, q, i))

    found = blocks.over_blocks(rows, queries, relevant, "query long, idx long, score double", block)
    best = found.groupBy("query").agg(F.max(F.struct("score", (-F.col("idx")).alias("i"))).alias("b"))
    at = scratch(rows.sparkSession, "best")
    queries.join(best.select("query", F.col("b.score").alias("score"), (-F.col("b.i")).alias("first")), "query").write.parquet(at)

    def before(some, chunk, products, near):
        own, least, first = chunk["idx"].to_numpy(), some["score"].to_numpy(), some["first"].to_numpy()
        above = products > (least + near)[:, None]
        n = above.sum(1)
        q, i = np.nonzero((products >= (least - near)[:, None]) & ~above)
        scores = blocks.exact(some, chunk, q, i)
        n += np.bincount(q[((scores > least[q]) | (scores == least[q]) & (own[i] < first[q])) & (own[i] != first[q])], minlength=len(n))
        return pd.DataFrame({"query": some["query"].to_numpy(), "n": n})

    counted = blocks.over_blocks(rows, rows.sparkSession.read.parquet(at), before, "query long, n long", block).groupBy("query").agg(F.sum("n").alias("n"))
    return counted.select("query", F.when(F.col("n") < within, F.col("n") + 1).alias("first"))


def first_ranks(scored: DataFrame, within: int) -> DataFrame:
    """(query, first): the rank of each query's first relevant row, null beyond within; queries without a relevant row aren't in it. By two aggregations: the best relevant row, and the rows before it; no query's rows are sorted."""
    best = scored.where("relevant").groupBy("query").agg(F.max(F.struct("score", (-F.col("idx")).alias("i"))).alias("_best"))
    before = scored.join(best, "query").groupBy("query").agg(F.count_if(F.struct("score", (-F.col("idx")).alias("i")) > F.col("_best")).alias("n"))
    return before.select("query", F.when(F.col("n") < within, F.col("n") + 1).alias("first"))


def measures(scored: DataFrame, within: int = 2000, recall_at: int = 20) -> DataFrame:
    """One row (queries, mrr, recall, hit1, hit5) over scored (query, idx, score, relevant); queries without a relevant row don't count."""
    return summary(first_ranks(scored, within), recall_at)


def summary(each: DataFrame, recall_at: int = 20) -> DataFrame:
    """One row of the measures over ranks (query, first)."""
    hit = lambda k: F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)))
    return each.agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(hit(recall_at), 6).alias("recall"), F.round(hit(1), 6).alias("hit1"), F.round(hit(5), 6).alias("hit5"),
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """One row of pairs (cosine): mean and least."""
    return pairs.agg(F.round(F.avg("cosine"), 6).alias("mean"), F.round(F.min("cosine"), 6).alias("min"))


def same_best(scored: DataFrame, a: str, b: str) -> DataFrame:
    """One row: queries whose best row is the same by scores a and b, and queries."""
    best = scored.groupBy("query").agg(F.max_by("idx", F.struct(F.col(a), -F.col("idx"))).alias("x"), F.max_by("idx", F.struct(F.col(b), -F.col("idx"))).alias("y"))
    return best.agg(F.count_if(F.col("x") == F.col("y")).alias("same"), F.count(F.lit(1)).alias("queries"))


def same_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: queries whose best row is the same in two rankings (query, idx) of one row a query, and queries."""
    both = a.select("query", F.col("idx").alias("_a")).join(b.select("query", F.col("idx").alias("_b")), "query", "full")
    return both.agg(F.count_if(F.col("_a") == F.col("_b")).alias("same"), F.count(F.lit(1)).alias("queries"))


def truth_groups(items: DataFrame, least: int = 2) -> DataFrame:
    """(subject, n): subjects of two words or more that name least items or more."""
    named = items.select(subject(F.col("p")).alias("subject"), "idx").where(F.size(F.split("subject", " ")) >= 2)
    return named.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def sample_truth(items: DataFrame, groups: int = 40, each: int = 2, distractors: int = 400, seed: int = 7) -> DataFrame:
    """(role, subject, idx): each items of groups subjects drawn by a hash, and distractors outside them. Rows are drawn in the order of their hashes, so no order of arrival matters."""
    draw = lambda c: F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))
    named = items.select("idx", subject(F.col("p")).alias("subject"))
    good = truth_groups(items, each).orderBy(draw(F.col("subject")), "subject").limit(groups)
    inside = named.join(F.broadcast(good.select("subject")), "subject")
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(draw(F.col("idx")), "idx"))
    chosen = inside.withColumn("_r", rank).where(F.col("_r") <= each).select(F.lit("positive").alias("role"), "subject", "idx")
    rest = named.join(chosen.select("idx"), "idx", "left_anti").orderBy(draw(F.col("idx")), "idx").limit(distractors)
    return chosen.unionByName(rest.select(F.lit("distractor").alias("role"), "subject", "idx"))


def hits(scored: DataFrame, at: int = 5) -> DataFrame:
    """(query, hit): whether a relevant row is among a query's first at."""
    return first_ranks(scored, at).select("query", F.col("first").isNotNull().alias("hit"))


def matches(name: Column, pattern: str) -> Column:
    """Relevance by a pattern over names, in either case."""
    return F.regexp_like(name, F.lit(f"(?i){pattern}"))
