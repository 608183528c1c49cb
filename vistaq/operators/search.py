"""Ranking: hybrid scores, top k in a total order, and one card per group of variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import blocks

# Weights of the name's vector and of literal hits, for images and for sounds, and of sound content.
NAME_WEIGHT, LITERAL_WEIGHT = 0.5, 0.25
SOUND_NAME, SOUND_LITERAL, SOUND_CONTENT = 1.0, 0.35, 0.6
#: Cards, variants in a card, and how many times the cards are ranked before grouping.
TOP, VARIANTS = 60, 40
WINDOW_ALL, WINDOW_PIECES, WINDOW_SIMILAR = 8, 4, 10


def target(pages: Column | str | int | None, top: int = TOP) -> int:
    """The number of cards for n pages: 1 to 8; what is no number is 1."""
    try:
        return top * max(1, min(8, int(pages)))
    except (TypeError, ValueError):
        return top


def targets(pages: Column, top: int = TOP) -> Column:
    """target for a column of whatever was asked for, as text."""
    asked = pages.cast("string").try_cast("int")
    return (F.lit(top) * F.greatest(F.lit(1), F.least(F.lit(8), F.coalesce(asked, F.lit(1))))).cast("int")


def literal(query: str | None) -> Column:
    """Coverage of the query's words by an item's; items may bring words, else they come from the path."""
    return text.coverage(text.token_set(F.lit(query or "")), text.name_words(F.col("p")))


def score_items(items: DataFrame, vector: list[float], query: str | None = None) -> DataFrame:
    """items (p, emb, nemb) with score: content, plus half the name's similarity where there is a name vector, plus a quarter of literal coverage."""
    score = vectors.dot_with(F.col("emb"), vector)
    if "nemb" in items.columns:
        score = score + F.lit(NAME_WEIGHT) * F.coalesce(vectors.dot_with(F.col("nemb"), vector), F.lit(0.0))
    if query:
        score = score + F.lit(LITERAL_WEIGHT) * literal(query)
    return items.withColumn("score", score)


def score_sounds(items: DataFrame, vector: list[float], content: list[float] | None, query: str | None = None) -> DataFrame:
    """items (p, nemb, cemb) with score; items without content vectors score by name alone."""
    score = F.lit(SOUND_NAME) * vectors.dot_with(F.col("nemb"), vector)
    if query:
        score = score + F.lit(SOUND_LITERAL) * literal(query)
    if content is not None:
        score = score + F.lit(SOUND_CONTENT) * F.coalesce(vectors.dot_with(F.col("cemb"), content), F.lit(0.0))
    return items.withColumn("score", score)


def fused(items: DataFrame) -> DataFrame:
    """items with one vector that stands for content and name: scores are linear in the query, so one product does for both."""
    return items.withColumn("fused", F.zip_with("emb", "nemb", lambda a, b: a.cast("double") + F.lit(NAME_WEIGHT) * b.cast("double")))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best, ties by idx: each task keeps k rows, and only these meet."""
    return scored.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), F.col("idx")).limit(k)


def top_k_each(items: DataFrame, queries: DataFrame, k: int, bonus: str | None = None, block: int = blocks.BLOCK, digits: int | None = None) -> DataFrame:
    """(query, idx, score): the k best items (idx, vector) for each of many queries (query, vector), ties by idx; an item isn't its own answer. bonus: a column to add to an item's products; digits: scores are rounded to so many first.

    See blocks.over_blocks: a task multiplies its items with a block of queries at once and keeps k of them per query, and
    only these meet. Items and queries without an id or a vector have no part.
    """
    rows = items.select(F.col("idx").cast("long").alias("idx"), "vector", (F.coalesce(F.col(bonus), F.lit(0.0)) if bonus else F.lit(0.0)).cast("double").alias("bonus"))

    def kernel(some, chunk, products, near):
        more = chunk["bonus"].to_numpy()
        scores = products + more
        if digits is not None:
            return blocks.best(some, chunk, np.round(scores, digits), k)
        return blocks.best(some, chunk, scores, k, near, lambda q, i: blocks.exact(some, chunk, q, i) + more[i])

    found = blocks.over_blocks(rows, queries.select(F.col("query").cast("long").alias("query"), "vector"), kernel, "query long, idx long, score double", block)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("idx"))
    return found.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= k).drop("_rn")


def collapse(ranked: DataFrame, cards: int, key: Column | None = None) -> DataFrame:
    """One row per group of the ranked rows (score, idx, p): its best row, n_variants, and variants, the next VARIANTS in order; the best cards groups.

    ranked is a top k, so what a group's window holds is bounded by that.
    """
    keyed = ranked.withColumn("map_key", key if key is not None else text.map_key(F.col("p")))
    by = Window.partitionBy("map_key").orderBy(F.col("score").desc(), F.col("idx"))
    place = keyed.withColumn("_rn", F.row_number().over(by)).where(F.col("_rn") <= VARIANTS + 1)
    row = F.struct("_rn", "idx", "p", "score")
    groups = place.groupBy("map_key").agg(F.min_by(F.struct("idx", "p", "score"), "_rn").alias("head"), F.array_sort(F.collect_list(F.when(F.col("_rn") > 1, row))).alias("variants"))
    out = groups.select("map_key", "head.*", F.size("variants").cast("long").alias("n_variants"), "variants")
    return out.orderBy(F.col("score").desc(), F.col("idx")).limit(cards)


def similar(items: DataFrame, idx: int, cards: int = TOP, pieces: DataFrame | None = None) -> DataFrame:
    """Cards like item idx: by content alone, on its side of pieces (idx), its own group left out after the window is taken. An unknown idx gives none."""
    found = items.where(F.col("idx") == idx).withColumn("_key", text.map_key(F.col("p")))
    if pieces is not None:  # in the same job: whether the item is one of them
        found = found.join(pieces.where(F.col("idx") == idx).select("idx", F.lit(True).alias("_own")).limit(1), "idx", "left")
    base = found.first()
    if base is None:
        return collapse(top_k(items.limit(0).withColumn("score", F.lit(0.0)), 0), 0)
    rows = items
    if pieces is not None:
        rows = items.join(pieces, "idx", "left_semi" if base["_own"] else "left_anti")
    ranked = top_k(rows.withColumn("score", vectors.dot_with(F.col("emb"), base["emb"])), cards * WINDOW_SIMILAR)
    keyed = ranked.withColumn("map_key", text.map_key(F.col("p"))).where(F.col("map_key") != base["_key"])
    return collapse(keyed, cards, F.col("map_key"))


def variants_of(items: DataFrame, idx: int) -> DataFrame:
    """The whole group of item idx by path, hidden ones too."""
    keyed = items.withColumn("map_key", text.map_key(F.col("p")))
    return keyed.join(keyed.where(F.col("idx") == idx).select("map_key"), "map_key", "left_semi").orderBy("p", "idx")


def search(items: DataFrame, vector: list[float], query: str | None, cards: int = TOP, pieces: DataFrame | None = None) -> dict[str, DataFrame]:
    """results, and where pieces (idx) are given their own ranking apart, so that their number doesn't crowd out the rest."""
    one = lambda rows, window: collapse(top_k(score_items(rows, vector, query), cards * window), cards)
    if pieces is None:
        return {"results": one(items, WINDOW_ALL)}
    return {"results": one(items.join(pieces, "idx", "left_anti"), WINDOW_ALL), "pieces": one(items.join(pieces, "idx", "left_semi"), WINDOW_PIECES)}


def top_sounds(section: str | None) -> int:
    """How many sounds a search gives: more where it is for sounds alone."""
    return TOP if section == "sounds" else TOP // 2


def sound_cards(rows: DataFrame, favs: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """What a card shows of a sound (idx, p, d, score): as cards, with its seconds in place of thumbnail and kind."""
    shown = cards(rows.withColumn("k", F.lit(None).cast("string")), favs, root).drop("thumb", "k")
    return shown.join(rows.select("idx", F.coalesce("d", F.lit(0.0)).alias("dur")), "idx")


def cards(rows: DataFrame, favs: DataFrame | None = None, root: str | None = None) -> DataFrame:
    """What a card shows of a row: path, the path below root, thumbnail, rounded score, name, the two folders above, kind, favourite."""
    p, up = text.parts(F.col("p")), text.last_parts(F.col("p"))
    below = F.replace(F.col("p"), F.lit("\\"), F.lit("/"))
    if root:
        head = root.replace("\\", "/").rstrip("/") + "/"
        below = F.when(F.startswith(below, F.lit(head)), F.substr(below, F.lit(len(head) + 1))).otherwise(below)
    out = rows
    if favs is not None:
        mine = favs.select(text.norm_dir(F.col("p")).alias("_n")).distinct().withColumn("_f", F.lit(True))
        out = out.withColumn("_n", text.norm_dir(F.col("p"))).join(mine, "_n", "left")
    folders = F.slice(up, 1, F.size(up) - 1)
    return out.select(
        "idx", F.col("p").alias("path"), below.alias("relative"), F.concat(F.lit("/thumbs/"), text.thumb_name(F.col("p"))).alias("thumb"), F.round("score", 3).alias("score"),
        text.stem(F.col("p")).alias("name"), F.when(F.size(p) > 1, F.array_join(folders, "/")).otherwise("").alias("dir"), F.coalesce("k", F.lit("i")).alias("k"),
        (F.coalesce("_f", F.lit(False)) if favs is not None else F.lit(False)).alias("fav"),
    )
