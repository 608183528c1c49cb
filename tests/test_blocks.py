"""Many queries against all rows: what a task holds at once, and rows of equal vectors, whose order is by id alone."""

import numpy as np
import pandas as pd
import pytest

from vistaq.operators import blocks, evaluation, search

R = np.random.default_rng(11)


def tables(spark, n, copies, labels=5):
    x = np.concatenate([R.standard_normal((n, 64)).astype(np.float32)] * copies)
    pdf = pd.DataFrame({"idx": np.arange(len(x)), "vector": list(x), "label": np.tile(R.integers(0, labels, n), copies).astype(str)})
    rows = spark.createDataFrame(list(zip(pdf["idx"].tolist(), x.tolist(), pdf["label"], strict=True)), "idx long, vector array<float>, label string").coalesce(2)
    # a product of its own for each pair, as SQL has it
    whole = x.astype(np.float64)
    scores = np.stack([(whole[q] * whole).sum(1) for q in range(0, len(x), 20)])
    scores[np.arange(len(scores)), np.arange(0, len(x), 20)] = -np.inf
    return rows, rows.where("idx % 20 = 0").withColumnRenamed("idx", "query"), scores, pdf["label"].to_numpy()


@pytest.mark.parametrize("tile", [1, 3_001, 1 << 21])
def test_equal_vectors_tie(spark, monkeypatch, tile):
    monkeypatch.setattr(blocks, "TILE", tile)
    rows, asked, scores, labels = tables(spark, 67, 13)
    order = np.stack([np.lexsort((np.arange(len(s)), -s)) for s in scores])
    got = search.top_k_each(rows, asked, 30).toPandas().sort_values(["query", "score", "idx"], ascending=[True, False, True])
    assert got["idx"].to_numpy().reshape(len(scores), 30).tolist() == order[:, :30].tolist()
    relevant = labels[order] == labels[::20, None]
    ranks = {q * 20: int(np.flatnonzero(r)[0]) + 1 for q, r in enumerate(relevant)}
    assert {r["query"]: r["first"] for r in evaluation.query_ranks(rows, asked, 2000).collect()} == ranks


def test_a_task_holds_a_tile(spark):
    # more products than a tile: none that a kernel gets has more, and all pairs come once
    rows, asked, scores, _ = tables(spark, 4_100, 1)
    most = 1 << 16

    def kernel(some, chunk, products, near):
        assert products.size <= max(most, len(chunk)) and 0 < near < 1e-6
        return pd.DataFrame({"query": some["query"].to_numpy(), "n": np.full(len(some), np.isfinite(products).sum(1)), "held": products.size})

    before = blocks.TILE
    try:
        blocks.TILE = most
        got = blocks.over_blocks(rows.drop("label"), asked.drop("label"), kernel, "query long, n long, held long", block=64).groupBy("query").sum("n").collect()
    finally:
        blocks.TILE = before
    assert len(got) == len(scores) and all(r["sum(n)"] == 4_099 for r in got)
    assert blocks.TILE * 8 <= 32 << 20  # bytes of a tile
