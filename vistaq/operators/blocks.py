"""Many queries against all rows: blocks of queries times chunks of rows, as matrix products inside tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..sources.scratch import scratch, ship

#: Queries that are sent along or stored together, and rows that a task holds meanwhile.
BLOCK, CHUNK = 1024, 50_000
#: Products that a task holds at once, so many of a block's queries are multiplied with a chunk; and rows of results.
TILE, HELD = 1 << 21, 20_000
#: How near two products are, as a share of the vectors' lengths, so that their order is told by sums of one order.
NEAR = 1e-11


def _blocks(told) -> Iterator[pd.DataFrame]:
    """The queries, block by block: those that were sent along, or the files of a folder, one at a time."""
    if isinstance(told, pd.DataFrame):
        if len(told):
            yield told
        return
    from pyarrow import parquet
    from pyarrow.fs import FileSelector, FileSystem

    fs, at = FileSystem.from_uri(told)
    for info in sorted(fs.get_file_info(FileSelector(at)), key=lambda i: i.path):
        if info.base_name.endswith(".parquet"):
            pdf = parquet.read_table(info.path, filesystem=fs).to_pandas()
            if len(pdf):
                yield pdf


def over_blocks(items: DataFrame, queries: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, float], pd.DataFrame], schema: str, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The rows that kernel(queries, items, products, near) gives for some queries (query, vector, ..) of a block and a chunk of items (idx, vector, ..), where an item's product with the query that it is itself is minus infinity.
    near is more than the products of equal vectors may come apart by the order of summing; see exact.

    A block at most is sent along with the plan; more queries are written to the shared folder, a file a block, which each
    task reads one by one for each of its chunks. Of a block so many queries are taken at once that their products are at
    most TILE. So the driver holds a block, a task a block, a chunk and a tile's products, and the plan is the same however
    many queries there are. Rows without an id or a vector are left out on both sides.
    """
    spark = items.sparkSession
    ship(spark)
    asked = queries.where("query is not null and vector is not null")
    n = asked.count()
    if n <= block:
        told = asked.toPandas()
    else:
        told = scratch(spark, "queries")
        asked.repartition(math.ceil(n / block)).write.parquet(told)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def work():
            rows = pd.concat(held, ignore_index=True)
            matrix, own = np.stack(rows["vector"].to_numpy()).astype(np.float64).T, rows["idx"].to_numpy()
            step, longest = max(1, TILE // len(rows)), _longest(matrix)
            for some in _blocks(told):
                made, size = [], 0
                for low in range(0, len(some), step):
                    few = some.iloc[low : low + step]
                    vectors = np.stack(few["vector"].to_numpy()).astype(np.float64)
                    products = vectors @ matrix
                    products[few["query"].to_numpy()[:, None] == own[None, :]] = -np.inf
                    made.append(kernel(few, rows, products, NEAR * longest * _longest(vectors.T)))
                    size += len(made[-1])
                    if size >= HELD:
                        yield pd.concat(made, ignore_index=True)
                        made, size = [], 0
                if made:
                    yield pd.concat(made, ignore_index=True)

        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                n += len(pdf)
            if n >= chunk:
                yield from work()
                held, n = [], 0
        if n:
            yield from work()

    return items.where("idx is not null and vector is not null").mapInPandas(run, schema)


def exact(some: pd.DataFrame, rows: pd.DataFrame, q: np.ndarray, i: np.ndarray, piece: int = 1 << 14) -> np.ndarray:
    """Products of the q-th queries and the i-th rows, each pair by itself: equal vectors have equal ones, which a product of matrices doesn't give, since it sums in another order at its edges."""
    asked, own, out = some["vector"].to_numpy(), rows["vector"].to_numpy(), np.empty(len(q))
    for low in range(0, len(q), piece):
        at = slice(low, low + piece)
        out[at] = (np.stack(asked[q[at]]).astype(np.float64) * np.stack(own[i[at]]).astype(np.float64)).sum(1)
    return out


def _longest(vectors: np.ndarray) -> float:
    """The greatest length of columns, but for those that are no numbers."""
    lengths = np.sqrt((vectors * vectors).sum(0))
    return float(lengths[np.isfinite(lengths)].max(initial=0.0))


def best(some: pd.DataFrame, rows: pd.DataFrame, scores: np.ndarray, k: int, near: float = 0.0, again: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> pd.DataFrame:
    """(query, idx, score): each query's k best of a chunk, ties by idx. What is below the k-th best isn't sorted. again: the scores proper of pairs (queries, rows), which may be off scores by near."""
    own = rows["idx"].to_numpy()
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if scores.shape[1] > k else np.full((len(scores), 1), -np.inf)
    q, i = np.nonzero((scores >= least - near) & np.isfinite(scores))
    found = scores[q, i] if again is None else again(q, i)
    order = np.lexsort((own[i], -found, q))
    q, i, found = q[order], i[order], found[order]
    first = np.searchsorted(q, q)  # where each query's rows begin
    keep = np.arange(len(q)) - first < k
    return pd.DataFrame({"query": some["query"].to_numpy()[q[keep]], "idx": own[i[keep]], "score": found[keep]})
