"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship

#: The network: bytes of a filter, size of a byte's embedding, filters, bytes from one position to the next.
WIDTH, EMBED, FILTERS, STRIDE = 8, 8, 24, 2
#: Bytes of a chunk; the next starts half a chunk on.
CHUNK = 256
#: Labelled rows that are learned from, at most, and bytes of their texts together.
TRAIN_ROWS, TRAIN_BYTES = 4_000, 16 << 20
#: Passes over the training rows, and the steps that fewer rows are gone over again for.
EPOCHS, STEPS, BATCH, RATE = 5, 400, 32, 0.01
THRESHOLD = 0.7
#: A filter drops what scores less: with doubt, a document stays.
REJECT = 0.5


class ByteCNN:
    """score = sigmoid(w . [mean over chunks, max over chunks] + b) of each chunk's max-pooled filter outputs.

    A filter's output at a position is relu(sum over its bytes of filter[j] . embedding[byte]). With the two multiplied
    out once, that is a sum of rows of WIDTH tables of 256.
    """

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        byte = np.arange(256)
        kinds = [(97 <= byte) & (byte < 123), (65 <= byte) & (byte < 91), (48 <= byte) & (byte < 58), (byte == 32) | (9 <= byte) & (byte < 14), byte >= 128]
        self.embed = (r.normal(0, 0.3, (256, EMBED))).astype(np.float32)
        self.embed[:, : len(kinds)] += np.stack(kinds, 1)
        self.filters = r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.out_bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]

    def tables(self) -> np.ndarray:
        return np.einsum("be,wef->wbf", self.embed, self.filters)

    @staticmethod
    def positions(text: str | None) -> np.ndarray:
        """The bytes, padded so that each byte is in a filter's reach; an empty text is padding."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return np.concatenate([raw, np.zeros(WIDTH + STRIDE - (len(raw) % STRIDE), np.uint8)])

    def chunks(self, data: np.ndarray, tables: np.ndarray, where: bool = False):
        """(chunks, filters) maxima before the bias; with where, the position of each maximum too."""
        n = (len(data) - WIDTH) // STRIDE + 1
        act = tables[0][data[: n * STRIDE : STRIDE]]
        for j in range(1, WIDTH):
            act += tables[j][data[j : j + n * STRIDE : STRIDE]]
        half = CHUNK // 2 // STRIDE
        starts = np.arange(0, n, half)
        top = np.maximum.reduceat(act, starts, axis=0)
        both = np.maximum(top[:-1], top[1:]) if len(top) > 1 else top  # a chunk is two halves
        if not where:
            return both, None
        at = np.stack([act[s : s + half].argmax(0) + s for s in starts])
        if len(top) > 1:
            at = np.where(top[:-1] >= top[1:], at[:-1], at[1:])
        return both, at

    def score(self, texts: Iterator[str | None]) -> np.ndarray:
        tables, out = self.tables(), []
        for text in texts:
            data = self.positions(text)
            # long texts by spans of many chunks, which overlap by half a chunk
            sums, tops, n = np.zeros(FILTERS), np.full(FILTERS, -np.inf), 0
            span, half = CHUNK * 512, CHUNK // 2
            for s in range(0, max(1, len(data) - half - WIDTH), span):
                c, _ = self.chunks(data[s : s + span + half + WIDTH - STRIDE], tables)
                c = np.maximum(c + self.bias, 0)
                sums, tops, n = sums + c.sum(0), np.maximum(tops, c.max(0)), n + len(c)
            out.append(float(np.concatenate([sums / n, tops]) @ self.out + self.out_bias[0]))
        return 1 / (1 + np.exp(-np.array(out)))

    def fit(self, texts: list[str | None], labels: list[int], seed: int = 0, epochs: int = EPOCHS, steps: int = STEPS) -> ByteCNN:
        """Adam on the log loss, for epochs and at least steps. A maximum passes its gradient to the position that it came from."""
        r, data = np.random.default_rng(seed), [self.positions(t) for t in texts]
        y = np.array(labels, np.float32)
        self.out_bias[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) if len(y) else 0
        first, second, step = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()], 0
        epochs = max(epochs, -(-steps * BATCH // max(1, len(data)))) if data else 0
        for epoch in range(epochs):
            order = r.permutation(len(data))
            for low in range(0, len(order), BATCH):
                some, tables = order[low : low + BATCH], self.tables()
                g_tables = np.zeros_like(tables)
                g_bias, g_out, g_out_bias = np.zeros_like(self.bias), np.zeros_like(self.out), 0.0
                for i in some:
                    c, at = self.chunks(data[i], tables, True)
                    on = c + self.bias
                    act = np.maximum(on, 0)
                    best = act.argmax(0)
                    x = np.concatenate([act.mean(0), act.max(0)])
                    d = 1 / (1 + np.exp(-(x @ self.out + self.out_bias[0]))) - y[i]
                    g_out += d * x
                    g_out_bias += d
                    g = np.broadcast_to(d * self.out[:FILTERS] / len(c), c.shape).copy()
                    g[best, np.arange(FILTERS)] += d * self.out[FILTERS:]
                    g = np.where(on > 0, g, 0)
                    g_bias += g.sum(0)
                    k, f = np.nonzero(g)
                    spot, amount = at[k, f] * STRIDE, g[k, f]
                    for j in range(WIDTH):
                        np.add.at(g_tables[j], (data[i][spot + j], f), amount)
                g_embed = np.einsum("wbf,wef->be", g_tables, self.filters)
                g_filters = np.einsum("wbf,be->wef", g_tables, self.embed)
                step += 1
                grads = [g_embed, g_filters, g_bias, g_out, np.array([g_out_bias], np.float32)]
                rate = RATE * (1 - epoch / epochs)
                for p, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                    g = g / len(some) + 1e-5 * p
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id):
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2. A null id reads null."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES, seed: int = 0) -> ByteCNN:
    """Fits on at most rows labelled documents outside the held-out fold, in the order of a hash of their ids, and on most_bytes of text.

    Both bounds hold before any text is sent to the driver: sizes are, of rows documents at most, and then the texts that
    together fit most_bytes, whole ones, taken in that order; one that no longer fits is passed over. Rows that repeat are
    learned from once. Labels are read by doc_id; null labels and ids are left out. Without both labels the network gives 0.5 or the share that there is.
    """
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = some.select("doc_id", "quality", F.xxhash64("doc_id", F.lit(seed)).alias("_order")).orderBy("_order", "doc_id").limit(rows)
    text = F.coalesce("text", F.lit(""))
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # rows labels at most
    got = got.select("doc_id", text.alias("text"), "quality", "_order", F.xxhash64(text).alias("_hash"), F.octet_length(text).alias("_n"))
    sizes = got.select("_order", "doc_id", "quality", "_hash", "_n").distinct().orderBy("_order", "doc_id", "_hash", "quality").limit(rows).collect()
    room, chosen = most_bytes, []
    for r in sizes:
        if r["_n"] <= room:
            room -= r["_n"]
            chosen.append((len(chosen), r["doc_id"], r["_hash"], r["quality"]))
    if not chosen:
        return ByteCNN(seed)
    wanted = docs.sparkSession.createDataFrame(chosen, "place int, doc_id long, _hash long, quality int")
    found = got.drop("quality").join(F.broadcast(wanted), ["doc_id", "_hash"]).groupBy("place", "quality").agg(F.first("text").alias("text")).collect()
    found.sort(key=lambda r: r["place"])
    return ByteCNN(seed).fit([r["text"] for r in found], [int(r["quality"] == 1) for r in found])


def score(docs: DataFrame, model: ByteCNN, name: str = "score") -> DataFrame:
    """docs with name, a probability from the whole text alone. Null texts count as empty, and empty ones are scored too."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts), dtype=float)

    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs, model).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
