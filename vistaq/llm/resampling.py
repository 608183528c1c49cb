"""Importance resampling towards a target distribution: hashed runs of words counted in one pass, documents weighed in a second and drawn by perturbed scores."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, read_table, ship

BUCKETS, RUN = 10_000, 2
SHARE, LEAST, SEED = 25, 20, 7
#: Bytes of a text that are taken apart at once; longer texts go through in blocks that end outside a word.
BLOCK = 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
_MADE = ("n_words", "n_features", "weight")


def blocks(raw: bytes) -> Iterator[bytes]:
    """raw in pieces of about BLOCK bytes that no word crosses."""
    at = 0
    while len(raw) - at > BLOCK:
        gap = _GAP.search(raw, at + BLOCK)
        end = gap.start() if gap else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


def features(text: str | None, run: int = RUN, size: int = BUCKETS) -> tuple[int, list[np.ndarray]]:
    """The number of words of a text and the buckets of its runs of 1 to run words. Only A to Z are lower-cased; words are digits, letters and all characters beyond ASCII. Null texts have none.

    A longer run's sum goes on from that of the run without its last word, so no run is put together.
    """
    n, out = 0, []
    before: list[list[int]] = [[] for _ in range(run)]  # sums of the runs of 1, 2 .. words that end the block before
    for raw in blocks((text or "").encode().lower()):
        words = _WORD.findall(raw)
        if not words:
            continue
        n += len(words)
        sums = list(map(crc32, words))
        out.append(np.array(sums, np.uint32))
        ends = [sums[-1:]]
        for k in range(1, run):
            # runs of k words that end before a word; that of the first one ends in the block before
            open_ = (before[k - 1] + sums)[:-1]
            sums = list(map(crc32, words[len(words) - len(open_) :], map(crc32, repeat(b" "), open_)))
            out.append(np.array(sums, np.uint32))
            ends.append(sums[-1:])
        before = ends
    return n, [x % np.uint32(size) for x in out]


def _count(run: int, size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for text in b.column(0):  # one text at a time is a Python string
                for x in features(text.as_py(), run, size)[1]:
                    total += np.bincount(x, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return of


def counts(docs: DataFrame, text: str = "text", run: int = RUN, size: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts: a vector per partition, merged in a tree, so neither the driver nor a task adds up more than some of them."""
    ship(docs.sparkSession)
    vectors = docs.select(F.col(text)).mapInArrow(_count(run, size), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(size, np.int64)
    return vectors.treeReduce(np.add, depth=2 if vectors.getNumPartitions() < 4096 else 3)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document: 1000 times the logarithm of its smoothed share in the target over that in the source, floored."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + size) / ((float(s) + 1) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(shared, run: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            words, of_doc, some = [], [], []
            total, n = np.zeros(len(b)), np.zeros(len(b), np.int64)
            held = 0

            def add() -> None:
                buckets, doc = np.concatenate(some), np.repeat(np.array(of_doc), [len(x) for x in some])
                total[:] += np.bincount(doc, weights=gain[buckets], minlength=len(total))  # whole numbers, exact below 2^53
                n[:] += np.bincount(doc, minlength=len(n))
                some.clear(), of_doc.clear()

            for i, text in enumerate(b.column(b.num_columns - 1)):
                w, found = features(text.as_py(), run, len(gain))
                words.append(w)
                some += found
                of_doc += [i] * len(found)
                held += sum(map(len, found))
                if held > BLOCK:
                    add()
                    held = 0
            if some:
                add()
            mean = total.astype(np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(words, pa.int64()), pa.array(n), pa.array(mean)], names=[*b.schema.names[:-1], *_MADE])

    return of


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate, floored, from the id alone: the highest sums of weight and noise are a draw by weight without replacement. A null id reads null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str], text: str = "text", doc_id: str = "doc_id", run: int = RUN, seed: int = SEED) -> DataFrame:
    """row (a struct of the columns keep), _id, n_words, n_features, weight and score of each row of docs. A text without a word has weight 0."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(gain)  # one number a bucket
    row = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("_"))
    asked = docs.select(row.alias("row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    schema = T.StructType([*asked.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in _MADE)])
    made = asked.mapInArrow(_weigh(shared, run), schema)
    return made.withColumn("score", F.col("weight") + noise(F.col("_id"), seed))


def ranked(stored: DataFrame, work: Workspace, share: int = SHARE, least: int = LEAST) -> DataFrame:
    """stored (_id, n_words, score, _uid and others) with rank: 1, 2, 3 .. of the share of 100 of the rows of least words or more with the highest scores, ties to the smaller id (null last); null for others.

    Rows are sorted in ranges and numbered within theirs; a range's first number is what the ranges before it hold. _uid
    tells rows apart that agree in score and id, so no range has to hold more than another.
    """
    spark = stored.sparkSession
    enough = F.col("n_words") >= least
    some = stored.where(enough)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = (F.col("score").desc(), F.col("_id").asc_nulls_last(), F.col("_uid"))
    numbered = some.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # within a partition ids count up from its own number times 2^33
    numbered = work.save(numbered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbered")
    sizes = {r[0]: r[1] for r in numbered.groupBy("_part").agg(F.count(F.lit(1))).collect()}  # a row per range
    firsts, done = [], 0
    for k in sorted(sizes):
        firsts.append((k, done))
        done += sizes[k]
    drawn = share * done // 100
    starts = spark.createDataFrame(firsts, "_part int, _first long")
    rank = F.col("_first") + F.col("_place") + 1
    good = numbered.join(F.broadcast(starts), "_part").select(*stored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return good.unionByName(stored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def scored(docs: DataFrame, target: DataFrame, work: Workspace, keep: list[str], text: str = "text", doc_id: str = "doc_id", run: int = RUN, size: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """weigh's rows, stored, with _uid, a number of their own. target has the texts, in a column of the same name, whose distribution is aimed at."""
    gain = gains(counts(docs, text, run, size), counts(target, text, run, size))
    return work.save(weigh(docs, gain, keep, text, doc_id, run, seed).withColumn("_uid", F.monotonically_increasing_id()), "scored")


def resample(docs: DataFrame, target: DataFrame, work: Workspace, share: int = SHARE, least: int = LEAST, text: str = "text", doc_id: str = "doc_id", run: int = RUN, size: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The share of 100 of the documents of least words or more that is drawn by importance, with the columns of docs and dsir, a struct (n_features, weight, score, rank), in place of a column of that name.

    Documents that are more like target weigh more; the draw is without replacement and, for the ids, fixed by seed. Null
    texts have no words. Rows of one id get the same noise; equal rows are drawn one by one, ranks among them in no given
    order. An empty table or target gives none or weights by the source alone.
    """
    kept = [c for c in docs.columns if c != "dsir"]
    table = scored(docs, target, work, kept, text, doc_id, run, size, seed)
    places = ranked(table.select("_id", "n_words", "score", "_uid"), work, share, least).where("rank is not null").select("_uid", "rank")
    both = table.join(places, "_uid")  # _uid is of its own for each row: no key is hot
    return both.select(*(F.col("row").getField(c).alias(c) for c in kept), F.struct("n_features", "weight", "score", "rank").alias("dsir"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = read_table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "dsir")
    table = scored(docs, read_table(spark, sf_dir, "benchmark"), work, ["doc_id"])
    out = ranked(table, work)
    return work.result(out.select("row.doc_id", "n_features", "weight", "score", "rank"))


OP12_SQL = """
WITH t AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM (SELECT range AS i FROM range(256))
), d AS (
  SELECT row_number() OVER () AS uid, 's' AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT row_number() OVER (), 't', NULL, coalesce(text, '') FROM benchmark
), w AS (
  SELECT uid, side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM d
), f AS (
  SELECT uid, side, unnest(w) AS f FROM w UNION ALL
  SELECT uid, side, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
), g AS (
  SELECT f, xor(list_reduce([4294967295] || list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM f), t
), n AS (SELECT uid, side, b, count(*) AS n FROM f JOIN g USING (f) GROUP BY ALL),
a AS (SELECT sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM n),
e AS (
  SELECT b, floor(1000 * ln((coalesce(sum(n) FILTER (side = 't'), 0) + 1)::DOUBLE * (coalesce(any_value(a.s), 0) + 10000)::DOUBLE / ((coalesce(sum(n) FILTER (side = 's'), 0) + 1)::DOUBLE * (coalesce(any_value(a.t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM n, a GROUP BY b
), x AS (
  SELECT uid, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM n JOIN e USING (b) WHERE side = 's' GROUP BY uid
), r AS (
  SELECT w.uid, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN x USING (uid) WHERE w.side = 's'
), k AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, uid) AS rank, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM r LEFT JOIN k USING (uid)
"""
