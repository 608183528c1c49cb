"""The incremental behaviour as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.deltas import DeltaIndex


def stream_recents(log: DataFrame) -> DataFrame:
    """The newest action per item of a stream (item, ts): state of one number per item."""
    return log.groupBy("item").agg(F.max("ts").alias("ts"))


def stream_favourites(log: DataFrame) -> DataFrame:
    """Whether each item of a stream (item, on, ts, seq) is a favourite: the last action counts, however late it comes."""
    return log.groupBy("item").agg(F.max_by("on", F.struct("ts", "seq")).alias("on"))


def stream_windows(log: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Actions by kind and window of event time; a window is given out once it can't change."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"))


def settled(df: DataFrame, root: str) -> DataFrame:
    """What a stream with aggregations comes to over all that is there now: each batch's whole result is written below root, and the last is read."""
    done = []

    def step(batch: DataFrame, number: int) -> None:
        done.append(f"{root}/result{number}")
        batch.write.mode("overwrite").parquet(done[-1])

    df.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(done[-1])


def progress(df: DataFrame, name: str, error: str | None = None) -> DataFrame:
    """df, with an observation of rows done and failed that listeners get as it goes."""
    failed = F.count_if(F.col(error).isNotNull()) if error else F.lit(0)
    return df.observe(name, F.count(F.lit(1)).alias("done"), (failed if error else F.max(F.lit(0))).alias("failed"))


def index_stream(files: DataFrame, root: str, checkpoint: str, make) -> StreamingQuery:
    """Keeps an index (see deltas.DeltaIndex) of a stream of listings (p, m, and gone where files are taken away): each batch appends the rows that make gives for files that are new or changed, and tombstones.

    A batch is known by its number and the stream's id, which the checkpoint keeps; one that is run again after a crash is
    either not there yet or not written a second time. A stream with a new checkpoint goes on with the same index.
    """
    name = []

    def step(batch: DataFrame, number: int) -> None:
        if not name:
            name.append(batch.sparkSession.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0])
        DeltaIndex(batch.sparkSession, root).apply(batch, make, f"{name[0]}.{number}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ttl_stream(requests: DataFrame, ttl: float = 300.0, late: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """Hits of cached answers over a stream (key, at in seconds), in the order of time within a batch and key.

    State is the time of a key's last fetch, kept for all keys of a bucket together, since a call of a group costs more
    than its rows. It is dropped once the watermark, late behind the newest request, has passed that by ttl: no request
    that still comes can hit it; at the latest with the bucket's next requests, or when all of its keys are over.
    Requests later than that are dropped, too. buckets can't change while a checkpoint is gone on with.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    ahead = 86_400.0  # of time 0, where watermarks begin: nothing is late before the first

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        over = state.getCurrentWatermarkMs() / 1000 - ahead - ttl
        last = {k: at for k, at in zip(*state.get, strict=True) if at > over} if state.exists else {}
        rows = sorted((at, i, k) for i, (k, at) in enumerate(x for pdf in batches for x in zip(pdf["key"].tolist(), pdf["at"].tolist(), strict=True)))
        hits = []
        for at, _, k in rows:
            since = last.get(k)
            hit = since is not None and at - since < ttl
            if not hit:
                last[k] = at
            hits.append(hit)
        state.update((list(last), list(last.values())))
        state.setTimeoutTimestamp(max(int((max(last.values()) + ttl + ahead) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k for _, _, k in rows], "at": [at for at, _, _ in rows], "hit": hits})

    timed = requests.withColumn("_time", F.timestamp_micros(((F.col("at") + ahead) * 1_000_000).cast("long"))).withWatermark("_time", late)
    grouped = timed.withColumn("_bucket", F.pmod(F.hash("key"), F.lit(buckets))).groupBy("_bucket")
    return grouped.applyInPandasWithState(step, "key string, at double, hit boolean", "keys array<string>, since array<double>", "append", "EventTimeTimeout")
