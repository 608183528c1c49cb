"""Translations that are being asked for: one request per query however often it comes, answers that are kept a while, and another try after a failed one."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.translate import valid_translation

#: Seconds after which a query is asked for again if no answer came, or none that is one; and that an answer is kept here.
PATIENCE, KEPT = 60.0, 86_400.0
#: Groups that queries share by their hash, a state each: a call of a group costs more than its rows.
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "pt string, at double, what string, en string"


class InFlight(StatefulProcessor):
    """State of a bucket's queries: the answer of each, or until when it counts as being asked. Both are told by the times of the events, so what comes out doesn't hang on when a timer fires; the timer only frees state."""

    def __init__(self, patience: float, kept: float):
        self.patience, self.kept = patience, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "pts array<string>, ens array<string>, untils array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {pt: (en, until) for pt, en, until in zip(*self.state.get(), strict=True)} if self.state.exists() else {}
        events = sorted(x for pdf in rows for x in zip(*(pdf[c].tolist() for c in ("at", "seq", "answers", "en", "pt")), strict=True))
        out = []
        for at, _, answers, told, pt in events:
            en, until = known.get(pt, (None, None))
            if until is not None and at >= until:
                en = until = None
            if answers and told:
                en, until = told, at + self.kept
                out.append((pt, at, "told", en))
            elif answers:  # a refusal: not at once again, unless it is known by now
                until = until if en is not None else at + self.patience
            elif en is not None:
                out.append((pt, at, "known", en))
            elif until is None:
                until = at + self.patience
                out.append((pt, at, "ask", None))
            known[pt] = en, until
        # after the rows: those of this batch may be older than its watermark, those of the next can't
        over = timerValues.getCurrentWatermarkInMs()
        left = [(pt, en, until) for pt, (en, until) in known.items() if until * 1000 > over]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            pts, ens, untils = (list(x) for x in zip(*left, strict=True))
            self.state.update((pts, ens, untils))
            self.handle.registerTimer(math.ceil(max(untils) * 1000))
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=["pt", "at", "what", "en"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["pt", "at", "what", "en"])


def in_flight(asks: DataFrame, answers: DataFrame, patience: float = PATIENCE, kept: float = KEPT, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """What to do about the streams asks (pt, at, seq) and answers (pt, at, seq, answer), at in seconds: rows (pt, at, what, en).

    what is ask, once a query until it is answered or patience is over; told, for each answer that is one; known, for a
    query that comes while its answer is kept. Events of a batch are taken in the order of at and seq, an ask before an
    answer; blank queries and null times are left out. Only what is more than late behind the newest is dropped.
    A query's state is freed when it is over and its bucket's next rows come, or all of the bucket's queries are over.
    buckets can't change while a checkpoint is gone on with.
    """
    one = asks.select("pt", "at", "seq", F.lit(False).alias("answers"), F.lit(None).cast("string").alias("en"))
    other = answers.select("pt", "at", "seq", F.lit(True).alias("answers"), valid_translation(F.col("answer")).alias("en"))
    # nulls of strings don't compare: an answer that is none is empty
    both = one.unionByName(other).select(F.trim("pt").alias("pt"), "at", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "answers", F.coalesce("en", F.lit("")).alias("en"))
    timed = both.where("pt <> '' and at is not null").withColumn("_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("_time", late)
    return timed.withColumn("_bucket", F.pmod(F.hash("pt"), F.lit(buckets))).groupBy("_bucket").transformWithStateInPandas(InFlight(patience, kept), _OUT, "Append", "EventTime")


def start(asks: DataFrame, answers: DataFrame, to: str, checkpoint: str, **how) -> StreamingQuery:
    """in_flight over all that is there, appended to the Parquet folder to. State is kept in RocksDB, which it needs; the session's own choice comes back after the start."""
    spark, name = asks.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        rows = in_flight(asks, answers, **how)
        return rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
