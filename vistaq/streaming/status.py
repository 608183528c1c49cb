"""How jobs get on, as a table: a listener for streams and an observation for batches write phase, done, failed and total."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Letters of an error that are kept.
MOST = 4_000
SCHEMA = "job string, run string, phase string, batch long, done long, failed long, total long, error string, at double"


class StatusTable:
    """JSON rows below root, a small file each, written once under a name of its own; a driver writes them, at most a few a batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    def write(self, **row) -> None:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"
        part = self._path(f"{self.root}/_{name}")  # not read before it is whole
        out = self._fs.create(part, True)
        out.write(bytearray((json.dumps({"at": time.time(), **row}) + "\n").encode()))
        out.close()
        self._fs.rename(part, self._path(f"{self.root}/{name}"))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.root)

    def jobs(self) -> DataFrame:
        """A row per run of a job: its last phase and error, batches, and how many rows are done and failed so far, of how many if that is known."""
        last = F.struct("at", F.expr("phase in ('ended', 'failed')").alias("final"))
        return self.rows().groupBy("job", "run").agg(
            F.max_by("phase", last).alias("phase"), F.count_distinct("batch").alias("batches"), F.sum(F.coalesce("done", F.lit(0))).alias("done"),
            F.sum(F.coalesce("failed", F.lit(0))).alias("failed"), F.max("total").alias("total"), F.max("error").alias("error"),
        )


class StatusListener(StreamingQueryListener):
    """Writes a row when a named stream starts, for each batch in which rows were observed (see jobs.progress), and when it ends."""

    def __init__(self, table: StatusTable, total: int | None = None):
        self.table, self.total, self.names = table, total, {}

    def onQueryStarted(self, event) -> None:
        if event.name:
            self.names[str(event.runId)] = event.name
            self.table.write(job=event.name, run=str(event.runId), phase="started", total=self.total)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get(p.name) if p.name else None
        if seen is not None and p.numInputRows:
            self.table.write(job=p.name, run=str(p.runId), phase="running", batch=p.batchId, done=seen["done"], failed=seen["failed"] or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.pop(str(event.runId), None)
        if name:
            self.table.write(job=name, run=str(event.runId), phase="failed" if event.exception else "ended", error=(event.exception or None) and str(event.exception)[:MOST])


def wait_for(table: StatusTable, job: str, seconds: float = 60.0) -> None:
    """Until the table says that a job is over: listeners hear of it a little later than whoever waits for the query."""
    end = time.time() + seconds
    while time.time() < end:
        if not table.rows().where((F.col("job") == job) & F.col("phase").isin("ended", "failed")).isEmpty():
            return
        time.sleep(0.2)
    raise TimeoutError(f"{job} hasn't ended")


def observed(df: DataFrame, table: StatusTable, job: str, write, error: str | None = None, total: int | None = None) -> None:
    """Runs write(df) with its rows counted on the way, done and failed, and tells the table; an error is told, too, before it goes on."""
    seen, run = Observation(job), uuid.uuid4().hex
    failed = F.count_if(F.col(error).isNotNull()) if error else F.count_if(F.lit(False))
    table.write(job=job, run=run, phase="started", total=total)
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("done"), failed.alias("failed")))
    except Exception as e:
        table.write(job=job, run=run, phase="failed", error=str(e)[:MOST])
        raise
    table.write(job=job, run=run, phase="ended", batch=0, done=seen.get["done"], failed=seen.get["failed"])
