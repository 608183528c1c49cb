"""What the operators of this subpackage share: the working folder, skew-safe joins, checked broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts spell it.
SPACE = "\\x20\\x09-\\x0D"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package even when only the driver has it on its path."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors see. Only in local mode, where all are one process, a temporary one takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vistaq-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """Tables that an operator writes to the shared folder to cut lineage. Its owner closes it once the result is stored, which deletes them; result() leaves one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/vistaq-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _folder(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def close(self) -> None:
        at, fs = self._folder()
        fs.delete(at, True)

    def clear(self, *but: str) -> None:
        """Deletes all tables but those saved by the names given."""
        at, fs = self._folder()
        for one in fs.listStatus(at) if fs.exists(at) else ():
            if not any(re.fullmatch(rf"{re.escape(name)}-[0-9a-f]{{8}}", one.getPath().getName()) for name in but):
                fs.delete(one.getPath(), True)

    def result(self, df: DataFrame) -> DataFrame:
        """df stored as the one table that is left."""
        out = self.save(df, "result")
        self.clear("result")
        return out


def id_text(df: DataFrame, name: str = "doc_id"):
    """A column of whole numbers as text, for Python workers: pandas makes floats of numbers beside a null, which rounds those beyond 2^53. exact_ids turns it back."""
    return F.col(name).cast("long").cast("string").alias(name)


def exact_ids(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("long"))


def row_of(df: DataFrame):
    """All columns of df as one struct, named row: operators that hand rows on keep them there, apart from columns of their own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def orderable(df: DataFrame, row: str):
    """What the struct row of df's columns can be compared by: itself, or its JSON where a column has no order, as maps have none."""
    from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

    def has(t: DataType) -> bool:
        return isinstance(t, (MapType, VariantType)) or isinstance(t, ArrayType) and has(t.elementType) or isinstance(t, StructType) and any(has(f.dataType) for f in t)

    return F.to_json(row, {"ignoreNullFields": "false"}) if has(df.schema) else F.col(row)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("row").getField(c).alias(c) for c in columns))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, most_rows: int = 10_000) -> DataFrame:
    """Broadcasts df only if it is known to have no more than most_rows rows; else leaves the join to a shuffle. df should be cheap to read, as a saved table is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def hot_keys(counts: DataFrame, key: str, n: str, share: int = 256) -> list:
    """Values of key that hold more than a 1/share of all rows counted in n: fewer than share of them, whatever the input, so they can be told to all tasks."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > max(1, total // share)).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list, spread: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """Joins many left rows to one right row per key. Rows of hot keys (see hot_keys) are dealt to salts partitions by the column spread, and the right row is repeated for each."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    a = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    b = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "_salt"], how).drop("_salt")
