"""Where jobs of the library put what they write for themselves."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which the driver and all executors share; in local mode below a temporary one where that is unset."""
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vistaq-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/vistaq-{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package even when only the driver has it on its path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
