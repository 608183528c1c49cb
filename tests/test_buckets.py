"""Cached answers of many keys in one bucket's state: as each key alone."""

import random

from vistaq.streaming import jobs


def test_keys_of_a_bucket_do_not_meet(spark, tmp_path):
    r, rows = random.Random(3), []
    for third in range(3):
        part = sorted((float(third * 5_000 + r.randrange(4_900)), f"k{r.randrange(30)}") for _ in range(400))
        rows += part
        spark.createDataFrame([(k, at) for at, k in part], "key string, at double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    want, since = [], {}
    for at, k in rows:
        hit = k in since and at - since[k] < 300
        since[k] = since[k] if hit else at
        want.append((k, at, hit))
    log = spark.readStream.schema("key string, at double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    for buckets in (1, 7):
        at = f"{tmp_path}/out{buckets}"
        jobs.ttl_stream(log, 300.0, "10 minutes", buckets).writeStream.format("parquet").option("path", at).option("checkpointLocation", f"{at}-c").trigger(availableNow=True).start().awaitTermination()
        assert sorted(tuple(x) for x in spark.read.schema("key string, at double, hit boolean").parquet(at).collect()) == sorted(want)
