"""The delta index: what a batch writes, replays, crashes, folding, old versions, whole passes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vistaq.functions.text import norm_dir
from vistaq.operators.deltas import DeltaIndex
from vistaq.streaming import jobs


@pytest.fixture
def root(tmp_path):
    return f"{tmp_path}/index"


def listing(spark, rows):
    return spark.createDataFrame(rows, "p string, m double, gone boolean")


def make(df):
    return df.withColumn("vector", F.array(F.col("m"), F.lit(0.5)))


def rows(df):
    return sorted((r.p, r.m) for r in df.collect())


def test_spellings_and_deletions(spark, root):
    index = DeltaIndex(spark, root)
    assert index.read() is None and index.chain() == []
    index.apply(listing(spark, [("X:\\lib\\a.webp", 1.0, False), ("X:/LIB/a.webp", 2.0, None), ("X:\\lib\\b.webp", 1.0, False), ("gone", 5.0, True)]), make)
    assert rows(index.read()) == [("X:/LIB/a.webp", 2.0), ("X:\\lib\\b.webp", 1.0)]
    index.apply(listing(spark, [("x:\\LIB\\A.webp", 3.0, False), ("X:/lib/B.WEBP", 1.0, True), ("c", 1.0, False), ("c", 1.0, True)]), make)
    assert rows(index.read()) == [("x:\\LIB\\A.webp", 3.0)]
    assert index.read().first().vector == [3.0, 0.5]
    # the same time again is no change, a tombstone of what isn't there neither
    assert index.changed(listing(spark, [("x:/lib/a.webp", 3.0, False), ("c", 9.0, True)])).isEmpty()


def test_failed_rows_leave_the_index_and_come_again(spark, root):
    index, bad = DeltaIndex(spark, root), lambda df: make(df).withColumn("error", F.when(F.col("m") == 2, "unreadable"))
    index.apply(listing(spark, [("a", 1.0, False), ("b", 2.0, False)]), bad)
    assert rows(index.read()) == [("a", 1.0)] and "error" not in index.read().columns
    index.apply(listing(spark, [("a", 2.0, False)]), bad)
    assert rows(index.read()) == []
    assert rows(index.changed(listing(spark, [("a", 2.0, False), ("b", 2.0, False)]))) == [("a", 2.0), ("b", 2.0)]


def test_a_batch_writes_what_it_changes(spark, root):
    index = DeltaIndex(spark, root)
    wide = lambda df: df.withColumn("vector", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(3) * i))
    index.apply(spark.range(20_000).select(F.concat(F.lit("f"), "id").alias("p"), F.lit(1.0).alias("m")), wide)
    whole = index.size(index.chain()[0])
    index.apply(listing(spark, [(f"f{i}", 2.0, False) for i in range(20)]), wide)
    first, second = index.chain()
    assert index.size(second) < whole / 50 and first.low == 1 and index.read().count() == 20_000


def test_replays_and_crashes(spark, root):
    index = DeltaIndex(spark, root)
    assert index.apply(listing(spark, [("a", 1.0, False)]), make, "s.0")
    before = index.chain()
    assert not index.apply(listing(spark, [("a", 7.0, False)]), make, "s.0") and index.chain() == before

    def broken(df):
        return df.withColumn("x", F.expr("raise_error('lost')"))

    with pytest.raises(Exception, match="lost"):
        index.apply(listing(spark, [("b", 1.0, False)]), broken, "s.1")
    assert [d for d in os.listdir(root) if "s.1" in d] and index.chain() == before and rows(index.read()) == [("a", 1.0)]
    assert index.apply(listing(spark, [("b", 1.0, False)]), make, "s.1") and rows(index.read()) == [("a", 1.0), ("b", 1.0)]
    # two runs of one version, as of two attempts: the first counts
    one = index.chain()[-1]
    index._write(spark.read.parquet(one.path).withColumn("m", F.lit(9.0)), one.low, one.high, "other")
    assert rows(index.read()) == [("a", 1.0), ("b", 1.0)]


def test_folding_against_a_dictionary(spark, root):
    r, index, want, states = random.Random(4), DeltaIndex(spark, root), {}, []
    for k in range(14):
        some = [(f"d/{r.randrange(30)}", float(k), r.random() < 0.3) for _ in range(r.randint(1, 12))]
        last = {}
        for p, m, gone in some:
            last[p] = last.get(p, False) or gone  # of one time a deletion counts
        for p, gone in last.items():
            want.pop(p, None) if gone else want.update({p: float(k)})
        index.apply(listing(spark, some), make, f"b{k}")
        assert rows(index.read()) == sorted(want.items())
        states.append(dict(want))
        chain = index.chain()
        assert chain[0].low == 1 and chain[-1].high == k + 1 and all(a.high + 1 == b.low for a, b in zip(chain, chain[1:]))
    assert len(index.chain()) <= 5  # of 14 versions
    assert [rows(index.read(v)) for v in (3, 9, 14)] == [sorted(states[v - 1].items()) for v in (3, 9, 14)]
    assert index.vacuum(grace=3600) == 0
    os.mkdir(f"{root}/r0000000099-0000000099-broken-00000000")
    assert index.vacuum(keep=2, grace=-5) > 5 and not any("broken" in d for d in os.listdir(root))
    assert rows(index.read()) == sorted(want.items()) and rows(index.read(13)) == sorted(states[12].items())
    assert index.read(3) is None
    assert not index.apply(listing(spark, [("late", 1.0, False)]), make, "b0")  # known still
    base = index.fold(factor=1e9)
    assert base.low == 1 and spark.read.parquet(base.path).where("_op <> 'put'").isEmpty() and rows(index.read()) == sorted(want.items())


def test_a_pass_goes_on_where_it_broke_off(spark, root):
    index = DeltaIndex(spark, root)
    files = listing(spark, [(f"f{i}", 1.0, False) for i in range(40)]).drop("gone")
    made = spark.sparkContext.accumulator(0)

    def breaks(df):
        nonlocal made
        n = df.count()
        if made.value + n > 25:
            raise RuntimeError("power cut")
        made += n
        return make(df)

    with pytest.raises(RuntimeError, match="power"):
        index.refresh(files, breaks, blocks=4)
    kept = index.read().count()
    assert 0 < kept == made.value < 40
    seen = []

    def counted(df):
        seen.append(df.count())
        return make(df)

    index.refresh(files.where("p <> 'f3'"), counted, blocks=4)
    assert index.read().count() == 39 and sum(seen) <= 40 - kept
    index.refresh(files.where("p < 'f2'"), counted)
    assert rows(index.read()) == sorted((f"f{i}", 1.0) for i in range(40) if f"f{i}" < "f2")


def test_stream_goes_on_with_the_index(spark, tmp_path, root):
    at, schema = f"{tmp_path}/listed", "p string, m double, gone boolean"

    def run(checkpoint, rows_):
        listing(spark, rows_).coalesce(1).write.mode("append").parquet(at)
        jobs.index_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at), root, f"{tmp_path}/{checkpoint}", make).awaitTermination()
        return rows(DeltaIndex(spark, root).read())

    assert run("c", [("a", 1.0, False), ("b", 1.0, False)]) == [("a", 1.0), ("b", 1.0)]
    assert run("c", [("A", 2.0, False), ("b", 3.0, True)]) == [("A", 2.0)]
    # another checkpoint reads all again: what is older doesn't hide what is newer for good, as batches come in their order
    assert run("d", [("c", 1.0, False)]) == [("A", 2.0), ("c", 1.0)]
    assert DeltaIndex(spark, root).read().where(F.col("path_norm") != norm_dir(F.col("p"))).isEmpty()


def test_names_that_very_many_files_share(spark):
    from vistaq.operators import index

    r = random.Random(2)
    rows = [("d", "a", ".png", i) for i in range(300)] + [("d", f"b{r.randrange(9)}", ".png", 1000 + i) for i in range(60)] + [(None, "a", ".png", 5), (None, "a", ".png", 6)]
    r.shuffle(rows)
    got = index.clash_names(spark.createDataFrame(rows, "dir string, name string, ext string, k int").withColumn("_order", F.col("k")).drop("_order"), F.col("k")).collect()
    want, seen = set(), {}
    for d, n, e, k in sorted(rows, key=lambda x: x[3]):
        i = seen[d, n] = seen.get((d, n), -1) + 1
        want.add((d, n, e, k, n + (f"-{i}" if i else "") + e))
    assert {tuple(x) for x in got} == want and len(got) == len(rows)
