"""Questions of many queries in one bucket's state: as each query alone, and no more groups than buckets."""

import random

import pytest

from vistaq.streaming import asked

EVENT = "pt string, at double, seq long, answer string"


def run(spark, root, batches, **how):
    """What came out, and how many groups hold state after the last batch; a file a batch, all in one run."""
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{root}/log")
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    q = asked.start(stream().where("answer is null"), stream().where("answer is not null"), f"{root}/out", f"{root}/check", **how)
    q.awaitTermination(180)
    return sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").selectExpr("pt", "at", "what", "coalesce(en, '')").collect()), q.lastProgress.stateOperators[0].numRowsTotal


def alone(rows, patience, kept):
    """The same from one query's events in their order."""
    out, en, until = [], None, None
    for pt, at, _, answer in rows:
        if until is not None and at >= until:
            en = until = None
        if answer == "warm":
            en, until = answer, at + kept
            out.append((pt, at, "told", en))
        elif answer:
            until = until if en else at + patience
        elif en:
            out.append((pt, at, "known", en))
        elif until is None:
            until = at + patience
            out.append((pt, at, "ask", ""))
    return out


@pytest.mark.parametrize("buckets", [1, 5])
def test_queries_of_a_bucket_do_not_meet(spark, tmp_path, buckets):
    r, seq, batches = random.Random(5), iter(range(9_999)), []
    for third in range(3):
        times = sorted(third * 5_000 + r.randrange(4_900) + 0.25 for _ in range(500))
        batches.append([(f"q{r.randrange(40)}", at, next(seq), r.choice([None, None, "warm", "MYMEMORY WARNING: all used"])) for at in times])
    want = []
    for pt in {x[0] for b in batches for x in b}:
        want += alone([x for b in batches for x in b if x[0] == pt], 300.0, 900.0)
    for rows in batches:
        r.shuffle(rows)
    got, groups = run(spark, tmp_path, batches, patience=300.0, kept=900.0, late="2 hours", buckets=buckets)
    assert got == sorted(want) and len(got) > 500 and 0 < groups <= buckets


def test_what_is_older_than_the_watermark_of_its_own_batch(spark, tmp_path):
    # the second batch is still filtered by the first one's watermark: its row of 150 comes while the answer is kept
    batches = [[("a", 100.0, 1, "warm"), ("z", 1000.0, 2, None)], [("a", 150.0, 3, None), ("y", 5000.0, 4, None)], [("a", 6000.0, 5, None)]]
    got, _ = run(spark, tmp_path, batches, patience=10.0, kept=60.0, late="10 minutes", buckets=1)
    assert got == [("a", 100.0, "told", "warm"), ("a", 150.0, "known", "warm"), ("a", 6000.0, "ask", ""), ("y", 5000.0, "ask", ""), ("z", 1000.0, "ask", "")]


def test_state_of_a_bucket_is_freed(spark, tmp_path):
    # a's and b's are over with the last batch's watermark; z's isn't
    batches = [[("a", 1.0, 1, None), ("b", 2.0, 2, None)], [("z", 9000.0, 3, None)]]
    _, groups = run(spark, tmp_path, batches, patience=10.0, late="1 minute", buckets=64)
    assert groups == 1
