"""Questions that are in flight, fetched pages, job status, batches with fallback, failures that are remembered, guarded clean-up."""

import json
import time
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaq.operators import passes
from vistaq.operators.deltas import DeltaIndex
from vistaq.sources import fetching
from vistaq.streaming import asked, jobs, status

EVENT = "pt string, at double, seq long, answer string"


def run_asked(spark, root, batches, **how):
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{root}/log")
        stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
        asked.start(stream().where("answer is null"), stream().where("answer is not null"), f"{root}/out", f"{root}/check", **how).awaitTermination(180)
    return sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").select("pt", "at", "what", F.coalesce("en", F.lit(""))).collect())


def test_one_request_until_it_is_answered(spark, tmp_path):
    first = [("inn", 1.0, 1, None), (" inn ", 2.0, 2, None), ("", 2.0, 3, None), (None, 2.0, 4, None), ("hill", 3.0, 5, None), ("nil", None, 6, None)]
    second = [("inn", 4.0, 7, " tavern "), ("inn", 5.0, 8, None), ("hill", 6.0, 9, "QUERY LENGTH LIMIT"), ("hill", 7.0, 10, None), ("hill", 65.9, 11, None), ("hill", 66.0, 12, None)]
    third = [("inn", 103.9, 13, None), ("inn", 104.0, 14, None), ("hill", 130.0, 15, None)]
    got = run_asked(spark, str(tmp_path), [first, second, third], patience=60.0, kept=100.0, late="1 hour")
    assert got == [
        ("hill", 3.0, "ask", ""), ("hill", 66.0, "ask", ""), ("hill", 130.0, "ask", ""),
        ("inn", 1.0, "ask", ""), ("inn", 4.0, "told", "tavern"), ("inn", 5.0, "known", "tavern"), ("inn", 103.9, "known", "tavern"), ("inn", 104.0, "ask", ""),
    ]
    # the session keeps its own choice of a state store
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_state_goes_once_nothing_can_need_it(spark, tmp_path):
    got = run_asked(spark, str(tmp_path), [[("a", 1.0, 1, None)], [("b", 5000.0, 2, None)], [("b", 9000.0, 3, None)], [("a", 9001.0, 4, None)]], patience=10.0, late="1 minute")
    assert [r[:3] for r in got] == [("a", 1.0, "ask"), ("a", 9001.0, "ask"), ("b", 5000.0, "ask"), ("b", 9000.0, "ask")]


class Answer:
    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self, n):
        return self.body[:n]


def test_tries():
    calls = []

    def flaky(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("reset")
        return Answer("é".encode())

    one = fetching.Address("s", 4, "u")
    row = fetching.fetched(one, wait=0, open_=flaky)
    assert row[:4] == ("s", 4, "u", "é") and row[5] is None and len(calls) == 3
    calls.clear()
    assert fetching.fetched(one, tries=2, wait=0, open_=flaky)[3:6:2] == (None, "reset") and len(calls) == 2

    def refused(url, timeout):
        calls.append(url)
        raise urllib.error.HTTPError(url, 404, "not here", {}, None)

    calls.clear()
    assert fetching.fetched(one, wait=0, open_=refused)[5] == "HTTP 404" and len(calls) == 1
    assert "bytes" in fetching.fetched(one, most=3, open_=lambda *_, **__: Answer(b"1234"))[5]


def test_pages_as_a_table_and_as_a_stream(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.html").write_text(f"page {i}")
    listed = fetching.addresses([(f"s{i}", f"file:{tmp_path}/{i}.html") for i in range(4)])
    fetching.register(spark)
    df = spark.read.format("fetched_pages").option("addresses", listed).option("wait", 0).load()
    assert df.rdd.getNumPartitions() == 4
    rows = sorted(df.collect(), key=lambda r: r.ord)
    assert [r.body for r in rows] == ["page 0", "page 1", "page 2", None] and [r.error is None for r in rows] == [True] * 3 + [False]
    assert {r.source for r in fetching.told(df).select("source").collect()} == {"s0", "s1", "s2"}
    none = spark.read.format("fetched_pages").option("addresses", json.dumps(json.loads(listed)[3:])).option("wait", 0).load()
    assert [r.source for r in fetching.told(none).collect()] == ["s3"] and fetching.told(none).columns == ["source", "error"]
    stream = spark.readStream.format("fetched_pages").option("addresses", listed).option("wait", 0).option("rounds", 2).load()
    for _ in range(2):  # the second time nothing is left to do
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start()
        q.processAllAvailable()
        q.stop()
        assert sorted((r.source, r.ord, r.body) for r in spark.read.parquet(f"{tmp_path}/out").where("error is null").collect()) == [(f"s{i}", 8 + i, f"page {i}") for i in range(3)]


def test_rounds_follow_the_clock():
    options = {"addresses": fetching.addresses([("a", "u"), ("b", "v")]), "every": "0.5"}
    one = fetching.FetchStream(options)
    first = one.latestOffset()["round"]
    assert one.initialOffset()["round"] in (first - 1, first)
    time.sleep(0.6)
    again = fetching.FetchStream(options)  # as after a restart
    later = again.latestOffset()["round"]
    assert later > first and [a.url for a in again.partitions({"round": first}, {"round": later})] == ["u", "v"] and again.partitions({"round": later}, {"round": later}) == []
    with pytest.raises(ValueError, match="some time"):
        fetching.FetchStream({**options, "every": "0"})


def test_status_of_streams_and_batches(spark, tmp_path):
    table = status.StatusTable(spark, f"{tmp_path}/status")
    docs = spark.range(30).withColumn("error", F.when(F.col("id") % 10 == 0, "bad"))
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    listener = status.StatusListener(table, total=30)
    spark.streams.addListener(listener)
    try:
        for name, broken in (("good", False), ("bad", True)):
            df = jobs.progress(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), name, "error")

            def step(batch, number, broken=broken):
                if broken and number:
                    raise OSError("no room")
                batch.write.format("noop").mode("overwrite").save()

            q = df.writeStream.queryName(name).foreachBatch(step).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
            try:
                q.awaitTermination(120)
            except Exception:  # noqa: BLE001
                assert broken
            status.wait_for(table, name)
    finally:
        spark.streams.removeListener(listener)
    rows = {r.job: r for r in table.jobs().collect()}
    assert (rows["good"].phase, rows["good"].done, rows["good"].failed, rows["good"].total, rows["good"].batches) == ("ended", 30, 3, 30, 3)
    assert rows["bad"].phase == "failed" and "no room" in rows["bad"].error and rows["bad"].done < 30
    status.observed(docs, table, "batch", lambda df: df.write.format("noop").mode("overwrite").save(), "error", total=30)
    assert [(r.phase, r.done, r.failed, r.total) for r in table.jobs().where("job = 'batch'").collect()] == [("ended", 30, 3, 30)]
    with pytest.raises(TimeoutError):
        status.wait_for(table, "never", 0.3)


def test_halves():
    for bad in ([], [3], [0, 999], list(range(5))):
        calls = []

        def encode(items, bad=bad, calls=calls):
            calls.append(len(items))
            if any(x in bad for x in items):
                raise MemoryError("too much")
            return np.array([[x] for x in items], np.float32)

        got = passes.halved(encode, list(range(1000)))
        assert [e is None for _, e in got] == [i not in bad for i in range(1000)] and all(v is None or v[0] == i for i, (v, _) in enumerate(got))
        if len(bad) == 1:
            assert len(calls) <= 22
    assert passes.halved(lambda items: np.zeros((0, 1)), [1])[0][1] == "0 vectors for 1 items"


def test_failures_are_remembered(spark):
    files = spark.createDataFrame([("a", 1.0, "x"), ("B", 1.0, "bad"), ("c", 1.0, None)], "p string, m double, v string")

    def encode(items):
        if "bad" in items:
            raise ValueError("bad one")
        return np.ones((len(items), 2))

    made = passes.encoded(files.withColumns({"vector": F.lit(1), "error": F.lit(2)}), encode, "v", batch=2)
    assert {r.p: (r.vector, r.error) for r in made.collect()} == {"a": ([1.0, 1.0], None), "B": (None, "bad one"), "c": (None, "nothing to encode")}
    one = passes.letters_after(None, made)
    two = passes.letters_after(one, passes.encoded(files, encode, "v"))
    tell = lambda df: sorted((r.path_norm, r.tries) for r in df.collect())
    assert tell(one) == [("b", 1), ("c", 1)] and tell(two) == [("b", 2), ("c", 2)]
    assert sorted(r.p for r in passes.worth_trying(files, two, 2).collect()) == ["a"] and passes.worth_trying(files, None).count() == 3
    changed = spark.createDataFrame([("b", 2.0, "fine"), ("C", 2.0, None)], "p string, m double, v string")  # other spellings, newer
    assert passes.worth_trying(changed, two, 2).count() == 2
    assert tell(passes.letters_after(two, passes.encoded(changed, encode, "v"))) == [("c", 1)]


def test_clean_up_waits_for_a_whole_pass(spark, tmp_path):
    from vistaq.functions.text import thumb_name

    index, manifest = DeltaIndex(spark, f"{tmp_path}/index"), passes.Manifest(spark, f"{tmp_path}/passes")
    files = spark.createDataFrame([(f"f{i}", 1.0) for i in range(20)], "p string, m double")
    thumbs = files.select(thumb_name(F.col("p")).alias("name")).unionByName(spark.createDataFrame([("old.webp",)], "name string"))
    left = lambda: passes.collectable(thumbs, index, manifest).count()
    assert left() == 0
    passes.whole_pass(index, manifest, files, lambda df: df)
    assert left() == 1
    calls = []

    def breaks(df):
        calls.append(1)
        if len(calls) > 1:
            raise InterruptedError("power cut")
        return df

    with pytest.raises(InterruptedError):
        passes.whole_pass(index, manifest, files.withColumn("m", F.lit(2.0)).where("p <> 'f1'"), breaks, blocks=3)
    assert left() == 0  # f1 has gone, but who knows what else would be there
    passes.whole_pass(index, manifest, files.where("p <> 'f1'"), lambda df: df)
    assert left() == 2
    index.append(spark.createDataFrame([("f2", 1.0, "gone")], "p string, m double, _op string"))
    assert left() == 0  # of a later version nothing is known


def test_state_is_switched_not_overwritten(spark, tmp_path):
    import os

    from vistaq.sources import state

    at = f"{tmp_path}/favs"
    rows = lambda *paths: spark.createDataFrame([("v", p) for p in paths], "kind string, p string")
    assert state.load_favourites(spark, at).count() == 0
    state.save_favourites(rows("a"), at)
    with pytest.raises(Exception, match="lost"):
        state.save_favourites(rows("b").withColumn("p", F.expr("raise_error('lost')")), at)
    assert [r.p for r in state.load_favourites(spark, at).collect()] == ["a"]
    before = state.load_favourites(spark, at)
    state.save_favourites(rows("b", "c"), at)
    assert [r.p for r in before.collect()] == ["a"]  # who reads the version before still can
    for p in "defg":
        state.save_favourites(rows(p), at)
    assert [r.p for r in state.load_favourites(spark, at).collect()] == ["g"]
    assert sum(os.path.exists(f"{at}/{d}/_SUCCESS") for d in os.listdir(at)) == 2
    now = f"{tmp_path}/catalogue"
    cat = spark.createDataFrame([("s", 1, 0, "t", "u", "", "c")], "source string, ord long, pos long, title string, url string, thumb string, cat string")
    assert state.save_catalogue(cat, now, 1000.0) and not state.save_catalogue(cat.limit(0), now, 2000.0)
    assert state.load_catalogue(spark, now, 1000.0 + 86_399).count() == 1 and state.load_catalogue(spark, now, 1000.0 + 86_400).isEmpty()
    (tmp_path / "memory.json").write_text('{"taverna ": "tavern", "noite": null, "": "x"}')
    (tmp_path / "bad.json").write_text("no object")
    assert [tuple(r) for r in state.read_memory_file(spark, f"{tmp_path}/*.json").collect()] == [("taverna", "tavern")]


def test_the_newest_answer_is_remembered(spark):
    from vistaq.functions import translate

    memory, asked_for = spark.createDataFrame([("old", "kept")], "pt string, en string"), spark.createDataFrame([("Ravenloft",)], "q string")
    answers = spark.createDataFrame([("x", "beta", 1.0), ("x", "alpha", 2.0), ("x", "MYMEMORY WARNING", 3.0), ("old", "other", 9.0), ("y", "b", None), ("y", "a", None)], "pt string, answer string, at double")
    got = {r.pt: r.en for r in translate.remember(memory, asked_for, answers).collect()}
    assert got == {"old": "kept", "x": "alpha", "y": "a"}
    assert {r.pt: r.en for r in translate.remember(memory, asked_for, answers.drop("at")).collect()} == {"old": "kept", "x": "alpha", "y": "a"}


def test_targets_as_a_column(spark):
    from vistaq.operators import search

    given = ["1", "0", "-3", "8", "9", "3", "x", "", None, "2.5"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "g string").select(search.targets(F.col("g"))).collect()]
    assert got == [60, 60, 60, 480, 480, 180, 60, 60, 60, got[-1]]
    assert got[:-1] == [search.target(g) for g in given[:-1]]


def test_releases(spark):
    from vistaq.sources import web

    rel = lambda tag, *names: json.dumps({"tag_name": tag, "assets": [{"name": n, "browser_download_url": f"u/{n}", "size": 5} for n in names], "body": "x" * 3000})
    rows = [rel("v1.10.0", "a.zip", "Setup.EXE", "b.exe"), rel("1.9", "a.exe"), rel("1.9.1-rc2", "a.exe"), rel("2", "a.zip"), rel("2.0.0.7", "a.exe"), "no json", None, "{}", '{"tag_name": "3"}', '{"tag_name": "3", "assets": [{"name": null}]}']
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "source string, ord int, body string")
    got = web.releases(df, "1.9.0").orderBy("ord").collect()
    assert [(r.ord, r.version, r.url, len(r.notes)) for r in got] == [(0, "v1.10.0", "u/Setup.EXE", 2000), (2, "1.9.1-rc2", "u/a.exe", 2000), (4, "2.0.0.7", "u/a.exe", 2000)]
