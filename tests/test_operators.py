"""Search, masks, index, actions, sources, evaluation and streams on small literal tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaq.operators import actions, evaluation, index, masks, search
from vistaq.operators.deltas import DeltaIndex
from vistaq.sources import state, web
from vistaq.streaming import jobs

ITEMS = "idx long, p string, k string, emb array<double>, nemb array<double>"


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (0, "X:\\lib\\en\\Tavern\\RedTavern_Day.webp", "i", [1.0, 0.0], [1.0, 0.0]), (1, "X:\\lib\\en\\Tavern\\RedTavern_Night.webp", "i", [0.9, 0.1], [1.0, 0.0]),
        (2, "X:\\lib\\fr\\maps\\RedTavern_Grid.webm", "v", [0.8, 0.2], [0.0, 1.0]), (3, "X:\\lib\\fr\\maps\\BlueCave_Day.webp", None, [0.7, 0.7], [0.0, 1.0]),
        (4, "X:\\lib\\de\\sprites\\Chair01.png", "i", [1.0, 0.0], None), (5, "X:\\LIB\\EN\\x\\OldMill_Day.webp", "i", [0.0, 1.0], [0.5, 0.5]),
    ]
    return spark.createDataFrame(rows, ITEMS)


@pytest.fixture(scope="module")
def folders(spark):
    rows = [(1, "X:/lib/en/", "scenes"), (2, "X:\\lib\\fr\\maps", "maps"), (3, "X:\\lib\\fr", "maps"), (4, "X:\\lib\\de", "assets"), (5, "X:\\li", "scenes")]
    return spark.createDataFrame(rows, "ord int, path string, category string")


def ids(df):
    return sorted(r.idx for r in df.collect())


def test_masks(spark, items, folders):
    off = spark.createDataFrame([("x:/LIB/fr",)], "path string")
    assert ids(masks.visible(items, off)) == [0, 1, 4, 5] and ids(masks.visible(items, off.limit(0))) == [0, 1, 2, 3, 4, 5]
    assert ids(masks.in_category(items, folders, "maps")) == [2, 3] and ids(masks.in_category(items, folders, "none")) == []
    assert ids(masks.keep(items, masks.animated(), None)) == [2] and ids(masks.keep(items, None)) == [0, 1, 2, 3, 4, 5]
    favs = spark.createDataFrame([("x:/lib/en/tavern/redtavern_day.WEBP",), ("gone",)], "p string")
    assert ids(masks.favourites(items, favs)) == [0]
    assert ids(masks.scenes_with_maps(items, folders)) == [0, 1, 2]
    first = {r.path: r.n for r in masks.folder_counts(items, folders).collect()}
    every = {r.path: r.n for r in masks.folder_counts(items, folders, first=False).collect()}
    assert first == {"X:/lib/en/": 3, "X:\\lib\\fr\\maps": 2, "X:\\lib\\fr": 0, "X:\\lib\\de": 1, "X:\\li": 0} and every["X:\\lib\\fr"] == 2
    assert masks.merge_defaults({"top_k": 5, "port": 1, "odd": 2}, {"top_k": 60, "port": 8060}) == {"top_k": 5, "port": 8060}


def test_scores(items):
    got = {r.idx: r.score for r in search.score_items(items, [1.0, 0.0], "red tavern").collect()}
    assert got[0] == pytest.approx(1 + 0.5 + 0.25) and got[3] == pytest.approx(0.7) and got[4] == pytest.approx(1.0)
    sounds = items.select("idx", "p", F.coalesce("nemb", "emb").alias("nemb"), F.when(F.col("idx") != 0, F.col("emb")).alias("cemb"))
    got = {r.idx: r.score for r in search.score_sounds(sounds, [1.0, 0.0], [0.0, 1.0], "red cave").collect()}
    assert got[0] == pytest.approx(1 + 0.35 / 2) and got[3] == pytest.approx(0.35 / 2 + 0.6 * 0.7)
    fused = {r.idx: r.score for r in search.fused(items).where("nemb is not null").select("idx", (F.get("fused", F.lit(0))).alias("score")).collect()}
    assert fused[0] == pytest.approx(1.5)


def test_collapse(spark, items):
    scored = search.score_items(items, [1.0, 0.0], None)
    cards = search.collapse(search.top_k(scored, 6), 10).collect()
    assert [(c.map_key, c.idx, c.n_variants) for c in cards] == [("red tavern", 0, 2), ("sprites|chair01", 4, 0), ("blue cave", 3, 0), ("old mill", 5, 0)]
    assert [v.idx for v in cards[0].variants] == [1, 2]
    many = spark.range(60).select(F.col("id").alias("idx"), F.concat(F.lit("a/RedTavern_"), F.col("id"), F.lit(".png")).alias("p"), (-F.col("id")).cast("double").alias("score"))
    head = search.collapse(many, 5, F.lit("one")).first()
    assert head.idx == 0 and head.n_variants == 40 and head.variants[-1].idx == 40
    # ties go by idx
    tied = many.withColumn("score", F.lit(1.0))
    assert [r.idx for r in search.top_k(tied, 3).collect()] == [0, 1, 2]


def test_similar_and_variants(items):
    got = search.similar(items, 0, pieces=items.where("idx = 4").select("idx")).collect()
    assert [c.idx for c in got] == [3, 5]
    assert search.similar(items, 99).count() == 0
    assert [r.idx for r in search.variants_of(items, 2).collect()] == [0, 1, 2]
    assert search.target("3") == 180 and search.target("99") == 480 and search.target("x") == search.target(None) == 60 and search.target(-2) == 60
    card = search.cards(search.score_items(items, [1.0, 0.0]), items.where("idx = 0"), "X:\\lib").where("idx = 0").first()
    assert (card.relative, card.name, card.dir, card.fav, card.score) == ("en/Tavern/RedTavern_Day.webp", "RedTavern_Day", "en/Tavern", True, 1.5)


def test_index(spark, tmp_path):
    new = spark.createDataFrame([("A/x.png", 1.0), ("a/y.png", 2.0), ("a/z.png", 3.0)], "p string, m double")
    old = spark.createDataFrame([("a\\X.PNG", 1.0 + 1e-9), ("a/y.png", 2.5), ("a/gone.png", 1.0)], "p string, m double")
    changes = index.diff(new, old)
    assert {r.path_norm: r.status for r in changes.collect()} == {"a\\x.png": "kept", "a\\y.png": "changed", "a\\z.png": "added", "a\\gone.png": "deleted"}
    assert tuple(index.counts(changes).first()) == (3, 1, 2, 2, 1, 1)
    again = index.diff(new, new)
    assert index.counts(again).first().added == 0 and index.counts(again).first().kept == 3
    no_thumbs = index.diff(new, new, spark.createDataFrame([], "name string"))
    assert index.counts(no_thumbs).first().kept == 0
    made = spark.createDataFrame([("a", None), ("b", "bad")], "p string, error string")
    assert [r.p for r in index.merge(spark.createDataFrame([("k",)], "p string"), made).orderBy("p").collect()] == ["a", "k"]
    root = str(tmp_path / "index")
    assert index.latest_snapshot(spark, root) is None
    index.save_snapshot(new, root, 1)
    index.save_snapshot(old.limit(1), root, 2)
    assert index.latest_snapshot(spark, root).count() == 1


def test_what_one_folder_refuses_another_may_take(spark):
    files = spark.createDataFrame([
        ("L/a/big.png", 90_000, 2000), ("L/a/small.png", 90_000, 500), ("L/a/tiny.png", 10, 2000), ("L/a/Tokens/t.png", 90_000, 2000), ("L/a/m-thumb.png", 90_000, 2000),
        ("L/a/v.webm", 5, None), ("L/a/x.txt", 90_000, 2000), ("L/a/skip/q.png", 90_000, 2000), ("L/b/u.png", 90_000, None), ("Tokens/a.png", 1, 1),
    ], "p string, size long, side int")
    dirs = spark.createDataFrame([(1, "L/a", 1024, 60, ["Skip"], False), (2, "L", 256, 0, [], False), (3, "Tokens", 0, 0, [], True)], "ord int, path string, min_side int, min_kb int, ignored array<string>, everything boolean")
    from vistaq.functions.text import IMAGES, VIDEOS

    got = {r.p: r.folder for r in index.admitted(files, dirs, IMAGES, VIDEOS).collect()}
    assert got == {"L/a/big.png": "L/a", "L/a/small.png": "L", "L/a/tiny.png": "L", "L/a/v.webm": "L/a", "L/a/skip/q.png": "L", "L/b/u.png": "L", "Tokens/a.png": "Tokens"}
    a = index.criterion(dirs).first()[0]
    assert a == index.criterion(dirs.orderBy(F.desc("ord"))).first()[0] != index.criterion(dirs.withColumn("min_kb", F.lit(1))).first()[0]


def test_index_helpers(spark):
    files = spark.createDataFrame([("d", "n", ".png", 1), ("d", "n", ".png", 2), ("d", "n", ".jpg", 3), ("e", "n", ".png", 4)], "dir string, name string, ext string, o int")
    assert [r.file for r in index.clash_names(files, F.col("o")).orderBy("o").collect()] == ["n.png", "n-1.png", "n.jpg", "n.png"]
    n = spark.range(103).select(F.format_string("%04d", "id").alias("p"))
    assert sorted(int(r.p) for r in index.strided(n, 10).collect()) == list(range(0, 100, 10))
    assert index.strided(n.limit(3), 10).count() == 3 and index.strided(n.limit(0), 10).count() == 0


@pytest.mark.parametrize("parts", [4, 8])
def test_even_steps_of_a_large_listing(spark, parts):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(400_000).select(((F.col("id") * 7919) % 400_003).alias("id"), F.md5(F.col("id").cast("string")).alias("p"))
        want = [r.id for r in rows.orderBy("p").collect()][:: 400_000 // 50][:50]
        for _ in range(2):
            assert {r.id for r in index.strided(rows, 50, "p").collect()} == set(want)
        numbers = index.strided(rows, 50, "id").select("id")
        assert sorted(r.id for r in numbers.collect()) == sorted(r.id for r in rows.select("id").collect())[:: 400_000 // 50][:50]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_scans(spark):
    files = spark.createDataFrame([("L/a/x.png", 5.0, 90_000, None), ("L/a/y.png", 5.0, 90_000, 500), ("l\\A\\Z.png", 6.0, 90_000, 500), ("L/a/w.png", 5.0, 10, None)], "p string, m double, size long, side int")
    config = spark.createDataFrame([(1, "L", None, None, None, None, None, None)], "ord int, path string, min_side int, min_kb int, ignored array<string>, everything boolean, kind string, category string")
    known = spark.createDataFrame([("l/a/Y.png", 5.0), ("L/a/z.png", 5.0), ("L/a/w.png", 5.0)], "p string, m double")
    assert sorted(r.p for r in index.scan(files, config).collect()) == ["L/a/x.png"]
    assert sorted(r.p for r in index.scan(files, config, known).collect()) == ["L/a/x.png", "L/a/y.png"]
    sounds = spark.createDataFrame([("S/a.MP3",), ("s\\A.mp3",), ("S/__MACOSX/b.ogg",), ("S/thumbs/c.wav",), ("T/d.mp3",)], "p string")
    got = index.scan_sounds(sounds, spark.createDataFrame([(1, "S"), (2, "S/thumbs")], "ord int, path string")).collect()
    assert sorted(r.p.lower().replace("\\", "/") for r in got) == ["s/a.mp3", "s/thumbs/c.wav"] and {r.folder for r in got} == {"S"}


def test_snapshots_that_do_not_fit(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0], [1.0]), ("b", [1.0, 2.0], [1.0, 3.0])], "p string, emb array<double>, nemb array<double>")
    assert index.usable_snapshot(None, 2) is None and index.usable_snapshot(rows, 3) is None
    assert index.usable_snapshot(rows.union(spark.createDataFrame([("c", None, None)], rows.schema)), 2) is None
    assert {r.p: r.nemb for r in index.usable_snapshot(rows, 2).collect()} == {"a": None, "b": [1.0, 3.0]}


def test_many_queries(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(60, 5)).round(1)
    rows = spark.createDataFrame([(i, x.tolist(), 0.1 * (i % 3)) for i, x in enumerate(v)] + [(99, None, 0.0)], "idx long, vector array<double>, bonus double").repartition(5)
    asked = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 60, 7)], "query long, vector array<double>")
    for block in (1024, 2):
        got = search.top_k_each(rows, asked, 4, "bonus", block).collect()
        for i in range(0, 60, 7):
            score = v @ v[i] + 0.1 * (np.arange(60) % 3)
            want = sorted((k for k in range(60) if k != i), key=lambda k: (-round(score[k], 9), k))[:4]
            assert [x.idx for x in sorted((x for x in got if x.query == i), key=lambda x: (-round(x.score, 9), x.idx))] == want
    # ids beyond 2^53 come back as they are; what has no id has no part
    big = spark.createDataFrame([(2**53 + 1, [1.0]), (None, [9.0]), (-(2**63) + 1, [2.0]), (2**63 - 1, [3.0])], "idx long, vector array<double>").coalesce(1)
    found = search.top_k_each(big, big.withColumnRenamed("idx", "query"), 2).collect()
    assert sorted((x.query, x.idx) for x in found) == sorted((a, b) for a in (2**53 + 1, -(2**63) + 1, 2**63 - 1) for b in (2**53 + 1, -(2**63) + 1, 2**63 - 1) if a != b)
    hits = actions.ttl_hits(spark.createDataFrame([("a", 1.0, 2**53 + 1), ("a", 2.0, None), ("b", 1.0, 2**63 - 1)], "key string, at double, seq long").coalesce(1))
    assert sorted(((r.key, r.seq, r.hit) for r in hits.collect()), key=repr) == sorted([("a", 2**53 + 1, False), ("a", None, True), ("b", 2**63 - 1, False)], key=repr)
    assert search.top_k_each(rows, asked.limit(0), 4).count() == 0 and search.top_k_each(rows.limit(0), asked, 4).count() == 0


def test_pairs_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], i % 3) for i in range(30)], "idx long, vector array<double>, label int")
    asked = rows.where("idx % 5 = 0").withColumnRenamed("idx", "query")
    one, many = evaluation.scored_pairs(rows, asked), evaluation.scored_pairs(rows, asked, 2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 6 * 29
    assert evaluation.scored_pairs(rows, asked.limit(0)).count() == 0
    # ranks without pairs, and with many ties; labels that are null are nobody's
    tied = spark.createDataFrame([(i, [float(i // 4), 1.0], None if i % 7 == 0 else i % 5) for i in range(40)], "idx long, vector array<double>, label int").repartition(6)
    some = tied.where("idx % 3 = 0").withColumnRenamed("idx", "query")
    want = sorted(map(tuple, evaluation.first_ranks(evaluation.scored_pairs(tied, some), 20).collect()))
    assert [sorted(map(tuple, evaluation.query_ranks(tied, some, 20, b).collect())) for b in (1024, 3)] == [want, want] and len(want) > 8
    plan = lambda n: len(evaluation.scored_pairs(tied, some, n)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(1) - plan(2)) < 50


def test_actions(spark):
    log = spark.createDataFrame([("a", True, 1.0, 1), ("a", False, 2.0, 2), ("b", True, 2.0, 3), ("b", False, 2.0, 1), ("c", True, 5.0, 9)], "item string, on boolean, ts double, seq int")
    assert sorted(r.item for r in actions.last_wins(log).collect()) == ["b", "c"]
    assert [r.item for r in actions.recents(log, 2).collect()] == ["c", "a"]
    assert sorted(r.item for r in actions.toggled(log).collect()) == ["c"]
    asked = spark.createDataFrame([("q", t, i) for i, t in enumerate((0.0, 200.0, 299.9, 300.0, 301.0, 650.0))] + [("r", 250.0, 9)], "key string, at double, seq int")
    got = {(r.key, r.at): r.hit for r in actions.ttl_hits(asked).collect()}
    assert [got["q", t] for t in (0.0, 200.0, 299.9, 300.0, 301.0, 650.0)] == [False, True, True, False, True, False] and not got["r", 250.0]
    assert actions.ttl_hits(asked.limit(0)).count() == 0
    snap = spark.createDataFrame([(2, 100.0), (1, 100.0), (2, -90_000.0)], "version int, fetched_at double")
    assert actions.fresh(snap, 200.0).count() == 1


def test_sources(spark):
    atom = '<feed><entry><title>A &amp; B</title><link href="http://r/1"/><media:thumbnail url="http://t/1"/></entry><entry><title>no link</title></entry><entry><title>C</title><link rel="x" href="http://r/2"/></entry></feed>'
    got = web.feed_entries(spark.createDataFrame([("maps", 0, atom), ("bad", 1, "<html>"), ("none", 2, None)], "source string, ord int, body string")).collect()
    assert [(r.title, r.url, r.thumb) for r in got] == [("A & B", "http://r/1", "http://t/1"), ("C", "http://r/2", "")]
    body = '[{"id":"1","title":"t","service":"s","user":"u","file":{"path":"/a.zip"},"attachments":[{"path":"/b.txt"},{"path":"/c.PNG"}]},{"id":"2","title":"x","service":"s","user":"u","file":{"path":"/d.jpg"},"attachments":[]},{"id":"3","title":"y","file":{},"attachments":[]}]'
    got = web.posts(spark.createDataFrame([("k", 0, body), ("k", 1, "broken")], "source string, ord int, body string"), "http://k").collect()
    assert [(r.url, r.thumb) for r in got] == [("http://k/s/user/u/post/1", "/c.PNG"), ("http://k/s/user/u/post/2", "/d.jpg")]
    html = '<a href="/fantasy/old-inn">x</a> <img src="http://i/1"> <a href="/fantasy/red-cave">y</a><a href="/fantasy/old-inn">z</a><img src="http://i/2">'
    rows = web.catalogue(spark.createDataFrame([("c", 0, html)], "source string, ord int, html string"), r'href="/(fantasy|scifi)/([a-z0-9-]+)"', r'src="([^"]+)"', "http://c")
    assert [(r.title, r.url, r.thumb) for r in rows.orderBy("pos").collect()] == [("Old Inn", "http://c/fantasy/old-inn", "http://i/1"), ("Red Cave", "http://c/fantasy/red-cave", "http://i/2"), ("Old Inn", "http://c/fantasy/old-inn", "http://i/2")]
    unique = web.first_by_url(rows)
    assert {(r.url, r.thumb) for r in unique.collect()} == {("http://c/fantasy/old-inn", "http://i/1"), ("http://c/fantasy/red-cave", "http://i/2")}
    assert [r.title for r in web.rank_titles(unique, "the red inn cave").collect()] == ["Red Cave", "Old Inn"] and web.rank_titles(unique, "inn", cat="scifi").count() == 0


def test_measures(spark):
    rows = [("a", 1, 0.9, False), ("a", 2, 0.8, True), ("a", 3, 0.8, True), ("b", 1, 0.5, True), ("c", 1, 0.5, False)]
    got = evaluation.measures(spark.createDataFrame(rows, "query string, idx int, score double, relevant boolean")).first()
    assert (got.queries, got.mrr, got.recall, got.hit1, got.hit5) == (2, 0.75, 1.0, 0.5, 1.0)
    late = evaluation.measures(spark.createDataFrame(rows, "query string, idx int, score double, relevant boolean"), within=1).first()
    assert late.mrr == 0.5


def test_streams(spark, tmp_path):
    log = [("a", 1.0, "view", True, 1), ("b", 2.0, "view", True, 2), ("a", 3.0, "view", False, 3)]
    schema = "item string, ts double, kind string, on boolean, seq int"
    for i, row in enumerate(log):
        spark.createDataFrame([row], schema).write.parquet(str(tmp_path / "log" / f"part={i}"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log" / "*"))
    for name, df, want in (("rec", jobs.stream_recents(stream()), {("a", 3.0), ("b", 2.0)}), ("fav", jobs.stream_favourites(stream()), {("a", False), ("b", True)})):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert {tuple(r) for r in spark.table(name).collect()} == want


def test_a_batch_that_runs_again_keeps_what_is_committed(spark, tmp_path):
    import shutil

    root, data, check = str(tmp_path / "index"), str(tmp_path / "files"), tmp_path / "check"
    make = lambda df: df.withColumns({"vec": F.col("m") * 2, "error": F.when(F.col("p") == "bad", "unreadable")})
    files = lambda: spark.readStream.schema("p string, m double").parquet(data)
    seen = []
    for rows in ([("a", 1.0), ("bad", 1.0)], [("a", 2.0), ("c", 1.0)]):
        spark.createDataFrame(rows, "p string, m double").write.mode("append").parquet(data)
        jobs.index_stream(files(), root, str(check), make).awaitTermination(120)
        seen.append({tuple(r) for r in DeltaIndex(spark, root).read().select("p", "m", "vec").collect()})
    assert seen == [{("a", 1.0, 2.0)}, {("a", 2.0, 4.0), ("c", 1.0, 2.0)}]
    for batch in (1, 0):  # the batch wrote its version, but its commit was lost
        for n in range(batch, 2):
            (check / "commits" / str(n)).unlink(missing_ok=True)
            (check / "commits" / f".{n}.crc").unlink(missing_ok=True)
        jobs.index_stream(files(), root, str(check), make).awaitTermination(120)
        assert {tuple(r) for r in DeltaIndex(spark, root).read().select("p", "m", "vec").collect()} == seen[1]
    assert {tuple(r) for r in DeltaIndex(spark, root).read(1).select("p", "m", "vec").collect()} == seen[0]
    shutil.rmtree(root)
    assert DeltaIndex(spark, root).read() is None


def test_index_stream_is_idempotent(spark, tmp_path):
    root, data = str(tmp_path / "index"), str(tmp_path / "files")
    make = lambda df: df.withColumn("vec", F.col("m") * 2)
    files = lambda: spark.readStream.schema("p string, m double").parquet(data)
    for rows in ([("a", 1.0), ("b", 1.0)], [("b", 2.0), ("c", 1.0)], [("a", 1.0)]):
        spark.createDataFrame(rows, "p string, m double").write.mode("append").parquet(data)
        jobs.index_stream(files(), root, str(tmp_path / "check"), make).awaitTermination(120)
    assert {tuple(r) for r in DeltaIndex(spark, root).read().select("p", "m", "vec").collect()} == {("a", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 1.0, 2.0)}


def test_ttl_stream(spark, tmp_path):
    for i, at in enumerate((0.0, 100.0, 400.0)):
        spark.createDataFrame([("k", at)], "key string, at double").write.parquet(str(tmp_path / "in" / f"b={i}"))
    rows = spark.readStream.schema("key string, at double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = jobs.ttl_stream(rows).writeStream.outputMode("append").format("memory").queryName("ttl").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["at"], r.hit) for r in spark.table("ttl").collect()} == {(0.0, False), (100.0, True), (400.0, False)}


def test_state_of_old_answers_leaves(spark, tmp_path):
    batches = [[(f"k{i}", float(i)) for i in range(20)], [("late", 2000.0)], [("late", 4000.0)], [("k3", 4001.0), ("late", 4001.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, at double").write.parquet(str(tmp_path / "in" / f"b={i}"))
        time.sleep(0.01)
    rows = spark.readStream.schema("key string, at double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = jobs.ttl_stream(rows.coalesce(1), 300.0, "1 second").writeStream.outputMode("append").format("memory").queryName("left").start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    got = {(r.key, r["at"]): r.hit for r in spark.table("left").collect()}
    assert left <= 2 and got["k3", 4001.0] is False and got["late", 4001.0] is True and got["late", 4000.0] is False


def test_progress(spark):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([("a", None), ("b", "bad")], "p string, error string")
    assert jobs.progress(rows, "index", "error").count() == 2 and jobs.progress(rows, "plain").count() == 2
    seen = Observation("seen")
    assert rows.observe(seen, F.count(F.lit(1)).alias("done")).count() == 2 and seen.get["done"] == 2


def test_stored_state(spark, tmp_path):
    at = str(tmp_path / "favs")
    state.save_favourites(spark.createDataFrame([("v", "B/x"), ("v", "b\\X"), ("a", "c")], "kind string, p string"), at)
    assert [tuple(r) for r in state.load_favourites(spark, at).orderBy("kind").collect()] == [("a", "c"), ("v", "b\\x")]
    state.save_recents(spark.createDataFrame([(f"p{i:03d}", 0, float(i)) for i in range(150)], "p string, a int, ts double"), str(tmp_path / "rec"))
    assert sorted(r.ts for r in state.load_recents(spark, str(tmp_path / "rec")).collect()) == [float(i) for i in range(50, 150)]
