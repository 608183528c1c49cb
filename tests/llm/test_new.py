"""Personal data, importance resampling and fill-in-middle against brute force."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaq.llm import middle, private, queries, resampling
from vistaq.llm.common import Workspace

from .fixtures import as_set, awkward, frame

ODD = [(2**53 + 1, "one two three four " * 8, "en", "s", 1), (None, "five six seven " * 9, "en", "s", 1), (-(2**63) + 1, "<P> eight nine", "en", "s", 1), (2**63 - 1, "x\x01y \x02 z\x02d\x01e \x02\x02\n\n", "en", "s", 1)]


def rows_():
    return awkward(3) + ODD


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("new"))
    frame(spark, rows_(), True).write.parquet(f"{at}/documents.parquet")
    bench = [(i, r[1]) for i, r in enumerate(rows_()[::5])]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    empty = str(tmp_path_factory.mktemp("none"))
    frame(spark, []).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    return at, empty


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# ---- fill-in-middle


def brute_middle(doc_id, text, seed=42):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = sha(f"{seed}:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, p, m, s, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_op13(spark, tables):
    want = []
    for i, t, *_ in rows_():
        n, form, p, m, _, out = brute_middle(i, t)
        want.append((i, n, form, None if p is None else len(p), None if m is None else len(m), sha(out), sha(t or "")))
    got = queries.QUERIES["op13_fill_in_middle"](spark, tables[0])
    assert as_set(got) == sorted(want, key=repr) and {r[2] for r in want} == {"plain", "spm", "psm"}
    assert queries.QUERIES["op13_fill_in_middle"](spark, tables[1]).count() == 0


def test_middle_keeps_columns_and_parts(spark):
    docs = frame(spark, rows_(), True).withColumns({"fim": F.lit(1), "_t": F.lit(2), "_m": F.lit(3), "_n": F.lit(4)})
    got = middle.fill_in_middle(docs)
    assert got.columns == [*(c for c in docs.columns if c != "fim"), "fim"]
    want = [(r[0], r[1], *brute_middle(r[0], r[1])) for r in rows_()]
    assert as_set(got.select("doc_id", "text", "fim.*")) == sorted(want, key=repr)
    assert got.where("row <> 'row' or _n <> 4").isEmpty()


def test_other_rates_and_sentinels(spark):
    docs = frame(spark, rows_())
    all_ = middle.fill_in_middle(docs, rate=100, spm=0, sentinels=("[pre]", "[suf]", "[mid]"))
    assert {r[0] for r in all_.where("length(text) > 0").select("fim.form").collect()} == {"psm"}
    back = middle.restored(F.col("fim.output"), F.col("fim.form"), ("[pre]", "[suf]", "[mid]"))
    assert all_.where(back != F.coalesce("text", F.lit(""))).isEmpty()
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "d"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "d")):
        with pytest.raises(ValueError, match="mistaken"):
            middle.fill_in_middle(docs, sentinels=bad)


def test_middle_stays_in_the_jvm(spark, tables):
    plan = queries.QUERIES["op13_fill_in_middle"](spark, tables[0])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- importance resampling


def brute_features(text, run=2):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def brute_resampled(docs, bench):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    source, target = Counter(), Counter()
    made = [(i, *brute_features(t)) for i, t in docs]
    for _, _, f in made:
        source.update(map(bucket, f))
    for t in bench:
        target.update(map(bucket, brute_features(t)[1]))
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, n, f in made:
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(sha(f"7:{'null' if i is None else i}")[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {}
    for k, r in enumerate(order[: 25 * len(order) // 100]):
        drawn.setdefault((r[0], r[4]), []).append(k + 1)
    rows = []
    for i, n, f, w, s in out:
        ranks = drawn.get((i, s)) if n >= 20 else None
        rows.append((i, f, w, s, ranks.pop(0) if ranks else None))
    return rows


def test_op12(spark, tables):
    docs = [(r[0], r[1]) for r in rows_()]
    want = brute_resampled(docs, [t for _, t in docs[::5]])
    got = queries.QUERIES["op12_importance_resampling"](spark, tables[0])
    assert as_set(got) == sorted(want, key=repr) and sum(r[4] is not None for r in want) > 10
    assert dict(got.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert queries.QUERIES["op12_importance_resampling"](spark, tables[1]).count() == 0


def test_resampled_documents_keep_columns(spark, tables):
    docs = frame(spark, rows_(), True).withColumns({"dsir": F.lit(1), "_id": F.lit(2), "_uid": F.lit(3), "n_words": F.lit(4)})
    work = Workspace(spark, "test")
    got = resampling.resample(docs, spark.read.parquet(f"{tables[0]}/benchmark.parquet"), work, least=1, share=50)
    assert got.columns == [*(c for c in docs.columns if c != "dsir"), "dsir"] and got.where("_id <> 2 or _uid <> 3 or row <> 'row'").isEmpty()
    n = sum(brute_features(r[1])[0] > 0 for r in rows_())
    assert sorted(r[0] for r in got.select("dsir.rank").collect()) == list(range(1, n * 50 // 100 + 1))
    work.close()


def test_words_across_blocks(monkeypatch):
    r = np.random.default_rng(0)
    text = "".join(r.choice(list("abcXYZ09 -.éß漢\n"), 5000)) + " end"
    for block in (1, 3, 10, 1000):
        monkeypatch.setattr(resampling, "BLOCK", block)
        for run in (1, 2, 3):
            n, made = resampling.features(text, run, 997)
            words, want = brute_features(text, run)
            assert n == words and Counter(np.concatenate(made).tolist()) == Counter(zlib.crc32(f.encode()) % 997 for f in want)
    assert resampling.features(None)[0] == resampling.features(" .. ")[0] == 0


# ---- personal data


def brute_private(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


CASES = [
    "a@b.c_x@y.z", "a@b.c@d.e", "x.@.y@z.w..q", "me@host", "@a.b u@-.-", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.255.0255 1.2.3", "9.9.9.9.300.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111", "+1 (743) 555-3824, +49--30) 123456 +1 2 +1234567890123456", "+1 555.123.45.67.89 x", "é@b.c Ü.u@é.com 𝄞 q@w.er", "",
]


def test_base_spans():
    r = np.random.default_rng(5)
    random_ = ["".join(r.choice(list("a1.@+- (é_9"), r.integers(1, 60))) for _ in range(4000)]
    for text in CASES + random_ + [x[1] for x in rows_() if x[1]]:
        assert private.base_spans(text) == brute_private(text), repr(text)


def test_op11(spark, tables):
    finder, want = private.train(), []
    said = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in spans)
    for i, t, *_ in rows_():
        base = brute_private(t or "")
        want.append((i, *(sum(k == x for k, *_ in base) for x in private.BASE), sha(said(base)), said(finder.find(t))))
    got = queries.QUERIES["op11_private_data"](spark, tables[0])
    assert as_set(got) == sorted(want, key=repr)
    assert queries.QUERIES["op11_private_data"](spark, tables[1]).count() == 0


def test_trees_find_what_rules_miss_and_leave_the_rest():
    finder = private.train()
    kinds = lambda t: [(k, t[s:e]) for k, s, e, _ in finder.find(t)]
    assert kinds("please call (555) 234-7812 today") == [("likely_phone", "(555) 234-7812")]
    assert kinds("my ssn 219-09-9999, thanks") == [("likely_id", "219-09-9999")]
    assert kinds("konto DE89 3704 0044 0532 0130 00 bitte") == [("likely_id", "DE89 3704 0044 0532 0130 00")]
    assert kinds("device 3c:22:fb:9a:01:7e joined") == [("likely_ip", "3c:22:fb:9a:01:7e")]
    for clean in ("order 4111111111111112 of 2024-01-15", "isbn 978-3-16-148410-0", "it was 12:30:45 at home. The end", "version 10.2.33", "total 1,234,567.00", "row 1 2 3 4 5 6 7 8 9 10"):
        assert kinds(clean) == [], clean
    x, y, of, of_kind, spans = private.labelled(3000, 99)
    p, of_kind = finder.model.probability(x), np.array(of_kind)
    for kind in private.ADDED:
        told = (of_kind == kind) & (p >= finder.thresholds[kind]) & private._winners(p, of, spans)
        assert y[told].mean() > 0.95 and y[told].sum() >= 0.8 * y[of_kind == kind].sum(), kind
    # probabilities mean what they say
    for low in (0.0, 0.5):
        some = (p >= low) & (p < low + 0.5)
        assert abs(p[some].mean() - y[some].mean()) < 0.05


def test_spans_are_apart_and_base_ones_stay():
    finder, r = private.train(), np.random.default_rng(2)
    parts = [t for t, _ in private.examples(300, 5)] + CASES
    for _ in range(200):
        text = " ".join(r.choice(parts, 5))
        found, base = finder.find(text), private.base_spans(text)
        assert [x[:3] for x in found if x[0] in private.BASE] == base
        added = sorted((s, e) for k, s, e, _ in found if k in private.ADDED)
        assert all(a[1] <= b[0] for a, b in zip(added, added[1:])) and all(e <= x or y <= s for s, e in added for _, x, y in base)


def test_time_grows_with_the_text():
    finder = private.train()
    for unit in ("a.", "1.", "1", "1 ", "+1", "a@", "@", "a@b", "(at)", " at ", "1-", ":1", "AA11", "+1 (", "a ", "A1 "):
        start = time.time()
        finder.find(unit * (200_000 // len(unit)))
        assert time.time() - start < 8, unit


def test_redacted(spark):
    finder = private.train()
    texts = ["mail a@b.com or +1 (743) 555-3824.", "none", None, "", "é 10.0.0.1é", "a@1.2.3.4 x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit("own"))
    got = [r.text for r in private.redact(private.find_private(docs, finder)).orderBy("doc_id").collect()]
    assert got == ["mail [email] or [phone].", "none", None, "", "é [ip]é", "[email] x"]


# ---- what earlier operators do with ids beyond 2^53 beside a null, and with odd runs


BIG = [2**53 + 1, None, -(2**63) + 1, 2**63 - 1, 2**53 + 3, 7]


def big_rows(with_null=True):
    base = "one two three four five six seven eight nine ten eleven twelve " * 8
    texts = {2**53 + 1: base + "end one", None: base + "end two", -(2**63) + 1: "alone here", 2**63 - 1: base + "end three", 2**53 + 3: None, 7: "token=abcdef12 a@b.com"}
    return [(i, texts[i], "en", "s", 1) for i in BIG if with_null or i is not None]


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("big"))
    frame(spark, big_rows()).coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, "one two three")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(2**53 + 1, 1, 0), (7, 0, 0), (2**63 - 1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n.split("_")[0] not in ("op7", "op8")))
def test_ids_come_back_exactly(spark, big, name):
    got = queries.QUERIES[name](spark, big)
    if "piece" in got.columns:
        got = got.where("piece = 0")
    assert sorted((r[0] for r in got.select("doc_id").collect()), key=repr) == sorted(BIG, key=repr)


def test_near_copies_are_found_with_and_without_a_null_id(spark):
    from vistaq.llm import near_dedup

    for with_null in (True, False):
        work = Workspace(spark, "near")
        got = near_dedup.drop_near_duplicates(frame(spark, big_rows(with_null)).coalesce(1), work)
        assert sorted(r[0] for r in got.select("doc_id").collect()) == [-(2**63) + 1, 7, 2**53 + 1, 2**53 + 3]
        work.close()


def test_pipeline_keeps_ids(spark, big):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, big).collect()
    assert rows and {r.doc_id for r in rows} <= set(BIG)


def test_string_ids_that_join_alike_are_two_documents(spark):
    from vistaq.llm import line_dedup

    rows = [("a", "b:x\nlost"), ("a:b", "x\nlost"), (None, "q"), ("null", "q"), ("null", "q")]
    work = Workspace(spark, "lines")
    got = line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id string, text string"), work, min_docs=2)
    assert as_set(got.select("doc_id", "kept_text")) == sorted([("a", "b:x"), ("a:b", "x"), (None, ""), ("null", ""), ("null", "")], key=repr)
    work.close()


def test_endpoints_in_linear_time():
    from vistaq.llm import secrets

    old = re.compile(r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:amazonaws\.com|azure\.com|googleapis\.com|internal)\b", re.I | re.A)
    r = np.random.default_rng(3)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "-", ".", ".internal", ".azure.com", "_", " ", "b1", "é", "..", ".internalx"], r.integers(1, 9)))
        assert secrets.endpoints(text) == [m.span() for m in old.finditer(text)], repr(text)
    for unit in ("a-", "1.", "a.b-", ".internal", "a.internal ", "host ", "jdbc:a"):
        start = time.time()
        secrets.find("token=abcdef12 " + unit * (500_000 // len(unit)))
        assert time.time() - start < 4, unit
