"""Column functions against plain restatements and fixed cases."""

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaq.functions import audio, images, text, translate, vectors


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def plain_tokens(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", s)
    return [w for w in re.split(r"[^a-z0-9]+", s.lower()) if len(w) > 2]


TEXTS = ["WildWestSaloon_NoSkull_Day", "Prisão ÉTÉ naïve", "a bc def", "", "x" * 5000, "HTMLParser2Go", "e\u0301tude Zo\u0308e", "ØsterÅ straße łódź", "çãõ-ÇÃÕ_123", "Việt Nam ﬁnance ｆｕｌｌ", "½ cup №12 ⑩ Ⅷ ǆ ㎏", "𝐁𝐨𝐥𝐝 𝒮𝒸𝓇𝒾𝓅𝓉", "й ё ά ώ", "q\u0323\u0307 \u1e9b\u0323", "हिन्दी", "a\u0488b x² — “q” … end"]


def test_tokens(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "x string").select("x", text.tokens(F.col("x")).alias("t"), text.fold_exactly(F.col("x")).alias("f")).collect()
    for r in rows:
        assert r.t == plain_tokens(r.x)
        assert r.f == "".join(c for c in unicodedata.normalize("NFKD", r.x) if not unicodedata.combining(c))
    assert one(spark, text.tokens) is None


@pytest.mark.parametrize(("path", "key"), [
    ("X:\\lib\\a\\WildWestSaloon_NoSkull_Day.webp", "wild west saloon"), ("X:/lib/Tavern/Variants/map_01_Night.webp", "tavern|map"),
    ("X:/lib/Tavern/Day.webp", "tavern|"), ("X:/lib/Tavern/RedTavern.Day.webp", "red tavern"), ("lone.webp", "|lone"),
])
def test_map_key(spark, path, key):
    assert one(spark, text.map_key, path) == key


def test_paths(spark):
    p = "X:\\Lib\\Maps\\Old Inn.v2.WEBP"
    got = spark.createDataFrame([(p,)], "p string").select(*(f(F.col("p")) for f in (text.stem, text.suffix, text.folder, text.kind, text.norm_dir, text.pretty_name))).first()
    assert tuple(got) == ("Old Inn.v2", ".webp", "Maps", "i", p.lower(), "maps webp inn lib old")
    assert one(spark, text.kind, "a/b.GIF") == "v" and one(spark, text.suffix, "noext") == "" and one(spark, text.stem, ".hidden") == ".hidden"
    assert one(spark, text.norm_dir, "A/B//") == "a\\b" and one(spark, lambda x: text.inside(x, F.lit("A/B/")), "a\\b\\c") and not one(spark, lambda x: text.inside(x, F.lit("A/B")), "a\\bc\\d")


def test_names_of_downloads(spark):
    assert one(spark, text.sanitize, ' a<b>:c\\d?*\x01  e ') == "a b c d e" and one(spark, text.sanitize, "??") == "baixado" and one(spark, text.sanitize) == "baixado"
    assert len(one(spark, text.sanitize, "z" * 200)) == 80
    suffix = lambda u, c: one(spark, lambda x: text.download_suffix(x, F.lit(c)), u)
    assert suffix("http://h/a.PNG?x=1", None) == ".png" and suffix("http://h/a", "image/webp; q=1") == ".webp" and suffix("http://h/a.exe", "text/html") == ".jpg"
    allowed = lambda u: one(spark, text.host_allowed, u)
    assert allowed("https://i.redd.it/x") and allowed("https://redd.it") and not allowed("https://evilredd.it/x") and not allowed("https://redd.it.evil.com") and not allowed("") and allowed("https://u@redd.it:443/x")
    assert one(spark, text.full_size_url, "https://preview.redd.it/ab.png?width=2") == "https://i.redd.it/ab.png" and one(spark, text.full_size_url, "https://x.com/a") is None


def test_versions_and_words(spark):
    assert one(spark, text.version_numbers, "v1.12.3-rc4") == [1, 12, 3] and one(spark, text.version_numbers, "none") == [0]
    newer = lambda a, b: one(spark, lambda x: text.version_numbers(x) > text.version_numbers(F.lit(b)), a)
    assert newer("1.10", "1.9.9") and not newer("1.9", "1.9") and newer("1.9.0", "1.9")
    assert one(spark, text.longest_word, "an old tavern inside castle") == "tavern" and one(spark, text.longest_word, "a b") is None
    assert one(spark, text.slug_title, "old-inn-2") == "Old Inn 2"


@pytest.mark.parametrize(("pt", "en", "missing"), [
    ("taverna a noite", "tavern night", False), ("templo na selva", "temple jungle", False), ("jungle temple", "jungle temple", True), ("Ravenloft", "Ravenloft", True),
    ("de da", "de da", True), ("", "", True), ("Prisão, abandonada!", "prison abandoned", False), ("castelo xyz", "castle xyz", True),
])
def test_dictionary(spark, pt, en, missing):
    assert tuple(one(spark, translate.by_dictionary, pt)) == (en, missing)


def test_memory(spark):
    q = spark.createDataFrame([("taverna",), ("Ravenloft",), ("bosque xyz",)], "q string")
    memory = spark.createDataFrame([("Ravenloft", "castle ravenloft")], "pt string, en string")
    assert {tuple(r) for r in translate.with_memory(q, memory).collect()} == {("taverna", "tavern", "dictionary"), ("Ravenloft", "castle ravenloft", "memory"), ("bosque xyz", "grove xyz", "fallback")}
    assert one(spark, translate.valid_translation, " ") is None and one(spark, translate.valid_translation, "MYMEMORY WARNING: limit") is None and one(spark, translate.valid_translation, "Query length limit") is None and one(spark, translate.valid_translation, "ok") == "ok"


def test_vectors(spark):
    r = np.random.default_rng(0)
    a, b = r.normal(size=8), r.normal(size=8)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.dot_with(F.col("a"), b.tolist()), vectors.normalize(F.col("a")), vectors.mean_of(F.col("a"), F.col("b"))).first()
    assert np.allclose(got[0], a @ b) and np.allclose(got[1], a @ b) and np.allclose(got[2], a / np.linalg.norm(a))
    assert np.allclose(got[3], (a + b) / np.linalg.norm(a + b))
    assert df.select(vectors.normalize(F.array().cast("array<double>"))).first()[0] == [] and df.select(vectors.normalize(F.lit(None).cast("array<double>"))).first()[0] is None
    zero = spark.createDataFrame([([0.0, 0.0],)], "a array<double>").select(vectors.normalize(F.col("a"))).first()[0]
    assert zero == [0.0, 0.0]
    rows = spark.createDataFrame([("k", a.tolist()), ("k", b.tolist()), ("k", None), ("n", None)], "k string, v array<double>")
    c = {x.k: x.centroid for x in vectors.centroids(rows, "k", "v").collect()}
    m = a / np.linalg.norm(a) + b / np.linalg.norm(b)
    assert list(c) == ["k"] and np.allclose(c["k"], m / np.linalg.norm(m))


def test_mel(spark):
    hz = spark.createDataFrame([(float(x),) for x in (0, 500, 1000, 4000, 14000)], "hz double").select("hz", audio.hertz(audio.mel(F.col("hz"))).alias("back"), audio.mel(F.col("hz")).alias("m")).collect()
    assert all(abs(r.hz - r.back) < 1e-6 * max(1, r.hz) for r in hz) and hz[2].m == 15
    f = audio.mel_filters()
    assert f.shape == (513, 64) and (f >= 0).all() and (f.sum(0) > 0).all()
    tone = np.sin(2 * np.pi * 1000 * np.arange(audio.RATE * 2) / audio.RATE)
    m = audio.log_mel(audio.filled(tone)[None], f)[0]
    assert m.shape == (1001, 64)
    assert abs(int(m.mean(0).argmax()) - int(f[round(1000 / audio.RATE * audio.FFT)].argmax())) <= 1
    assert audio.log_mel(audio.filled(np.zeros(0))[None]).max() == pytest.approx(-100)


def test_sounds(spark, tmp_path):
    import wave

    for name, seconds in (("short", 1), ("long", 25)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000)
            w.writeframes((np.sin(np.arange(8000 * seconds) / 3) * 9000).astype("<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    got = audio.log_mels(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    by = {}
    for r in got:
        by.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert len(by["short.wav"]) == 1 and len(by["long.wav"]) == 3 and by["bad.wav"][0].error and by["short.wav"][0].seconds == 1.0
    assert all(len(r.mel) == 1001 * 64 for r in by["long.wav"])


def test_memory_grows_by_what_is_certain(spark):
    memory = spark.createDataFrame([("Ravenloft", "castle")], "pt string, en string")
    q = spark.createDataFrame([(" taverna ",), ("bosque xyz",), ("bosque xyz",), ("Ravenloft",), ("",), (None,), ("abc xyz",)], "q string")
    assert sorted(r.pt for r in translate.to_ask(q, memory).collect()) == ["abc xyz", "bosque xyz"]
    assert [r.pt for r in translate.to_ask(q, memory, spark.createDataFrame([("abc xyz",)], "pt string")).collect()] == ["bosque xyz"]
    answers = spark.createDataFrame([("bosque xyz", " grove of xyz "), ("abc xyz", "QUERY LENGTH LIMIT"), ("Ravenloft", "other")], "pt string, answer string")
    assert sorted(tuple(r) for r in translate.remember(memory, q, answers).collect()) == [("Ravenloft", "castle"), ("bosque xyz", "grove of xyz"), ("taverna", "tavern")]


def test_images(spark):
    rng = np.random.default_rng(0)
    flat = images.preprocess(np.full((30, 50, 3), 128, np.uint8), 16, (0.5, 0.5, 0.5), (0.5, 0.25, 0.5))
    assert flat.shape == (3, 16, 16) and np.allclose(flat[0], (128 / 255 - 0.5) / 0.5, atol=1e-6) and np.allclose(flat[1], (128 / 255 - 0.5) / 0.25, atol=1e-6)
    same = rng.integers(0, 256, (16, 16, 3), dtype=np.uint8)
    assert np.allclose(images.preprocess(same, 16, (0, 0, 0), (1, 1, 1)), same.transpose(2, 0, 1) / 255)
    ramp = np.repeat(np.arange(200, dtype=np.uint8)[None, :, None], 3, 2).repeat(40, 0)
    small = images.preprocess(ramp, 20, (0, 0, 0), (1, 1, 1))[0] * 255
    assert np.allclose(small[:, 2:-2], (np.arange(20) * 10 + 4.5)[2:-2], atol=0.6)
    sizes = {(100, 50): (100, 50), (512, 256): (256, 128), (300, 600): (128, 256), (10_000, 3): (256, 1), (256, 257): (255, 256)}
    got = spark.createDataFrame(list(sizes), "w int, h int").select("w", "h", images.fitted(F.col("w"), F.col("h")).alias("s")).collect()
    assert {(r.w, r.h): (r.s.w, r.s.h) for r in got} == sizes
