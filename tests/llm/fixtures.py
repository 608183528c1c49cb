"""Small tables that hold the awkward cases, and what brute force makes of them."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASH = ("row", "key", "node", "doc", "n", "score", "_text", "_digest", "_salt", "_size", "rate", "keep", "band", "comp", "spans", "payload", "feature", "keep_id", "n_lines", "fast", "_id", "by", "rest", "template")


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def awkward(seed: int = 0, n: int = 60):
    """(doc_id, text, lang, source, n_chars) rows: nulls anywhere, empty texts, copies, repeated rows, near copies, one long text."""
    r = random.Random(seed)
    rows = [(i, " ".join(words(r, r.randint(1, 120))), "en", f"src{r.randint(0, 3)}", 0) for i in range(n)]
    rows += [(n + i, rows[i % 5][1], "fr", "src0", 1) for i in range(30)]
    base = words(r, 200)
    for i in range(25):
        w = list(base)
        w[r.randrange(200)] = f"edit{i}"
        rows.append((n + 100 + i, " ".join(w), "de", None, None))
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None), (None, None, None, None, None), (900, None, "en", "src1", 0), (901, "", "en", "src1", 0), (902, " \n\t", "en", "zero", 0), (903, "!!! ???", None, "src2", 7)]
    rows.append((950, "\n".join(" ".join(words(r, 12)) for _ in range(4000)), "en", "src0", 5))
    shared = [" ".join(words(r, 6)) for _ in range(4)]
    for i in range(24):
        rows.append((1000 + i, "\n".join([shared[0] + "  ", " ".join(words(r, 8)), shared[1].upper() if i < 9 else shared[2], "", shared[3] if i < 10 else "end"]), "es", "src1", i))
    rows += [(2000, "é" * 50 + "\n" + "𝄞 clef", "fr", "src9", 2), (2001, "a b\rc\x00d", "fr", "src9", 2)]
    r.shuffle(rows)
    return rows


def frame(spark, rows=None, clash=False):
    df = spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(c).alias(c) for c in CLASH))
    return df


def as_set(df):
    """Rows as a sorted list, whatever their order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
