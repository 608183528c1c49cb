"""Fill-in-middle: escaped marker injection cuts texts into units, and parts of them change places under sentinels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read_table, row_of

#: The delimiter that is put after each unit, and the character that takes it out of the text first. Neither is white space, so escaping moves no unit's end.
MARK, ESCAPE = "\x01", "\x02"
#: A unit: what isn't white space with the white space before it, or white space at the end. Possessive, as the two classes have nothing in common.
UNIT = f"[{SPACE}]*+[^{SPACE}]++|[{SPACE}]++"
#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 42, 50, 80


def escaped(text: Column) -> Column:
    """text without MARK: MARK is ESCAPE and d, ESCAPE is ESCAPE and e."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """What was escaped, without the marks between units."""
    bare = F.replace(text, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "d"), F.lit(MARK)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with MARK after each unit."""
    return F.regexp_replace(escaped(text), UNIT, "$0" + MARK)


def number(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """The k-th (from 0) group of 8 hex digits of sha256(seed:doc_id), as a number: reruns and other partitionings draw the same. A null id reads null."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _check(sentinels: tuple[str, str, str]) -> None:
    """Sentinels have to be found again: none may end as another, or itself, begins, or lie in another."""
    for i, a in enumerate(sentinels):
        for b in sentinels:
            if not a or a in sentinels[:i] or a != b and a in b or any(a.endswith(b[:n]) for n in range(1, len(b) if a == b else len(b) + 1)):
                raise ValueError(f"sentinels {a!r} and {b!r} could be mistaken for each other")


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with fim, a struct (n, form, prefix, middle, suffix, output), in place of a column of that name.

    A text of n units is cut after two of the places 0 to n, drawn by a hash of the id. rate of 100 texts change their
    form, and of these spm of 100 to suffix, prefix, middle (spm), the others to prefix, suffix, middle (psm); each part
    follows its sentinel. The others are plain, output is the text and the parts are null; so are empty texts, null ones,
    which count as empty, and those that hold a sentinel already. Rows are worked on one by one: repeated rows and ids
    come out alike, nothing is shuffled, and all is done in the JVM.
    """
    _check(sentinels)
    p, s, m = map(F.lit, sentinels)
    h = [number(F.col("_id"), k, seed) for k in range(4)]
    # one step each, as a later one uses the one before several times
    rows = docs.select(row_of(docs), F.col(text).alias("_t"), F.col(doc_id).alias("_id")).select("row", F.coalesce("_t", F.lit("")).alias("_t"), *(x.alias(f"_h{k}") for k, x in enumerate(h)))
    rows = rows.select("*", marked(F.col("_t")).alias("_m"))
    rows = rows.select("*", (F.length("_m") - F.length(F.replace(F.col("_m"), F.lit(MARK), F.lit("")))).cast("long").alias("_n"))
    a, b = F.pmod("_h0", F.col("_n") + 1), F.pmod("_h1", F.col("_n") + 1)
    holds = F.contains("_t", p) | F.contains("_t", s) | F.contains("_t", m)
    plain = (F.col("_t") == "") | holds | (F.pmod("_h2", F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod("_h3", F.lit(100)) < spm, "spm").otherwise("psm")
    rows = rows.select("*", F.least(a, b).cast("int").alias("_a"), F.greatest(a, b).cast("int").alias("_b"), form.alias("_form"))
    n, low, high = (F.col(c).cast("int") for c in ("_n", "_a", "_b"))
    # counted from the left the k-th mark ends the first k units; from the right, the (n - k + 1)-th begins the rest
    cut = lambda x: F.when(F.col("_form") != "plain", unescaped(x))
    prefix = cut(_index(F.col("_m"), low))
    middle = cut(_index(_index(F.col("_m"), low - n - 1), high - low))
    suffix = cut(_index(F.col("_m"), high - n - 1))
    rows = rows.select("row", "_n", "_t", "_form", prefix.alias("_prefix"), middle.alias("_middle"), suffix.alias("_suffix"))
    output = F.when(F.col("_form") == "plain", F.col("_t")).when(F.col("_form") == "psm", F.concat(p, "_prefix", s, "_suffix", m, "_middle")).otherwise(F.concat(s, "_suffix", p, "_prefix", m, "_middle"))
    fim = F.struct(F.col("_n").alias("n"), F.col("_form").alias("form"), F.col("_prefix").alias("prefix"), F.col("_middle").alias("middle"), F.col("_suffix").alias("suffix"), output.alias("output"))
    rows = rows.select("row", fim.alias("fim"))
    kept = [c for c in docs.columns if c != "fim"]
    return rows.select(*(F.col("row").getField(c).alias(c) for c in kept), "fim")


def _index(text: Column, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(MARK), count)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of a form was made from: its parts are found by their sentinels, which no part holds."""
    p, s, m = sentinels
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("fim.output"), F.col("fim.form"))
    return docs.select(
        "doc_id", "fim.n", "fim.form", F.length("fim.prefix").cast("long").alias("prefix_chars"), F.length("fim.middle").cast("long").alias("middle_chars"),
        F.sha2("fim.output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), n AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
