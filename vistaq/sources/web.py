"""Rows (title, url, thumb, source) from feeds, posts and catalogue pages that are already fetched."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug_title, version_numbers

#: A thumbnail is looked for in so many characters after its link.
NEAR = 4000
TOP = 40


def feed_entries(feeds: DataFrame) -> DataFrame:
    """Entries of Atom documents (source, ord, body): the title, the first link's address and the thumbnail's. Entries without a link are left out."""
    entry = F.regexp_extract_all("body", F.lit(r"(?s)<entry[ >].*?</entry>"), 0)
    rows = feeds.select("source", "ord", F.posexplode(entry).alias("pos", "_e"))
    return rows.select(
        "source", "ord", "pos", unescape(F.regexp_extract("_e", r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        unescape(F.regexp_extract("_e", r'<link\b[^>]*\bhref="([^"]*)"', 1)).alias("url"), unescape(F.regexp_extract("_e", r'<media:thumbnail\b[^>]*\burl="([^"]*)"', 1)).alias("thumb"),
    ).where("url <> ''")


def unescape(text: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#32;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


_POST = "array<struct<id:string,title:string,service:string,user:string,file:struct<name:string,path:string>,attachments:array<struct<name:string,path:string>>>>"


def posts(answers: DataFrame, site: str) -> DataFrame:
    """Posts of JSON answers (source, ord, body) that have an image: the file's, or else the first attachment's that is one."""
    rows = answers.select("source", "ord", F.posexplode(F.from_json("body", _POST)).alias("pos", "_p"))
    image = lambda p: F.regexp_like(F.lower(F.coalesce(p, F.lit(""))), F.lit(r"\.(webp|jpe?g|png|gif)$"))
    other = F.get(F.filter(F.coalesce("_p.attachments", F.array().cast("array<struct<name:string,path:string>>")), lambda a: image(a.path)), 0).path
    path = F.when(image(F.col("_p.file.path")), F.col("_p.file.path")).otherwise(other)
    url = F.concat(F.lit(site), F.lit("/"), F.col("_p.service"), F.lit("/user/"), F.col("_p.user"), F.lit("/post/"), F.col("_p.id"))
    return rows.select("source", "ord", "pos", F.col("_p.title").alias("title"), url.alias("url"), path.alias("thumb")).where("thumb is not null")


_RELEASE = "tag_name string, body string, assets array<struct<name:string,browser_download_url:string,size:long>>"
#: Letters of a release's notes that are kept. Fixed value.
NOTES = 2000


def releases(answers: DataFrame, current: Column | str, ending: str = ".exe") -> DataFrame:
    """(source, ord, version, url, size, notes) of JSON answers (source, ord, body) that tell of a release newer than current with an asset whose name ends so, in either case: the first one. Versions are compared by their first three numbers; what is no object, or has no tag, is none."""
    now = F.lit(current) if isinstance(current, str) else current
    rows = answers.select("source", "ord", F.from_json("body", _RELEASE).alias("_r"), now.alias("_now"))
    fits = F.filter(F.coalesce("_r.assets", F.array().cast("array<struct<name:string,browser_download_url:string,size:bigint>>")), lambda a: F.endswith(F.lower(a["name"]), F.lit(ending.lower())))
    rows = rows.where(version_numbers(F.coalesce("_r.tag_name", F.lit(""))) > version_numbers(F.coalesce("_now", F.lit("")))).withColumn("_a", F.get(fits, 0)).where("_a is not null")
    return rows.select("source", "ord", F.col("_r.tag_name").alias("version"), F.col("_a.browser_download_url").alias("url"), F.coalesce("_a.size", F.lit(0)).alias("size"), F.substring(F.coalesce("_r.body", F.lit("")), 1, NOTES).alias("notes"))


def catalogue(pages: DataFrame, link: str, image: str, site: str = "") -> DataFrame:
    """Links of pages (source, ord, html) that match link, whose groups are section and slug, with the first image after each."""
    last = re.compile(link).groups + 1
    ahead = F.lit(f"{link}(?=([\\s\\S]{{0,{NEAR}}}))")  # a match with what follows it, so one may follow within another's text
    both = F.arrays_zip(F.regexp_extract_all("html", ahead, 0).alias("hit"), F.regexp_extract_all("html", ahead, last).alias("after"))
    rows = pages.select("source", "ord", F.posexplode(both).alias("pos", "_b")).select("source", "ord", "pos", "_b.*")
    section, slug = F.regexp_extract("hit", link, 1), F.regexp_extract("hit", link, 2)
    return rows.select("source", "ord", "pos", slug_title(slug).alias("title"), F.concat(F.lit(f"{site}/"), section, F.lit("/"), slug).alias("url"), F.regexp_extract("after", image, 1).alias("thumb"), section.alias("cat"))


def first_by_url(rows: DataFrame) -> DataFrame:
    """One row per address: the first by ord and pos."""
    rest = [c for c in rows.columns if c != "url"]
    return rows.groupBy("url").agg(F.min_by(F.struct(*rest), F.struct("ord", "pos")).alias("_r")).select("url", "_r.*")


def rank_titles(rows: DataFrame, query: str, top: int = TOP, cat: str | None = None) -> DataFrame:
    """rows by how many of the query's words their titles contain, at least one; words of three letters or more, or else the query whole."""
    words = [w.lower() for w in query.split() if len(w) > 2] or [query.lower()]
    n = sum((F.contains(F.lower("title"), F.lit(w)).cast("int") for w in words), F.lit(0))
    some = rows if cat is None else rows.where(F.col("cat") == cat)
    return some.withColumn("n", n).where("n > 0").orderBy(F.col("n").desc(), "ord", "pos").limit(top)


def with_errors(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """What a fan-out over sources gives: its rows, or the errors (source, error) if there is no row at all."""
    return rows if not rows.isEmpty() else errors


def online(*found: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """What several sources gave for a query, as one table: title, url, thumb, source, place (the source's in the order given, then ord and pos), error.

    Each of found has rows as feed_entries, posts or rank_titles give them. errors (source, error) are told only if no
    source gave a row.
    """
    named = [f.select("title", "url", "thumb", "source", F.struct(F.lit(k).alias("of"), F.col("ord").cast("long").alias("ord"), F.col("pos").cast("long").alias("pos")).alias("place"), F.lit(None).cast("string").alias("error")) for k, f in enumerate(found)]
    rows = reduce(DataFrame.unionByName, named)
    if errors is None:
        return rows
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("title", "url", "thumb")]
    return with_errors(rows, errors.select(*none, "source", F.lit(None).cast(rows.schema["place"].dataType).alias("place"), "error"))


def sources_list(rows: DataFrame, off: DataFrame) -> DataFrame:
    """(source, n, on): the sources of rows, their number of rows, and whether they are on; off (source) are not."""
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(off.select("source").distinct().withColumn("_off", F.lit(True)), "source", "left").select("source", "n", F.col("_off").isNull().alias("on"))
