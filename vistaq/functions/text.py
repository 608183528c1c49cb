"""Text of paths, titles and queries: folding, tokens, names, keys. All are column expressions."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark variants of one map, and folder names too general to tell maps apart.
VARIANT_WORDS = (
    "day", "night", "dawn", "dusk", "original", "clean", "empty", "winter", "summer", "spring", "autumn", "fall", "rain", "rainy",
    "snow", "snowy", "fog", "foggy", "storm", "dust", "wind", "cloudy", "dark", "lit", "lights", "sunset", "sunrise", "overcast",
    "gridless", "gridded", "grid", "nogrid", "variant", "variants", "gm", "player", "dm", "hd", "low", "high", "res", "alt",
    "version", "top", "bottom", "upper", "lower", "floor", "level", "part",
)
GENERIC_FOLDERS = ("variants", "scenes", "gridless", "gridded", "thumbs", "assets", "maps", "webp", "jpg", "png")
SUBJECT_WORDS = (
    "day", "night", "original", "clean", "empty", "winter", "summer", "rain", "snow", "fog", "gridless", "gridded", "variant",
    "variants", "scenes", "assets", "tier", "gl", "g", "thumb", "part", "gm", "player",
)
# File kinds by extension.
IMAGES = (".webp", ".jpg", ".jpeg", ".png")
VIDEOS = (".webm", ".mp4", ".m4v", ".gif")
SOUNDS = (".mp3", ".ogg", ".wav", ".flac", ".m4a", ".opus")
# Hosts that thumbnails and downloads may come from.
HOSTS = ("redd.it", "reddit.com", "redditmedia.com", "kemono.cr", "czepeku.com", "encounterkit.com")
MEDIA_TYPES = {"image/jpeg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif"}


def _foldings() -> tuple[str, str, dict[str, str], str]:
    """By Unicode's compatibility decomposition without combining marks: characters that become one other and these, characters that become several, and the marks as a pattern. Syllables of Hangul and ideographs are left out."""
    one, many, marks = [], {}, []
    for code in range(0x80, 0x20000):
        c = chr(code)
        if 0xAC00 <= code < 0xD7A4 or 0x2E80 <= code < 0x2FE0 or 0xD800 <= code < 0xE000 or 0xF900 <= code < 0xFB00:
            continue
        if unicodedata.combining(c):
            if marks and marks[-1][1] == code - 1:
                marks[-1][1] = code
            else:
                marks.append([code, code])
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base == c or not base:
            continue
        if len(base) == 1:
            one.append((c, base))
        else:
            many[c] = base
    return "".join(a for a, _ in one), "".join(b for _, b in one), many, "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in marks) + "]+"


_ACCENTED, _PLAIN, _MANY, _MARKS = _foldings()
#: Whether a text needs more than one letter for one: it has a character beyond the Latin letters, or one of those that become several.
_ODD = r"[^\x{0}-\x{24F}]|[" + "".join(f"\\x{{{ord(c):X}}}" for c in _MANY if ord(c) < 0x250) + "]"


def fold(text: Column) -> Column:
    """Text without accents and with plain letters for compatibility characters, as NFKD without combining marks has it: ligatures, full-width and styled letters, fractions and numbers in circles included. Syllables of Hangul and compatibility ideographs stay whole; see fold_exactly."""
    several = F.from_json(F.lit(json.dumps(_MANY)), "map<string,string>")
    spread = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    odd = F.regexp_replace(F.translate(spread, _ACCENTED, _PLAIN), _MARKS, "")
    return F.when(F.octet_length(text) == F.length(text), text).when(F.regexp_like(text, F.lit(_ODD)), odd).otherwise(F.translate(text, _ACCENTED, _PLAIN))


def fold_exactly(text: Column) -> Column:
    """NFKD without combining marks, of any character; leaves the JVM."""
    return F.pandas_udf(_nfkd, "string")(text)


def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def _parts_of(text: Column, letters: str) -> Column:
    spaced = F.regexp_replace(fold(text), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(spaced), f"[^{letters}]+"), lambda w: F.length(w) > 2)


def tokens(text: Column) -> Column:
    """Lower-case words of three letters and digits or more, in order, split at camel case too."""
    return _parts_of(text, "a-z0-9")


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def parts(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def last_parts(path: Column, n: int = 3) -> Column:
    """The last n parts of a path, or all; slice with a negative start would give none of a shorter path."""
    p = parts(path)
    return F.slice(p, F.greatest(F.lit(1), F.size(p) - (n - 1)), n)


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The lower-case extension with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def folder(path: Column, up: int = 1) -> Column:
    return F.coalesce(F.try_element_at(parts(path), F.lit(-1 - up)), F.lit(""))


def kind(path: Column) -> Column:
    """v for animated files, gif among them, else i."""
    return F.when(suffix(path).isin(*VIDEOS), "v").otherwise("i")


def norm_dir(path: Column) -> Column:
    r"""Lower case with \ between parts and none at the end: how paths are compared."""
    return F.lower(F.regexp_replace(F.replace(path, F.lit("/"), F.lit("\\")), r"\\+$", ""))


def inside(path: Column, directory: Column) -> Column:
    """Whether a path lies below a directory, both by norm_dir."""
    return F.startswith(norm_dir(path), F.concat(norm_dir(directory), F.lit("\\")))


def thumb_name(path: Column) -> Column:
    return F.concat(F.substring(F.sha1(path.cast("binary")), 1, 16), F.lit(".webp"))


def name_words(path: Column) -> Column:
    """The words of the file name and of two folders above it, the extension among them."""
    return token_set(F.array_join(last_parts(path), " "))


def coverage(query_words: Column, words: Column) -> Column:
    """The share of the query's words that are in words; 0 for a query without any."""
    return F.when(F.size(query_words) > 0, F.size(F.array_intersect(query_words, words)) / F.size(query_words)).otherwise(F.lit(0.0))


def pretty_name(path: Column) -> Column:
    """The name's distinct words, the longest first and equally long ones by letter: what is embedded for a name."""
    keyed = F.transform(name_words(path), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x.w), " ")


def map_key(path: Column) -> Column:
    """What variants of one map share: the first three words of the name that mark no variant. Fewer than two words are told apart by the folder, or by that above it where its name is general."""
    words = F.slice(F.filter(tokens(stem(path)), lambda w: ~w.isin(*VARIANT_WORDS)), 1, 3)
    above = F.when(F.lower(folder(path)).isin(*GENERIC_FOLDERS), folder(path, 2)).otherwise(folder(path))
    poor = F.concat(F.lower(above), F.lit("|"), F.array_join(F.array_sort(words), " "))
    return F.when(F.size(words) >= 2, F.array_join(words, " ")).otherwise(poor)


def subject(path: Column) -> Column:
    """The subject that a file's name, or else its folder's, stands for in evaluations: up to four words of letters."""
    plain = lambda t: F.filter(_parts_of(t, "a-z"), lambda w: ~w.isin(*SUBJECT_WORDS))
    own = plain(stem(path))
    return F.array_join(F.slice(F.when(F.size(own) < 2, plain(folder(path))).otherwise(own), 1, 4), " ")


def slug_title(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def sanitize(title: Column, default: str = "baixado") -> Column:
    """A title as a file name: no characters that file systems refuse, single spaces, 80 characters at most."""
    clear = F.regexp_replace(F.coalesce(title, F.lit(default)), '[<>:"/\\\\|?*\\x00-\\x1f]+', " ")
    clear = F.left(F.trim(F.regexp_replace(clear, r"\s+", " ")), F.lit(80))
    return F.coalesce(F.nullif(clear, F.lit("")), F.lit(default))


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_allowed(url: Column, hosts=HOSTS) -> Column:
    """Whether a URL's host is one of hosts or below one."""
    h = host(url)
    out = F.lit(False)
    for one in hosts:
        out = out | (h == one) | F.endswith(h, F.lit("." + one))
    return out


def full_size_url(thumb: Column) -> Column:
    """The full file that a thumbnail's address leads to, or null."""
    h = host(thumb)
    return (
        F.when(F.contains(h, F.lit("encounterkit.com")), F.replace(thumb, F.lit("width=480"), F.lit("width=1920")))
        .when(h == "img.kemono.cr", F.replace(thumb, F.lit("img.kemono.cr/thumbnail/data"), F.lit("kemono.cr/data")))
        .when(h == "preview.redd.it", F.concat(F.lit("https://i.redd.it/"), F.element_at(F.split(F.regexp_extract(thumb, r"^[^?#]*", 0), "/"), -1)))
    )


def download_suffix(url: Column, content_type: Column) -> Column:
    """The extension to store a download under: the URL's if it is a known one, else by content type, else .jpg."""
    own = suffix(F.regexp_extract(url, r"^[^?#]*", 0))
    by_type = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    known = (".jpg", ".jpeg", ".png", ".webp", ".gif", ".webm", ".mp4")
    return F.when(own.isin(*known), own).otherwise(F.coalesce(F.try_element_at(by_type, F.split(F.coalesce(content_type, F.lit("")), ";")[0]), F.lit(".jpg")))


def version_numbers(tag: Column) -> Column:
    """The first three numbers of a version tag, [0] if there is none; arrays compare as versions do."""
    found = F.transform(F.slice(F.regexp_extract_all(tag, F.lit(r"(\d+)")), 1, 3), lambda x: x.cast("bigint"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(0).cast("bigint")))


def long_words(query: Column) -> Column:
    return F.filter(F.split(query, r"\s+"), lambda w: F.length(w) > 2)


def longest_word(query: Column) -> Column:
    """The first of a query's longest words of three letters or more: what a search falls back on."""
    w = long_words(query)
    return F.array_max(F.transform(w, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("w")))).w
