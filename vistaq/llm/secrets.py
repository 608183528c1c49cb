"""Secret scans: single-part rules, and weak identifiers, secrets and endpoints that count only where complementary parts meet."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship

#: In the order in which kinds of one start are listed.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
_SPANS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a match is a whole run, so the least length can stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{28,}={0,2}(?![A-Za-z0-9+/_=-])")
_WEAK_ID = re.compile(r"""(?:client|access|account|user|login|key)[_-]?(?:id|name|key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})|\b(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}""", re.I | re.A)
_ENDPOINT = re.compile(r"""(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\s"'<>]+|\b(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}|\b\d{1,3}(?:\.\d{1,3}){3}:\d{2,5}\b""", re.I | re.A)
_CLOUD = re.compile(r"\.(?:amazonaws\.com|azure\.com|googleapis\.com|internal)\b", re.I | re.A)
_NAMES = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*", re.I)
_NAME_START = re.compile(r"\b(?=[a-z0-9-])", re.I | re.A)
_SCOPE = re.compile(r"\n[\x20\t\r]*\n")


def _random_looking(s: str) -> bool:
    """Letters of both cases and digits, at 3.5 bits a character or more."""
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= 3.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    return out + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses with a scheme, named, with a port, or of cloud hosts, leftmost first and apart. A dotted run of names is looked through once: it is a cloud host from its first word to the last suffix in it."""
    found = [m.span() for m in _ENDPOINT.finditer(text)]
    if _CLOUD.search(text):
        for run in _NAMES.finditer(text):
            joined = text[run.end() : run.end() + 1] == "_"  # a word goes on after the run
            ends = [m for m in _CLOUD.finditer(text, run.start() + 1, run.end()) if not (joined and m.end() == run.end())]
            if ends and (first := _NAME_START.search(text, run.start(), ends[-1].start())):
                found.append((first.start(), ends[-1].end()))
    out, done = [], 0
    for s, e in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= done:
            out.append((s, e))
            done = e
    return out


def joins(parts: list[tuple[int, int]], others: list[tuple[int, int]], cuts: list[int], reach: int | None = None) -> list[tuple[int, int]]:
    """Those of parts with one of others in their scope, at most reach apart if that is given: an interval join, by binary search over sorted starts and running greatest ends."""
    others = sorted(others)
    starts, ends, far = [s for s, _ in others], [], 0
    for _, e in others:
        ends.append(far := max(far, e))
    out = []
    for s, e in parts:
        k = bisect.bisect_right(cuts, s)
        if reach is None:
            first = bisect.bisect_left(starts, cuts[k - 1]) if k else 0
            if first < (bisect.bisect_left(starts, cuts[k]) if k < len(cuts) else len(starts)):
                out.append((s, e))
            continue
        low, high = (cuts[k - 1] if k else 0), (cuts[k] if k < len(cuts) else math.inf)
        # others that start in [.., min(e + reach, high)) and of these one that ends after max(s - reach, low)
        i = bisect.bisect_left(starts, min(e + reach + 1, high))
        if i and ends[i - 1] > max(s - reach - 1, low) and any(b > max(s - reach - 1, low) and a >= low for a, b in _back(others, ends, i, max(s - reach - 1, low))):
            out.append((s, e))
    return out


def _back(others, ends, i, low):
    while i and ends[i - 1] > low:
        i -= 1
        yield others[i]


def apart_from(spans: list[tuple[int, int]]):
    """Whether a span touches none of spans, by binary search."""
    spans, far, ends = sorted(spans), 0, []
    for _, e in spans:
        ends.append(far := max(far, e))
    starts = [s for s, _ in spans]

    def clear(s: int, e: int) -> bool:
        i = bisect.bisect_left(starts, e)  # those that begin before e: does one end after s?
        return not i or ends[i - 1] <= s

    return clear


def find(text: str | None, reach: int | None = None) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start and then kind; offsets in code points, end exclusive.

    A secret is a base assign or hex span or a weak secret: a random-looking run that no base span touches. An identifier
    is a base access span or a weak one. Weak identifiers and endpoints count with a secret near, weak secrets with an
    identifier or an endpoint near; near is in the same scope, a paragraph, and at most reach code points apart, if that
    is given. The work grows with the text and the logarithm of its spans.
    """
    text = text or ""
    spans = base_spans(text)
    strong = [(s, e) for s, e, k in spans if k != "access"]
    clear = apart_from([(s, e) for s, e, _ in spans])
    weak = [m.span() for m in _WEAK_SECRET.finditer(text) if _random_looking(m[0]) and clear(*m.span())]
    if strong or weak:  # without a secret, nothing links
        cuts = [m.end() for m in _SCOPE.finditer(text)]
        ids = [m.span() for m in _WEAK_ID.finditer(text) if clear(*m.span())]
        ends = [x for x in endpoints(text) if clear(*x)]
        access = [(s, e) for s, e, k in spans if k == "access"]
        spans += [(*x, "linked_id") for x in joins(ids, strong + weak, cuts, reach)]
        spans += [(*x, "linked_endpoint") for x in joins(ends, strong + weak, cuts, reach)]
        spans += [(*x, "linked_secret") for x in joins(weak, ids + access + ends, cuts, reach)]
    return [(k, s, e) for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))]


def _scan(reach: int | None):
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find(t, reach)] for t in texts], dtype=object)

    return run


def scan(docs: DataFrame, text: str = "text", reach: int | None = None) -> DataFrame:
    """docs with spans, an array of (kind, start, end), in place of a column of that name. Null and empty texts have none; rows stay as they are, repeated ones too, so nothing is shuffled."""
    ship(docs.sparkSession)
    return docs.withColumn("spans", F.pandas_udf(_scan(reach), _SPANS)(F.col(text)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs).drop("text")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin("assign", "access", "hex"))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
