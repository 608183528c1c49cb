"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, exact_ids, hot_keys, id_text, orderable, read_table, row_of, salted_join, ship, unpacked

SHINGLE, SIMILAR = 5, 0.8
#: At similarity 0.8 some band of 16 agrees in its 4 samples with probability 0.9998.
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Shingles in fewer than this share of the documents all weigh the same, most of all; of the others the documents are counted.
RARE = 1e-3
#: Shingles that are listed with their weights, at most: 12 bytes each. No more can be found in 1/LISTED of all (document, shingle) pairs. A parameter: where documents have more than RARE * LISTED different shingles on average, it raises RARE (see document_frequencies).
LISTED = 1 << 21
#: Bytes of text whose shingles are counted together, hashes that a task holds, and bits by which hashes are dealt out at once.
PART_BYTES, HELD, DEAL_BITS = 8 << 20, 1_500_000, 12
#: Of pairs that are 0.8 alike, 0.0000003 agree in less of their samples.
PROMISING = 0.55
#: Left-over rows, and rows of a bucket that they are compared with, in one task: more in larger buckets, so that these aren't repeated for each other too often.
ROWS_FROM, ROWS_TO = 256, 2048
#: Bytes of the left-over texts whose shingles a task holds while the others pass by; one text may be longer.
LEFT_BYTES = 8 << 20
#: Rows that are sent to all tasks, at most, to tell which texts are wanted or which rows go: 50 MB. Beyond, texts are shuffled.
TOLD = 500_000
#: Links that a task of the search for components takes.
LINKS = 250_000
_CELL = "bucket long, band int, i int, j int, side int, node long, comp long, own boolean, size long, sig binary, bands array<long>"
_CELL_COLUMNS = [c.split()[0] for c in _CELL.split(", ")]
_SIGNATURE = "doc_id string, fast long, key binary, size long, bands array<long>, sig binary"
_COUNTS = "part long, keys binary, counts binary"


# ---- shingles and weights


_WORD = np.ones(256, bool)  # letters, digits and all bytes of characters beyond ASCII
_WORD[[b for b in range(128) if not chr(b).isalnum()]] = False
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[int(base)] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's runs of size lower-cased words, rising, and how often each occurs. A text of fewer words is one shingle, one without a word none."""
    b = np.frombuffer((text or "").lower().encode(), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _WORD[b]
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_P, len(b)), out=sums[1:])
    words = _mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(b) + 1)[starts])
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(out)]
    return np.unique(_mix(out), return_counts=True)


class Weights:
    """Inverse document frequencies: from 2 for a shingle in RARE of the documents or fewer down to 1 for one in all, 1 + ln(n / df) / ln(1 / RARE).

    They depend on the share of documents alone, so a pair is as alike in a large corpus as in a small one. The range is
    this narrow so that what a large group of near copies shares, being frequent for that reason, isn't outweighed by the
    few words in which each copy differs. floor: documents of a shingle that isn't listed.
    """

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int, floor: float = 1, bits: int = 0):
        self.keys, self.shift = np.asarray(keys, np.uint64), np.uint64(32 - bits)
        idf = lambda d: 1 + np.log(max(n, 1) / np.clip(d, floor, max(n, 1))) / np.log(1 / RARE)
        self.values, self.rare = idf(np.asarray(df, np.float64)).astype(np.float32), np.float32(idf(np.float64(min(floor, max(n, 1)))))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), self.rare)
        k = hashes >> self.shift
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.values[at], self.rare)


def weighted(text: str | None, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    h, tf = shingles(text)
    return h, tf.astype(np.float32) * weights(h)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of minima by sum of maxima. 1 for two empty sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / whole if whole > 0 else 1.0


class Sampler:
    """Improved consistent weighted sampling: of shingles with weights s, sample k takes the one of least a, where, with its own
    r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), t = floor(ln s / r + b) and ln a = ln c - r (t - b + 1); two sets take the same
    (shingle, t) with probability their weighted Jaccard similarity. The variates are drawn anew for each shingle and sample,
    from all 64 bits of the shingle's hash, so texts of any length have as many of them as shingles."""

    #: Shingles at a time: what is drawn for them stays in a core's cache.
    STEP = 256

    def __init__(self, samples: int = SAMPLES, seed: int = 7):
        self.keys = np.random.default_rng(seed).integers(0, 1 << 63, (samples, 1), np.uint64)

    def _draw(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, ln c and b by sample and shingle: Gamma(2, 1) is minus the logarithm of a product of two uniform variates."""
        x = _mix(hashes[None, :] ^ self.keys)
        y = x * np.uint64(0xD6E8FEB86659FD93)
        y ^= y >> np.uint64(32)
        y *= np.uint64(0xD6E8FEB86659FD93)
        y ^= y >> np.uint64(32)
        b = ((x * np.uint64(0xA0761D6478BD642F)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)

        def gamma(bits: np.ndarray) -> np.ndarray:
            u = bits.view(np.uint32).reshape(*bits.shape, 2).astype(np.float32)
            u += np.float32(0.5)
            u *= np.float32(2**-32)
            return np.maximum(-np.log(u[..., 0] * u[..., 1]), np.float32(1e-7))

        return gamma(x), np.log(gamma(y)), b

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """An identifier of each sample."""
        k = np.arange(len(self.keys))
        best, ids = np.full(len(k), np.inf, np.float32), np.zeros(len(k), np.uint64)
        for low in range(0, len(hashes), self.STEP):
            h, logs = hashes[low : low + self.STEP], np.log(weights[low : low + self.STEP])
            r, ln_c, b = self._draw(h)
            t = np.floor(logs / r + b)
            a = ln_c - r * (t - b + np.float32(1))
            i = a.argmin(1)
            found = a[k, i]
            own = _mix(h[i] ^ (t[k, i].astype(np.int64).astype(np.uint64) * _P))
            ids = np.where(found < best, own, ids)
            best = np.minimum(best, found)
        return ids


def bands(ids: np.ndarray) -> np.ndarray:
    """A key per band, which tells the band too."""
    out = np.arange(1, BANDS + 1).astype(np.uint64)
    for row in ids.reshape(BANDS, ROWS).T:
        out = _mix(out * _P + row)
    return out.view(np.int64)


# ---- passes over the documents


def _packed(keys: np.ndarray) -> bytes:
    """Rising keys as byte planes of their steps: the two low planes are as good as random, the others nearly empty."""
    planes = np.diff(keys, prepend=np.zeros(1, np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(4, "little") + planes[:2].tobytes() + zlib.compress(planes[2:].tobytes(), 1)


def _keys(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(data[4 : 4 + 2 * n] + zlib.decompress(data[4 + 2 * n :]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(n), dtype=np.uint64)


def _dealt(keys: np.ndarray, counts: np.ndarray, shift: int) -> pd.DataFrame:
    """Rising keys by part, key >> shift, as rows of _COUNTS: of the counts, those above 1 with their places."""
    part = keys >> np.uint64(shift)
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    out = []
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        many = np.flatnonzero(counts[s:e] > 1)
        out.append((int(part[s]), _packed(keys[s:e]), many.astype("<u4").tobytes() + counts[s:e][many].astype("<u8").tobytes()))
    return pd.DataFrame(out, columns=["part", "keys", "counts"])


def _summed(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Rising keys and counts of rows of one part."""
    keys, counts = [], []
    for k, c in rows:
        keys.append(_keys(k))
        own, n = np.ones(len(keys[-1]), np.int64), len(c) // 12
        own[np.frombuffer(c, "<u4", n)] = np.frombuffer(c, "<u8", n, 4 * n)
        counts.append(own)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[starts], np.add.reduceat(c, starts)


def _count(bits: int, dealt: int):
    """Of each document its different shingles; of what a task holds, each once with its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in chain(batches, [None]):
            for text in () if pdf is None else pdf["text"]:
                held.append(shingles(text)[0] >> np.uint64(32 - bits))
                n += len(held[-1])
                if n >= HELD:
                    yield _dealt(*np.unique(np.concatenate(held), return_counts=True), 32 + bits - dealt)
                    held, n = [], 0
        if n:
            yield _dealt(*np.unique(np.concatenate(held), return_counts=True), 32 + bits - dealt)

    return run


def _deal_again(shift: int):
    """Over a partition sorted by part: parts are split further, no more of one held than of a task's documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, n = None, [], 0
        for pdf in batches:
            for p, k, c in zip(pdf["part"], pdf["keys"], pdf["counts"], strict=True):
                if held and (p != part or n >= HELD):
                    yield _dealt(*_summed(held), shift)
                    held, n = [], 0
                part, n = p, n + int.from_bytes(k[:4], "little")
                held.append((k, c))
        if held:
            yield _dealt(*_summed(held), shift)

    return run


def _frequent(least: int):
    """Of a part, the keys of least documents or more, and with no key the sum over all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = _summed(list(zip(pdf["keys"], pdf["counts"], strict=True)))
        some = c >= least
        return pd.DataFrame({"shingle": [*k[some].tolist(), None], "df": [*c[some].tolist(), int(c.sum())]}).astype({"shingle": "Int64"})

    return run


def document_frequencies(docs: DataFrame, work: Workspace) -> Weights:
    """Weights by the documents of each shingle, counted over all of them.

    Shingles are known by 32 bits of their hash and as many more as there are parts, dealt out by these, so a part holds
    the shingles of about PART_BYTES of text, and counts of frequent ones leave each task once. Those in RARE of the
    documents and 1/LISTED of all (document, shingle) pairs, or more, are listed: LISTED at most, whatever the corpus.
    So the share of documents below which all shingles weigh the same is RARE, or the mean number of a document's
    different shingles over LISTED where that is more (from 2,097 on); it follows the mean length, not the size of the
    corpus. Weights span 1 to 2: term counts with a touch of IDF, as the few words in which near copies differ are rare.
    """
    ship(docs.sparkSession)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = min(2 * DEAL_BITS, math.ceil(math.log2(max(1, size / PART_BYTES))))
    first = min(bits, DEAL_BITS)
    parts = docs.select("text").mapInPandas(_count(bits, first), _COUNTS)
    if bits > first:
        dealt = parts.repartition(int(work.spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part")
        parts = dealt.mapInPandas(_deal_again(32), _COUNTS)
    least = max(2, math.ceil(RARE * n))
    found = work.save(parts.groupBy("part").applyInPandas(_frequent(least), "shingle long, df long"), "frequent")
    pairs = found.where("shingle is null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    floor = max(1.0, RARE * n, pairs / LISTED)
    listed = found.where(F.col("shingle").isNotNull() & (F.col("df") >= floor)).toArrow().sort_by("shingle")
    return Weights(listed["shingle"].to_numpy().astype(np.uint64), listed["df"].to_numpy(), n, floor, bits)


def _sign(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, weights = Sampler(), shared.value
        for pdf in batches:
            out = []
            for doc_id, fast, text in zip(pdf["doc_id"], pdf["fast"], pdf["text"], strict=True):
                h, w = weighted(text, weights)
                if len(h):
                    raw, ids = text.encode(), sampler(h, w)
                    out.append((doc_id, fast, hashlib.md5(raw).digest(), len(raw), bands(ids), (ids & np.uint64(255)).astype(np.uint8).tobytes()))
                else:
                    out.append((doc_id, fast, b"", 0, np.zeros(0, np.int64), b""))
            yield pd.DataFrame(out, columns=["doc_id", "fast", "key", "size", "bands", "sig"])

    return run


def _verify(shared, similar: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, last, other = shared.value, None, None
        for pdf in batches:
            good = np.zeros(len(pdf), bool)
            for i, (a, b) in enumerate(zip(pdf["text_a"], pdf["b"], strict=True)):
                if b != last:
                    last, other = b, weighted(pdf["text_b"].iloc[i], weights)
                good[i] = similarity(weighted(a, weights), other) >= similar
            yield pdf.loc[good, ["a", "b"]]

    return run


def _agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype=float)
    a, b = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (x, y))
    return pd.Series((a == b).mean(1))


class _Left:
    """Left-over rows of a cell as arrays."""

    def __init__(self, rows: list):
        self.node, self.comp = np.array([r.node for r in rows]), np.array([r.comp for r in rows])
        self.sigs = np.frombuffer(b"".join(r.sig for r in rows), np.uint8).reshape(len(rows), -1)
        self.bands = np.array([r.bands for r in rows], np.int64)

    def partners(self, row) -> np.ndarray:
        """Which left-over rows to compare row with: promising ones of other components, that it shares no earlier band with, since these meet there; of two left-over rows each is once the row."""
        ok = (self.node < row.node) if row.own else (self.node != row.node)
        ok &= self.comp != row.comp
        if ok.any():
            ok &= (self.sigs == np.frombuffer(row.sig, np.uint8)).sum(1) >= PROMISING * self.sigs.shape[1]
        if ok.any():
            ok &= ~(self.bands[:, : row.band] == row.bands[: row.band]).any(1)
        return np.flatnonzero(ok)


def _cells(batches: Iterator[pd.DataFrame], key: list[str]):
    """Of a partition sorted by cell and side: a left-over row's cell is begun with it; each other row comes with the left-over rows of its cell, as a list that is the same object for a cell."""
    cell, left = None, []
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            now = tuple(getattr(row, c) for c in key)
            if now != cell:
                cell, left = now, []
            if row.side == 0:
                left.append(row)
            elif left:
                yield row, left


def _promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over a partition sorted by cell and side: the rows that have a partner in their cell. The left-over rows of one cell are held."""
    last, data, hit, out = None, None, set(), []
    for row, left in _cells(batches, ["bucket", "i", "j"]):
        if left is not last:
            last, data, hit = left, _Left(left), set()
        found = data.partners(row)
        if len(found):
            out.append(row)
            out += [left[k] for k in found.tolist() if k not in hit]
            hit.update(found.tolist())
        if len(out) >= 5000:
            yield pd.DataFrame(out, columns=_CELL_COLUMNS)
            out = []
    if out:
        yield pd.DataFrame(out, columns=_CELL_COLUMNS)


def similarities(one: tuple[np.ndarray, np.ndarray], hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of one with each of the sets that begin at starts of the joined hashes and weights; none of them is empty."""
    at = np.minimum(np.searchsorted(one[0], hashes), len(one[0]) - 1)
    both = np.add.reduceat(np.where(one[0][at] == hashes, np.minimum(one[1][at], weights), 0).astype(np.float64), starts)
    return both / (one[1].sum(dtype=np.float64) + np.add.reduceat(weights.astype(np.float64), starts) - both)


def _link(shared, similar: float):
    """Over a partition sorted by cell and side: edges between components, as many a cell as unions, not as pairs. The shingles of a cell's left-over rows are held, and those of one other row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, data, vectors, root, out = None, None, {}, {}, []

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for row, left in _cells(batches, ["bucket", "i", "j", "k"]):
            if left is not last:
                last, data, vectors, root = left, _Left(left), {}, {}
            some = [k for k in data.partners(row).tolist() if find(left[k].comp) != find(row.comp)]
            if not some:
                continue
            for k in some:
                if k not in vectors:
                    vectors[k] = weighted(left[k].text, shared.value)
            parts = [vectors[k] for k in some]
            starts = np.cumsum([0, *(len(h) for h, _ in parts[:-1])])
            alike = similarities(weighted(row.text, shared.value), np.concatenate([h for h, _ in parts]), np.concatenate([w for _, w in parts]), starts)
            for k, good in zip(some, (alike >= similar).tolist(), strict=True):
                if good and find(left[k].comp) != find(row.comp):
                    root[find(left[k].comp)] = find(row.comp)
                    out.append((left[k].comp, row.comp))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


# ---- links and components


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b), comp being the smallest node: large stars and small stars in turn, until nothing changes. Hubs are salted."""

    tasks = lambda n: max(1, -(-n // LINKS))  # noqa: E731  as the links become fewer, so do the tasks

    def stars(e: DataFrame, n: int, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = work.save(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(tasks(n)), "least")
        hubs = hot_keys(least, "u", "n")
        joined = salted_join(both, least.select("u", F.least("u", "m").alias("m")), "u", hubs, "v")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks(n))
        rest = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks(n))

    def digest(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = work.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = digest(e)
    while n := before[0]:
        e = work.save(stars(work.save(stars(e, n, True), "large"), n, False), "small")
        if (now := digest(e)) == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def told(table: DataFrame) -> DataFrame:
    """A saved table for a join in which texts take part: told to all tasks where it has TOLD rows at most, so texts stay where they are; else texts are shuffled."""
    return broadcast_if_small(table, TOLD)


def texts_of(docs: DataFrame, wanted: DataFrame, work: Workspace) -> DataFrame:
    """(node, text) for wanted (node, low, fast, key). Rows that repeat bring a text once."""
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_fast"))
    got = rows.join(told(wanted), (F.col("_fast") == F.col("fast")) & F.col("doc_id").eqNullSafe(F.col("low")))
    got = work.save(got.where(F.unhex(F.md5("text")) == F.col("key")).select("node", "text"), "texts")
    if got.count() > wanted.count():
        got = work.save(got.groupBy("node").agg(F.first("text").alias("text")), "texts")
    return got


def near_groups(docs: DataFrame, work: Workspace, similar: float = SIMILAR) -> DataFrame:
    """A row per row of docs: doc_id, fast and key (hashes of its text; key is empty without a word), class_id, class_size, keep_id, keep_key.

    Classes are the connected components of links between texts whose weighted Jaccard similarity is similar or more and
    that share a band. Equal texts are one node. In each bucket every node is compared with the bucket's first; the nodes
    that this leaves over are compared, in blocks, with all nodes of the bucket that are in other components, so groups
    with one hub never make pairs, and no link between components that share a bucket is passed by; a pair that shares
    several buckets is compared in that of the first band. Signatures are compared first, and texts are fetched only for
    rows with a promising partner. class_id is the smallest doc_id; keep_id and keep_key tell the row that stays.

    Texts without a word, null and empty ones included, are one class. Null ids come after all others. Rows that repeat
    belong together. An empty table gives none; other columns are not looked at.
    """
    spark = work.spark
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(document_frequencies(docs, work))
    asked = docs.select(id_text(docs), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fast"))
    signed = work.save(exact_ids(asked.mapInPandas(_sign(shared), _SIGNATURE)), "signed")
    one = lambda c: F.first(c).alias(c)  # noqa: E731  equal for a key
    nodes = signed.groupBy("key").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"), *map(one, ("fast", "size", "bands", "sig")))
    nodes = work.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = nodes.select("node", "low", "fast", "key")

    entries = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))  # the bucket tells the band
    buckets = entries.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = work.save(buckets, "buckets")
    star = salted_join(entries, buckets.select("bucket", "leader"), "bucket", hot_keys(buckets, "bucket", "n"), "node")
    star = work.save(star.select("bucket", "band", "node", "leader"), "star")  # the leaders are in it too

    # every node against the first of its buckets
    pairs = work.save(star.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    heads = work.save(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "heads")
    hubs = hot_keys(heads, "b", "n")
    alike = F.pandas_udf(_agreeing, "double")
    signs = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    signs = salted_join(signs, nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b", hubs, "a")
    pairs = work.save(signs.where(alike("sig_a", "sig_b") >= PROMISING).select("a", "b"), "promising")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts_of(docs, work.save(found.join(ends, "node"), "wanted"), work)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = salted_join(both, texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b", hubs, "a")
    edges = work.save(both.sortWithinPartitions("b").mapInPandas(_verify(shared, similar), "a long, b long"), "verified")

    # what is left over, against the rest of its buckets
    comps = work.save(components(edges, work), "comps")
    linked = edges.select(F.col("a").alias("node"), F.col("b").alias("leader"), F.lit(True).alias("_linked"))
    member = star.join(linked, ["node", "leader"], "left").withColumn("own", F.col("_linked").isNull() & (F.col("node") != F.col("leader"))).drop("_linked", "leader")
    member = work.save(member.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "member")
    opened = member.groupBy("bucket").agg(F.count_if("own").alias("left"), F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n"))
    size = F.least(F.lit(ROWS_TO), F.greatest(F.lit(ROWS_FROM), 4 * F.sqrt("n")))
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    opened = opened.where("left > 0 and c0 <> c1").select("bucket", "n", blocks(F.col("left"), size).alias("ni"), blocks(F.col("n"), size).alias("nj"))
    opened = work.save(opened, "open")
    inside = salted_join(member, opened.drop("n"), "bucket", hot_keys(opened, "bucket", "n"), "node")
    inside = work.save(inside.join(nodes.select("node", "size", "sig", "bands"), "node"), "inside")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = lambda i, j, side: ("bucket", "band", i.alias("i"), j.alias("j"), F.lit(side).alias("side"), "node", "comp", "own", "size", "sig", "bands")
    cells = inside.where("own").select(*cell(mine("ni"), every("nj"), 0)).unionByName(inside.select(*cell(every("ni"), mine("nj"), 1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    rest = work.save(dealt.mapInPandas(_promising, _CELL), "rest")
    texts = texts_of(docs, work.save(found.join(rest.select("node").distinct(), "node"), "wanted"), work)
    sizes = rest.groupBy("bucket", "i", "j").agg(F.sum(F.when(F.col("side") == 0, F.col("size")).otherwise(0)).alias("bytes"))
    rest = rest.join(sizes.select("bucket", "i", "j", F.greatest(F.lit(1), blocks(F.col("bytes"), F.lit(LEFT_BYTES))).alias("nk")), ["bucket", "i", "j"])
    rest = rest.withColumn("k", F.explode(F.when(F.col("side") == 0, F.array(mine("nk"))).otherwise(F.sequence(F.lit(0), F.col("nk") - 1)))).drop("nk", "size")
    dealt = rest.join(texts, "node").repartition(parts, "bucket", "i", "j", "k").sortWithinPartitions("bucket", "i", "j", "k", "side")
    more = work.save(dealt.mapInPandas(_link(shared, similar), "a long, b long"), "more")

    labelled = nodes.select("key", "node", "low", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if not more.isEmpty():  # links between components
        joined = components(more, work).select(F.col("node").alias("comp"), F.col("comp").alias("_comp"))
        labelled = labelled.join(joined, "comp", "left").withColumn("comp", F.coalesce("_comp", "comp")).drop("_comp")
    labelled = work.save(labelled, "labelled")
    last = F.struct(F.col("low").isNull().alias("none"), "low", "key")
    classes = labelled.groupBy("comp").agg(F.sum("n").alias("class_size"), F.min(last).alias("first"), F.count(F.lit(1)).alias("nodes"))
    classes = work.save(classes.select("comp", "class_size", "nodes", F.col("first.low").alias("keep_id"), F.col("first.key").alias("keep_key")), "classes")
    labelled = salted_join(labelled, classes.drop("nodes"), "comp", hot_keys(classes, "comp", "nodes"), "node")
    labelled = work.save(labelled.select("key", "n", "class_size", "keep_id", "keep_key"), "classed")
    out = salted_join(signed.select("doc_id", "fast", "key"), labelled.drop("n"), "key", hot_keys(labelled, "key", "n"), "doc_id")
    return out.select("doc_id", "fast", "key", F.col("keep_id").alias("class_id"), "class_size", "keep_id", "keep_key")


def drop_near_duplicates(docs: DataFrame, work: Workspace, similar: float = SIMILAR) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, and of rows that repeat it one. The rows that go are told to all tasks if they are few enough (see told), so the others stay where they are."""
    groups = work.save(near_groups(docs, work, similar), "groups")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    wordless = groups.where(stays & (F.length("key") == 0)).agg(F.min("fast")).first()[0]  # of their one class
    stays &= (F.length("key") > 0) | (F.col("fast") == wordless)
    rows = groups.groupBy("doc_id", "fast", "key").agg(F.bool_or(stays).alias("_stays"), F.count(F.lit(1)).alias("_n"))
    gone = work.save(rows.select(F.col("doc_id").alias("_id"), "fast", "key", "_stays", "_n").where("not _stays or _n > 1"), "gone")
    keyed = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_fast"))
    same = (F.col("_fast") == F.col("fast")) & F.col("doc_id").eqNullSafe(F.col("_id")) & ((F.length("key") == 0) | (F.unhex(F.md5("text")) == F.col("key")))
    out = keyed.join(told(gone), same, "left_anti").select("row")
    again = work.save(gone.where("_stays"), "again")
    work.clear("gone", "again")
    if not again.isEmpty():  # rows that repeat: the largest of them by all columns
        some = keyed.join(told(again), same).groupBy("_id", "fast", "key").agg(F.max_by("row", orderable(docs, "row")).alias("row"))
        out = out.unionByName(some.select("row"))
    return unpacked(out, docs.columns)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "near")
    out = near_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"), work)
    return work.result(out.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")))
